"""Quality rules: counts per text, and how far its histograms are from those of clean language.

A text is described by two histograms: the classes of its characters, and how often it uses each of its
language's ``COMMON`` commonest words (with one cell for all other words). The references are the same
histograms summed over all documents of a language; every text adds the shares of its cells, so that long
texts do not dominate. The verdict compares both by Jensen-Shannon distance (the root of the divergence to base 2) with the reference
of the text's own language, or the nearest one if its language has no reference. The character reference of a
language with few documents leans on that of all (``PRIOR_TEXTS`` texts of it). Guards: characters are
compared from ``MIN_CHARS`` characters, words from ``MIN_WORDS`` words on.

Base counts per text: words, code points in words, symbols, repeated lines, words in repeated 3-word
windows; a text fails the base rule below ``MIN_WORDS`` words or if more than half its words are in
repeated windows. Null text has no words and fails. A null language is compared with the nearest
reference. Repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_list, slices, written

COMMON = 100
MIN_WORDS = 50
MIN_CHARS = 200
PRIOR_TEXTS = 50
MAX_CHARACTER_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.51
#: The symbols that are counted, and the edges stripped from a word before it is looked up.
SYMBOLS = b"#*$%&|<>"
EDGES = b".,;:!?\"'()[]"
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "wide")
_LINE = re.compile(rb"[^\x20\x09-\x0D]")


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, members in (
        ("lower", b"abcdefghijklmnopqrstuvwxyz"),
        ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("digit", b"0123456789"),
        ("space", b" \t\x0b\x0c\r"),
        ("line", b"\n"),
        ("stop", b".,;:!?'\"-()"),
        ("symbol", SYMBOLS),
    ):
        table[list(members)] = CLASSES.index(name)
    table[0xC0:] = CLASSES.index("wide")  # the first byte of a character beyond ASCII
    table[0x80:0xC0] = len(CLASSES)  # its other bytes count for nothing
    return table


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def character_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    at = np.fromiter((w in often for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(windows) + shift] |= at
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if _LINE.search(line)]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, between 0 and 1, along the last axis."""
    middle = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(middle > 0, middle, 1)), 0).sum(axis=-1)

    return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0))


@dataclass
class References:
    """Per language: the character histogram, its common words and their histogram (last cell: all others)."""

    characters: dict[str, np.ndarray]
    words: dict[str, dict[bytes, int]]
    shares: dict[str, np.ndarray]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed shares (lang, kind, cell, share, n) of a task's texts: kind 0 characters, kind 1 words."""
    total: Counter = Counter()
    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
            words = text.split()
            counts = character_counts(text)
            if len(words) < MIN_WORDS or counts.sum() < MIN_CHARS:
                continue
            for name, count in zip(CLASSES, (counts / counts.sum()).tolist()):
                total[lang, 0, name.encode()] += count
            share = 1 / len(words)
            for word, count in Counter(words).items():
                total[lang, 1, word.lower().strip(EDGES)] += count * share
            total[lang, 2, b""] += 1
        if len(total) > 200_000:
            yield _sums(total)
            total = Counter()
    if total:
        yield _sums(total)


def _sums(total: Counter) -> pa.RecordBatch:
    lang, kind, cell = zip(*total)
    columns = [pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(cell, pa.binary()), pa.array(list(total.values()), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "kind", "cell", "share"])


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """The histograms of all documents of each language; the driver sees COMMON words of each."""
    sums = docs.where(F.col(lang).isNotNull()).select(F.col(lang), F.col(text)).mapInArrow(_histograms, "lang string, kind int, cell binary, share double")
    totals = written(sums.groupBy("lang", "kind", "cell").agg(F.sum("share").alias("share")), "histograms")
    commonest = Window.partitionBy("lang").orderBy(F.desc("share"), "cell")
    words = totals.where("kind = 1 and cell != cast('' as binary)").withColumn("place", F.row_number().over(commonest)).where(F.col("place") <= COMMON)
    rest = totals.where("kind != 1").withColumn("place", F.lit(0))
    found = rest.unionByName(words).toPandas().sort_values(["lang", "kind", "place"])
    found["cell"] = found.cell.map(bytes)
    characters, names, shares = {}, {}, {}
    pooled = found[found.kind == 0].groupby("cell").share.sum()
    pooled = np.array([pooled.get(c.encode(), 0.0) for c in CLASSES]) / max(1.0, found.share[found.kind == 2].sum())
    for language, part in found.groupby("lang"):
        texts = part.share[part.kind == 2].sum()
        by_class = dict(zip(part.cell[part.kind == 0], part.share[part.kind == 0]))
        own = np.array([by_class.get(c.encode(), 0.0) for c in CLASSES])
        characters[language] = (own + PRIOR_TEXTS * pooled) / (texts + PRIOR_TEXTS)
        chosen = part[part.kind == 1]
        names[language] = {w: i for i, w in enumerate(chosen.cell)}
        shares[language] = np.append(chosen.share.to_numpy() / texts, max(0.0, 1 - chosen.share.sum() / texts))
    return References(characters, names, shares)


def assess(text: bytes, lang: str | None, known: References) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, character and word distance, kept)."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    counts = character_counts(text)
    n, repeats = len(words), repeated_words(words)
    white = int(counts[CLASSES.index("space")] + counts[CLASSES.index("line")])
    base = (n, int(counts.sum()) - white, int(_SYMBOL[data].sum()), repeated_lines(text), repeats)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    languages = [lang] if lang in known.characters else list(known.characters)
    far_characters = far_words = None
    if languages and counts.sum() >= MIN_CHARS:
        far_characters = min(float(distance(counts / counts.sum(), known.characters[x])) for x in languages)
    if languages and n >= MIN_WORDS:
        found = Counter(words)
        far_words = min(_word_distance(found, n, x, known) for x in languages)
    near = (far_characters is None or far_characters <= MAX_CHARACTER_DISTANCE) and (far_words is None or far_words <= MAX_WORD_DISTANCE)
    return (*base, failed, far_characters, far_words, not failed and near)


def _word_distance(found: Counter, n: int, lang: str, known: References) -> float:
    places, histogram = known.words[lang], np.zeros(len(known.shares[lang]))
    for word, count in found.items():
        histogram[places.get(word.lower().strip(EDGES), -1)] += count
    return float(distance(histogram / n, known.shares[lang]))


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, character_distance double, word_distance double, kept boolean"


def judge(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, counts, base_failed, distances, kept) per row, against references from all rows."""
    shared = spark.sparkContext.broadcast(references(docs, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = [assess(t, x, shared.value) for x, t in zip(batch.column(1).to_pylist(), byte_list(batch.column(2)))]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(x.split()[0] for x in _OUT.split(", "))])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + _OUT)
