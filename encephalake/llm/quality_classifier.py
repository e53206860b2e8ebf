"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

Grades are ordered (0: junk, 1: readable but toxic, 2: clean). One weight vector w over hashed text
features is shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - w.x), with thresholds kept
in order. Expected grade and the tail probability P(grade >= ``TARGET``) follow; a text is selected if
the tail probability reaches ``CUTOFF``.

Features: the distinct lower-cased words of the whole text, stripped of edge punctuation (value 1), and
the shares of words of a few shapes (value 4 x share), all hashed to 2**``HASH_BITS`` weights. Fitting
uses the ``SAMPLE`` labelled ids with the smallest hash, one row each (of several the one whose text has
the smallest hash), in one task; the table is read and joined in as many tasks as it has parts; features
found in fewer than ``MIN_DOCS`` of them, or less than the share ``MIN_SHARE``, keep weight zero. Scoring reads all rows and whole texts.

Label rows with a null id, quality or toxic are not learned from; of several labels of an id one row is
used, the lowest grade. Without any usable label every text of at least one word is selected, with
expected grade null. A null text or one without words has no features: it is never selected. Null ids
are scored like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_list, slices

GRADES = 3
TARGET = 2
CUTOFF = 0.5
SAMPLE = 9000
MIN_DOCS = 5
MIN_SHARE = 0.005
HASH_BITS = 20
STEPS = 200
RIDGE = 1e-3
#: Characters stripped from the edges of a word, and those that count as symbols.
EDGES = b".,;:!?\"'()[]"
SYMBOLS = b"#*$%&|<>"
SHAPES = (b"symbol", b"upper", b"repeat", b"digit", b"shout")
_SHAPE_VALUE = 4.0
_WORDS_KEPT = 200_000


def slot(token: bytes) -> int:
    return xxhash.xxh32_intdigest(token) & (1 << HASH_BITS) - 1


_SHAPE_SLOTS = [slot(b"\x00shape " + s) for s in SHAPES]


def _word_slot(word: bytes) -> int:
    return slot(word.lower().strip(EDGES))


class Features:
    """Hashed features of texts; remembers the slots of words seen before, within a bound."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values; empty for a text without words."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        known, distinct = self.slots, set(words)
        if len(known) > _WORDS_KEPT:
            known.clear()
        places = set()
        for word in distinct:
            at = known.get(word)
            if at is None:
                at = known[word] = _word_slot(word)
            places.add(at)
        n = len(words)
        odd = [w for w in distinct if w.strip(SYMBOLS) != w]
        loud = [w for w in distinct if w.isupper() and len(w) > 1]
        digit = [w for w in distinct if any(48 <= c < 58 for c in w)]
        shout = [w for w in distinct if w.endswith(b"!!")]
        repeats = sum(map(bytes.__eq__, words, words[1:]))
        shares = np.array([_count(words, odd), _count(words, loud), repeats, _count(words, digit), _count(words, shout)])
        used = np.flatnonzero(shares)
        slots = np.concatenate([np.fromiter(places, np.int64, len(places)), np.array(_SHAPE_SLOTS, np.int64)[used]])
        return slots, np.concatenate([np.ones(len(places)), _SHAPE_VALUE * shares[used] / n])


def _count(words: list[bytes], kinds: list[bytes]) -> int:
    if not kinds:
        return 0
    chosen = set(kinds)
    return sum(w in chosen for w in words)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Model:
    """Penalised maximum likelihood by Adam with full batches; the thresholds are a start and positive gaps."""
    lengths = np.array([len(s) for s, _ in examples], np.int64)
    slots = np.concatenate([s for s, _ in examples]) if len(examples) else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in examples]) if len(examples) else np.zeros(0)
    docs = np.repeat(np.arange(len(examples)), lengths)
    seen = np.bincount(slots, minlength=1 << HASH_BITS)  # slots are small numbers, so nothing need be sorted
    columns = np.flatnonzero(seen)
    place = np.zeros(1 << HASH_BITS, np.int64)
    place[columns] = np.arange(len(columns))
    keep = (seen >= max(MIN_DOCS, MIN_SHARE * len(examples)))[slots]
    column, values, docs = place[slots[keep]], values[keep], docs[keep]
    del slots, keep
    # parameters: weights, first threshold, logs of the gaps between thresholds
    size = len(columns)
    theta = np.zeros(size + GRADES - 1)
    theta[size] = -1.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        cuts = theta[size] + np.concatenate([[0.0], np.cumsum(np.exp(theta[size + 1 :]))])
        score = np.bincount(docs, values * theta[column], len(examples))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
        d_score = (d_upper - d_lower) / chance  # of the negative log likelihood
        gradient = np.zeros_like(theta)
        gradient[:size] = np.bincount(column, values * d_score[docs], size) / len(examples) + RIDGE * theta[:size]
        d_cut = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            d_cut[k] = (-(d_upper / chance)[grades == k].sum() + (d_lower / chance)[grades == k + 1].sum()) / len(examples)
        gradient[size] = d_cut.sum()
        for k in range(1, GRADES - 1):
            gradient[size + k] = d_cut[k:].sum() * np.exp(theta[size + k])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[columns] = theta[:size]
    cuts = theta[size] + np.concatenate([[0.0], np.cumsum(np.exp(theta[size + 1 :]))])
    return Model(weights, cuts)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded training sample (id, grade, text) in; used slots with their weights and the thresholds out."""
    features, rows = Features(), []
    for batch in slices(batches, 2):
        for key, grade, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2))):
            rows.append((key, grade, *features.of(text)))
    if rows:
        rows.sort(key=lambda r: r[0])
        model = fit([(s, v) for _, _, s, v in rows], np.array([r[1] for r in rows]))
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([used, -1 - np.arange(GRADES - 1)])), pa.array(np.concatenate([model.weights[used], model.thresholds]))], ["slot", "weight"]
        )


def graded(labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(id, grade): junk 0, toxic 1, clean 2; one row per id."""
    grade = F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2)
    usable = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull() & F.col(toxic).isNotNull())
    return usable.groupBy(F.col(key).cast("long").alias("_key")).agg(F.min(grade).alias("grade"))


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, grade, _text) in one partition: one row for each of ``SAMPLE`` ids at most, shuffled after the scan and the join."""
    chosen = F.broadcast(graded(labels, key).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE))  # SAMPLE rows at most
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    first = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("first")
    single = rows.join(chosen, "_key").groupBy("_key", F.col("grade").cast("int").alias("grade")).agg(first)
    return single.select("_key", "grade", "first._text").repartition(1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on the bounded sample of labelled rows; None if there is none."""
    found = training_sample(docs, labels, key, text).mapInArrow(_fit_task, "slot long, weight double").toPandas()
    if not len(found):
        return None
    cuts = found[found.slot < 0].sort_values("slot", ascending=False).weight.to_numpy()
    weights = np.zeros(1 << HASH_BITS, np.float32)
    body = found[found.slot >= 0]
    weights[body.slot.to_numpy()] = body.weight.to_numpy()
    return Model(weights, cuts)


def rate(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with expected_grade, p_tail and selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    n, inner = len(keep), [*keep, text] if text not in keep else keep
    at = inner.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value, Features()
        for batch in slices(batches, at):
            found = [features.of(t) for t in byte_list(batch.column(at))]
            words = np.array([len(s) > 0 for s, _ in found])
            if m is None:
                empty = pa.nulls(len(found), pa.float64())
                told = [empty, empty, pa.array(words)]
            else:
                total = np.array([float(m.weights[s] @ v) for s, v in found])
                tails = m.tails(total)
                told = [pa.array(tails.sum(axis=1)), pa.array(tails[:, TARGET - 1]), pa.array(words & (tails[:, TARGET - 1] >= CUTOFF))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *told], [*batch.schema.names[:n], "expected_grade", "p_tail", "selected"])

    schema = docs.select(*keep).schema.add("expected_grade", "double").add("p_tail", "double").add("selected", "boolean")
    return docs.select(*inner).mapInArrow(score, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_tail, selected) per row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rate(rows, train(rows, labels.select(F.col(key).alias("doc_id"), "quality", "toxic")), "text", ["doc_id"])
