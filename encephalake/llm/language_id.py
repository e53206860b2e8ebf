"""Language by prediction by partial matching: the language whose byte context trees code a text shortest.

Per language, counts of every byte after every context of up to ``ORDER`` bytes form a context tree.
A byte costs -log2 of its probability in the longest context that the trees hold; a context that has
not seen it pays an escape (PPM method C, with exclusion) and the shorter context goes on, down to a
uniform guess. The statistics are frozen after training, so the cost is a function of context and
byte: it is tabled once and looked up for whole texts of any length.

Training reads ``PER_LANGUAGE`` documents of each language (those with the smallest hash of their id, and of
an id's rows the one with the smallest hash of its text, so the choice does not depend on the layout of the
table and no repeated id counts more) and their whole texts; contexts seen fewer
than ``MIN_COUNT`` times are left to the shorter ones. Rows without language or text are not learned.

Null texts and texts without a letter are ``und`` with score 0, as is everything if there was nothing
to learn from. Score is the language's share of the probability of the text among all languages. A
null id belongs to no fold: it is neither held out nor learned. Repeated rows are treated alike, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, byte_list, sample_per_group, slices

ORDER = 3
PER_LANGUAGE = 300
MIN_COUNT = 3
#: Sampled texts that a task counts, so partial counts follow the sample and not the number of partitions.
TEXTS_A_TASK = 600
UNKNOWN = "und"
_BLOCK = 1 << 20


@dataclass
class Model:
    """Costs in bits: ``costs[state[h3, h2, h1] * size + symbol]`` has one number per language."""

    languages: list[str]
    symbol: np.ndarray
    size: int
    state: np.ndarray
    costs: np.ndarray


def _histories(symbols: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """The 1st, 2nd, ... symbol before each place; 0 before the start of a text."""
    out = []
    for k in range(1, order + 1):
        back = np.zeros_like(symbols)
        back[k:] = symbols[:-k]
        for j in range(k):
            places = starts + j
            back[places[places < len(back)]] = 0
        out.append(back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n): a gram is a context of ``order`` bytes and the byte after it, as a number."""
    for batch in slices(batches, 1):
        languages = np.array(batch.column(0).to_pylist())
        for language in np.unique(languages):
            texts = byte_list(batch.column(1).filter(pa.array(languages == language)))
            for order in range(ORDER + 1):
                grams = []
                for text in texts:
                    data = np.frombuffer(text, np.uint8).astype(np.int64)
                    if len(data) > order:
                        gram = np.zeros(len(data) - order, np.int64)
                        for j in range(order + 1):
                            gram = gram << 8 | data[j : len(data) - order + j]
                        grams.append(gram)
                if grams:
                    values, counts = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(values)), pa.array(np.full(len(values), order, np.int32)), pa.array(values), pa.array(counts)],
                        ["lang", "context", "gram", "n"],
                    )


def gram_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Summed (lang, context, gram, n) of the training sample of ``docs``."""
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    rows = rows.where("_key is not null and _lang is not null and _text is not null")
    rows = rows.withColumn("_mark", F.xxhash64("_text"))
    one = rows.groupBy("_key", "_lang").agg(F.min("_mark").alias("_mark"))
    chosen = sample_per_group(one, "_lang", "_key", PER_LANGUAGE)
    same = ["_key", "_lang", "_mark"]
    size = chosen.limit(BROADCAST_ROWS + 1).count()
    sample = rows.join(F.broadcast(chosen) if size <= BROADCAST_ROWS else chosen, same, "left_semi").groupBy(*same).agg(F.first("_text").alias("_text"))
    counts = sample.coalesce(-(-size // TEXTS_A_TASK) or 1).select("_lang", "_text").mapInArrow(_count, "lang string, context int, gram long, n long")
    return counts.groupBy("lang", "context", "gram").agg(F.sum("n").alias("n"))


def build(counts: DataFrame) -> Model:
    """The tables of ``gram_counts``, which the bounded sample keeps small."""
    found = counts.toPandas().sort_values(["lang", "context", "gram"])
    languages = sorted(found.lang.unique())
    number = {name: i for i, name in enumerate(languages)}
    if not languages:
        return Model([], np.zeros(256, np.int64), 1, np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    seen = np.unique(found.gram[found.context == 0].to_numpy(np.int64))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    # contexts, shortest first: rows of `known[k]` are the symbols of a context of k bytes, oldest first
    state = np.zeros(1, np.int64)
    weights = [np.zeros((1, len(languages), size))]
    parents = [np.zeros(1, np.int64)]
    first = [0, 1]
    for order in range(ORDER + 1):
        part = found[found.context == order]
        gram = part.gram.to_numpy(np.int64)
        symbols = [symbol[gram >> 8 * j & 255] for j in range(order, -1, -1)]
        context = np.zeros(len(part), np.int64)
        for s in symbols[:-1]:
            context = context * size + s
        if order:
            total = np.bincount(np.unique(context, return_inverse=True)[1], part.n) if len(part) else np.zeros(0)
            values = np.unique(context)[total >= MIN_COUNT]
            state = np.tile(state, size)  # the shorter context's state, for any older symbol
            parents.append(state[values])
            state[values] = first[-1] + np.arange(len(values))
            first.append(first[-1] + len(values))
            weights.append(np.zeros((len(values), len(languages), size)))
        row = state[context] - first[order]
        held = row >= 0
        np.add.at(weights[order], (row[held], part.lang.map(number).to_numpy()[held], symbols[-1][held]), part.n.to_numpy()[held])
    costs = np.concatenate([_costs(weights, parents, first, k) for k in range(ORDER + 1)])
    return Model(languages, symbol, size, state.astype(np.int32), costs.transpose(0, 2, 1).reshape(-1, len(languages)).astype(np.float32))


def _costs(weights: list[np.ndarray], parents: list[np.ndarray], first: list[int], order: int) -> np.ndarray:
    """Bits of every symbol in every context of ``order`` bytes: counts, escapes and exclusion down the suffixes."""
    shape = weights[order].shape
    free = np.ones(shape, bool)
    chance, left = np.zeros(shape), np.ones(shape[:2])
    everything = np.concatenate(weights)
    base = np.concatenate(parents)
    rows = np.arange(shape[0]) + first[order]
    for level in range(order, -1, -1):
        here = np.where((rows >= first[level])[:, None, None], everything[rows] * free, 0)
        total, kinds = here.sum(axis=2), (here > 0).sum(axis=2)
        scale = np.divide(left, total + kinds, out=np.zeros_like(left), where=total > 0)
        chance += here * scale[:, :, None]
        left = np.where(total > 0, scale * kinds, left)
        free &= here == 0
        rows = np.where(rows >= first[level], base[rows], rows)
    rest = free.sum(axis=2)
    chance += free * np.divide(left, rest, out=np.zeros_like(left), where=rest > 0)[:, :, None]
    return -np.log2(np.maximum(chance, 1e-300))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text under each language."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    bits = np.zeros((len(texts), len(model.languages)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    for low in range(0, len(data), _BLOCK):
        high = min(len(data), low + _BLOCK)
        base = max(0, low - ORDER)
        symbols = model.symbol[data[base:high]]
        inside = np.unique((ends - lengths)[lengths > 0])
        starts = inside[(inside >= base) & (inside < high)] - base
        context = np.zeros(high - base, np.int64)
        for back in reversed(_histories(symbols, starts, ORDER)):
            context = context * model.size + back
        spent = model.costs[model.state[context].astype(np.int64) * model.size + symbols][low - base :]
        opens = np.flatnonzero(lengths > 0)
        opens = opens[(ends[opens] > low) & ((ends - lengths)[opens] < high)]
        bits[opens] += np.add.reduceat(spent, np.maximum((ends - lengths)[opens] - low, 0), axis=0, dtype=np.float64)
    return bits


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return build(gram_counts(docs, key, text, lang))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    types = docs.select(*keep).schema
    n, inner = len(keep), [*keep, text] if text not in keep else keep
    at = inner.index(text)
    rows = docs.select(*inner, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in slices(batches, at):
            told = pc.fill_null(batch.column(len(inner)), False).to_numpy(zero_copy_only=False) & bool(m.languages)
            pred, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            if m.languages:
                bits = code_lengths(m, byte_list(batch.column(at)))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                pred, score = np.where(told, best, pred), np.where(told, share, 0.0)
            columns = [*batch.columns[:n], pa.array(names[pred], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "lang_pred", "score"])

    return rows.mapInArrow(label, types.add("lang_pred", "string").add("score", "double"))


def held_out(key: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, learned from the rows that are not held out."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(key).alias("held_out"))
    model = train(rows.where(~F.col("held_out")), "doc_id", "text", "lang")
    return identify(rows, model, "text", ["doc_id", "held_out"])
