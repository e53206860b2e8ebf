"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

A document's ids (with an end id) are one piece, or several of ``CAPACITY`` if it is longer; then the
first piece may be shorter. Pieces of full size are sequences of their own. All others are packed by
length only: a piece goes to the open sequence (or a new one) for which the sum, over the residual gaps
below the capacity, of the squared counts of open sequences becomes smallest; ties go to the smaller gap.

Packing runs in rounds. Each round deals the pieces evenly over shards of at most ``SHARD`` pieces; a
shard takes its pieces longest first. Sequences that came out exactly full are final, the pieces of all
others go to the next round. When one shard holds what is left, or a round fills too little, the pieces
in sequences that are still open are put once more by best fit, longest first, and are final. So only
the last round wastes room, however many shards the data need. Nothing but a count reaches the driver.

Null text is an empty document, whose only id is the end id. Rows repeated with id and text are packed
as often as they occur. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, slices, written
from .tokens import TextEncoder, encoder

CAPACITY = 1024
SHARD = 1 << 16
END_ID = 2
PIECES = 600_000  # known words that a Python worker keeps
AT_ONCE = 4 << 20  # bytes of text that it encodes at once
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _SCHEMA + ", sequence_id long, offset long, final boolean"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(a, min(b, length) - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID, kind: type = TextEncoder, known: int = PIECES, at_once: int = AT_ONCE) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind, known).encode
        for batch in slices(batches, 1, at_once):
            ids, counts = encode([t.decode("utf-8", "replace") for t in byte_list(batch.column(1))], end)
            data, ends, rows = ids.astype("<u4"), np.cumsum(counts), []
            for key_value, stop, count in zip(batch.column(0).to_pylist(), ends.tolist(), counts.tolist()):
                for number, (start, length) in enumerate(cut(count)):
                    at = stop - count + start
                    rows.append((key_value, number, start, length, zlib.crc32(data[at : at + length].tobytes())))
            columns = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(split, _SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each length, taken in the given order."""
    counts = np.zeros(capacity + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, made = np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # change of the sum of squares when a sequence moves from gap g to gap g - size; a new one comes from no gap
        gaps = np.flatnonzero(counts[size:capacity]) + size
        gap = capacity
        if len(gaps):
            change = np.where(gaps == size, 1 - 2 * counts[gaps], 2 * (counts[gaps - size] - counts[gaps] + 1))
            best = change.argmin()
            if change[best] <= 2 * counts[capacity - size] + 1:
                gap = int(gaps[best])
        if gap == capacity:
            place[i], made = made, made + 1
        else:
            counts[gap] -= 1
            place[i] = open_by_gap[gap].pop()
        if gap > size:
            counts[gap - size] += 1
            open_by_gap[gap - size].append(int(place[i]))
    return place


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each length, taken in the given order: the smallest gap that holds it."""
    counts = np.zeros(capacity + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, made = np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        found = np.flatnonzero(counts[size:capacity])
        gap = int(found[0]) + size if len(found) else capacity
        if gap == capacity:
            place[i], made = made, made + 1
        else:
            counts[gap] -= 1
            place[i] = open_by_gap[gap].pop()
        if gap > size:
            counts[gap - size] += 1
            open_by_gap[gap - size].append(int(place[i]))
    return place


def place_shard(lengths: np.ndarray, last: bool, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, final) of each length of a shard, whose lengths come longest first."""
    place = sum_of_squares(lengths, capacity)
    full = np.bincount(place, lengths)[place] == capacity if len(place) else np.zeros(0, bool)
    if last and not full.all():
        again = best_fit(lengths[~full], capacity)
        loose = np.unique(place[~full])
        if again.max() + 1 <= len(loose):
            place[~full] = loose[again]
        full[:] = True
    return place, full


def _pack(last: bool, round_number: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        place, final = place_shard(lengths, last)
        order = np.argsort(place, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        opens = np.flatnonzero(np.diff(place[order], prepend=-1))
        offset = np.zeros(len(lengths), np.int64)
        offset[order] = before - np.repeat(before[opens], np.diff(opens, append=len(order)))
        sequence = (1 + round_number << 56) + (TaskContext.get().partitionId() << 28) + place
        out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("final", pa.array(final))
        yield from out.to_batches(max_chunksize=10_000)

    return pack


def pack(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """``rows`` of :func:`pieces` with sequence_id and offset."""
    rows = written(rows, "pieces")
    full = rows.where(F.col("length") == CAPACITY).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left, done, number = rows.where(F.col("length") < CAPACITY), full, 0
    count = left.count()
    while count:
        shards = math.ceil(count / shard)
        placed = written(left.repartition(shards).mapInArrow(_pack(shards == 1, number), _PLACED), "packed")
        open_count = placed.where("not final").count()
        if open_count > 0.8 * count:  # shards of these lengths hardly fill: finish them as they are
            placed, open_count = written(left.repartition(shards).mapInArrow(_pack(True, number), _PLACED), "packed"), 0
        done = done.unionByName(placed.where("final").drop("final"))
        left, count, number = placed.where("not final").drop("sequence_id", "offset", "final"), open_count, number + 1
    return done


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", kind: type = TextEncoder, known: int = PIECES, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all documents."""
    return pack(pieces(docs, tokenizer, key, text, kind=kind, known=known, at_once=at_once))
