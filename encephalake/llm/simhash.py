"""SimHash near-duplicates: keyed BK-tree shards find every pair within the radius, then components.

Fingerprints are 64 bits over 3-word shingles. Two fingerprints within two bits agree in two of
four equal blocks, so each is sent to six shards (a pair of blocks with its value). Shards beyond
``SHARD`` members split again on the bits that are still free, at most twice: then 8 bits are free
and 256 members are the most there can be. A shard is one BK-tree whose children are keyed by their
Hamming distance to the parent; its members search it, following only edges within the radius, and
leave one link each to a tree member (never all pairs). A tree over everything would have to be
visited whole: at random 64-bit distances a radius of two prunes half of each level at best.

Null and empty texts have fingerprint zero and link like any other. Texts of fewer than three words
have one shingle. Repeated rows share a fingerprint. A null id counts only if its component has no
other. Only id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_list, join_by_count, slices, written
from .components import components

RADIUS = 2
WORDS = 3
SEED = 42
SHARD = 1024
_BITS = 64


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of one text, unsigned."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(map((1).__add__, map(len, parts))))
    starts = [0, *ends]
    grams = [joined[a : b - 1] for a, b in zip(starts, ends[words - 1 :])] or [joined]
    total, count = np.zeros(_BITS, np.int64), len(grams)
    for i in range(0, count, 1 << 16):
        part = grams[i : i + (1 << 16)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint as a signed long, and a hash of the text that tells rows of one id apart."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints = np.array([fingerprint(t, words) for t in byte_list(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text), mark(text).alias("mark"))
    return rows.mapInArrow(every, "doc_id long, mark long, fp long")


def mark(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Tree:
    """A BK-tree of integers under Hamming distance: node -> {distance to it: child}."""

    def __init__(self, members: Iterable[int]):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in members:
            at = 0 if self.values else -1
            while at >= 0:
                distance = (self.values[at] ^ value).bit_count()
                following = self.children[at].get(distance)
                if following is None:
                    self.children[at][distance] = len(self.values)
                    at = -1
                else:
                    at = following
            self.values.append(value)
            self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the members at most ``radius`` away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            todo += [c for d, c in self.children[at].items() if abs(d - distance) <= radius]
        return found


def _shard_links(members: list[int]) -> Iterator[tuple[int, int]]:
    """Links that join the members within the radius of each other, as many as they need at most."""
    tree = Tree(members)
    root = list(range(len(members)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for place, value in enumerate(tree.values):
        for other in tree.within(value, RADIUS):
            a, b = top(place), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield value, tree.values[other]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [p for row in batch.column(0) for p in _shard_links([v & 0xFFFFFFFFFFFFFFFF for v in row.as_py()])]
        flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["a", "b"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int) -> list[int]:
    """Masks that add two of the four equal parts of the bits free in ``mask``."""
    free = [i for i in range(_BITS) if not mask >> i & 1]
    size = len(free) // (RADIUS + 2)
    parts = [sum(1 << i for i in free[k * size : (k + 1) * size]) for k in range(RADIUS + 2)]
    return [mask | a | b for a, b in combinations(parts, 2)]


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the distinct fingerprints within the radius of each other connect."""
    masks = {0: _finer(0)}
    level = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    found = None
    for last in (False, False, True):
        pairs = [x for m, finer in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in finer]))]
        level = level.select("fp", F.explode(F.create_map(*pairs)[F.col("mask")]).alias("mask"))
        level = level.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        sizes = written(level.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        small = sizes if last else sizes.where(F.col("n") <= SHARD)
        shards = level.join(small.select("mask", "value"), ["mask", "value"]).groupBy("mask", "value").agg(F.collect_list("fp").alias("members"))
        links = shards.select("members").mapInArrow(_links, "a long, b long")
        found = links if found is None else found.unionByName(links)
        level = level.join(sizes.where(F.col("n") > SHARD).select("mask", "value"), ["mask", "value"], "left_semi").select("fp", "mask")
        masks = {k: _finer(k) for finer in masks.values() for k in finer} if not last else {}
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id, mark, component) for every row; ``component`` is unique even if ids are not."""
    rows = written(fingerprints(docs, key, text, words), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "prints")
    roots = written(components(near_links(prints)), "roots").withColumnRenamed("node", "fp")
    members = roots.join(prints, "fp").select("fp", "root", "first_id")
    lowest = written(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    linked = roots.join(lowest, "root").select("fp", "root", "component_id")
    smallest = F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    labelled = prints.join(linked, "fp", "left").select("fp", "n", smallest, F.coalesce("root", "fp").alias("component"))
    labelled = written(labelled, "labelled")
    return join_by_count(rows, labelled, "fp", "n", rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "mark", "component"
    )
