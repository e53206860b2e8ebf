"""Jaccard self-join of word n-grams: size-banded tiles, bitmap signatures, exact intersections.

Every pair of texts whose sets of word shingles have a Jaccard similarity of p/q or more is found. Texts
with equal sets are one node from the start. In any order of all shingles, two sets this similar share one
of the first n - ceil(n p/q) + 1 of each; the order is by hash, but for shingles that batches of all texts
show to be common, which come last. The order decides how many nodes meet, never which pairs are found.

Nodes meet in tiles: a shared shingle and a band of sizes. A band spans one factor q/p, so the partners of
a node are in its own band or the ones beside it; it is a resident of its own and a visitor of the next.
A shingle of up to ``TILE`` nodes is one tile, the tiles of one beyond that are cut into pairs of blocks. Inside a tile, sizes and places of the shared
shingle leave out pairs first. Then parity signatures do: a bit tells whether an odd number of elements falls on it, so each
bit in which two of them differ takes an element of one set only, and half of sizes minus differing bits bounds the overlap from
above. Shared elements cancel out, so that also a text of more elements than bits keeps a sharp bound. Tiles hold signatures folded
to ``tile_bits``; the pairs that they leave are bounded again by the whole signatures, which have two bits for every
element of all but the longest texts. What is left then is compared by the exact intersection of the sorted hash arrays.

Only components are wanted, so a group of many copies need not become all its pairs: ``PHASES`` first
compares a node with the nodes of which most is shared (what others were copied from is such a node), in tiles of its
first shared shingles, which are the rarest, and of those that a hash picks: the rarest may be an edit that only a few
of a large group's copies have, a hash picks what most of them have. From then on only nodes of
different components are compared. The last phase has no limit, so no link between components is lost. Shingles
that only nodes of one component share are dropped before they are dealt, if they need more than one block. A row
of the last phase has the two shared shingles before its own; nodes with one of them in common have met in its tile.

Only A-Z is lower-cased, words are separated by white space. A text with fewer words than a shingle has
the whole sequence as its only one; null, empty and blank texts have none and link with nothing (or with
each other, if ``link_empty``). Texts are read whole, the longest is one row. Sets are of 64-bit hashes.
Repeated rows are linked. A null id counts only if its component has no other. An empty table gives an
empty result. Only id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, product
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_list, join_by_count, only, slices, tidy, written
from .components import components

WORDS = 5
SIMILARITY = 0.8
TILE = 512
#: (shared shingles of a node, partners in a tile, are they its most shared nodes or else the next by size); None is all.
#: With the most shared nodes, as many shingles picked by hash are taken beside the first ones.
PHASES = ((4, 2, True), (None, None, False))
#: Pairs that are compared for each two components before all the others between them are, if there are more than so many.
BETWEEN, AT_ONCE = 4, 20_000
#: A shingle is common from this share of the texts on; so many of them are told apart, the most common first.
COMMON_SHARE = 1 / 2000
COMMON_KEPT = 50_000
#: Bits of a signature: the power of two at or above twice the set's size, within these. Tiles hold as many up to the first
#: number of bits, then those at or above 3/5 of the size (4/9 must differ in sets that share nothing), up to the second.
_LEAST_BITS, _MOST_BITS = 256, 1 << 16
TILE_BITS = (1024, 8192)
_CHUNK = 1 << 14
_TILE_COLUMNS = ["key", "band", "lo", "hi"]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = list(accumulate(map((1).__add__, map(len, parts))))
    grams = [joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :])] or [joined]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def _power(n: int) -> int:
    """The power of two at or above ``n``."""
    return 1 << max(0, n - 1).bit_length()


def signature(hashes: np.ndarray) -> bytes:
    """The parity of the elements on each value of the hashes' low bits; folded by half it is that of half as many bits."""
    size = min(_MOST_BITS, max(_LEAST_BITS, _power(2 * len(hashes))))
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def tile_bits(n: int) -> int:
    least, most = TILE_BITS
    return max(min(least, max(_LEAST_BITS, _power(2 * n))), min(most, _power(n * 3 // 5)))


def folded(sig: bytes, bits: int) -> bytes:
    """The signature of ``bits`` bits at most."""
    data = np.frombuffer(sig, np.uint8)
    return np.bitwise_xor.reduce(data.reshape(-1, min(len(data), bits // 8)), axis=0).tobytes()


def node_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


class Limit:
    """The similarity as a fraction, and what follows from it for sizes."""

    def __init__(self, similarity: float):
        exact = Fraction(similarity).limit_denominator(1000)
        if not 0 < exact <= 1:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.p, self.q = exact.numerator, exact.denominator

    def prefix(self, n: int) -> int:
        return n + self.p * -n // self.q + 1 if n else 0

    def overlap(self, sizes):
        """The least overlap of two sets of so many elements together."""
        return -(-self.p * sizes // (self.p + self.q))

    def band(self, size: str):
        """Partners are at most one band apart; the sliver keeps equal ratios from being rounded past it."""
        return F.floor(F.log(size) / (log(self.q / self.p) * (1 + 1e-9))) if self.p < self.q else F.col(size)


def differing_bits(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which signatures ``a`` and ``b`` differ, the longer folded to the shorter's length."""
    out = np.zeros(len(a), np.int64)
    kinds = lengths[a] * _MOST_BITS + lengths[b]
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        size = [int(lengths[side[at[0]]]) for side in (a, b)]
        least = min(size)
        step = max(1, (_CHUNK << 6) // max(size))  # the index of a byte takes eight
        for i in range(0, len(at), step):
            part = at[i : i + step]
            sides = []
            for side, own in zip((a, b), size):
                rows = flat[starts[side[part]][:, None] + np.arange(own)]
                sides.append(np.bitwise_xor.reduce(rows.reshape(len(part), own // least, least), axis=1))
            out[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return out


def facts(docs: DataFrame, key: str, text: str, words: int, link_empty: bool) -> DataFrame:
    """A row for every text (doc_id, mark, node, n, sig, tag), and rows (common, seen) of shingles that a batch has often."""
    schema = "doc_id long, mark long, node long, n long, sig binary, tag binary, common long, seen long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingles(t, words) for t in byte_list(batch.column(1))]
            nodes = [node_of(s) if len(s) or link_empty else None for s in sets]
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(2, len(sets) * COMMON_SHARE)
            keys, counts, rows = keys[often].view(np.int64), counts[often].astype(np.int64), len(sets)
            more = len(keys)
            whole = [signature(s) for s in sets]
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.binary()), pa.array([folded(x, tile_bits(len(s))) for x, s in zip(whole, sets)], pa.binary())]
            columns = [pa.concat_arrays([c, pa.nulls(more, c.type)]) for c in columns]
            columns += [pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(c)]) for c in (keys, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "n", "sig", "tag", "common", "seen"])

    return docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).mapInArrow(scan, schema)


def _entries(docs: DataFrame, text: str, words: int, limit: Limit, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(key, node, place) of the shingles in each text's prefix; ``keys`` (in order) come last, by their counts."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in slices(batches, 0):
            found, nodes = [], []
            for text in byte_list(batch.column(0)):
                own = shingles(text, words)
                often = np.zeros(len(own), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = np.where(keys[at] == own, counts[at], 0)
                found.append(own[np.lexsort((own, often))[: limit.prefix(len(own))]])
                nodes.append(node_of(own))
            lengths = [len(k) for k in found]
            places = np.concatenate([np.arange(n, dtype=np.int64) for n in lengths])
            columns = [np.concatenate(found).view(np.int64), np.repeat(np.array(nodes, np.int64), lengths), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "place"])

    return docs.select(text).mapInArrow(first, "key long, node long, place long")


def _dealt(rows: DataFrame, limit: Limit, every: bool) -> DataFrame:
    """Rows with the tile they go to; with ``every``, each pair of partners meets in one tile of a shingle at least."""
    if every:
        large = rows.where(F.col("members") > TILE)
        roots = large.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
        mixed = written(roots.where("low <> high").select("key", "members"), "mixed")
        total = mixed.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        large = join_by_count(large.drop("members"), mixed, "key", "members", total).where("members is not null")
        rows = rows.where(F.col("members") <= TILE).unionByName(large)
    blocks = F.ceil(F.col("members") / TILE).cast("long")
    block = F.pmod(F.xxhash64("node", "key"), blocks)
    rows = rows.withColumn("block", block).withColumn("band", limit.band("n").cast("long"))
    if not every:
        return rows.withColumn("lo", F.col("block")).withColumn("hi", F.col("block")).withColumn("visits", F.lit(False))
    own, following, all_sizes = (F.struct(b.cast("long").alias("band"), F.lit(v).alias("visits")) for b, v in ((F.col("band"), False), (F.col("band") + 1, True), (F.lit(-1), False)))
    # the nodes of one block need no bands: in order of size, a node meets no one beyond its partners' sizes
    place = F.explode(F.when(F.col("members") <= TILE, F.array(all_sizes)).otherwise(F.array(own, following)))
    rows = rows.withColumn("at", place).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumns({"band": F.col("at.band"), "visits": F.col("at.visits"), "lo": F.least("block", "other"), "hi": F.greatest("block", "other")})


def _candidates(tiles: DataFrame, reach: int | None, limit: Limit, centres: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of a tile's nodes in different components whose overlap may be large enough.

    Partners are the next ``reach`` by size (all if None) or, with ``centres``, the ``reach`` most shared nodes of the tile.
    If all, a pair that has met in the tile of one of the two shared shingles before is left out.
    """
    p, q = limit.p, limit.q
    every_tile = reach is None and not centres

    def of(rows: pa.Table) -> np.ndarray:
        rows = rows.combine_chunks()
        get = lambda name: rows.column(name).to_numpy()
        tile = np.stack([get(c) for c in _TILE_COLUMNS])
        node, n, place, root, block, visits = (get(c) for c in ("node", "n", "place", "root", "block", "visits"))
        apart = get("lo") != get("hi")
        before = [get("before"), get("earlier")] if every_tile else []
        (sig,) = rows.column("sig").chunks or [pa.array([], pa.binary())]
        ends = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset : sig.offset + len(sig) + 1].astype(np.int64)
        flat = np.frombuffer(sig.buffers()[2], np.uint8)
        last = np.append(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1, len(n))
        stop = last[np.searchsorted(last, np.arange(len(n)), "right")]
        found = []

        def meet(a: np.ndarray, b: np.ndarray) -> None:
            least = limit.overlap(n[a] + n[b])
            fits = (root[a] != root[b]) & ~(visits[a] & visits[b]) & ~(apart[a] & (block[a] == block[b])) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= least)
            for x, y in product(before, before):
                fits &= x[a] != y[b]
            a, b, least = a[fits], b[fits], least[fits]
            if len(a):
                bound = (n[a] + n[b] - differing_bits(flat, ends[:-1], np.diff(ends), a, b)) // 2
                a, b = a[bound >= least], b[bound >= least]
                found.append(np.sort(np.stack([node[a], node[b]]), axis=0))

        every, step = np.arange(len(n)), 0
        active = every
        while centres and step < reach:
            centre = np.concatenate([[0], last[:-1]])[np.searchsorted(last, every, "right")] + step
            meet(centre[centre < every], every[centre < every])
            step += 1
        while not centres and len(active) and (reach is None or step < reach):
            step += 1
            active = active[active + step < stop[active]]
            active = active[p * n[active + step] <= q * n[active]]
            meet(active, active + step)
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tile = [held.column(c).to_numpy() for c in _TILE_COLUMNS]
            same = np.logical_and.reduce([c == c[-1] for c in tile]) if held.num_rows else np.zeros(0, bool)
            ready = held.num_rows - int(same.sum())  # rows are sorted, so the last tile's are at the end
            if ready:
                pairs = of(held.slice(0, ready))
                held = held.slice(ready)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in of(held)], ["a", "b"])

    first = F.round(F.col("n") * 1000 / F.col("keys")) if centres else F.lit(0)  # keys: the node's shared shingles
    columns = [*_TILE_COLUMNS, "n", "node", "place", "root", "block", "visits", "sig", *(["before", "earlier"] if every_tile else [])]
    sorted_rows = tiles.select(*columns, first.cast("long").alias("first")).repartition(*_TILE_COLUMNS)
    sorted_rows = sorted_rows.sortWithinPartitions(*_TILE_COLUMNS, "first", "n", "node").drop("first")
    return sorted_rows.mapInArrow(every, "a long, b long").distinct()


def _bounded(pairs: DataFrame, whole: DataFrame, limit: Limit) -> DataFrame:
    """Pairs whose whole signatures (node, n, sig) leave room for enough overlap."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, 3), 5):
            sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            sides = [byte_list(batch.column(i)) for i in (3, 5)]
            lengths = np.array([len(x) for side in sides for x in side], np.int64)
            flat, rows = np.frombuffer(b"".join(sides[0] + sides[1]), np.uint8), np.arange(batch.num_rows)
            differ = differing_bits(flat, np.cumsum(lengths) - lengths, lengths, rows, rows + batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array((sizes - differ) // 2 >= limit.overlap(sizes), pa.bool_()))

    joined = pairs.join(whole.toDF("a", "_n", "_one"), "a").join(whole.toDF("b", "_m", "_other"), "b")
    return joined.select("a", "b", "_n", "_one", "_m", "_other").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """Pairs whose sorted hash arrays overlap enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, 2), 3):
            keep = []
            for one, other in zip(byte_list(batch.column(2)), byte_list(batch.column(3))):
                one, other = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= limit.overlap(len(one) + len(other)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "_one"), "a").join(sets.toDF("b", "_other"), "b")
    return joined.select("a", "b", "_one", "_other").mapInArrow(check, "a long, b long")


def _sets(docs: DataFrame, text: str, words: int, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes, from one text of each."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [shingles(t, words) for t in byte_list(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    marks = written(only(known, nodes, "node").groupBy("node").agg(F.min("mark").alias("_mark")).select("_mark"), "marks")
    chosen = only(docs.select(F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_mark")), marks, "_mark")
    return chosen.groupBy("_mark").agg(F.first("_text").alias("_text")).select("_text").mapInArrow(every, "node long, hashes binary")


def near_sets(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    link_empty: bool = False,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, mark, n_shingles, component, component_id) for every row.

    ``component`` is the smallest node linked (null for texts without words), unique even if ids are not;
    ``component_id`` the smallest id in it. ``mark`` is the 64-bit hash of the text. ``candidates`` (a, b)
    are pairs of marks that another method found; they are compared exactly before all others.
    """
    limit = Limit(similarity)
    seen = written(facts(docs, key, text, words, link_empty), "facts")
    rows = seen.where("common is null").select("doc_id", "mark", "node", "n")
    total = rows.count()
    often = seen.where("common is not null").groupBy("common").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= total * COMMON_SHARE)
    often = often.orderBy(F.desc("seen"), "common").limit(COMMON_KEPT).toPandas()
    keys = often.common.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    entries = written(_entries(docs, text, words, limit, keys[order], often.seen.to_numpy(np.int64)[order]), "entries")
    met = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members"))
    met = written(met.where("low <> high").select("key", "members"), "met")
    tidy(spark)
    shared = join_by_count(entries, met, "key", "members", entries.count()).where("members is not null").drop("members")
    shared = written(shared.distinct(), "shared")
    tidy(spark)
    held = written(shared.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "held")
    one_each = seen.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("tag").alias("sig"))
    one_each = written(one_each, "tags")
    shared = join_by_count(shared, held, "key", "members", shared.count()).join(one_each.select("node", "n"), "node")
    whole = seen.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    own = Window.partitionBy("node")  # a node's shared shingles, at most its prefix
    shared = shared.withColumn("pick", F.row_number().over(own.orderBy(F.xxhash64("key"), "key"))).withColumn("keys", F.count(F.lit(1)).over(own))
    shared = shared.withColumn("turn", F.row_number().over(own.orderBy("place")))
    # where there is none, the node itself: no other node has it
    shared = shared.withColumns({name: F.coalesce(F.lag("key", i).over(own.orderBy("place")), F.col("node")) for i, name in enumerate(("before", "earlier"), 1)})
    shared = written(shared, "shared")
    tidy(spark)

    sets = links = tried = roots = None
    known = rows.select("node", "mark")
    for which, reach, centres in ([("given", None, False)] if candidates is not None else []) + list(PHASES):
        if which == "given":
            at = [known.groupBy(F.col("mark").alias(side)).agg(F.min("node").alias("_" + side)) for side in "ab"]
            pairs = candidates.select("a", "b").join(at[0], "a").join(at[1], "b").where("_a <> _b")
            pairs = pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        else:
            current = shared if which is None else shared.where((F.col("turn") <= which) | (F.lit(centres) & (F.col("pick") <= which)))
            current = current.withColumn("root", F.col("node")) if roots is None else current.join(roots.toDF("node", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
            current = current.join(one_each.select("node", "sig"), "node")
            pairs = _candidates(_dealt(current, limit, reach is None), reach, limit, centres)
        pairs = written(_bounded(written(pairs, "pairs"), whole, limit), "bounded")
        # what is left is compared as long as it lies between components, first a few pairs for each two of them
        for few in (BETWEEN, None) if pairs.count() > AT_ONCE else (None,):
            chosen = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
            for side in "ab":
                at = F.lit(None).cast("long") if roots is None else F.col(f"_root_{side}")
                chosen = chosen if roots is None else chosen.join(roots.toDF(side, f"_root_{side}"), side, "left")
                chosen = chosen.withColumn(f"r{side}", F.coalesce(at, F.col(side)))
            chosen = chosen.where("ra <> rb")
            if few is not None:
                between = Window.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.xxhash64("a", "b"))
                chosen = chosen.withColumn("_r", F.row_number().over(between)).where(F.col("_r") <= few)
            chosen = written(chosen.select("a", "b"), "chosen")
            if chosen.isEmpty():
                break
            nodes = chosen.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            nodes = written(nodes if sets is None else nodes.join(sets, "node", "left_anti"), "nodes")
            if sets is None or not nodes.isEmpty():
                new = written(_sets(docs, text, words, known, nodes), "sets")
                sets = new if sets is None else sets.unionByName(new)
            found = written(_verified(chosen, sets, limit), "links")
            tidy(spark)
            tried = chosen if tried is None else tried.unionByName(chosen)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = written(components(links), "roots")

    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    if roots is None:
        labelled = classes.select("node", "copies", F.col("node").alias("component"), F.col("first_id").alias("component_id"))
    else:
        classes = classes.join(roots.toDF("node", "_root"), "node", "left").withColumn("component", F.coalesce("_root", "node"))
        lowest = classes.where("_root is not null").groupBy(F.col("component").alias("_c")).agg(F.min("first_id").alias("_lowest"))
        labelled = classes.join(lowest, F.col("component") == F.col("_c"), "left").select("node", "copies", "component", F.coalesce("_lowest", "first_id").alias("component_id"))
    labelled = written(labelled, "labelled")
    out = ["doc_id", "mark", F.col("n").alias("n_shingles"), "component", "component_id"]
    alone = rows.where("node is null").select(*out[:3], F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return join_by_count(rows.where("node is not null"), labelled, "node", "copies", total).select(*out).unionByName(alone)


def similar_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    return near_sets(spark, docs, key, text, words, similarity).select("doc_id", "n_shingles", "component_id")
