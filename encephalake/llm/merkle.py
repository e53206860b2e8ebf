"""A Merkle manifest of a dataset with a witness for every row, by incremental witnesses.

Rows are leaves; the leaves of a source, in order of id, form a tree of fan-out ``FAN``: every run of
consecutive nodes (the last may be shorter, even one node) becomes the hash of their digests, until one
node, the subroot, is left. Subroots, in order of source, form the tree of the root in the same way.

A block of ``FAN`` ** ``LEVELS`` leaves is aligned with the tree, so blocks are worked on alone. In a block
leaves are appended one after another: an open subtree keeps the range of its leaves, and each leaf a
partial witness. A node that joins a run takes the digests before it into its leaves' witnesses, and each
later sibling's digest extends the witnesses of those before it; a full run is a node of the next level.
Block roots are then appended in blocks of their own, as many rounds as it takes, and subroots after them.
A leaf's whole witness is its own, its block's, that block's and so on. A group never has more rows than a block,
whatever a source holds; places in order come from range partitions and their counts.

A witness is an array with one entry a level: the digests before the node in its run, one after another,
and those after it, in lower-case hex. ``folded`` recomputes the root from a leaf and a witness.

A null in a column is the mark ``-``. Null ids come first, then ids in order; rows with the same id are in order
of their leaves, so equal rows have neighbouring places. A null source is a source. Very long texts are hashed where
they are read, only digests are moved. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, partitions, written

FAN = 3
LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_WITNESS = "array<struct<before:string,after:string>>"


def leaf_of(columns: Sequence[Column]) -> Column:
    """The digest of a row's values, each with its length in bytes."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(witness, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def siblings(witness: Column) -> Column:
    """All siblings of a witness one after another, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda level: F.concat(level["before"], level["after"])), "")


@dataclass
class Frontier:
    """Leaves appended in order: open runs by level, and the witnesses so far."""

    fan: int = FAN
    runs: list[list[tuple[str, int, int]]] = field(default_factory=list)
    witnesses: list[list[list[str]]] = field(default_factory=list)

    def append(self, digest: str) -> None:
        place = len(self.witnesses)
        self.witnesses.append([])
        self._join(0, digest, place, place + 1)

    def _join(self, level: int, digest: str, start: int, stop: int) -> None:
        """A node over the leaves from ``start`` to ``stop`` joins the open run of its level."""
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        if len(run) == self.fan:
            run.clear()
        before = "".join(node for node, _, _ in run)
        for leaf in range(start, stop):
            self.witnesses[leaf].append([before, ""])
        for _, first, last in run:
            for leaf in range(first, last):
                self.witnesses[leaf][level][1] += digest
        run.append((digest, start, stop))
        if len(run) == self.fan:
            self._close(level)

    def _close(self, level: int) -> None:
        run = self.runs[level]
        digest = hashlib.sha256("".join(node for node, _, _ in run).encode()).hexdigest()
        self._join(level + 1, digest, run[0][1], run[-1][2])

    def finish(self, levels: int | None = None) -> str:
        """Close what is open, up to one node or to the node of level ``levels``; its digest."""
        level = 0
        while True:
            if level == levels or (levels is None and level == len(self.runs) - 1 and len(self.runs[level]) == 1):
                break
            if len(self.runs[level]) < self.fan:
                self._close(level)
            level += 1
        for witness in self.witnesses:
            del witness[level:]
        return self.runs[level][-1][0]


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) in the order of ``order`` in their group, and the group's ``size``.

    Rows are dealt by ranges of (group, order), so a large group is spread; places in a range count on
    from the ranges before it, of which there are as many rows as ranges and groups.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(partitions(rows.sparkSession), group, *order, "_tie").withColumn("_range", F.spark_partition_id())
    spread = written(spread, "ranges")
    counts = spread.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range")
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.sum("_n").over(before) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order, "_tie")) - 1
    numbered = spread.withColumn("_inside", inside)
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))
    placed = numbered.join(_small(starts), same).withColumn("place", (F.col("_start") + F.col("_inside")).cast("long"))
    return placed.drop("_tie", "_range", "_g", "_r", "_start", "_inside")


#: Rows with a witness (one or two kB) that may be broadcast once they have been counted.
_WITNESSES = 5_000


def _small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only if counted small."""
    rows = written(rows, "counted")
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def _blocks(nodes: DataFrame, group: str, fan: int, levels: int) -> DataFrame:
    """Rows (group, block, place, digest, witness) of (group, place, size, digest); the block's root is on each row."""
    block = fan**levels

    def climb(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        frontier = Frontier(fan)
        for digest in frame["digest"]:
            frontier.append(digest)
        frame["block_root"] = frontier.finish(levels if frame["size"].iloc[0] > block else None)
        frame["witness"] = [[{"before": a, "after": b} for a, b in w] for w in frontier.witnesses]
        return frame[[group, "block", "place", "size", "digest", "block_root", "witness"]]

    kind = dict(nodes.dtypes)[group]
    schema = f"{group} {kind}, block long, place long, size long, digest string, block_root string, witness {_WITNESS}"
    cut = nodes.select(group, F.floor(F.col("place") / block).alias("block"), "place", "size", "digest")
    return cut.groupBy(group, "block").applyInPandas(climb, schema)


def trees(nodes: DataFrame, group: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(group, place, digest, top, witness) of (group, place, size, digest): a tree per group, whatever its size."""
    block = fan**levels
    done = written(_blocks(nodes, group, fan, levels), "blocks")
    several = done.where(F.col("size") > block)
    if several.isEmpty():
        return done.select(group, "place", "digest", F.col("block_root").alias("top"), "witness")
    heads = several.where(F.col("place") % block == 0)
    heads = heads.select(group, F.col("block").alias("place"), F.ceil(F.col("size") / block).cast("long").alias("size"), F.col("block_root").alias("digest"))
    above = trees(heads, group, fan, levels).select(F.col(group).alias("_g"), F.col("place").alias("_block"), F.col("top").alias("_top"), F.col("witness").alias("_above"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block"))
    joined = done.join(_small(above, _WITNESSES), same, "left")
    whole = F.when(F.col("_g").isNull() & F.col("_top").isNull(), F.col("witness")).otherwise(F.concat("witness", F.coalesce("_above", F.array().cast(_WITNESS))))
    return joined.select(group, "place", "digest", F.coalesce("_top", "block_root").alias("top"), whole.alias("witness"))


def manifest(leaves: DataFrame, key: str, group: str, leaf: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``witness`` (from the leaf to the root)."""
    own = [c for c in leaves.columns if c not in (group, leaf)]
    rows = written(ranked(written(leaves, "leaves"), group, [key, leaf]), "ranked")
    nodes = rows.select(group, "place", "size", F.col(leaf).alias("digest"))
    inner = written(trees(nodes, group, fan, levels), "inner")
    subroots = inner.where("place = 0").select(F.col(group).alias("_name"), F.col("top").alias("_sub"), F.lit(0).alias("_all"))
    outer = ranked(written(subroots, "subroots"), "_all", ["_name"])
    top = trees(outer.select("_all", "place", "size", F.col("_sub").alias("digest")), "_all", fan, levels)
    top = outer.select("_name", "_sub", "place").join(top.select("place", F.col("top").alias("root"), F.col("witness").alias("_outer")), "place").drop("place")
    inner = inner.select(F.col(group).alias("_g"), F.col("place").alias("_p"), F.col("witness").alias("_inner"))
    joined = rows.join(inner, F.col(group).eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_p")))
    joined = _with_groups(joined, group, written(top, "top"), rows)
    return joined.select(*own, group, leaf, F.col("_sub").alias("subroot"), "root", F.concat("_inner", "_outer").alias("witness"))


def _with_groups(joined: DataFrame, group: str, top: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row with its group's one row of ``top``.

    Few groups are broadcast. Of many, those that hold more than 1/P of the rows are (at most P of them); no other is a hot key.
    """
    same = F.col(group).eqNullSafe(F.col("_name"))
    if top.limit(_WITNESSES + 1).count() <= _WITNESSES:
        return joined.join(F.broadcast(top), same)
    large = F.col("size") * partitions(rows.sparkSession) > rows.count()
    names = rows.where("place = 0").where(large).select(F.col(group).alias("_large"))
    hot = top.join(F.broadcast(names), F.col("_name").eqNullSafe(F.col("_large")), "left_semi")
    return joined.where(large).join(F.broadcast(hot), same).unionByName(joined.where(~large).join(top, same))


def audit(spark: SparkSession, docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The manifest of ``docs`` (id, source, ..., text), with rows of even id checksum changed and verified against it."""
    key, group, text = columns[0], columns[1], columns[-1]
    even = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
    given = leaf_of([F.col(c) for c in columns])
    later = leaf_of([*[F.col(c) for c in columns[:-1]], changed])
    leaves = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(group).alias("source"), given.alias("leaf"), later.alias("later"))
    rows = manifest(leaves, "doc_id", "source", "leaf").withColumn("folded_root", folded(F.col("later"), F.col("witness")))
    proof = F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_VALUE = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_HEAD = " || ".join(_VALUE.format(c) for c in COLUMNS[:-1])
#: The parity of crc32: the number starts at 2^32 - 1; a byte is xored in, then eight times shifted out (-1).
_EVEN = """list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
    lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) % 2 = 1"""


def _levels(name: str, start: str) -> str:
    return f"""{name}(grp, lvl, pos, n, digest) as (
  {start}
  union all
  select grp, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from {name} where n > 1 group by grp, lvl, pos // 3)"""


ORACLE = f"""
with recursive d as (select doc_id, source, sha256({_HEAD} || {_VALUE.format("text")}) leaf,
    sha256({_HEAD} || case when {_EVEN} then {_VALUE.format("replace(text, chr(10), '')")} else {_VALUE.format("text")} end) later from documents),
r as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as size,
    dense_rank() over (order by encode(source) nulls first) - 1 as grp from d),
{_levels("inside", "select grp, 0, place, size, leaf from r")},
subs as (select grp, digest from inside where n = 1),
{_levels("outside", "select 0::bigint, 0, grp, count(*) over (), digest from subs")},
tree as (select grp, lvl, pos, digest from inside union all
    select -1, lvl, pos, digest from outside),
height as (select grp, max(lvl) h from inside group by grp union all select -1, max(lvl) from outside),
steps as (select r.doc_id, r.grp, r.place, r.leaf, r.later, s.lvl, s.tree_grp, s.step,
    (case when s.tree_grp = -1 then r.grp else r.place end) // (3 ** s.lvl)::bigint as pos
  from r join (select grp, grp tree_grp, unnest(range(h)) lvl, unnest(range(h)) step from height where grp >= 0
    union all select a.grp, -1, unnest(range(b.h)), unnest(range(a.h, a.h + b.h)) from height a, height b where a.grp >= 0 and b.grp = -1) s on s.grp = r.grp),
near as (select s.grp, s.place, s.step, coalesce(string_agg(t.digest, '' order by t.pos) filter (where t.pos < s.pos), '') bef,
    coalesce(string_agg(t.digest, '' order by t.pos) filter (where t.pos > s.pos), '') aft
  from steps s join tree t on t.grp = s.tree_grp and t.lvl = s.lvl and t.pos // 3 = s.pos // 3 group by all),
proofs as (select grp, place, sha256(string_agg(bef || aft, '' order by step)) proof from near group by all),
fold(grp, place, step, node) as (
  select grp, place, 0, later from r
  union all
  select f.grp, f.place, f.step + 1, sha256(n.bef || f.node || n.aft) from fold f join near n on n.grp = f.grp and n.place = f.place and n.step = f.step),
last as (select grp, place, max_by(node, step) node from fold group by all),
top as (select digest root from outside where n = 1)
select doc_id, leaf, subs.digest as subroot, root, coalesce(proof, sha256('')) as proof_sha256, last.node as folded_root, last.node = root as verified
from r join subs using (grp) join last using (grp, place) left join proofs using (grp, place), top
"""
