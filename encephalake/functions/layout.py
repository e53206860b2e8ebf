"""How long-format samples are laid out for order-dependent work.

A recording can be arbitrarily long and a single (session, channel) may hold a
large part of all rows, so nothing here ever gathers a whole channel.  Work is
cut into chunks of a fixed number of samples; neighbours a kernel needs are
copied into the chunk as a halo.  Tables with one row per channel are joined
back section by section, so a long channel spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["session_id", "channel_idx"]
CHUNK = 4096
SECTION = 1 << 20


def with_halo(
    df: DataFrame, length: int = CHUNK, left: int = 0, right: int = 0, pos: str = "sample_idx"
) -> DataFrame:
    """Add ``chunk``; copy each chunk's ``left``/``right`` neighbours into it.

    Rows a chunk owns satisfy ``own(length)``; halo rows do not.
    """
    if max(left, right) > length:
        raise ValueError("halo must not exceed the chunk length")
    p, c = F.col(pos) % length, F.expr(f"{pos} div {length}")
    if not left and not right:
        return df.withColumn("chunk", c)
    targets = F.array(
        c,
        F.when((p < right) & (c > 0), c - 1) if right else F.lit(None).cast("bigint"),
        F.when(p >= length - left, c + 1) if left else F.lit(None).cast("bigint"),
    )
    return df.withColumn("chunk", F.explode(F.array_compact(targets)))


def own(length: int = CHUNK, pos: str = "sample_idx") -> Column:
    """True on the rows that belong to the chunk itself."""
    return F.expr(f"{pos} div {length}") == F.col("chunk")


def sorted_values(pos: str, value: str) -> Column:
    """Aggregate: ``value`` as an array in ``pos`` order (groups must be bounded)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return packed["v"]


def chunk_arrays(
    samples: DataFrame,
    length: int = CHUNK,
    left: int = 0,
    right: int = 0,
    keys: Sequence[str] = KEYS,
    pos: str = "sample_idx",
    value: str = "uv",
    positions: bool = False,
) -> DataFrame:
    """One row per (keys, chunk): ``start`` (index of the first entry) and ``x``, with ``positions`` also ``p``.

    One shuffle on (keys, chunk).  Every group holds at most
    ``length + left + right`` samples, whatever the recording's length.
    """
    halo = with_halo(samples.select(*keys, pos, value), length, left, right, pos)
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    rows = (
        halo.groupBy(*keys, "chunk")
        .agg(packed.alias("_g"), F.max(F.when(own(length, pos), 1).otherwise(0)).alias("_own"))
        .where("_own = 1")
    )
    shown = [F.col("_g.p").alias("p")] if positions else []
    return rows.select(*keys, "chunk", F.element_at("_g.p", 1).alias("start"), F.col("_g.v").alias("x"), *shown)


def placed(chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The chunks an inner join on (keys, chunk) can keep; said beforehand, both of its sides share one exchange."""
    for c in (*keys, "chunk"):
        chunks = chunks.where(F.col(c).isNotNull())
    return chunks


def gapless(positions: np.ndarray) -> list[slice]:
    """The runs of consecutive positions."""
    cuts = np.flatnonzero(np.diff(positions) != 1) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(positions)])]


def sorted_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, its rows) one after another, of rows sorted by the key in their first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
        cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(names)]):
            if held and names[a] != key:
                yield key, held
                held = []
            key = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def gapless_stretches(samples: DataFrame, keys: Sequence[str] = KEYS, pos: str = "sample_idx", length: int = CHUNK) -> DataFrame:
    """Add ``stretch``, the first index of the gapless run a row lies in, and count ``pos`` from there.

    Runs are found inside chunks; what a chunk's first run continues comes from a table of one row per chunk.
    """
    keys = list(keys)
    rows = samples.withColumn("_chunk", F.floor(F.col(pos) / length).cast("bigint"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    jump = F.coalesce(F.col(pos) - F.lag(pos).over(inside) != 1, F.lit(True))
    rows = rows.withColumn("_open", F.when(jump, F.col(pos)))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_run", F.last("_open", ignorenulls=True).over(so_far))
    chunks = rows.groupBy(*keys, "_chunk").agg(F.min(pos).alias("_first"), F.max(pos).alias("_end"), F.max("_run").alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    fresh = F.coalesce(F.col("_first") - F.lag("_end").over(order) != 1, F.lit(True))
    # a chunk that is one run through and through only passes on where the run began
    begins = F.when((F.col("_tail") != F.col("_first")) | fresh, F.col("_tail"))
    chunks = chunks.withColumn("_begins", begins).withColumn("_fresh", fresh)
    before = F.last("_begins", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(*keys, "_chunk", "_first", F.when(F.col("_fresh"), F.col("_first")).otherwise(before).alias("_head"))
    joined = rows.join(chunks, [*keys, "_chunk"])
    stretch = F.when(F.col("_run") == F.col("_first"), F.col("_head")).otherwise(F.col("_run"))
    return joined.withColumn("stretch", stretch).withColumn(pos, F.col(pos) - F.col("stretch")).drop("_chunk", "_open", "_run", "_first", "_head")


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join a per-key table back to rows that have no position, by a fixed salt.

    The small side is repeated ``salts`` times and the big side is split by
    ``spread_by``; if the small side is tiny Spark turns this into a broadcast
    by its own size check.
    """
    left = big.withColumn("_salt", F.pmod(spread_by.cast("bigint"), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def section_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    last: str,
    pos: str = "sample_idx",
    how: str = "inner",
    section: int = SECTION,
    first: str | None = None,
) -> DataFrame:
    """Join a per-key table back to its many rows without a hot task.

    Positions are cut into sections of a million; ``first`` and ``last`` are the key's smallest (0 if not
    given) and largest position, so the small side is repeated once per section a key really has: an
    ordinary recording joins as usual, a huge one spreads over many tasks.
    """
    left = big.withColumn("_sec", F.expr(f"{pos} div {section}"))
    start = F.lit(0).cast("bigint") if first is None else F.expr(f"cast({first} as bigint) div {section}")
    right = small.withColumn("_sec", F.explode(F.sequence(start, F.expr(f"cast({last} as bigint) div {section}"))))
    return left.join(right, [*on, "_sec"], how).drop("_sec")


def place_join(big: DataFrame, small: DataFrame, on: Sequence[str], pos: str, section: int = SECTION) -> DataFrame:
    """``section_join`` for rows with wide spaces between them, such as marks at clock times.

    The small side is repeated for the sections that hold a row, never more often than there are rows.
    """
    left = big.withColumn("_sec", F.expr(f"{pos} div {section}"))
    held = left.select(*on, "_sec").distinct().join(small, list(on))
    return left.join(held, [*on, "_sec"]).drop("_sec")


def numbered(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Exact 0-based ``rn`` per key in two levels.

    ``bucket`` must be monotone in the order.  Only one bucket's rows meet in a
    task; the offsets come from a table of bucket counts.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("rn", (F.col("_rn") + F.col("_off") - 1).cast("bigint"))
        .drop("_bucket", "_rn", "_off")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str
) -> DataFrame:
    """Inclusive running total per key as ``running``, in two levels like ``numbered``."""
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_in", F.sum(value).over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("running", F.col("_in") + F.col("_off"))
        .drop("_bucket", "_in", "_off")
    )


def next_in_order(
    df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], bucket_len: int = CHUNK
) -> DataFrame:
    """``lead`` over an unbounded group: adds ``next_<col>`` for each value.

    Rows are led inside position buckets; the last row of a bucket takes the
    first row of the next non-empty bucket from a table with one row per bucket.
    ``pos`` must be unique within ``keys`` for a defined order.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", F.floor(F.col(pos) / bucket_len).cast("bigint"))
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    firsts = rows.groupBy(*keys, "_bucket").agg(F.min_by(packed, pos).alias("_first"))
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket")
    following = firsts.withColumn("_next_bucket", F.lead("_first").over(over_buckets)).drop("_first")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(pos)
    led = (
        rows.withColumn("_in", F.lead(packed).over(inside))
        .join(following, [*keys, "_bucket"])
        .withColumn("_nx", F.coalesce("_in", "_next_bucket"))
    )
    out = led.select(*df.columns, *[F.col(f"_nx.{v}").alias(f"next_{v}") for v in values])
    return out


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    end: str,
    condition: Column,
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Range join as an equi join on a position bucket plus a residual predicate.

    Each interval is repeated for the buckets it touches (bounded by the
    recording's length / width plus one each), points go to one bucket.
    """
    keys = list(keys)
    left = points.withColumn("_b", F.floor(F.col(point) / width).cast("bigint"))
    right = intervals.withColumn(
        "_b",
        F.explode(
            F.sequence(
                F.floor(F.col(start) / width).cast("bigint"),
                F.greatest(F.floor(F.col(end) / width), F.floor(F.col(start) / width)).cast("bigint"),
            )
        ),
    )
    renamed = {k: f"_r_{k}" for k in keys}
    for k, r in renamed.items():
        right = right.withColumnRenamed(k, r)
    right = right.withColumnRenamed("_b", "_rb")
    on = (F.col("_b") == F.col("_rb")) & condition
    for k, r in renamed.items():
        on = on & (F.col(k) == F.col(r))
    return left.join(right, on, how).drop("_b", "_rb", *renamed.values())
