"""Element-wise sums of arrays per key, and fixed-point loops built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .layout import spread_join

# A small state stays on the driver: at most this many keys (x a C x C matrix).
MAX_DRIVER_KEYS = 1024
# Rows that a round works on at a time.
SLICE = 256


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _groups(pdf: pd.DataFrame, keys: list[str]):
    """(key, rows) of every key; a missing part of a key is None, as in a row."""
    for key, part in pdf.groupby(keys, sort=False, dropna=False):
        yield tuple(None if pd.isna(k) else k for k in key), part


def _entry_sums(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p, n, e) from partial rows (keys, n, v)."""
    entries = partial.select(*keys, "n", F.posexplode("v").alias("p", "e"))
    return entries.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def matrix_sums(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, total): sum of equally long arrays per key, and how many there were.

    Every task first reduces its rows to one per key and Arrow batch; entries are
    then summed by a partial aggregate, so a hot key costs no more than another.
    """
    keys = list(keys)

    def reduce(batches):
        for pdf in batches:
            for key, part in _groups(pdf, keys):
                total = np.sum(np.stack(part[value].to_list()), axis=0)
                yield pd.DataFrame([(*key, len(part), total)], columns=[*keys, "n", "v"])

    partial = df.select(*keys, value).mapInPandas(reduce, f"{_key_types(df, keys)}, n bigint, v array<double>")
    packed = F.array_sort(F.collect_list(F.struct("p", "e")))["e"]
    return _entry_sums(partial, keys).groupBy(*keys).agg(F.max("n").alias("n"), packed.alias("total"))


def fixed_point(
    data: DataFrame,
    keys: Sequence[str],
    value: str,
    start: DataFrame,
    contribute: Callable[[list, np.ndarray], np.ndarray],
    update: Callable[[np.ndarray, int, np.ndarray], tuple[np.ndarray, bool]],
    max_iter: int,
    max_driver_keys: int = MAX_DRIVER_KEYS,
) -> DataFrame:
    """Iterate a parameter vector per key until every key is done.

    ``data`` is (keys, value array) and is written once for the loop, where lost executors
    can read it again; ``start`` is (keys, s).  One round sums ``contribute(rows, s)`` over a key's rows and calls
    ``update(total, n, s)``, which returns the new vector and whether to stop.
    The vectors stay on the driver while there are few keys (checked); beyond
    that they live in a written table and advance by joins.
    """
    keys = list(keys)
    data = materialise(data.select(*keys, value), "loop")
    few = start.select(*keys, "s").limit(max_driver_keys + 1).collect()
    if len(few) <= max_driver_keys:
        return _on_driver(data, keys, value, few, start, contribute, update, max_iter)
    return _in_table(data, keys, value, start, contribute, update, max_iter)


def _on_driver(data, keys, value, few, start, contribute, update, max_iter) -> DataFrame:
    spark = data.sparkSession
    states = {tuple(r[k] for k in keys): np.asarray(r["s"]) for r in few}
    live = set(states)
    schema = f"{_key_types(data, keys)}, n bigint, v array<double>"
    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast({k: states[k] for k in live})

        def partial(batches, shared=shared):
            sums: dict[tuple, list] = {}
            for pdf in batches:
                for key, part in _groups(pdf, keys):
                    if key not in shared.value:
                        continue
                    for at in range(0, len(part), SLICE):
                        rows = part[value].iloc[at : at + SLICE].to_list()
                        v = contribute(rows, shared.value[key])
                        old = sums.get(key)
                        sums[key] = [len(rows), v] if old is None else [old[0] + len(rows), old[1] + v]
            for key, (n, v) in sums.items():
                yield pd.DataFrame([(*key, n, v)], columns=[*keys, "n", "v"])

        rows = _entry_sums(data.mapInPandas(partial, schema), keys).collect()
        totals: dict[tuple, dict[int, float]] = {}
        counts: dict[tuple, int] = {}
        for r in rows:
            key = tuple(r[k] for k in keys)
            totals.setdefault(key, {})[r["p"]] = r["e"]
            counts[key] = r["n"]
        for key, entries in totals.items():
            total = np.array([entries[p] for p in range(len(entries))])
            states[key], done = update(total, counts[key], states[key])
            if done:
                live.discard(key)
        live &= set(totals)
        shared.unpersist()
        if not live:
            break
    fields = start.select(*keys, "s").schema
    return spark.createDataFrame([(*k, s.tolist()) for k, s in states.items()], fields)


def _in_table(data, keys, value, start, contribute, update, max_iter) -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([contribute([v], np.asarray(p)) for v, p in zip(x, s)])

    @F.pandas_udf("struct<s:array<double>,done:boolean>")
    def advance(total: pd.Series, n: pd.Series, s: pd.Series, done: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, old, d in zip(total, n, s, done):
            rows.append((old, True) if d or t is None else update(np.asarray(t), k, np.asarray(old)))
        return pd.DataFrame(rows, columns=["s", "done"])

    state = materialise(start.select(*keys, "s", F.lit(False).alias("done")), "state")
    for _ in range(max_iter):
        live = state.where("not done").drop("done")
        parts = spread_join(data, live, keys, F.xxhash64(value)).select(*keys, apply(value, "s").alias("v"))
        sums = matrix_sums(parts, keys, "v")
        step = advance("total", F.coalesce("n", F.lit(0)), F.col("s"), F.col("done"))
        state = state.join(sums, keys, "left").select(*keys, step.alias("r")).select(*keys, "r.s", "r.done")
        state = materialise(state, "state")  # a small table; cuts the lineage
        if state.where("not done").isEmpty():
            break
    return state.select(*keys, "s")
