"""Column expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import CURRENT_MONTAGE, MONTAGES, SAMPLE_RATE


def channel_name(idx: Column, version: str = CURRENT_MONTAGE) -> Column:
    """Montage position of a 0-based channel index (constant-folded lookup)."""
    names = F.array(*[F.lit(n) for n in MONTAGES[version]])
    return F.get(names, idx.cast("int"))


def seconds(idx: Column, fs: float = SAMPLE_RATE) -> Column:
    return idx / F.lit(float(fs))


def nz(col: Column) -> Column:
    """Turn -0.0 into 0.0 so that results compare and hash equal."""
    return col + F.lit(0.0)


def rounded(col: Column, digits: int = 6) -> Column:
    return nz(F.round(col, digits))


def membership(col: Column, values: Sequence[str]) -> Column:
    return col.isin(list(values))


def rank_in(col: Column, values: Sequence[str]) -> Column:
    """Position of a value in a fixed list, NULL if absent."""
    whens = None
    for i, v in enumerate(values):
        whens = F.when(col == v, i) if whens is None else whens.when(col == v, i)
    return whens


def micros_of(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    d = f"(cast({ts} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(
        f"extract(day from {d}) * 86400000000L + extract(hour from {d}) * 3600000000L "
        f"+ extract(minute from {d}) * 60000000L + cast(extract(second from {d}) * 1000000 as bigint)"
    )
