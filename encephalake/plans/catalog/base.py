"""Registration and the SQL fragments several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views
from ..views import E_SQL, K_SQL, L_SQL, M_SQL, S_SQL  # noqa: F401

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def pick(df: DataFrame, spec: str) -> DataFrame:
    """Select ``name`` or ``name:digits`` (rounded, without negative zero)."""
    cols = []
    for item in spec.split():
        name, _, digits = item.partition(":")
        c = F.col(name)
        cols.append((F.round(c, int(digits)) + F.lit(0.0)).alias(name) if digits else c)
    return df.select(*cols)


def sel(spec: str) -> str:
    """The same list as SQL text."""
    out = []
    for item in spec.split():
        name, _, digits = item.partition(":")
        out.append(f"round({name}, {digits}) + 0.0 as {name}" if digits else name)
    return ", ".join(out)


#: First index of cropped recordings, and the indexes that gapped ones lack.
CROP, GAP = 300, (480, 519)
CROPPED_SQL = S_SQL.replace("s as (", "s0 as (", 1) + f""",
  s as (select session_id, channel, channel_idx, sample_idx - {CROP} sample_idx, uv from s0 where sample_idx >= {CROP})"""
#: Each side of the gap as a recording of its own.
GAPPED_SQL = S_SQL.replace("s as (", "s0 as (", 1) + f""",
  s as (select session_id || '#' || (case when sample_idx > {GAP[1]} then {GAP[1] + 1} else 0 end) session_id, channel, channel_idx,
    sample_idx - case when sample_idx > {GAP[1]} then {GAP[1] + 1} else 0 end sample_idx, uv from s0 where sample_idx not between {GAP[0]} and {GAP[1]})"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def windows_sql(name: str, source: str = "s", w: int = 250, hop: int = 250) -> str:
    """Complete windows in long form: win, j (place in the window), uv."""
    return f"""{name} as (
  select * from (
    select t.*, q.win, t.sample_idx - q.win * {hop} j, {w} n,
           count(*) over (partition by t.session_id, t.channel_idx, q.win) c
    from {source} t join (select unnest(range((select max(sample_idx) // {hop} + 1 from {source}))) win) q
      on t.sample_idx >= q.win * {hop} and t.sample_idx < q.win * {hop} + {w})
  where c = {w})"""


def spectrum_sql(name: str, source: str, keys: str, taper: str = "hann") -> str:
    """re, im and one-sided density per bin of sources with columns keys, j, n, uv."""
    a = {"hann": 0.5, "hamming": 0.54}[taper]
    energy = a * a + (1 - a) ** 2 / 2
    return f"""{name} as (
  select {keys}, n, k, k * 125.0::double / n freq, re, im,
         (re * re + im * im) * (case when k = 0 or 2 * k = n then 1 else 2 end) / (125 * {energy!r}::double * n) psd
  from (select {keys}, n, k, sum(xw * cos(2 * pi() * k * j / n)) re, -sum(xw * sin(2 * pi() * k * j / n)) im
        from (select {keys}, n, j, (uv - avg(uv) over (partition by {keys}))
                     * ({a!r}::double - {1 - a!r}::double * cos(2 * pi() * j / n)) xw from {source}) g,
             (select unnest(range(126)) k) b
        where k <= n // 2 group by all))"""


def bands_sql(name: str, spectrum: str, keys: str, bands: dict[str, tuple[float, float]] | None = None) -> str:
    """Relative trapezoid powers per band."""
    from ...dims import BANDS

    parts = ", ".join(
        f"coalesce(sum(case when freq >= {lo} and fn < {hi} then (psd + pn) / 2 * (fn - freq) end), 0) / tot as {b}"
        for b, (lo, hi) in (bands or BANDS).items()
    )
    return f"""{name} as (
  select {keys}, {parts} from (
    select *, case when t0 = 0 then 1e-10 else t0 end tot from (
      select *, sum((psd + pn) / 2 * (fn - freq)) over (partition by {keys}) t0 from (
        select *, lead(psd) over (partition by {keys} order by k) pn,
               lead(freq) over (partition by {keys} order by k) fn from {spectrum})))
  group by {keys}, tot)"""


WIN_KEYS = "session_id, channel_idx, win"


def encoded_sql(hop: int = 62) -> str:
    """PNS: per-channel encoding over sliding windows."""
    return ",\n".join(
        [
            windows_sql("wn", "s", 250, hop),
            spectrum_sql("sp", "wn", WIN_KEYS),
            bands_sql("bp", "sp", WIN_KEYS),
            """pns as (select session_id, channel_idx, win, beta + gamma a, 2 * pi() * alpha b, delta + theta c from bp)""",
        ]
    )


STATES_SQL = """iv as (
  select m.session_id, sample_index / 125.0::double onset_sec, marker_id, label,
         coalesce(lead(sample_index) over (partition by m.session_id order by sample_index) / 125.0::double,
                  (n_samples - 1) / 125.0::double) end_sec
  from m join (select session_id, max(sample_idx) + 1 n_samples from s group by 1) using (session_id))"""

__all__ = ["views"]
