"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _LONG, _DBL, _FLT = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.FloatType(),
)
_DOUBLES, _STRINGS, _TEXT_MAP = T.ArrayType(_DBL), T.ArrayType(_STR), T.MapType(_STR, _STR)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SAMPLES = _table(session_id=_STR, channel=_STR, channel_idx=_INT, sample_idx=_LONG, uv=_DBL, t_sec=_DBL)
MARKERS = _table(session_id=_STR, sample_index=_LONG, marker_id=_INT, label=_STR)
FEEDBACK = _table(session_id=_STR, t_sec=_DBL, state=_FLT, target=_FLT)
SESSIONS = _table(
    subject_id=_STR,
    session_id=_STR,
    session_type=_STR,
    duration_sec=_DBL,
    n_channels=_INT,
    sample_rate=_DBL,
    channel_names=_STRINGS,
    montage_version=_STR,
    status=_STR,
    uri=_STR,
    created_at=T.TimestampType(),
    attrs=_TEXT_MAP,
)
PN = _table(session_id=_STR, channel=_STR, sample_idx=_LONG, a=_DBL, b=_DBL, c=_DBL)
QUALITY = _table(
    session_id=_STR, channel=_STR, win=_LONG, rail_pct=_DBL, std_uv=_DBL, line_ratio=_DBL, status=_INT
)
SCHEDULE = _table(start_sec=_DBL, duration_sec=_DBL, condition=_INT, label=_STR, cycle=_INT)
TEMPLATES = _table(
    name=_STR, label=_INT, n_channels=_INT, n_segments=_LONG, members=T.ArrayType(_DOUBLES), norm=_DBL, metadata=_TEXT_MAP
)
EVENT_LOG = _table(
    config=T.MapType(_STR, _DBL),
    events=T.ArrayType(_table(timestamp=_DBL, event=_STR, condition=_INT, label=_STR)),
)
