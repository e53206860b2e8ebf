"""The session registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import CURRENT_MONTAGE, SAMPLE_RATE
from ..schema import SESSIONS


def register(
    samples: DataFrame, subject: str = "S000", session_type: str = "resting", fs: float = SAMPLE_RATE,
    uri: str = "", attrs: dict[str, str] | None = None,
) -> DataFrame:
    """Registry rows of the recordings in ``samples``: status 'recorded', stamped now."""
    facts = samples.groupBy("session_id").agg(
        (F.max("sample_idx") + 1).alias("_n"),
        F.array_sort(F.collect_set(F.struct("channel_idx", "channel"))).alias("_ch"),
    )
    extra = F.create_map(*[F.lit(x) for kv in (attrs or {}).items() for x in kv]) if attrs else F.lit(None)
    values = {
        "subject_id": F.lit(subject),
        "session_type": F.lit(session_type),
        "duration_sec": F.col("_n") / F.lit(fs),
        "n_channels": F.size("_ch"),
        "sample_rate": F.lit(fs),
        "channel_names": F.col("_ch.channel"),
        "montage_version": F.lit(CURRENT_MONTAGE),
        "status": F.lit("recorded"),
        "uri": F.lit(uri),
        "created_at": F.current_timestamp(),
        "attrs": extra,
    }
    return facts.select(
        *[values.get(f.name, F.col("session_id")).cast(f.dataType).alias(f.name) for f in SESSIONS.fields]
    )


def query_sessions(sessions: DataFrame, subject_id: str, session_type: str | None = None) -> DataFrame:
    out = sessions.where(F.col("subject_id") == subject_id)
    return out if session_type is None else out.where(F.col("session_type") == session_type)


def list_sessions(objects: DataFrame, subject_id: str | None = None) -> DataFrame:
    """Distinct (subject, session) of stored objects."""
    out = objects if subject_id is None else objects.where(F.col("subject_id") == subject_id)
    return out.select("subject_id", "session_id").distinct()
