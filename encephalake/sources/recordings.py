"""Recordings: Parquet tables, sessions in versions, bulk import of array folders and CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import SAMPLE_RATE
from ..functions.layout import numbered, section_join
from ..schema import FEEDBACK, MARKERS, SAMPLES, SESSIONS
from . import array_folders

TABLES = {"samples": SAMPLES, "markers": MARKERS, "feedback": FEEDBACK, "sessions": SESSIONS}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its fixed schema; filters on session_id prune folders."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    """Append rows to a stored table, one folder per session.

    Rows are hashed on session and a slice of the sample index first, so a big
    session is written by many tasks and a small one does not scatter.
    """
    _write(df, f"{root}/{name}", name, "append")


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """The table's columns; a nullable one that ``df`` lacks is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])


def _write(df: DataFrame, path: str, name: str, mode: str) -> None:
    rows = _shaped(df, name)
    if name == "samples":
        rows = rows.repartition("session_id", F.expr("sample_idx div 1000000")).sortWithinPartitions(
            "session_id", "channel_idx", "sample_idx"
        )
    writer = rows.write.mode(mode)
    if name != "sessions":
        writer = writer.partitionBy("session_id")
    writer.parquet(path)


def sample_time(fs: float = SAMPLE_RATE) -> Column:
    """A sample's stored time, or its index over the rate."""
    return F.coalesce(F.col("t_sec"), F.col("sample_idx") / F.lit(float(fs)))


def read_session(spark: SparkSession, root: str, fs: float = SAMPLE_RATE) -> tuple[DataFrame, DataFrame]:
    """Samples with ``t_sec``, and markers with ``onset_sec``, of a root of plain tables or of versions."""
    read = read_version if has_versions(spark, root) else read_table
    samples = read(spark, root, "samples").withColumn("t_sec", sample_time(fs))
    return samples, with_onsets(read(spark, root, "markers"), fs)


# ---------------------------------------------------------------- versions

def has_versions(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(seq, version, committed_at) of the committed versions; later ones replace sessions of earlier ones."""
    schema = "seq bigint, version string, committed_at timestamp"
    return spark.read.schema(schema).parquet(f"{root}/manifest") if has_versions(spark, root) else spark.createDataFrame([], schema)


def write_version(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write sessions as one version: all tables to fresh folders first, then one row in the manifest.

    Readers follow the manifest, so a version that was left half-written is never seen, and neither is one
    that is being written. ``tables`` has at least ``sessions``, which says whose rows the version has.
    """
    if "sessions" not in tables:
        raise ValueError("a version needs its sessions")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        _write(df, f"{root}/{name}/version={version}", name, "error")
    last = versions(spark, root).agg(F.max("seq")).first()[0]
    row = spark.range(1).select(F.lit(0 if last is None else last + 1).cast("bigint").alias("seq"), F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as the committed versions leave it: each session as its newest version has it.

    Filters on session_id still prune folders. Sessions are matched section by section, so a long one is not one task.
    """
    committed = versions(spark, root).orderBy("seq").collect()  # one row a commit
    schema = T.StructType([*TABLES[name].fields, T.StructField("version", T.StringType())])

    def of(table: str, fields: T.StructType) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path
        found = [f"{root}/{table}/version={r.version}" for r in committed]
        found = [p for p in found if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
        return spark.read.schema(fields).option("basePath", f"{root}/{table}").parquet(*found) if found else None

    rows = of(name, schema)
    if rows is None:
        return spark.createDataFrame([], TABLES[name])
    if len(committed) > 1:
        order = spark.createDataFrame([(r.version, r.seq) for r in committed], "version string, seq bigint")
        held = of("sessions", T.StructType([*SESSIONS.fields, T.StructField("version", T.StringType())]))
        newest = held.select("session_id", "version").join(order, "version").groupBy("session_id").agg(F.max_by("version", "seq").alias("version"), F.max("seq").alias("_seq"))
        if name == "samples":
            ends = rows.groupBy("session_id", "version").agg(F.min("sample_idx").alias("_first"), F.max("sample_idx").alias("_last"))
            rows = section_join(rows, newest.join(ends, ["session_id", "version"]).drop("_seq"), ["session_id", "version"], "_last", first="_first").drop("_first", "_last")
        else:
            rows = rows.join(newest.drop("_seq"), ["session_id", "version"])
    return rows.select(*TABLES[name].names)


def with_onsets(markers: DataFrame, fs: float = SAMPLE_RATE) -> DataFrame:
    return markers.withColumn("onset_sec", F.col("sample_index") / F.lit(fs)).withColumn(
        "duration_sec", F.lit(0.0)
    )


def by_kind(rows: DataFrame, channels: DataFrame, kind: str = "eeg") -> DataFrame:
    """Board rows of one kind; ``channels`` maps row_idx to (kind, channel)."""
    return rows.join(channels.where(F.col("kind") == kind), "row_idx")


def import_array_folders(spark: SparkSession, pattern: str, task_bytes: int = array_folders.TASK_BYTES) -> DataFrame:
    """Long samples from ``<session>/raw_data.npy`` plus ``metadata.json`` folders, through the data source."""
    rows = array_folders.read(spark, pattern, taskBytes=str(task_bytes))
    return _shaped(rows, "samples")


def board_time(samples: DataFrame, times: DataFrame, fs: float = SAMPLE_RATE, bucket: int = 4096) -> DataFrame:
    """Adds ``t_sec``: the board's time of the sample, else of the last sample before that has one, carried on at the rate.

    ``times`` is (session_id, sample_idx, board_sec), possibly with gaps. As-of matches run inside buckets of
    the index; a bucket starts from the last time before it, so no session is one group. Samples before the first
    stored time have index over rate.
    """
    keys = ["session_id", "_bucket"]
    place = F.floor(F.col("sample_idx") / bucket).cast("bigint")
    stored = times.where("board_sec is not null").select("session_id", "sample_idx", "board_sec").withColumn("_bucket", place)
    own = F.struct(F.col("sample_idx").alias("at"), F.col("board_sec").alias("t"))
    lasts = stored.groupBy(*keys).agg(F.max(own).alias("_in"))
    held = samples.select("session_id", place.alias("_bucket")).distinct()
    order = Window.partitionBy("session_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket of a session
    both = held.join(lasts, keys, "full").withColumn("_before", F.last("_in", ignorenulls=True).over(order)).drop("_in")
    marks = stored.select(*keys, "sample_idx", own.alias("_mark"), F.lit(True).alias("_is_mark"))
    rows = samples.withColumn("_bucket", place)
    names = samples.columns
    mixed = rows.withColumn("_mark", F.lit(None).cast("struct<at:bigint,t:double>")).withColumn("_is_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # a mark comes before the samples of its own index
    inside = Window.partitionBy(*keys).orderBy("sample_idx", F.desc("_is_mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = mixed.withColumn("_mark", F.last("_mark", ignorenulls=True).over(inside)).where(~F.col("_is_mark")).join(both, keys, "left")
    mark = F.coalesce("_mark", "_before")
    rate = F.lit(float(fs))
    t = F.coalesce(mark["t"] + (F.col("sample_idx") - mark["at"]) / rate, F.col("sample_idx") / rate)
    return seen.select(*names, t.alias("t_sec"))


def read_percent_csv(spark: SparkSession, pattern: str, n_channels: int = 16) -> DataFrame:
    """(session_id, channel_idx, sample_idx, uv, file) of exports with ``%`` header lines.

    A line is the board's counter and one column per channel; a cell that is no number is null, the line stays.
    A line's place counts from its file's start over all splits of it. Files are told apart by their whole path;
    ``session_id`` is the file's name, which two folders may share.
    """
    cols = ", ".join(["board_idx double", *[f"ch{i} double" for i in range(n_channels)]])
    wide = (
        spark.read.schema(cols)
        .option("comment", "%")
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True)
        .csv(pattern)
        .withColumn("file", F.input_file_name())
        .withColumn("_at", F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("line")))
    )
    # the board's own counter wraps, so rows are numbered by their place in the file
    placed = numbered(wide, ["file"], F.col("_at.block"), [F.col("_at.line")])
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"ch{i}").alias("v")) for i in range(n_channels)])
    session = F.element_at(F.split(F.element_at(F.split("file", "/"), -1), r"\."), 1)
    rows = placed.select("file", session.alias("session_id"), F.col("rn").alias("sample_idx"), F.explode(values).alias("e"))
    return rows.select("session_id", F.col("e.i").alias("channel_idx"), "sample_idx", F.col("e.v").alias("uv"), "file")


def provenance(sessions: DataFrame, components: DataFrame, source: str) -> DataFrame:
    """Session rows with what was removed: ``components`` is (session_id, component, label)."""
    removed = components.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct("component", "label"))).alias("_l"),
    )
    facts = {
        "ica_applied": F.lit("true"),
        "ica_source": F.lit(source),
        "ica_n_excluded": F.coalesce("_n", F.lit(0)).cast("string"),
        "ica_excluded_labels": F.coalesce(F.concat_ws(",", F.col("_l.label")), F.lit("")),
    }
    added = F.create_map(*[x for name, value in facts.items() for x in (F.lit(name), value)])
    # attributes of the source stay, but for those that the cleaning sets
    kept = F.map_filter(F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~k.isin(*facts))
    return sessions.join(removed, "session_id", "left").withColumn("attrs", F.map_concat(kept, added)).drop("_n", "_l")


def save_cleaned(spark: SparkSession, root: str, cleaned: DataFrame, components: DataFrame, source: str) -> str:
    """Commit cleaned samples of sessions below ``root`` as their next version; the version.

    Markers, feedback, stored times and attributes come from the version that is now the newest; the session
    rows say what was removed. All of it becomes visible at once.
    """
    ids = cleaned.select("session_id").distinct()
    mine = {name: read_version(spark, root, name).join(ids, "session_id", "left_semi") for name in TABLES}
    if "t_sec" not in cleaned.columns:
        at = ["session_id", "channel_idx", "sample_idx"]
        times = mine["samples"].select(*at, "t_sec")
        cleaned = cleaned.join(times, at, "left")
    facts = provenance(mine["sessions"], components, source)
    return write_version(spark, root, {"samples": cleaned, "markers": mine["markers"], "feedback": mine["feedback"], "sessions": facts})
