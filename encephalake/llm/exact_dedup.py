"""Exact duplicates through a persistent digest index, bucketed and sorted by digest.

Texts are equal when they agree without white space. The index is a bucketed table
(digest, keep_id, points, group_size, batch). A new batch is reduced to one row per digest,
checked by a sort-merge anti-join (the index side needs neither shuffle nor sort), and what
is new is appended. All of it is DataFrame operations.

Null text counts as empty. Of equal texts the one with the most code points stays, then the
smallest id; a null id loses to any other. Rows repeated with id and text share one decision.
An empty batch leaves the index as it is. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, fresh_path, join_by_count, partitions, written

_COLUMNS = "digest string, keep_id bigint, points int, group_size bigint, batch string"


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table in the catalog, stored at ``path``."""

    name: str
    path: str
    buckets: int


def open_index(spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """Create an index, or register one that an earlier session left at ``path``."""
    name = name or f"digest_index_{uuid.uuid4().hex}"
    path = path or fresh_path(spark, name)
    buckets = buckets or partitions(spark)
    spark.sql(
        f"create table if not exists {name} ({_COLUMNS}) using parquet "
        f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
    )
    return DigestIndex(name, path, buckets)


def digest_of(text: str):
    """SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE + "+", ""), 256)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, points): points are the code points of the whole text."""
    points = F.length(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).cast("long").alias("doc_id"), digest_of(text).alias("digest"), points.alias("points"))


def ingest(spark: SparkSession, index: DigestIndex, entries: DataFrame) -> DataFrame:
    """Append the digests of ``entries`` that the index lacks; one decision per row of ``entries``.

    Returns (doc_id, keep_id, group_size, kept, text_sha256). ``group_size`` counts the rows
    of the batch that brought the digest; a later batch keeps none of them.
    """
    entries = written(entries, "digests")
    batch = uuid.uuid4().hex
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))).alias("best")
    winners = (
        entries.groupBy("digest")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("points"), "group_size", F.lit(batch).alias("batch"))
    )
    known = spark.table(index.name)
    fresh = winners.repartition(index.buckets, "digest").join(known.select("digest").hint("merge"), "digest", "left_anti")
    fresh.write.format("parquet").bucketBy(index.buckets, "digest").sortBy("digest").mode("append").option("path", index.path).saveAsTable(index.name)
    found = spark.table(index.name).select("digest", "keep_id", "group_size", "batch")
    return join_by_count(entries, found, "digest", "group_size", entries.count()).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Decisions for one table against an index of its own."""
    return ingest(spark, open_index(spark), digests(docs, key, text))


ORACLE = r"""
with n as (select doc_id, coalesce(text, '') as t from documents),
h as (select doc_id, length(t) as points, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as digest from n),
k as (select *, first_value(doc_id) over (partition by digest order by points desc, doc_id) as keep_id,
             count(*) over (partition by digest) as group_size from h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, digest as text_sha256 from k
"""
