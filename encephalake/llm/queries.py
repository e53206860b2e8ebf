"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, merkle, ngram_join, packing, quality_classifier, quality_rules, sentence_pieces, simhash, spelling, token_files, transcripts, warc
from .tokens import AddedTextEncoder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_warc", warc.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query("op3_sentence_pieces")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), kind=AddedTextEncoder)


@query("op5_exact_dedup", exact_dedup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, table(spark, sf_dir, "documents"))


@query("op6_sum_of_squares_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), kind=AddedTextEncoder)


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(spark, table(spark, sf_dir, "documents"))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op10_transcripts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.recover(spark, table(spark, sf_dir, "conversations"))


@query("op11_ngram_join")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(spark, table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", merkle.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(spark, table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", spelling.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spark, table(spark, sf_dir, "documents"))
