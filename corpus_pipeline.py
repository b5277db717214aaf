"""The corpus pipeline: five operators after each other, from documents to token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.byte_bpe import bpe_encode
from tallyfold.llm.jaccard_join import jaccard_join
from tallyfold.llm.mixing import mixed
from tallyfold.llm.quality_rules import quality_rules
from tallyfold.llm.registry import plain_words
from tallyfold.llm.scratch import drop, fresh, settle, small_batches
from tallyfold.llm.secrets import secret_scan, train


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text, so that no column's name can clash with one of an operator's own."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, repeated rows repeated; null and empty texts go."""
    return quality_rules(whole(docs), keep=("row",)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the least doc_id, with all its texts if rows of one doc_id differ. Documents
    without words link with none and stay, as do all rows without a doc_id. Of repeated rows of one doc_id and text one stays."""
    small_batches(spark)
    least = settle(jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct())
    # Texts move once, at any size of the two sides.
    kept = docs.where("doc_id IS NOT NULL").join(least.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*rest or ["doc_id"]))
    nth = fresh(docs, "_nth")
    return kept.withColumn(nth, first).where(F.col(nth) == 1).select(docs.columns).unionAll(docs.where("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] for each secret in the text and n_chars counted anew there; null texts stay null."""
    found = secret_scan(whole(docs).withColumn("row", F.col("row").dropFields("text")), train(spark, plain_words()), keep=("row",))
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.col("n_secrets") > 0, F.length("redacted").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, one or two times. Those without words are never taken."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to. A null text has no ids, as an empty one; a copy is coded as often as it is there."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_encode(docs, path, public_tokenizers.PATTERN, ("doc_id", "source"), decode=True)
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Neither the forest nor the merges can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        older, docs = docs, settle(stage(spark, docs, sf_dir))
        drop(older)  # nothing for the documents themselves
    return docs
