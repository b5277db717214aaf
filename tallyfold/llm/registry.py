"""The queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import language_id, quality_classifier
from tallyfold.llm import quality_rules as rules
from tallyfold.llm.byte_bpe import bpe_encode
from tallyfold.llm.jaccard_join import jaccard_join
from tallyfold.llm.mixing import mix_sources
from tallyfold.llm.substring_dedup import substring_dedup
from tallyfold.llm.tool_calls import link_tools
from tallyfold.llm.topk_search import top_k
from tallyfold.llm.scratch import small_batches
from tallyfold.llm.secrets import dictionary, secret_scan, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), k=5, percent=80)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5)


def plain_words() -> tuple[str, ...]:
    return dictionary(*(public_tokenizers.path(f"byte_bpe_{x}.tiktoken") for x in ("50k", "multi_50k")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"), train(spark, plain_words())).drop("redacted")


def _held_out(divisor: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == rest


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    languages, weights = language_id.train(docs.where(~_held_out(5, 0)))
    return language_id.identify(docs, languages, weights).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return top_k(table, table.where("vec_id % 50 = 0"), k=5)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(~_held_out(4, 2))
    weights = quality_classifier.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    scored = quality_classifier.score_quality(docs, weights)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations hold no calls of their own: each user turn is put as a call that waits for the user turn before, each assistant turn as the result of the turn before."""
    rows = _table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    call = F.struct(F.array(F.struct(name.alias("id"), F.lit("reply").alias("name"), F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("arguments"), F.when(F.col("turn") >= 2, F.array(F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string")))).alias("after"))).alias("tool_calls"))
    result = F.struct(F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content"))
    put = F.when(F.col("role") == "user", F.to_json(call)).when(F.col("role") == "assistant", F.to_json(result)).otherwise(F.col("text"))
    schemas = spark.sql("SELECT * FROM VALUES ('reply', 'text', 'string', true), ('reply', 'turn', 'integer', true) AS t(name, key, type, required)")
    return link_tools(rows.select("conv_id", "turn", "role", put.alias("text")), schemas)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_language_id, op3_quality_rules, op4_exact_topk, op5_quality_classifier, op6_substring_dedup, op7_byte_bpe, op8_source_mixing, op9_tool_call_linking, op10_secret_scan)}
TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

SQL: dict[str, str] = {"op3_quality_rules": rules.SQL, "op4_exact_topk": TOPK_SQL}
