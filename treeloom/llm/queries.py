"""Queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stages
from .byte_bpe import round_trip
from .embeddings import embedding_groups
from .exact_dedup import exact_dedup
from .html_text import extract
from .language_id import held_out, identify, learn
from .line_dedup import dedup_lines
from .mixing import mix
from .simhash import simhash_groups
from .token_counts import count_tokens
from .token_files import token_checks, token_files
from .vocab import vocabulary


#: Narrower margins than this share of the bytes are rejected: texts that two
#: dictionaries shorten alike.
MIN_MARGIN = 0.01


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), spans=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_checks(token_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", "text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = learn(docs.where(~held_out()))
    got = identify(docs.select("doc_id", "text"), learned, min_margin=MIN_MARGIN)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_mixing, op2_simhash, op3_embedding_dedup, op4_token_counts, op5_byte_bpe, op6_token_files, op7_line_dedup, op8_exact_dedup,
           op9_language_id, op10_html_text, pipeline]
    return {f.__name__: f for f in ops}


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL}
