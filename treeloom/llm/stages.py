"""The stages of the corpus pipeline: from raw documents to token ids.

All but the last take and return the columns of documents, whatever they are;
nulls in other columns, clashing names and empty tables go through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .common import Scratch, lean, small, text_of
from .language_id import choose_margin, identify, learn
from .line_dedup import dedup_lines
from .mixing import mix
from .simhash import similar_groups
from .vocab import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found. Those rejected go: texts that are
    null, empty or hold no letter, and margins that are narrow, by the labelled
    documents that no dictionary is made of. All languages are learned from the
    documents themselves; rows that repeat a text are judged alike, and stay or
    go together; without labels nothing is learned and all go."""
    learned = learn(docs)
    got = identify(docs, learned, min_margin=choose_margin(docs, learned))
    return got.where("lang_accepted").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one, by id and line
    number, null ids first; n_chars becomes that of the text left. Null texts
    stay null; a document whose lines all go stays, with empty lines only; rows
    that repeat id and text are one document and stay alike."""
    return with_length(dedup_lines(docs)).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by a Jaccard similarity of
    0.8 or more of their 5-word shingles: the one with the smallest id, then
    hash of its text. Null ids come last, so a group of null ids keeps one of
    them; of rows that repeat id and text one stays. The groups' table has a
    row for each document; texts are not grouped."""
    scratch = Scratch(spark, "stays")
    rows = similar_groups(docs, shingle=5, similarity=0.8).groupBy("group", "doc_id", "text_key").count()
    low = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "count")).alias("at"))
    stays = scratch.keep(low.select(F.col("at.doc_id").alias("__id"), F.col("at.text_key").alias("__key"), (F.col("at.count") > 1).alias("__more")))
    keyed = docs.withColumn("__key2", F.xxhash64(text_of("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key2") == F.col("__key"))
    single = keyed.join(stays.where("not __more"), same, "left_semi")
    # only rows that repeat id and text are numbered
    order = W.partitionBy("doc_id", "__key2").orderBy(F.xxhash64(*docs.columns))
    more = keyed.join(stays.where("__more"), same, "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return single.select(*docs.columns).unionByName(more.select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more with
    the words it takes beyond that, if any. Documents it does not take go, as
    do those without words. A null source is a source of its own. Rows that
    repeat id, text and source are told apart by a number and their plans dealt
    to them in turn; any of them may get any, as they are alike."""
    scratch = Scratch(spark, "mixed")
    cuts = ["rounds", "size", "a0", "a1", "b0", "b1"]
    key = ["__id", "__key", "__source"]
    plan = mix(docs).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("source").alias("__source"), "taken", *[F.col(c).alias(f"__{c}") for c in cuts])
    plan = plan.withColumn("__more", F.count("*").over(W.partitionBy(*key)) > 1).where("taken > 0").drop("taken")
    same = W.partitionBy(*key).orderBy("__rounds", "__a0", "__a1", "__b0", "__b1")
    plan = scratch.keep(plan.withColumn("__n", F.row_number().over(same)))
    keyed = docs.withColumn("__key2", F.xxhash64("text"))
    of = lambda p: F.col("doc_id").eqNullSafe(p["__id"]) & (F.col("__key2") == p["__key"]) & F.col("source").cast("string").eqNullSafe(p["__source"])
    # texts are not sorted, and shuffled only beside a large plan
    single = plan.where("not __more")
    met = keyed.join(F.broadcast(single) if small(single) else single.hint("shuffle_hash"), of(single))
    # rows that repeat id, text and source are told apart by their number
    more = plan.where("__more")
    keys = scratch.keep(more.select(*key).distinct())
    number = F.row_number().over(W.partitionBy("doc_id", "__key2", "source").orderBy(F.xxhash64(*[c for c in docs.columns if c != "text"])))
    numbered = keyed.join(F.broadcast(keys) if small(keys) else keys, of(keys), "left_semi").withColumn("__n2", number)
    met = met.unionByName(numbered.join(more, of(more) & (F.col("__n2") == more["__n"])).drop("__n2"))
    met = met.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("__rounds").cast("int"))))
    met = met.where("__pass < __rounds or __a1 > __a0 or __b1 > __b0")
    whole = F.expr("__pass < __rounds or __a1 - __a0 = __size or __b1 - __b0 = __size")
    met = met.select(*docs.columns, F.when(whole, F.array().cast("array<bigint>")).otherwise(F.array("__b0", "__b1", "__a0", "__a1")).alias("__cut"))
    return with_length(met.mapInArrow(lean(_cut(docs.columns.index("text"))), docs.schema))


def _cut(at: int):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def taken(text, cut):
        """Words cut[0]-cut[1] and cut[2]-cut[3] of a text, as they stand."""
        if not cut:
            return text
        spans = [m.span() for m in word.finditer(text)]
        return "\n".join(text[spans[a][0]:spans[z - 1][1]] for a, z in (cut[:2], cut[2:]) if z > a)

    def run(batches):
        for b in batches:
            cols = list(b.columns[:-1])
            cols[at] = pa.array([taken(t, c) for t, c in zip(cols[at].to_pylist(), b.columns[-1].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return run


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document its id, number of tokens and digests of ids and bytes;
    null text counts as empty, repeated rows are kept as they are."""
    return round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, made that of the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Compression sizes, fingerprints and token ids are not SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
