"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, text_of

FIRST_DIGIT = 64
GROWTH = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts; the row with the largest id stays.

    Most-significant digit first: the first digit of a text is its length and
    its first 64 bytes, the next ones are 16 times as many bytes each. A level
    groups (group, digit) with map-side combining, so thousands of copies cost
    a row for each task; groups of one row are done, so are groups whose bytes
    have ended, the others go on. Bytes are compared themselves: no digest.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. Null text counts as empty. Null ids sort below all others.
    Rows that repeat both id and text count in group_size and are kept alike,
    since no column tells them apart. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("rest"))
    rows = rows.select("doc_id", F.octet_length("rest").alias("n"), F.substring("rest", 1, FIRST_DIGIT).alias("digit"),
                       F.sha2("rest", 256).alias("text_sha256"), "rest")
    groups = scratch.keep(
        rows.groupBy("n", "digit").agg(F.count("*").alias("size"))
        .where("size > 1").withColumn("gid", F.monotonically_increasing_id()))
    tied = F.broadcast(groups) if small(groups) else groups
    met = rows.join(tied, ["n", "digit"], "left")
    alone = met.where("gid is null").select("doc_id", F.col("doc_id").alias("keep_id"),
                                            F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    going = scratch.keep(
        met.where("gid is not null").select("doc_id", "gid", "size", F.greatest(F.col("n") - FIRST_DIGIT, F.lit(0)).alias("left"), "text_sha256",
                                            F.expr(f"substring(rest, {FIRST_DIGIT + 1})").alias("rest")))
    ended, width = [], FIRST_DIGIT * GROWTH
    while True:
        ended.append(going.where("size = 1 or left = 0").select("doc_id", "gid", "text_sha256"))
        more = going.where("size > 1 and left > 0")
        if more.isEmpty():
            break
        more = more.withColumn("digit", F.substring("rest", 1, width))
        split = scratch.keep(
            more.groupBy("gid", "digit").agg(F.count("*").alias("size"))
            .withColumn("sub", F.monotonically_increasing_id()))
        tied = F.broadcast(split) if small(split) else split
        # ids of a level do not meet those of another: the level's number goes in front
        going = scratch.keep(
            more.drop("size").join(tied, ["gid", "digit"])
            .select("doc_id", (F.lit(len(ended)) * F.lit(1 << 56) + F.col("sub")).alias("gid"), "size",
                    F.greatest(F.col("left") - width, F.lit(0)).alias("left"), "text_sha256",
                    F.expr(f"substring(rest, {width + 1})").alias("rest")))
        width *= GROWTH
    members = ended[0]
    for part in ended[1:]:
        members = members.unionByName(part)
    best = members.groupBy("gid").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = members.join(best, "gid").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(same)
