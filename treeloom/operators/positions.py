"""Positions, running values and row frames over a whole table.

A window without PARTITION BY would bring all rows to one task. Here the rows
are cut into ranges of the whole order, as many as the table's size asks for,
numbered within each range, and each range's count moves the next ones on. The
cuts come from a bounded sample of the order's values, inside the same query:
nothing runs while it is planned. Frames of a few rows then run in blocks of
BLOCK positions that also hold the few rows before and after them; running
values add what the blocks before have come to.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import QueryError
from ..plans.relation import Rel, column, fresh

#: Rows of a range, about; ranges at most, so that the table of cuts is
#: bounded; rows of the sample for each range.
ROWS, RANGES, SAMPLE = 1 << 16, 1 << 14, 32
BLOCK = 1 << 20
POS = "__pos"


def cuts(rel: Rel):
    """One row: where the ranges begin (``__cuts``, in order) and the steps of a
    search among them (``__steps``, falling powers of two).

    The sample is the rows whose hash is low enough, so many that each range
    has about SAMPLE of them, at most RANGES * SAMPLE in all; a small table is
    one range and has no cuts.
    """
    keys = rel.df.select(rel.place().alias("k"))
    size = rel.df.agg(F.count("*").alias("n"))
    ranges = F.least(F.ceil(F.col("n") / ROWS), F.lit(RANGES))
    size = size.select(ranges.alias("r"), (F.lit(2.0**63) * F.least(F.lit(1.0), ranges * SAMPLE / F.greatest("n", F.lit(1)))).alias("low"))
    some = keys.join(F.broadcast(size), F.lit(True)).where((F.col("r") > 1) & (F.abs(F.xxhash64("k").cast("double")) <= F.col("low")))
    held = some.agg(F.array_sort(F.collect_list("k")).alias("all"), F.max("r").alias("r"))
    at = F.transform(F.sequence(F.lit(1).cast("bigint"), F.coalesce(F.col("r"), F.lit(2)) - 1), lambda i: F.floor(i * F.size("all") / F.col("r")).cast("int"))
    held = held.select(F.transform(F.filter(F.array_distinct(at), lambda i: (i >= 0) & (i < F.size("all"))), lambda i: F.get("all", i)).alias("__cuts"))
    bits = F.sequence(F.ceil(F.log2(F.size("__cuts") + 1)).cast("int"), F.lit(0))
    return held.withColumn("__steps", F.transform(bits, lambda b: F.pow(F.lit(2), b).cast("int")))


def positions(rel: Rel) -> Rel:
    """The relation ordered by a column ``__pos``, 0 to n - 1. Rows that are
    equal in the whole order share a range."""
    if [n for n, _ in rel.order] == [POS]:
        return rel
    order = rel.sorting()
    found = F.aggregate("__steps", F.lit(0), lambda lo, s: F.when((lo + s <= F.size("__cuts")) & (F.get("__cuts", lo + s - 1) <= F.col("__key")), lo + s).otherwise(lo))
    keyed = rel.df.withColumn("__key", rel.place()).join(F.broadcast(cuts(rel)), F.lit(True))
    ranged = keyed.withColumn("__range", found).drop("__key", "__cuts", "__steps")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    # at most RANGES rows
    before = counts.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    local = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    df = ranged.withColumn("__local", local).join(F.broadcast(before), "__range")
    drop = [n for n, _ in rel.order if n not in rel.columns() and n.startswith("__")]
    df = df.withColumn(POS, F.col("__before") + F.col("__local")).drop("__range", "__local", "__before", *drop)
    return replace(rel, df=df, order=[(POS, False)])


def framed(rel: Rel, before: int, after: int, expr):
    """``expr`` of a window over frames that reach at most ``before`` rows back
    and ``after`` rows on: a DataFrame with the column ``__out``."""
    rel = positions(rel)
    if before >= BLOCK or after >= BLOCK:
        raise QueryError(f"frames reach {BLOCK - 1} rows at most")
    at = F.floor(F.col(POS) / BLOCK)
    inner = F.col(POS) % BLOCK
    blocks = F.array_compact(F.array(at, F.when(inner >= BLOCK - before, at + 1) if before else F.lit(None).cast("long"), F.when(inner < after, at - 1) if after else F.lit(None).cast("long")))
    df = rel.df.withColumn("__block", F.explode(blocks))
    over = W.partitionBy("__block").orderBy(POS)
    df = df.withColumn("__out", expr(over)).where(F.col("__block") == at).drop("__block")
    return replace(rel, df=df)


def running(rel: Rel, value, agg, merge):
    """Running aggregate: within blocks by a window, and the blocks before them
    by an aggregate of a row for each block."""
    rel = positions(rel)
    at = F.floor(F.col(POS) / BLOCK)
    df = rel.df.withColumn("__block", at).withColumn("__v", value)
    tag = fresh("r")
    totals = df.groupBy("__block").agg(agg(F.col("__v")).alias("t"))
    carry = totals.select(F.col("__block").alias(tag), agg(F.col("t")).over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)).alias("__carry"))
    over = W.partitionBy("__block").orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__own", agg(F.col("__v")).over(over)).join(carry, F.col("__block") == F.col(tag)).drop(tag)
    df = df.withColumn("__out", F.when(F.col("__carry").isNull(), F.col("__own")).when(F.col("__own").isNull(), F.col("__carry")).otherwise(merge(F.col("__carry"), F.col("__own"))))
    return replace(rel, df=df.drop("__block", "__v", "__carry", "__own"))
