"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch

WEIGHTS = (3, 1, 2)
#: Shards of a source at most, which one task plans.
MOST_SHARDS = 1 << 16


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1); ties go to the first.

    ``most`` bounds each entry; what a full entry cannot take goes to the next
    highest quotients. The divisor is bisected, the last seats are dealt by
    quotient, so the cost does not depend on the number of seats.
    """
    votes = np.asarray(votes, dtype=np.float64)
    most = np.full(len(votes), np.iinfo(np.int64).max // 4, dtype=np.int64) if most is None else np.asarray(most, dtype=np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0 or not len(votes):
        return np.zeros(len(votes), dtype=np.int64)
    dealt = lambda d: np.minimum(np.floor(np.minimum(votes / d + 0.5, 4e18)), most).astype(np.int64)
    high = votes.max() * 2.000001
    low = high
    while dealt(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if dealt(mid).sum() >= seats else (low, mid)
    got = dealt(high)
    while (short := seats - got.sum()) > 0:
        quotient = np.where(got < most, votes / (2 * got + 1), -1.0)
        for i in np.lexsort((np.arange(len(votes)), -quotient))[: int(short)]:
            if quotient[i] > 0:
                got[i] += 1
    return got


def water_fill(caps: np.ndarray, weights: np.ndarray, total: float) -> np.ndarray:
    """Shares of total by weight, none above its cap; what is over is dealt
    again by weight among the rest."""
    out, open_ = np.zeros(len(caps)), caps > 0
    left = min(float(total), float(caps.sum()))
    while open_.any():
        share = left * weights / weights[open_].sum()
        full = open_ & (share >= caps)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = caps[full]
        left -= float(caps[full].sum())
        open_ &= ~full
    return out


def _plan_sources(weights, budget, most, block):
    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        null = rows["source"].isna()
        rows = rows.assign(_last=null, _key=rows["source"].fillna("")).sort_values(["_last", "_key"]).reset_index(drop=True)
        size = rows["source_size"].to_numpy(dtype=np.float64)
        w = np.array([weights[i % len(weights)] for i in range(len(rows))], dtype=np.float64)
        target = water_fill(most * size, w, budget * size.sum())
        quota = sainte_lague(target, round(target.sum() / block), np.ceil(most * size / block))
        return pd.DataFrame({"source": rows["source"], "source_size": rows["source_size"], "shards": rows["shards"], "target": target, "quota": quota})
    return plan


def _plan_shards(most, block):
    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard").reset_index(drop=True)
        words = rows["shard_size"].to_numpy(dtype=np.int64)
        got = sainte_lague(words, int(rows["quota"].iloc[0]), -(-most * words // block))
        return rows.assign(take=np.minimum(got * block, most * words))[["source", "shard", "shard_size", "take"]]
    return plan


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: int = 2, block_tokens: int = 16, shard_docs: int = 4096,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes.

    Sources in code-point order, null last, have ``weights`` in turn and share
    ``budget`` times all words, none above ``most`` times its own. A source's
    documents lie in a seeded order in shards of about ``shard_docs``
    documents, or MOST_SHARDS larger ones; blocks of ``block_tokens`` words are apportioned to the sources
    and then to the shards of each source. A shard takes whole rounds of
    itself and then the blocks that follow a seeded place, round the end.

    Returns, per row: doc_id, source, text_key, size, source_size, target,
    taken, rounds (whole passes), and the two word ranges taken beyond them,
    a0-a1 and b0-b1 (the second after the turn round the end).

    Null text has size 0; a null source is a source of its own, the last;
    repeated rows count each; an empty table gives no rows; other columns are
    ignored. One task holds a row for each source, and for each source a row
    for each shard, MOST_SHARDS at most; documents never meet in a group larger than a shard.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text_col).alias("text_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")))
    sources = (sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.least(F.ceil(F.count("*") / shard_docs), F.lit(MOST_SHARDS)).alias("shards"))
               .withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_plan_sources(tuple(weights), budget, most, block_tokens),
                                                "source string, source_size long, shards long, target double, quota long"))
    sources = scratch.keep(sources)
    placed = (sized.join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
              .withColumn("place", F.xxhash64("doc_id", "text_key", F.lit(seed)))
              .withColumn("shard", F.pmod(F.xxhash64("place", F.lit(seed)), F.col("shards"))))
    shards = (placed.groupBy("source", "shard", "quota").agg(F.sum("size").alias("shard_size"))
              .groupBy("source").applyInPandas(_plan_shards(most, block_tokens), "source string, shard long, shard_size long, take long"))
    shards = scratch.keep(shards.select(F.col("source").alias("s2"), F.col("shard").alias("shard2"), "shard_size", "take"))
    order = W.partitionBy("source", "shard").orderBy("place", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - F.col("size"))
    laid = laid.join(shards, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("shard2")))
    full = F.greatest("shard_size", F.lit(1))
    laid = (laid.withColumn("rounds", F.floor(F.col("take") / full)).withColumn("extra", F.col("take") % full)
            .withColumn("from", F.pmod(F.xxhash64("s2", "shard", F.lit(seed + 1)), full)))
    part = lambda a, b: (F.least(F.greatest(F.col("start"), a), F.col("stop")) - F.col("start"),
                         F.greatest(F.least(F.col("stop"), b), F.col("start")) - F.col("start"))
    a = part(F.col("from"), F.least(F.col("from") + F.col("extra"), full))
    b = part(F.lit(0), F.greatest(F.col("from") + F.col("extra") - full, F.lit(0)))
    laid = laid.withColumns({"a0": a[0], "a1": F.greatest(a[0], a[1]), "b0": b[0], "b1": F.greatest(b[0], b[1])})
    taken = F.col("rounds") * F.col("size") + (F.col("a1") - F.col("a0")) + (F.col("b1") - F.col("b0"))
    return laid.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"),
                       "rounds", "a0", "a1", "b0", "b1")
