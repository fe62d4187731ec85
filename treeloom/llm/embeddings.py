"""Embedding near-dedup: random-hyperplane tables, exact cosine, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components, forest

BUCKET = 256
CELL = 2048


def table_shape(vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET vectors, and as many tables as
    keep the chance of missing a pair right at the threshold under ``miss``."""
    bits = min(30, max(2, math.ceil(math.log2(max(1, vectors) / BUCKET)))) if vectors > BUCKET else 1
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    if same >= 1:
        return bits, 1
    return bits, math.ceil(math.log(miss) / math.log(1 - same ** bits))


def _sign(bits: int, tables: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vecs = b.column(1)
            sig = np.zeros((len(vecs), tables), dtype=np.int32)
            lens = np.array([len(v) for v in vecs])
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lens)
            for dim in np.unique(lens):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                at = np.flatnonzero(lens == dim)
                rows = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                on = (rows @ planes[dim] >= 0).reshape(len(at), tables, bits)
                sig[at] = (on * (1 << np.arange(bits))).sum(axis=2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), tables).cast(pa.list_(pa.int32()))], ["cid", "sig"])

    return run


def _cells(threshold: float):
    """Compare the rows of one cell: those of chunk i with those of chunk j, or
    a chunk with itself. A pair counts in the first table where it meets."""
    def cell(key, rows: pa.Table):
        table, i, j = (int(v) for v in key)
        cid = rows["cid"].to_numpy()
        cnt = rows["cnt"].to_numpy()
        chunk = rows["chunk"].to_numpy()
        vec = np.array(rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(cid), -1)
        sig = rows["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)[:, :table]
        norm = np.sqrt((vec * vec).sum(axis=1))
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        links, a, b = np.zeros(len(cid), dtype=np.int64), [], []
        for s in range(0, len(left), 256):
            x = left[s:s + 256]
            p, q = np.nonzero(vec[x] @ vec[right].T >= threshold * norm[x][:, None] * norm[right][None, :] * (1 - 1e-12))
            p, q = x[p], right[q]
            if i == j:
                up = q > p
                p, q = p[up], q[up]
            if table and len(p):
                new = ~(sig[p] == sig[q]).any(axis=1)
                p, q = p[new], q[new]
            if len(p):
                ok = np.einsum("ij,ij->i", vec[p], vec[q]) / (norm[p] * norm[q]) >= threshold
                p, q = p[ok], q[ok]
                np.add.at(links, p, cnt[q])
                np.add.at(links, q, cnt[p])
                a.append(p)
                b.append(q)
        ids, to, n = [], [], []
        hit = links > 0
        if hit.any():
            x, y = forest(np.concatenate(a), np.concatenate(b))
            ids = np.concatenate([cid[hit], cid[x]])
            to = np.concatenate([np.full(hit.sum(), -1), cid[y]])
            n = np.concatenate([links[hit], np.zeros(len(x), dtype=np.int64)])
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(to, pa.int64()), "n": pa.array(n, pa.int64())})

    def run(key, rows):
        return cell([k.as_py() for k in key[3:]], rows)

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, seed: int = 42,
                     id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Near-duplicate groups of vectors with the same, non-null label.

    Equal vectors are first joined into classes. Classes hash to the sign
    pattern of random hyperplanes in several tables; classes that meet in a
    bucket are compared by cosine in double precision, so no pair below the
    threshold links, and a pair at the threshold is missed with chance
    ``miss``. A bucket of over CELL classes is dealt to cells of two chunks,
    which together hold every pair once, so no task takes a whole hot bucket;
    a cell sends back counts and a spanning forest, not its pairs.

    Returns one row per input row: vec_id, n_links (other rows linked
    directly), component_id (smallest id reachable), kept (vec_id is the
    component_id). Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows with a null label, link with nothing;
    vectors of different lengths do not link. A null id takes part and is
    never the smallest. Repeated rows link with each other. An empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), label.alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = scratch.keep(rows.where(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("cnt"))
                           .withColumn("cid", F.monotonically_increasing_id()))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_shape(most, threshold, miss)
    signs = classes.select("cid", "embedding").mapInArrow(_sign(bits, tables, seed), "cid long, sig array<int>")
    signs = scratch.keep(signs)
    keyed = (classes.join(signs, "cid").select("*", F.size("embedding").alias("dim"), F.posexplode("sig").alias("t", "s"))
             .withColumnRenamed("t", "table"))
    full = (signs.join(classes.select("cid", "label", F.size("embedding").alias("dim")), "cid").select("label", "dim", F.posexplode("sig").alias("table", "s"))
            .groupBy("label", "dim", "table", "s").agg(F.ceil(F.count("*") / CELL).alias("chunks"), F.count("*").alias("m")).where("m > 1").drop("m"))
    keyed = keyed.join(full, ["label", "dim", "table", "s"])
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    keyed = keyed.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    found = scratch.keep(
        keyed.select("label", "dim", "s", "table", "i", "j", "cid", "cnt", "chunk", "embedding", "sig")
        .groupBy("label", "dim", "s", "table", "i", "j").applyInArrow(_cells(threshold), "a long, b long, n long"))
    comp = connected_components(found.where("b >= 0").select("a", "b"), scratch)
    links = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    known = (classes.select("cid", "low", "cnt").join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
             .select("cid", "low", F.coalesce("component", "cid").alias("component"), (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    known = scratch.keep(known)
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = classes.select("cid", "label", "embedding").join(known.join(lows, "component").select("cid", "component_id", "n_links"), "cid").drop("cid")
    linked = rows.where(fine).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"),
                                            F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
