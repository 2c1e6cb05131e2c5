"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmosaic.llm.common import written

TABLES = 8
PROBES = 1 / 8
ROTATIONS = 3
DATA_BLOCK = 8192
QUERY_BLOCK = 512
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signs(tables: int, width: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, ROTATIONS, width))


def axis_scores(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Closeness of each row to the 2 x width signed axes after a pseudo-rotation (signs, then Hadamard, three times)."""
    width = sign.shape[1]
    unit = np.zeros((len(x), width))
    unit[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for s in sign:
        unit = hadamard(unit * s)
    return np.concatenate([unit, -unit], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in one fixed order, so equal vectors give equal sums."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def search_block(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, tables: int = TABLES, probes: float = PROBES):
    """(query number, data number, score) of the ``k`` best candidates of each query in one block, with all ties.

    A row lies in one bucket a table, that of its nearest signed axis; a query looks into the buckets of its
    nearest ``probes`` share of the axes. Only pairs that meet in a bucket are scored.
    """
    width = 1 << max(1, ceil(np.log2(max(2, x.shape[1]))))
    found = np.full((len(q), len(x)), -np.inf)
    for sign in signs(tables, width):
        bucket = axis_scores(x, sign).argmax(axis=1)
        looks = np.argsort(-axis_scores(q, sign), axis=1, kind="stable")[:, :max(1, round(probes * 2 * width))]
        wanted = np.zeros((len(q), 2 * width), bool)
        np.put_along_axis(wanted, looks, True, axis=1)
        order = np.argsort(bucket, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            who = np.flatnonzero(wanted[:, bucket[members[0]]])
            if len(who):
                found[np.ix_(who, members)] = q[who] @ x[members].T
    found[own[:, None] == ids[None, :]] = -np.inf
    kth = np.partition(found, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
    who, what = np.nonzero((found > -np.inf) & (found >= (kth - 1e-9 * (1 + np.abs(kth, where=np.isfinite(kth), out=np.zeros(len(kth)))))[:, None]))
    return who, what, exact(q[who], x[what])


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(good & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: float = PROBES,
            data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``vec_id, embedding`` -> ``query_id, rank, vec_id, score`` by largest inner product.

    Every usable row is indexed, in blocks of about ``data_block`` rows; every query visits every block, and
    within it only its buckets. A task holds one block of rows and one of queries, whatever the table's size
    or skew. Of equal vectors only the ``k + 1`` smallest ids can be in any answer, so further copies are left
    out before the search without changing it. Rows alike in id and vector are one row. Shorter vectors count
    as padded with zeros. Vectors null, empty, zero or with a component null or not finite take no part,
    neither do null ids. Fewer than ``k`` candidates give fewer ranks; an empty table gives no rows.
    """
    kind = "float" if vectors.select("embedding").dtypes[0][1] == "array<float>" else "double"  # floats travel as such and are widened in the tasks
    nought = F.lit(0.0).cast(kind)
    clean = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    clean = clean.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", F.transform("v", lambda c: c + nought).alias("v"), "asks").distinct()
    clean = written(clean, "ann-rows")
    size = clean.agg(F.count("*").alias("n"), F.count_if("asks").alias("m"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    blocks, parts = max(1, ceil(size.n / data_block)), max(1, ceil(size.m / query_block))
    padded = F.concat("v", F.array_repeat(nought, F.lit(size.d) - F.size("v"))).alias("v")
    copy = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    data = clean.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"), F.lit(None).cast("bigint").alias("asked"), "vec_id", padded)
    asks = clean.filter("asks").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("g"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("b"),
                                       F.xxhash64("v").alias("asked"), "vec_id", padded)
    out = "asked bigint, query_id bigint, vec_id bigint, score double"

    def run(t: pa.Table) -> pa.Table:
        asked, ids = t.column("asked").combine_chunks(), t.column("vec_id").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(len(ids), size.d)
        is_row = asked.is_null().to_numpy(zero_copy_only=False)
        rows, q = np.flatnonzero(is_row), np.flatnonzero(~is_row)
        got = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for i in range(0, len(q) if len(rows) else 0, 512):
            part = q[i:i + 512]
            who, what, score = search_block(ids[rows], v[rows], ids[part], v[part], k, tables, probes)
            got.append((part[who], rows[what], score))
        who, what, score = (np.concatenate(x) for x in zip(*got))
        return pa.table({"asked": asked.take(pa.array(who)), "query_id": ids[who], "vec_id": ids[what], "score": score})

    found = data.union(asks).groupBy("g", "b").applyInArrow(run, out)
    rank = F.row_number().over(W.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)
