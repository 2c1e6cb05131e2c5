"""Whitening of embeddings with exact integer scatter from bit planes.

Entries become integers; each dimension, shifted to start at zero, is cut into bit planes, and the planes are packed
across rows into 64-row words. The popcount of two planes' AND, weighted by their bits, adds up to the exact
cross-product of two dimensions, so means are taken off as integers before anything is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import written

SCALE, SHIFT = 1024, 100_000
CHUNK = 1 << 15  # rows packed at a time: 512 words a plane


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integers of a column of equally long lists, one row a vector."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= 2.0 ** 62:
        raise ValueError("an entry is too large for an integer of 64 bits")
    return flat.astype(np.int64).reshape(-1, dims) + SHIFT


def chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, list[pa.RecordBatch]]]:
    """Integer matrices of about ``CHUNK`` rows, with the batches they come from."""
    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            held.append(b.slice(i, CHUNK))
            n += held[-1].num_rows
            if n >= CHUNK:
                yield np.concatenate([matrix(h.column("v"), dims) for h in held]), held
                held, n = [], 0
    if n:
        yield np.concatenate([matrix(h.column("v"), dims) for h in held]), held


@dataclass
class Fit:
    """What is needed to whiten: row count, exact sums, and the leading unit eigenvectors (columns) with their values."""

    n: int
    dims: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def ranges(table: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Rows, and least and largest integer of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for x, _ in chunks(batches, dims):
            n += len(x)
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"d": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "low": low, "high": high})

    part = table.select("v").mapInArrow(run, "d int, n bigint, low bigint, high bigint")
    got = part.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return got[0].n, [r.low for r in got], [r.high for r in got]


def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of non-negative columns, dimension by dimension, packed over rows: (planes, words)."""
    words = -(-len(y) // 64)
    out = np.zeros((sum(bits), words), np.uint64)
    k = 0
    for d, n in enumerate(bits):
        for b in range(n):
            packed = np.packbits(((y[:, d] >> b) & 1).astype(np.uint8))
            out.view(np.uint8)[k, :len(packed)] = packed
            k += 1
    return out


def scatter(table: DataFrame, dims: int, low: list[int], bits: list[int]) -> DataFrame:
    """``i, j, power, hits`` (i <= j): rows in which a bit of dimension i and one of j, together worth 2^power, are set.

    Every task keeps one count per pair of planes, whatever its rows, and counts meet in one summing shuffle.
    """
    owner = np.repeat(np.arange(dims), bits)
    place = np.concatenate([np.arange(b) for b in bits]) if sum(bits) else np.zeros(0, np.int64)
    base = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(owner), len(owner)), np.int64)
        for x, _ in chunks(batches, dims):
            p = planes(x - base, bits)
            for k in range(len(p)):
                total[k, k:] += np.bitwise_count(p[k:] & p[k]).sum(1, dtype=np.int64)
        a, b = np.nonzero(total)
        if len(a):
            hits, power, wide = total[a, b], place[a] + place[b], 2 * max(bits)
            # a pair of different planes of one dimension stands for two products
            hits = np.where((owner[a] == owner[b]) & (a != b), 2 * hits, hits)
            cell, at = np.unique((owner[a] * dims + owner[b]) * wide + power, return_inverse=True)
            sums = np.zeros(len(cell), np.int64)
            np.add.at(sums, at, hits)
            yield pa.RecordBatch.from_pydict({"i": cell // wide // dims, "j": cell // wide % dims, "power": cell % wide, "hits": sums})

    return table.select("v").mapInArrow(run, "i bigint, j bigint, power bigint, hits bigint").groupBy("i", "j", "power").agg(F.sum("hits").alias("hits"))


def plane_sums(table: DataFrame, dims: int, low: list[int], bits: list[int]) -> DataFrame:
    """``i, power, hits``: rows in which a bit of a dimension is set."""
    base = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(bits), np.int64)
        for x, _ in chunks(batches, dims):
            total += np.bitwise_count(planes(x - base, bits)).sum(1, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(dims), bits), "power": np.concatenate([np.arange(b) for b in bits]), "hits": total})

    return table.select("v").mapInArrow(run, "i bigint, power bigint, hits bigint").groupBy("i", "power").agg(F.sum("hits").alias("hits"))


def exact_covariance(n: int, sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """(n * sum(y y') - S S') / n^2, whole numbers until the one division."""
    d = len(sums)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    return v


def fit(table: DataFrame, dims: int, components: int) -> Fit:
    """Statistics of all vectors ``v``. What reaches the driver is one number per bit of a dimension and per pair of
    dimensions and bit sum, whatever the rows."""
    n, low, high = ranges(table, dims)
    bits = [(h - l).bit_length() for l, h in zip(low, high)]
    shifted = [0] * dims
    products: dict[tuple[int, int], int] = {}
    if sum(bits):
        for r in plane_sums(table, dims, low, bits).collect():
            shifted[r.i] += r.hits << r.power
        for r in scatter(table, dims, low, bits).collect():
            products[r.i, r.j] = products.get((r.i, r.j), 0) + (r.hits << r.power)
    v = exact_covariance(n, shifted, products)  # covariances do not change with the shift
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Fit(n, dims, [s + n * l for s, l in zip(shifted, low)], vectors, values[order], float(np.trace(v)))


def deviations(x: np.ndarray, f: Fit) -> tuple[np.ndarray, list[int]]:
    """n * x - S (exact; whole numbers of any size where 64 bits do not do) and the sum of its squares by row."""
    most = max((f.n * max(abs(int(x[:, d].min())), abs(int(x[:, d].max()))) + abs(f.sums[d]) for d in range(f.dims)), default=0)
    if most * most * f.dims < 1 << 63:
        dev = f.n * x - np.array(f.sums, np.int64)
    else:
        dev = f.n * x.astype(object) - np.array(f.sums, object)
        if len(dev) and (top := int(np.abs(dev).max())) * top * f.dims < 1 << 63:
            dev = dev.astype(np.int64)
    return dev, [int(s) for s in (dev * dev).sum(1)]


def whiten(table: DataFrame, f: Fit) -> DataFrame:
    """``row, deviation, deviation_exact, w`` of every vector; a component without variance is null in ``w``."""
    alive = f.values > max(1.0, f.trace) * np.finfo(float).eps * f.dims
    gain = np.where(alive, 1 / np.sqrt(np.where(alive, f.values, 1.0)), np.nan)
    kind = table.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, held in chunks(batches, f.dims):
            dev, square = deviations(x, f)
            w = ((dev / f.n).astype(np.float64) @ f.vectors) * gain
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([h.column("row") for h in held]),
                pa.array([s if s < 1 << 63 else None for s in square], pa.int64()), pa.array([str(s) for s in square]),
                pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32)), flat)],
                names=["row", "deviation", "deviation_exact", "w"])

    return table.select("row", "v").mapInArrow(run, f"row {kind}, deviation bigint, deviation_exact string, w array<double>")


def whitened(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable vector and component.

    Vectors that are null or hold null or non-finite entries are dropped. All others must be of one length; the most
    frequent one (the longer of two) is taken, and vectors of another length are dropped too. Repeated rows and null
    ids count row by row. ``deviation`` is null where the exact number, kept as text in ``deviation_exact``, passes
    64 bits. A component without variance has ``whitened`` null; without any variance ``explained`` is null too.
    An empty table gives no rows.
    """
    table = vectors.filter(usable(F.col(vector))).select(F.col(ident).alias("row"), F.col(vector).alias("v"))
    size = table.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = f"{ident} {table.schema['row'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"
    if size is None or size.d == 0:
        return vectors.sparkSession.createDataFrame([], out)
    table = table.filter(F.size("v") == size.d)
    f = fit(table, size.d, components)
    wide = written(whiten(table, f), "whitened")
    k = len(f.values)
    live = [i for i in range(k) if f.values[i] > max(1.0, f.trace) * np.finfo(float).eps * f.dims]
    error = F.lit(None).cast("double")
    if live:
        # centred sums, merged pairwise by the built-in aggregate
        cov = wide.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a in live for b in live if a <= b]).first()
        error = F.lit(max(abs(cov[f"c{a}_{b}"] - (a == b)) for a in live for b in live if a <= b))
    shares = F.array(*[F.lit(float(e / f.trace) if f.trace > 0 else None).cast("double") for e in f.values])
    return wide.select(F.col("row").alias(ident), F.posexplode("w").alias("_c", "whitened"), "deviation", "deviation_exact").select(
        ident, (F.col("_c") + 1).alias("component"), F.lit(f.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_c")).alias("explained"), error.alias("identity_error"), "deviation_exact")
