"""Splits, samples, weighted draws and augmentation plans.

Every random choice is a hash of (seed, key): reruns and repartitioning give the same rows.
Exact-size splits need ranks; these come from hash buckets (count per bucket, prefix over the
bucket table, rank inside a bucket) instead of one global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmosaic.operators import masks as M


def draw(seed: int, *keys: str) -> Column:
    """Hex text that orders rows at random but repeatably."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(hex_text: Column) -> Column:
    """[0, 1) from the first 13 hex digits (52 bits, exact in a double)."""
    return F.conv(F.substring(hex_text, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet null keys; the keys come once."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return a.join(right, same).drop(*[f"_k_{k}" for k in keys])


def hash_rank(df: DataFrame, seed: int, key: Sequence[str], by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """0-based ``rank`` in hash order and total ``n``, per group ``by``; null is a group like any other.

    ``digits`` hex digits of the hash make the buckets (16 ** digits a group).

    ``key`` must tell rows apart. Buckets are hashes of unique keys, so they stay even however
    the groups are skewed.
    """
    marked = df.withColumn("_h", draw(seed, *key)).withColumn("_b", F.substring("_h", 1, digits))
    count = marked.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # at most 16 ** digits rows per group
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = count.select(*by, "_b", before.alias("_s"), F.sum("_c").over(w).alias("n"))
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *key)) - 1
    ranked = null_safe_join(marked.withColumn("_r", local), start, [*by, "_b"])
    return ranked.withColumn("rank", F.col("_r") + F.col("_s")).drop("_h", "_b", "_r", "_s")


def split_exact(df: DataFrame, test_fraction: float, seed: int, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``split`` = val for ceil(n * fraction) rows (per group of ``by``), else train."""
    r = hash_rank(df, seed, key, by)
    return r.withColumn("split", F.when(F.col("rank") < F.ceil(F.col("n") * F.lit(test_fraction)), "val").otherwise("train")).drop("rank", "n")


def split_threshold(df: DataFrame, test_fraction: float, seed: int, key: Sequence[str]) -> DataFrame:
    """Split of expected size by hash threshold; no shuffle at all."""
    return df.withColumn("split", F.when(uniform(draw(seed, *key)) < test_fraction, "val").otherwise("train"))


def split_images(manifest: DataFrame, seed: int, train: float = 0.8, val: float = 0.1, image: str = "image_id") -> DataFrame:
    """Whole images to train, val, test (sizes truncated), joined back to all their rows."""
    ids = hash_rank(manifest.select(image).distinct(), seed, [image])
    n_train, n_val = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    part = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    return manifest.join(ids.select(image, part.alias("split")), image)


def sample_fraction(df: DataFrame, fraction: float, seed: int, key: Sequence[str]) -> DataFrame:
    return df.filter(uniform(draw(seed, *key)) < fraction)


def complement(df: DataFrame, part: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(part.select(*key), list(key), "left_anti")


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows in hash order (top-n per task, then merge)."""
    return df.withColumn("_h", draw(seed, *key)).orderBy("_h", *key).limit(n).drop("_h")


def weighted_draws(df: DataFrame, n: int, seed: int, key: Sequence[str], label: str = "label", pos_boost: float = 1.0) -> DataFrame:
    """``n`` draws with replacement, row weight = boost / class count.

    A draw picks a class by total class weight, then a position inside it; rows are found by an
    equi join on (class, position).
    """
    ranked = hash_rank(df, seed, key, [label])
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    boost = F.when(F.col(label) == 1, F.lit(float(pos_boost))).otherwise(F.lit(1.0))
    share = per.select(label, "_n", boost.alias("_w"))  # one row per class
    w = Window.partitionBy(F.lit(0)).orderBy(label)
    share = share.select(label, "_n", (F.sum("_w").over(w) - F.col("_w")).alias("_lo"), F.sum("_w").over(w).alias("_hi"),
                         F.sum("_w").over(Window.partitionBy(F.lit(0))).alias("_all"))
    classes = share.agg(F.array_sort(F.collect_list(F.struct(label, "_n", "_lo", "_hi", "_all"))).alias("c")).scalar()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), classes.alias("_c"))
    u = uniform(F.md5(F.concat_ws(":", F.lit(f"{seed}:class"), F.col("draw").cast("string"))))
    v = uniform(F.md5(F.concat_ws(":", F.lit(f"{seed}:row"), F.col("draw").cast("string"))))
    picked = draws.select("draw", u.alias("_u"), v.alias("_v"), "_c").withColumn(
        "_k", F.expr("filter(_c, x -> _u * x._all >= x._lo and _u * x._all < x._hi)[0]"))
    spot = picked.select("draw", F.col(f"_k.{label}").alias(label), F.floor(F.col("_v") * F.col("_k._n")).alias("rank"))
    return null_safe_join(spot, ranked, [label, "rank"]).select("draw", *df.columns)


def chunk_shuffle(df: DataFrame, chunk: int, seed: int, position: str) -> DataFrame:
    """``chunk`` number by position and random ``slot`` inside the chunk."""
    cut = df.withColumn("chunk", F.expr(f"{position} div {chunk}"))
    w = Window.partitionBy("chunk").orderBy(draw(seed, position), position)  # ``chunk`` rows
    return cut.withColumn("slot", F.row_number().over(w) - 1)


def augment_plan(images: DataFrame, seed: int, epoch: int, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Horizontal flip, vertical flip and quarter turns per image and epoch."""
    h = F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *[F.col(k).cast("string") for k in keys]))
    digit = lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    return images.select(*keys, (digit(1) < 8).alias("hflip"), (digit(2) < 8).alias("vflip"), (digit(3) % 4).alias("turns"))


def augment_segments(segments: DataFrame, plan: DataFrame, size: int, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Flips, then anticlockwise quarter turns, of square masks; the result is merged segments.

    Half turns and flips keep column intervals; a quarter turn makes rows into columns, so only
    those masks pass through pixels.
    Masks are merged and placed by image before they are turned, so pixels are merged again where they are made.
    """
    s = M.union(segments, keys, place=True).join(plan, list(keys))
    c = F.when(F.col("hflip"), size - 1 - F.col("col")).otherwise(F.col("col"))
    a = F.when(F.col("vflip"), size - F.col("r1")).otherwise(F.col("r0"))
    b = F.when(F.col("vflip"), size - F.col("r0")).otherwise(F.col("r1"))
    s = s.select(*keys, "turns", c.alias("col"), a.alias("r0"), b.alias("r1"))
    half = s.filter(F.col("turns") % 2 == 0)
    flip = F.col("turns") == 2
    half = half.select(*keys, F.when(flip, size - 1 - F.col("col")).otherwise(F.col("col")).alias("col"),
                       F.when(flip, size - F.col("r1")).otherwise(F.col("r0")).alias("r0"),
                       F.when(flip, size - F.col("r0")).otherwise(F.col("r1")).alias("r1"))
    turned = s.filter(F.col("turns") % 2 == 1).select(*keys, "turns", "col", F.explode(F.expr("sequence(r0, r1 - 1)")).alias("row"))
    left = F.col("turns") == 1
    row = F.when(left, size - 1 - F.col("col")).otherwise(F.col("col"))
    turned = turned.select(*keys, F.when(left, F.col("row")).otherwise(size - 1 - F.col("row")).alias("col"),
                           row.alias("r0"), (row + 1).alias("r1"))
    return M.union(half.unionByName(turned), keys, few=True)
