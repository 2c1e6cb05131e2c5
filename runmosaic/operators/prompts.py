"""Prompt tables for promptable segmenters: points, boxes, padding, best proposal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmosaic.operators import masks as M


def best_proposal(proposals: DataFrame, ident: str, quality: str, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Proposal with the highest predicted quality, ties to the lower id."""
    best = F.min(F.struct((-F.col(quality)).alias("q"), F.col(ident).alias("i")))
    return proposals.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.i").alias(ident), (-F.col("_b.q")).alias(quality))


def point_prompts(boxes: DataFrame, segments: DataFrame, seed: int, size: tuple[int, int], negatives: int = 2,
                  ident: str = "box_id", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Centre of each box (label 1) and hash-placed points outside the merged mask (label 0)."""
    h, w = size
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in (*keys, ident)])
    spot = lambda k, axis, n: F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{k}:{axis}"))), 1, 13), 16, 10).cast("bigint") % n
    centre = boxes.select(*keys, ident, F.lit(1).alias("label"), F.expr("x1 + (x2 - x1) div 2").alias("x"),
                          F.expr("y1 + (y2 - y1) div 2").alias("y"))
    far = boxes.select(*keys, ident, F.explode(F.array(*[
        F.struct(spot(k, "x", w).alias("x"), spot(k, "y", h).alias("y")) for k in range(negatives)])).alias("_p"))
    far = far.select(*keys, ident, F.lit(0).alias("label"), "_p.x", "_p.y")
    hit = [far[k] == segments[k] for k in keys]
    covered = hit + [far["x"] == segments["col"], far["y"] >= segments["r0"], far["y"] < segments["r1"]]
    return centre.unionByName(far.join(segments, covered, "left_anti"))


def pad_lists(df: DataFrame, batch: str, values: str, zero: Column) -> DataFrame:
    """Pad each list with ``zero`` to the longest list of its batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(values)).alias("_m"))
    joined = df.join(longest, batch)
    pad = F.array_repeat(zero, F.col("_m") - F.size(values))
    return joined.withColumn(values, F.concat(F.col(values), pad)).drop("_m")
