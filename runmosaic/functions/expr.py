"""Column expressions: scores, pixel values, boxes and size classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
BAND_MEAN = (0.485, 0.456, 0.406)
BAND_STD = (0.229, 0.224, 0.225)
SMALL_BELOW = 100
MEDIUM_BELOW = 500


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_ship(rle: str | Column) -> Column:
    return col(rle).isNotNull().cast("int")


def image_path(base: str, image_id: str | Column) -> Column:
    return F.concat(F.lit(base), col(image_id).cast("string"))


def decide(score: str | Column, threshold: float, inclusive: bool = True) -> Column:
    s = col(score)
    return s >= threshold if inclusive else s > threshold


def binarise(value: str | Column, threshold: float = 0.5) -> Column:
    return (col(value) > threshold).cast("int")


def sigmoid(logit: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(logit)))


def normalise(value: str | Column, band: int) -> Column:
    return (col(value) / 255 - BAND_MEAN[band]) / BAND_STD[band]


def denormalise(value: str | Column, band: int) -> Column:
    return F.least(F.greatest(col(value) * BAND_STD[band] + BAND_MEAN[band], F.lit(0.0)), F.lit(1.0))


def error_confidence(predicted: str | Column, prob: str | Column) -> Column:
    return F.when(col(predicted) == 1, col(prob)).otherwise(1 - col(prob))


def size_class(area: str | Column) -> Column:
    return (F.when(col(area) < SMALL_BELOW, "small").when(col(area) < MEDIUM_BELOW, "medium").otherwise("large"))


def size_filter(area: str | Column, least: int | None = None, most: int | None = None) -> Column:
    keep = F.lit(True)
    if least is not None:
        keep = keep & (col(area) >= least)
    if most is not None:
        keep = keep & (col(area) <= most)
    return keep


def xywh_to_xyxy(x, y, w, h) -> list[Column]:
    x, y, w, h = map(col, (x, y, w, h))
    return [x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")]


def xyxy_to_xywh(x1, y1, x2, y2) -> list[Column]:
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return [x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")]


def pad_box(x1, y1, x2, y2, padding: int, height: int, width: int) -> list[Column]:
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return [F.greatest(x1 - padding, F.lit(0)).alias("x1"), F.greatest(y1 - padding, F.lit(0)).alias("y1"),
            F.least(x2 + padding, F.lit(width)).alias("x2"), F.least(y2 + padding, F.lit(height)).alias("y2")]


def expand_box(x1, y1, x2, y2, ratio: float) -> list[Column]:
    """Scale a box about its centre."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    dx, dy = (x2 - x1) * (ratio - 1) / 2, (y2 - y1) * (ratio - 1) / 2
    return [(x1 - dx).alias("x1"), (y1 - dy).alias("y1"), (x2 + dx).alias("x2"), (y2 + dy).alias("y2")]


def box_area(p: str = "") -> Column:
    return (F.col(f"x2{p}") - F.col(f"x1{p}")) * (F.col(f"y2{p}") - F.col(f"y1{p}"))


def box_overlap(p: str, q: str) -> Column:
    w = F.least(f"x2{p}", f"x2{q}") - F.greatest(f"x1{p}", f"x1{q}")
    h = F.least(f"y2{p}", f"y2{q}") - F.greatest(f"y1{p}", f"y1{q}")
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def box_iou(p: str, q: str) -> Column:
    both = box_overlap(p, q)
    return both / (box_area(p) + box_area(q) - both)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def stable_bce(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy of a logit without overflow."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - target) * logit + (1 + (pos_weight - 1) * target) * soft


def once(value: Column) -> Column:
    """``value`` made once and read as a plain column by what follows, one row each.

    Without it the optimizer repeats a costly text in every place that reads it, and moves filters on it, with the text, down to the scan.
    """
    return F.explode_outer(F.array(value))
