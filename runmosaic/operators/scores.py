"""Classifier reports over (label, prob) tables.

Curves work on one row per distinct score. Ranks and running totals over scores use two levels (block of
scores, then score in block) over a table written once, so that no single task sorts all distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmosaic.functions import expr as X
from runmosaic.session import written


def predicted(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    return df.withColumn("predicted", X.binarise(prob, threshold))


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "predicted") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    df = counts.withColumn("accuracy", X.safe_ratio(tp + tn, tp + tn + fp + fn)) \
        .withColumn("precision", X.safe_ratio(tp, tp + fp)).withColumn("recall", X.safe_ratio(tp, tp + fn)) \
        .withColumn("specificity", X.safe_ratio(tn, tn + fp)).withColumn("npv", X.safe_ratio(tn, tn + fn))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", X.safe_ratio(2 * p * r, p + r))


def per_score(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    return df.groupBy(F.col(prob).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def in_blocks(scores: DataFrame, order: str) -> DataFrame:
    """``scores`` as a table written once, cut into range blocks of ``order`` of about equal size, numbered ``_b``.

    All passes over ranks and running totals read this table and use its one cut. A block holds all rows of a
    value, as many as ``spark.sql.shuffle.partitions`` gives; results do not depend on where the cuts fall.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(scores.repartitionByRange(parts, order).withColumn("_b", F.spark_partition_id()), "blocks")


def running_from_top(blocked: DataFrame, sums: Sequence[str], order: str = "threshold") -> DataFrame:
    """Totals over all scores >= this one, ``cum_<name>``, without a global window.

    ``blocked`` comes from :func:`in_blocks` and has distinct values of ``order``. Totals of the blocks above come from a
    window over one row a block, the rest from a window inside the block.
    """
    totals = blocked.groupBy("_b").agg(*[F.sum(s).alias(s + "_all") for s in sums])
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    lead = totals.select("_b", *[F.coalesce(F.sum(s + "_all").over(above), F.lit(0)).alias(s + "_above") for s in sums])
    inner = Window.partitionBy("_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    # one row a block
    joined = blocked.join(F.broadcast(lead), "_b")
    return joined.select(*blocked.columns, *[(F.sum(s).over(inner) + F.col(s + "_above")).alias("cum_" + s) for s in sums])


def best_from_here_down(blocked: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """``values`` replaced by their maxima over this and all smaller ``order``, in the same two levels.

    Frames run from the smallest value up to the row: one that reaches from a row to the end is summed anew for every row.
    """
    below = Window.orderBy(F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    tops = blocked.groupBy("_b").agg(*[F.max(v).alias("_top_" + v) for v in values])
    lead = tops.select("_b", *[F.max("_top_" + v).over(below).alias("_below_" + v) for v in values])
    inner = Window.partitionBy("_b").orderBy(F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    here = blocked.join(F.broadcast(lead), "_b")
    keep = [c for c in blocked.columns if c not in values]
    return here.select(*keep, *[F.greatest(F.max(v).over(inner), F.col("_below_" + v)).alias(v) for v in values])  # greatest skips null


def quantiles(values: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls do not count, no values give nulls.

    Two refinements of the range: counts per block name the blocks that hold the wanted ranks, and only these are
    counted through. What reaches the driver is one row a block and one a rank.
    """
    per = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    blocked = in_blocks(per, "v")
    sizes = sorted((r._b, r.n) for r in blocked.groupBy("_b").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(shares)
    ranks = {r for q in shares for r in (floor((total - 1) * q), ceil((total - 1) * q))}
    found, before = {}, 0
    wanted = []
    for block, n in sizes:
        wanted += [(block, r, r - before) for r in ranks if before <= r < before + n]
        before += n
    inner = Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counted = blocked.filter(F.col("_b").isin(sorted({b for b, _, _ in wanted}))).withColumn("_past", F.sum("n").over(inner))
    at = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(r).alias("r"), F.lit(k).alias("k")) for b, r, k in wanted])
    hits = counted.select("_b", "v", "n", "_past", F.explode(at).alias("w")).filter("w.b = _b and w.k < _past and w.k >= _past - n")
    found = {r.r: r.v for r in hits.select("w.r", "v").collect()}
    out = []
    for q in shares:
        at = (total - 1) * q
        low, high = found[floor(at)], found[ceil(at)]
        out.append(low + (at - floor(at)) * (high - low))
    return out


def roc_auc(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Area under the ROC curve by pair counting, ties as one half; 0 with one class only."""
    run = running_from_top(in_blocks(per_score(df, label, prob), "threshold"), ["pos"])
    # for each negative: positives strictly above count 1, positives at the same score one half
    won = (F.col("cum_pos") - F.col("pos") + F.col("pos") * 0.5) * F.col("neg").cast("double")
    return run.agg(F.sum(won).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).select(
        X.safe_ratio(F.col("_w"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """fpr and tpr at each distinct score, with the (0, 0) start at an infinite threshold.

    With one class only the rate of the other is 0 everywhere."""
    per = in_blocks(per_score(df, label, prob), "threshold")
    total = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = total.select("p").scalar(), total.select("n").scalar()
    run = running_from_top(per, ["pos", "neg"])
    points = run.select("threshold", X.safe_ratio(F.col("cum_neg"), n).alias("fpr"), X.safe_ratio(F.col("cum_pos"), p).alias("tpr"))
    start = total.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def probability_histogram(df: DataFrame, bins: int = 30, label: str = "label", prob: str = "prob") -> DataFrame:
    """Density per true class on [0, 1]; the last bin is closed."""
    slot = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    n = df.groupBy(label, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(label))  # bins rows per class
    return n.withColumn("density", F.col("n") * bins / total)


def confusion_percent(df: DataFrame, label: str = "label", pred: str = "predicted") -> DataFrame:
    n = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(label)))


def classification_report(df: DataFrame, label: str = "label", pred: str = "predicted") -> DataFrame:
    """Rows 0, 1, accuracy, macro avg and weighted avg, all from one confusion row."""
    c = confusion(df, (), label, pred)
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))

    def prf(hit: Column, false: Column, miss: Column) -> list[Column]:
        p, r = X.safe_ratio(hit, hit + false), X.safe_ratio(hit, hit + miss)
        return [p, r, X.safe_ratio(2 * p * r, p + r)]

    neg, pos = prf(tn, fn, fp), prf(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    acc = X.safe_ratio(tp + tn, n0 + n1)
    rows = [("0", neg, n0), ("1", pos, n1), ("accuracy", [acc, acc, acc], n0 + n1),
            ("macro avg", [(a + b) / 2 for a, b in zip(neg, pos)], n0 + n1),
            ("weighted avg", [X.safe_ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(neg, pos)], n0 + n1)]
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), v[0].alias("precision"), v[1].alias("recall"), v[2].alias("f1"),
                 s.cast("bigint").alias("support")) for name, v, s in rows])))


def errors(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    wrong = df.filter(F.col(label) != F.col("predicted"))
    return wrong.withColumn("confidence", X.error_confidence("predicted", prob))


def error_statistics(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    return errors(df, label, prob).agg(
        F.count(F.lit(1)).alias("total_errors"), F.count_if(F.col(label) == 0).alias("false_positives"),
        F.count_if(F.col(label) == 1).alias("false_negatives"), F.avg("confidence").alias("avg_error_confidence"),
        F.max("confidence").alias("max_error_confidence"))


def top_errors(df: DataFrame, k: int, tie: str, label: str = "label", prob: str = "prob") -> DataFrame:
    return errors(df, label, prob).orderBy(F.desc("confidence"), tie).limit(k)


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], label: str = "label", prob: str = "prob") -> DataFrame:
    """Confusion at each threshold from one pass over per-score counts."""
    per = per_score(df, label, prob).withColumnRenamed("threshold", "score")
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    hit = F.col("score") >= F.col("threshold")
    n = per.select("*", t.alias("threshold")).groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"))
    return rates(n)


def class_balance(df: DataFrame, label: str = "label", split: str | None = None) -> DataFrame:
    by = [split] if split else []
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("bigint").alias("positives"),
                               F.avg(label).alias("positive_rate"))


def class_weights(df: DataFrame, pos_boost: float = 1.0, label: str = "label") -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(pos_boost))).otherwise(F.lit(1.0)) * (1 / F.col("n")))


def submission_stats(pred: DataFrame) -> DataFrame:
    """Distinct images, non-empty rows, rows, and distinct images with a mask."""
    full = F.coalesce(F.col("rle"), F.lit("")) != ""
    per_image = pred.groupBy("image_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("full"))
    return per_image.agg(
        F.count(F.lit(1)).alias("total_images"), F.sum("full").cast("bigint").alias("nonempty_rows"),
        F.sum("rows").cast("bigint").alias("total_rows"), F.count_if(F.col("full") > 0).alias("images_with_ships"))


def batch_summary(log: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return log.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, F.col("ships")).otherwise(0)).cast("bigint").alias("total_ships"),
        F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"))


def latency(log: DataFrame) -> DataFrame:
    return log.agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"), F.min("seconds").alias("min"),
                   F.max("seconds").alias("max"), F.try_divide(F.lit(1.0), F.avg("seconds")).alias("fps"))


def ship_statistics(ships: DataFrame) -> DataFrame:
    """Area statistics; without rows the totals are 0 and the minimum is infinite."""
    a = F.col("area")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ships.agg(
        F.count(a).alias("num_ships"), zero(F.sum(a).cast("double")).alias("total_area"), zero(F.avg(a)).alias("mean_area"),
        zero(F.stddev_pop(a)).alias("std_area"), F.coalesce(F.min(a).cast("double"), F.lit(float("inf"))).alias("min_area"),
        zero(F.max(a).cast("double")).alias("max_area"), F.count_if(X.size_class(a) == "small").alias("small"),
        F.count_if(X.size_class(a) == "medium").alias("medium"), F.count_if(X.size_class(a) == "large").alias("large"))
