"""Box joins, non-maximum suppression, matching, F-beta and average precision.

Boxes are half-open integer or double rectangles ``x1, y1, x2, y2`` per image. Pairs are found
through the cells of a grid in levels, and a pair is taken only in the cell that holds the top-left corner of its overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runmosaic.functions import expr as X
from runmosaic.operators import masks as M
from runmosaic.operators import scores as C
from runmosaic.operators.graph import greedy_drop
from runmosaic.operators.grouped import Columns, batched_map, merged_runs
from runmosaic.session import shared_path, written

# fixed values
IOU_STEPS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
RECALL_POINTS = 101


def _level(side: str, cell: int) -> Column:
    """Level of a box: its cells are at least as long as its longer side."""
    long = F.greatest(F.col("x2" + side) - F.col("x1" + side), F.col("y2" + side) - F.col("y1" + side))
    return F.greatest(F.ceil(F.log2(F.greatest(long, F.lit(1)) / cell)), F.lit(0)).cast("int")


def _spread(df: DataFrame, side: str, ident: str, keys: Sequence[str], cell: int, extra: Sequence[str], levels: Column, own_role: int) -> DataFrame:
    """Boxes in the cells they touch: at their own level under ``own_role``, at the levels to look up under the other."""
    df = df.select(*keys, F.col(ident).alias("id" + side), *[F.col(n).alias(n + side) for n in ("x1", "y1", "x2", "y2", *extra)])
    own = _level(side, cell)
    # boxes of one level meet under role 0 alone
    above = F.filter("_levels", (lambda l: l > own) if own_role == 0 else (lambda l: l >= own))
    # listed only where the other table has boxes that look up this level
    asked = F.exists("_levels", (lambda l: l <= own) if own_role == 0 else (lambda l: l < own))
    at = F.concat(F.when(asked, F.array(F.struct(F.lit(own_role).alias("_role"), own.alias("_lv")))).otherwise(F.array().cast("array<struct<_role:int,_lv:int>>")),
                  F.transform(above, lambda l: F.struct(F.lit(1 - own_role).alias("_role"), l.alias("_lv"))))
    df = df.withColumn("_levels", levels).withColumn("_at", F.explode(at)).select("*", "_at.*").drop("_at", "_levels")
    cells = lambda a, b: F.expr(f"sequence(cast(floor({a} / ({cell}L << _lv)) as bigint), cast(floor(({b} - 1e-9) / ({cell}L << _lv)) as bigint))")
    return (df.withColumn("_cx", F.explode(cells(f"x1{side}", f"x2{side}")))
            .withColumn("_cy", F.explode(cells(f"y1{side}", f"y2{side}"))))


def overlapping(a: DataFrame, b: DataFrame, id_a: str, id_b: str, keys: Sequence[str] = M.KEYS, cell: int = 64,
                extra_a: Sequence[str] = (), extra_b: Sequence[str] = (), sizes: DataFrame | None = None) -> DataFrame:
    """Pairs of boxes with positive overlap: ``id_a, id_b``, both boxes and their IoU.

    Cells come in levels, each twice as long as the one below. A box is listed at the level of its own size and looks
    up larger boxes at the levels that the other table has, so it takes at most four cells a level whatever its size.
    ``sizes`` is a table that holds boxes of all their sizes, where that is cheaper to read than ``a`` and ``b``.
    """
    # at most one entry per power of two between the cell and the largest box
    levels = lambda df: F.coalesce(df.select(_level("", cell).alias("l")).filter("l is not null").agg(F.collect_set("l").alias("l")).scalar(),
                                   F.array().cast("array<int>"))
    of_a = levels(a if sizes is None else sizes)
    of_b = of_a if b is a or sizes is not None else levels(b)
    pairs = _spread(a, "_a", id_a, keys, cell, extra_a, of_b, 1).join(_spread(b, "_b", id_b, keys, cell, extra_b, of_a, 0), [*keys, "_role", "_lv", "_cx", "_cy"])
    side = F.expr(f"{cell}L << _lv")
    home = (F.floor(F.greatest("x1_a", "x1_b") / side) == F.col("_cx")) & (F.floor(F.greatest("y1_a", "y1_b") / side) == F.col("_cy"))
    return (pairs.filter(home & (X.box_overlap("_a", "_b") > 0))
            .withColumn("overlap", X.box_overlap("_a", "_b")).withColumn("iou", X.box_iou("_a", "_b")).drop("_role", "_lv", "_cx", "_cy"))


BLOCK = 1024


def block_of(x: Column | str, y: Column | str) -> Column:
    """Number of the square block a point lies in; two blocks may share a number, which only makes them one."""
    at = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / BLOCK)
    return (at(x) * 1_000_003 + at(y)).cast("bigint")


def conflicts(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of boxes as edges for :func:`greedy_drop`."""
    return pairs.select(*keys, "id_a", "id_b", block_of("x1_a", "y1_a").alias("blk_a"), block_of("x1_b", "y1_b").alias("blk_b"))


def nms(boxes: DataFrame, threshold: float, ident: str = "box_id", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Greedy non-maximum suppression: by falling score (ties: lower id), a box goes when a kept
    box overlaps it with IoU above the threshold.

    Copies of one rectangle are first reduced to the best of them, which greedy order would keep
    anyway, so a pile of copies makes no pairs. The rest is settled block by block
    (:func:`runmosaic.operators.graph.greedy_drop`).
    """
    best = boxes.groupBy(*keys, "x1", "y1", "x2", "y2").agg(
        F.min(F.struct((-F.col("score")).alias("_o"), F.col(ident).alias("_id"))).alias("_b"))
    best = best.select(*keys, F.col("_b._id").alias(ident), "x1", "y1", "x2", "y2", (-F.col("_b._o")).alias("score"))
    pairs = overlapping(best, best, ident, ident, keys, extra_a=["score"], extra_b=["score"], sizes=boxes)
    return _suppress(best, pairs, threshold, ident, keys)


def _suppress(ranked: DataFrame, pairs: DataFrame, threshold: float, ident: str, keys: Sequence[str]) -> DataFrame:
    """What the greedy pass leaves of ``ranked``, given the pairs ``id_a, id_b, score_a, score_b, iou``."""
    better = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("id_a") < F.col("id_b")))
    dropped = greedy_drop(conflicts(pairs.filter((F.col("iou") > threshold) & better), keys), keys)
    if dropped is None:
        return ranked
    return ranked.join(dropped.withColumnRenamed("id_b", ident), [*keys, ident], "left_anti")


def mask_nms(segments: DataFrame, scores: DataFrame, threshold: float, ident: str = "box_id", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Greedy suppression by mask IoU: ``segments`` carry ``ident``, ``scores`` has ``ident, score``."""
    a = segments.select(*keys, F.col(ident).alias("box_id"), "col", "r0", "r1")
    both = mask_iou_pairs(a, None, keys, threshold)
    of = lambda side, name: scores.select(*keys, F.col(ident).alias(name), F.col("score").alias("score" + side))
    pairs = both.filter(F.col("iou") > threshold).join(of("_a", "pred"), [*keys, "pred"]).join(of("_b", "gt"), [*keys, "gt"])
    names = {"pred": "id_a", "gt": "id_b", "x_p": "x1_a", "y_p": "y1_a", "x_g": "x1_b", "y_g": "y1_b"}
    return _suppress(scores, pairs.withColumnsRenamed(names), threshold, ident, keys)


def top_per_image(boxes: DataFrame, k: int, ident: str = "box_id", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """At most ``k`` best boxes per image.

    The rank filter on a row_number window is pushed below the shuffle by the optimizer
    (window group limit), so an image sends at most k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(ident))
    return boxes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def match(edges: DataFrame, keys: Sequence[str], steps: Sequence[float] | None = None) -> DataFrame:
    """Greedy one-to-one matching of candidate pairs ``pred, gt, score, iou`` per ``keys``.

    In the order of falling score (ties: lower pred) each prediction takes the free truth with
    the highest IoU (ties: lower gt). With ``steps`` the matching is made once per IoU step among the pairs that reach it,
    and ``step`` is added to the result.

    ``blk`` names the block of a prediction (without it, its hash). A pair is final when it is the first choice of its
    prediction and no better prediction still asks for that truth. One pass settles in every block all that does not
    wait for predictions of other blocks, at every step at once; only what is left is exchanged and goes round again, so
    there are as many rounds as chains of competing predictions cross blocks. A prediction without a score comes last.
    """
    if "blk" not in edges.columns:
        edges = edges.withColumn("blk", F.pmod(F.xxhash64("pred"), F.lit(64)))
    names = [*keys, "pred", "gt", "score", "iou", "blk"]
    score = F.col("score").cast("double")
    last = score.isNull() | F.isnan(score)
    edges = written(edges.withColumn("score", F.when(last, F.lit(float("-inf"))).otherwise(score)).select(*names), "candidates")
    if edges.count() > BLOCK_PAIRS:
        crowded = edges.groupBy(*keys, "blk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_PAIRS)
        crowded = written(crowded.select(*keys, "blk", F.ceil(F.col("n") / BLOCK_PAIRS).alias("_n")), "crowded")
        edges = edges.join(crowded, [*keys, "blk"], "left").withColumn("blk", F.when(F.col("_n").isNull(), F.col("blk")).otherwise(
            F.xxhash64("blk", F.pmod(F.xxhash64("pred"), "_n")))).drop("_n")
    live = edges.withColumn("step", F.lit(None).cast("double"))
    kinds = dict(live.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "step"]) + ", final boolean"
    spark, folder, rounds = edges.sparkSession, shared_path(edges.sparkSession, "match"), 0
    by = [*keys, "gt", "step"]
    while True:
        # for each truth, the best prediction that asks for it from each of the few blocks around it
        asking = live.groupBy(*by, "blk").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("pred").alias("p"))).alias("b"))
        rivals = asking.groupBy(*by).agg(F.collect_list(F.struct("b", "blk")).alias("_all")).filter(F.size("_all") > 1)
        rivals = rivals.select(*[F.col(c).alias("_" + c) for c in by], "_all")
        same = [F.col("_" + c).eqNullSafe(F.col(c)) if c == "step" else F.col("_" + c) == F.col(c) for c in by]
        other = F.array_min(F.transform(F.filter("_all", lambda r: r["blk"] != F.col("blk")), lambda r: r["b"]))
        met = (live.join(rivals, same, "left").withColumn("_o", other)
               .select(*names, "step", F.col("_o")["s"].alias("rival_s"), F.col("_o")["p"].alias("rival_p")))
        path = f"{folder}/round={rounds}"
        batched_map(met, [*keys, "blk"], ["pred"], _pair_up(names, tuple(steps) if steps and not rounds else None), schema).write.parquet(path)
        rounds += 1
        done = spark.read.schema(schema).parquet(path)
        left = done.filter("not final")
        if left.isEmpty():
            break
        if done.filter("final").isEmpty() and rounds > 1:
            raise RuntimeError("no pair was settled in a round")
        # a truth taken in one block is gone in the others
        taken = done.filter("final").select(*[F.col(c).alias("_" + c) for c in by])
        live = left.join(taken, same, "left_anti").drop("final")
    out = spark.read.schema(schema + ", round int").parquet(folder).filter("final")
    return out.select(*keys, *(["step"] if steps else []), "pred", "gt", "score", "iou")


BLOCK_PAIRS = 1_000_000


def _pair_up(names: Sequence[str], steps: tuple[float, ...] | None):
    """Final pairs of whole blocks, and the pairs that wait for predictions elsewhere."""

    def run(cols: Columns, group: np.ndarray) -> Columns:
        parts = []
        for step in steps or (None,):
            at = np.flatnonzero(cols["iou"] >= step) if step is not None else np.arange(len(group))
            final, wait = _settle_pairs({n: v[at] for n, v in cols.items()}, group[at])
            for mine, flag in ((at[final], True), (at[wait], False)):
                value = cols["step"][mine].astype(float) if step is None else np.full(len(mine), step)
                parts.append({**{n: cols[n][mine] for n in names}, "step": value, "final": np.full(len(mine), flag)})
        return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

    return run


def _settle_pairs(cols: Columns, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = lambda c: np.unique(group * (c.max() + 1) + c, return_inverse=True)[1]
    # pairs of different steps have nothing to do with one another
    step = pd.factorize(cols["step"], use_na_sentinel=False)[0]
    group = group * (step.max() + 1) + step
    pred, gt = number(pd.factorize(cols["pred"])[0]), number(pd.factorize(cols["gt"])[0])
    has = ~pd.isna(cols["rival_s"])
    rival_s = np.where(has, cols["rival_s"], np.inf).astype(float)
    # one order of all predictions: by falling score, then id; a rival elsewhere stands before the ones it beats
    rival_p = np.where(has, cols["rival_p"], cols["pred"])
    order = pd.DataFrame({"s": np.concatenate([-cols["score"], rival_s]), "p": np.concatenate([cols["pred"], rival_p])})
    rank = order.groupby(["s", "p"], sort=True).ngroup().to_numpy()
    mine, rival = rank[:n], np.where(has, rank[n:], np.iinfo(np.int64).max)
    by_choice = np.lexsort((mine, cols["gt"], -cols["iou"], pred))  # of rows with one id the best one chooses
    live = by_choice
    free_p, free_g = np.ones(pred.max() + 1, bool), np.ones(gt.max() + 1, bool)
    final = []
    while len(live):
        p, g = pred[live], gt[live]
        first = np.ones(len(live), bool)
        first[1:] = p[1:] != p[:-1]
        best = np.full(len(free_g), np.iinfo(np.int64).max)
        np.minimum.at(best, g, np.minimum(mine[live], rival[live]))
        hit = live[first & (best[g] == mine[live])]
        if not len(hit):
            break
        final.append(hit)
        free_p[pred[hit]] = False
        free_g[gt[hit]] = False
        live = live[free_p[p] & free_g[g]]
    return np.concatenate(final) if final else np.zeros(0, np.int64), live


def box_candidates(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = M.KEYS, least_iou: float = 0.5) -> DataFrame:
    pairs = overlapping(pred, gt, "box_id", "gt_id", keys, extra_a=["score"])
    return pairs.filter(F.col("iou") >= least_iou).select(
        *keys, F.col("id_a").alias("pred"), F.col("id_b").alias("gt"), F.col("score_a").alias("score"), "iou", block_of("x1_a", "y1_a").alias("blk"))


def mask_iou_pairs(pred: DataFrame, gt: DataFrame | None, keys: Sequence[str] = M.KEYS, least_iou: float = 0.0) -> DataFrame:
    """IoU of every pair of instance masks that share a pixel and reach ``least_iou``.

    ``pred``/``gt`` are segments with ``box_id``/``gt_id``; without ``gt`` the masks of ``pred`` meet one another, each pair in both
    orders. A mask that repeats inside its own rows counts once. Square blocks are compared in one pass each, and what lies in a
    single block is final there; masks of several blocks give parts that are added up. ``x_p, y_p`` and ``x_g, y_g`` are
    a corner of each mask, to the word.
    """
    kinds = dict(pred.dtypes)
    side = lambda df, n, name: df.filter("r1 > r0").na.drop(subset=[*keys, name, "col"]).select(
        *keys, F.lit(n).alias("side"), F.col(name).alias("id"), *[F.col(c).cast("bigint").alias(c) for c in ("col", "r0", "r1")])
    rows = side(pred, 0, "box_id")
    if gt is not None:
        rows = rows.unionByName(side(gt, 1, "gt_id"))
    rows = rows.withColumn("_br", F.explode(F.expr(f"sequence(cast(floor(r0 / {BLOCK}) as bigint), cast(floor((r1 - 1) / {BLOCK}) as bigint))"))).withColumn(
        "_bc", F.floor(F.col("col") / BLOCK))
    rows = rows.withColumn("r0", F.greatest("r0", F.col("_br") * BLOCK)).withColumn("r1", F.least("r1", F.col("_br") * BLOCK + BLOCK))
    whole = Window.partitionBy(*keys, "side", "id")
    rows = rows.withColumn("parts", (F.min("_br").over(whole) < F.max("_br").over(whole)) | (F.min("_bc").over(whole) < F.max("_bc").over(whole)))
    schema = (", ".join(f"{k} {kinds[k]}" for k in keys) + f", kind int, pred {kinds['box_id']}, gt {kinds['box_id']}, "
              "overlap bigint, area_p bigint, area_g bigint, x_p bigint, y_p bigint, x_g bigint, y_g bigint")
    found = written(batched_map(rows, [*keys, "_br", "_bc"], [], _meet(keys, gt is None, least_iou), schema, by=list(keys)), "mask-pairs")
    measures = ["area_p", "area_g", "x_p", "y_p", "x_g", "y_g"]
    inter = found.filter(F.col("kind") == PART).repartition(*keys).groupBy(*keys, "pred", "gt").agg(F.sum("overlap").alias("overlap"))
    of = lambda kind, name, s: found.filter(F.col("kind") == kind).repartition(*keys).groupBy(*keys, name).agg(
        F.sum("area_" + s).alias("area_" + s), F.min("x_" + s).alias("x_" + s), F.min("y_" + s).alias("y_" + s))
    parts = inter.join(M.by_shuffle(of(AREA_P, "pred", "p")), [*keys, "pred"]).join(M.by_shuffle(of(AREA_G, "gt", "g")), [*keys, "gt"])
    both = found.filter(F.col("kind") == WHOLE).select(*keys, "pred", "gt", "overlap", *measures).unionByName(parts)
    iou = (F.col("overlap") / (F.col("area_p") + F.col("area_g") - F.col("overlap"))).alias("iou")
    return both.select(*keys, "pred", "gt", "overlap", iou, "x_p", "y_p", "x_g", "y_g").filter(F.col("iou") >= least_iou)


# kinds of rows that come out of a block
WHOLE, PART, AREA_P, AREA_G = range(4)


def _starts_inside(line_a: np.ndarray, start_a: np.ndarray, line_b: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) where an ``a`` starts in [lo, hi) of a ``b`` on its line; ``a`` is sorted by line and start."""
    top = int(max(start_a.max(initial=0), hi_b.max(initial=0))) + 1
    at = line_a * top + start_a
    first, last = np.searchsorted(at, line_b * top + lo_b), np.searchsorted(at, line_b * top + hi_b)
    n = last - first
    b = np.repeat(np.arange(len(n)), n)
    return np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + first[b], b


def _meet(keys: Sequence[str], alone: bool, least_iou: float):
    """Pairs of masks in whole blocks; areas and overlaps of masks that have rows elsewhere go out as parts."""

    def run(cols: Columns, group: np.ndarray) -> Columns:
        ident = pd.factorize(cols["id"])[0]
        mask = np.unique((group * 2 + cols["side"]) * (ident.max(initial=0) + 1) + ident, return_inverse=True)[1]
        low = cols["r0"].min(initial=0)
        r0, r1 = cols["r0"] - low, cols["r1"] - low
        # runs of a mask in a column that overlap or touch are one
        order = np.lexsort((r0, cols["col"], mask))
        m, c, r0, r1 = mask[order], cols["col"][order], r0[order], r1[order]
        line = np.concatenate([[0], np.cumsum((m[1:] != m[:-1]) | (c[1:] != c[:-1]))])
        first, ends = merged_runs(line, r0, r1)
        m, c, r0, r1, order = m[first], c[first], r0[first], ends, order[first]
        masks = int(m.max(initial=-1)) + 1
        area = np.bincount(m, r1 - r0, masks).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        row = order[start]  # any row of each mask
        x, y = np.minimum.reduceat(c, start), (np.minimum.reduceat(r0, start) + low) // 64 * 64
        # runs that meet: one of the two starts inside the other
        line = pd.factorize(group[order] * (int(c.max(initial=0) - c.min(initial=0)) + 1) + c - c.min(initial=0))[0]
        by_line = np.lexsort((r0, line))
        m, line, r0, r1 = m[by_line], line[by_line], r0[by_line], r1[by_line]
        left = np.ones(len(m), bool) if alone else cols["side"][row][m] == 0
        right = left if alone else ~left
        (ma, la, a0, a1), (mb, lb, b0, b1) = ((v[left] for v in (m, line, r0, r1)), (v[right] for v in (m, line, r0, r1)))
        i1, j1 = _starts_inside(la, a0, lb, b0, b1)
        j2, i2 = _starts_inside(lb, b0, la, a0 + 1, a1)
        i, j = np.concatenate([i1, i2]), np.concatenate([j1, j2])
        shared = np.minimum(a1[i], b1[j]) - np.maximum(a0[i], b0[j])
        pair, at = np.unique(ma[i] * masks + mb[j], return_inverse=True)
        overlap = np.bincount(at, shared, len(pair)).astype(np.int64)
        p, g = pair // max(masks, 1), pair % max(masks, 1)
        if alone:
            p, g, overlap = p[p != g], g[p != g], overlap[p != g]
        parts = cols["parts"][row].astype(bool)
        piece = parts[p] | parts[g]
        full = ~piece & (overlap >= least_iou * (area[p] + area[g] - overlap) * (1 - 1e-9))
        # a mask whose partner goes on elsewhere is summed with it
        asked_p, asked_g = parts.copy(), parts.copy()
        asked_p[p[piece]] = True
        asked_g[g[piece]] = True
        is_p = np.ones(masks, bool) if alone else cols["side"][row] == 0
        is_g = is_p if alone else ~is_p
        out = []
        for kind, a, b, n in ((WHOLE, p[full], g[full], overlap[full]), (PART, p[piece], g[piece], overlap[piece]),
                              (AREA_P, np.flatnonzero(asked_p & is_p), None, None), (AREA_G, None, np.flatnonzero(asked_g & is_g), None)):
            a, b = (b if a is None else a), (a if b is None else b)
            at = row[a]
            out.append({**{k: cols[k][at] for k in keys}, "kind": np.full(len(a), kind), "pred": cols["id"][at], "gt": cols["id"][row[b]],
                        "overlap": np.zeros(len(a), np.int64) if n is None else n, "area_p": area[a], "area_g": area[b],
                        "x_p": x[a], "y_p": y[a], "x_g": x[b], "y_g": y[b]})
        return {n: np.concatenate([o[n] for o in out]) for n in out[0]}

    return run


def mask_candidates(pred: DataFrame, gt: DataFrame, scores: DataFrame, keys: Sequence[str] = M.KEYS, least_iou: float = 0.5) -> DataFrame:
    """Candidate pairs for :func:`match` by mask IoU; ``scores`` has ``box_id, score``."""
    pairs = mask_iou_pairs(pred, gt, keys, least_iou)
    return pairs.join(scores.select(*keys, F.col("box_id").alias("pred"), "score"), [*keys, "pred"]).select(
        *keys, "pred", "gt", "score", "iou", block_of("x_p", "y_p").alias("blk"))


def matches_by_threshold(candidates: DataFrame, keys: Sequence[str] = M.KEYS, steps: Sequence[float] = IOU_STEPS) -> DataFrame:
    return match(candidates.filter(F.col("iou") >= min(steps)), keys, steps)


def f_beta(images: DataFrame, pred: DataFrame, gt: DataFrame, candidates: DataFrame, beta: float = 2.0,
           keys: Sequence[str] = M.KEYS, steps: Sequence[float] = IOU_STEPS) -> DataFrame:
    """F-beta per image, averaged over IoU steps; an image with neither truth nor prediction scores 1."""
    hits = matches_by_threshold(candidates, keys, steps).groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("tp"))
    n_p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    n_g = gt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    base = (images.select(*keys).join(n_p, list(keys), "left").join(n_g, list(keys), "left").na.fill(0, ["n_pred", "n_gt"])
            .select("*", F.explode(F.array(*[F.lit(float(s)) for s in steps])).alias("step")))
    j = base.join(hits, [*keys, "step"], "left").na.fill(0, ["tp"])
    b2 = beta * beta
    fn, fp = F.col("n_gt") - F.col("tp"), F.col("n_pred") - F.col("tp")
    score = F.when((F.col("n_pred") == 0) & (F.col("n_gt") == 0), F.lit(1.0)).otherwise(
        (1 + b2) * F.col("tp") / ((1 + b2) * F.col("tp") + b2 * fn + fp))
    return j.groupBy(*keys).agg(F.avg(score).alias("f_beta"))


def average_precision(pred: DataFrame, gt: DataFrame, candidates: DataFrame, keys: Sequence[str] = M.KEYS,
                      steps: Sequence[float] = IOU_STEPS) -> DataFrame:
    """AP per IoU step: precision envelope read at 101 recall points over the whole data set.

    Predictions of exactly equal score enter together. One row per distinct score carries the hits of all steps as
    columns; running sums and the envelope work on it in two levels (block of scores, then score in block), so no task
    sorts all scores. A data set without truth has AP 0.
    """
    k = range(len(steps))
    hit = matches_by_threshold(candidates, keys, steps)
    # the score of a hit is that of each row with its id
    own = hit.drop("score").join(pred.select(*keys, F.col("box_id").alias("pred"), "score"), [*keys, "pred"])
    tp = own.groupBy("score").agg(*[F.count_if(F.col("step") == float(s)).alias(f"tp{i}") for i, s in enumerate(steps)])
    total = pred.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    scores = C.in_blocks(total.join(tp, "score", "left").na.fill(0, [f"tp{i}" for i in k]), "score")
    n_gt = gt.count()
    curve = C.running_from_top(scores, [*[f"tp{i}" for i in k], "n"], "score")
    # recall points in (recall of the next higher score, recall] read this row's envelope
    point = lambda c: F.floor((c / n_gt if n_gt else F.lit(0.0)) * (RECALL_POINTS - 1) + 1e-9)
    top = F.col("cum_n") == F.col("n")
    curve = written(curve.select("_b", "score", *[(F.col(f"cum_tp{i}") / F.col("cum_n")).alias(f"p{i}") for i in k], *[
        (point(F.col(f"cum_tp{i}")) - F.when(top, F.lit(-1)).otherwise(point(F.col(f"cum_tp{i}") - F.col(f"tp{i}")))).alias(f"w{i}") for i in k]), "curve")
    env = C.best_from_here_down(curve, [f"p{i}" for i in k], "score")
    sums = env.agg(*[F.sum(F.col(f"w{i}") * F.col(f"p{i}")).alias(f"s{i}") for i in k], F.count(F.lit(1)).alias("rows")).filter("rows > 0")
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("step"), (F.col(f"s{i}") / RECALL_POINTS).alias("ap")) for i, s in enumerate(steps)])))
