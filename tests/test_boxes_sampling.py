from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from runmosaic.operators import boxes as B
from runmosaic.operators import geo as E
from runmosaic.operators import graph as G
from runmosaic.operators import sampling as P
from runmosaic.operators import scores as C

BOX = "image_id bigint, box_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, score double"


def random_boxes(n, seed, copies=0):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = g.integers(0, 60, 2)
        w, h = g.integers(5, 30, 2)
        rows.append((int(i % 3), i, int(x), int(y), int(x + w), int(y + h), float(g.integers(0, 20)) / 20))
    # a pile of copies of one box in one image
    rows += [(0, n + i, 10, 10, 30, 30, float(i % 7) / 7) for i in range(copies)]
    return rows


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    o = max(w, 0) * max(h, 0)
    return o / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - o)


def greedy(rows, t):
    kept = []
    for a in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(b[0] != a[0] or iou(a, b) <= t for b in kept):
            kept.append(a)
    return {k[1] for k in kept}


@pytest.mark.parametrize("threshold", [0.2, 0.45])
def test_nms_is_greedy_and_survives_copies(spark, threshold):
    rows = random_boxes(90, 1, copies=300)
    got = {r.box_id for r in B.nms(spark.createDataFrame(rows, BOX), threshold).collect()}
    assert got == greedy(rows, threshold)


def test_overlaps_are_found_once(spark):
    rows = random_boxes(60, 2)
    df = spark.createDataFrame(rows, BOX)
    got = sorted((r.id_a, r.id_b) for r in B.overlapping(df, df, "box_id", "box_id", cell=7).filter("id_a < id_b").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and iou(a, b) > 0)
    assert got == want


def test_matching_is_greedy(spark):
    pred, gt = random_boxes(60, 3), random_boxes(50, 4)
    dp = spark.createDataFrame(pred, BOX)
    dg = spark.createDataFrame(gt, BOX).select("image_id", F.col("box_id").alias("gt_id"), "x1", "y1", "x2", "y2")
    got = {(r.pred, r.gt) for r in B.match(B.box_candidates(dp, dg, least_iou=0.1), ["image_id"]).collect()}
    want, used = set(), set()
    for p in sorted(pred, key=lambda r: (-r[6], r[1])):
        free = [(-iou(p, g), g[1]) for g in gt if g[0] == p[0] and g[1] not in used and iou(p, g) >= 0.1]
        if free:
            used.add(min(free)[1])
            want.add((p[1], min(free)[1]))
    assert got == want


def rounds_of(monkeypatch, module, tag):
    """Folders of rounds that calls in ``module`` make under ``tag``."""
    made, plain = [], module.shared_path
    monkeypatch.setattr(module, "shared_path", lambda spark, t: made.append((t, plain(spark, t))) or made[-1][1])
    return lambda: [len(list(Path(p.removeprefix("file://")).glob("round=*"))) for t, p in made if t == tag]


@pytest.mark.parametrize("step,blocks", [(1, 1), (4, 4)])
def test_a_long_chain_takes_as_many_rounds_as_blocks(spark, monkeypatch, step, blocks):
    """1,000 boxes, each in conflict with the next only; every second one stays."""
    rounds = rounds_of(monkeypatch, G, "greedy")
    rows = [(0, i, step * i, 0, step * i + 2 * step, 10, 1 - i / 2000) for i in range(1000)]
    df = spark.createDataFrame(rows, BOX).repartition(6)
    kept = {r.box_id for r in B.nms(df, 0.3).collect()}
    assert kept == set(range(0, 1000, 2)) and rounds() == [blocks]
    seeds = {r.cluster for r in E.merge_clusters(df, "seed", 0.5).collect()}
    assert seeds == set(range(0, 1000, 2)) and rounds()[-1] <= blocks


def test_a_long_chain_of_matches(spark, monkeypatch):
    """Every prediction would like the truth that the better one before it has taken."""
    rounds = rounds_of(monkeypatch, B, "match")
    pred = [(0, i, 4 * i, 0, 4 * i + 8, 10, 1 - i / 2000) for i in range(1000)]
    gt = [(0, i, 4 * i - 3 if i else 0, 0, 4 * i + 5 if i else 8, 10, 0.0) for i in range(1001)]
    dp = spark.createDataFrame(pred, BOX).repartition(6)
    dg = spark.createDataFrame(gt, BOX).select("image_id", F.col("box_id").alias("gt_id"), "x1", "y1", "x2", "y2")
    got = {(r.pred, r.gt) for r in B.match(B.box_candidates(dp, dg, least_iou=0.1), ["image_id"]).collect()}
    want, used = set(), set()
    for p in pred:
        free = [(-iou(p, g), g[1]) for g in gt[max(0, p[1] - 5):p[1] + 6] if g[1] not in used and iou(p, g) >= 0.1]
        if free:
            used.add(min(free)[1])
            want.add((p[1], min(free)[1]))
    assert got == want and rounds()[0] <= 5


@pytest.mark.parametrize("block", [7, 16, 1024])
def test_blocks_do_not_change_results(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(G, "BLOCK_EDGES", 40)
    monkeypatch.setattr(B, "BLOCK_PAIRS", 40)
    rows, gt = random_boxes(120, 11), random_boxes(100, 12)
    assert {r.box_id for r in B.nms(spark.createDataFrame(rows, BOX), 0.1).collect()} == greedy(rows, 0.1)
    dg = spark.createDataFrame(gt, BOX).select("image_id", F.col("box_id").alias("gt_id"), "x1", "y1", "x2", "y2")
    steps = (0.1, 0.3, 0.5)
    got = {(r.step, r.pred, r.gt) for r in B.matches_by_threshold(B.box_candidates(spark.createDataFrame(rows, BOX), dg, least_iou=0.1), steps=steps).collect()}
    want = set()
    for t in steps:
        used = set()
        for p in sorted(rows, key=lambda r: (-r[6], r[1])):
            free = [(-iou(p, g), g[1]) for g in gt if g[0] == p[0] and g[1] not in used and iou(p, g) >= t]
            if free:
                used.add(min(free)[1])
                want.add((t, p[1], min(free)[1]))
    assert got == want


def test_a_large_box_takes_few_cells(spark):
    """At most four cells at its own level and at each level it looks up."""
    rows = [(0, i, 10 * i, 5 * i, 10 * i + n, 5 * i + n, 0.5) for i, n in enumerate([1, 60, 64, 65, 1000, 50_000, 50_000])]
    df = spark.createDataFrame(rows, BOX)
    got = sorted((r.id_a, r.id_b) for r in B.overlapping(df, df, "box_id", "box_id").filter("id_a < id_b").collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and iou(a, b) > 0)
    levels = F.array(*[F.lit(v) for v in range(11)])
    for role in (0, 1):
        cells = B._spread(df, "_a", "box_id", ["image_id"], 64, [], levels, role).groupBy("id_a", "_role", "_lv").count()
        assert cells.agg(F.max("count")).first()[0] <= 4


def test_predictions_without_score_and_repeated_ids(spark):
    pred = [(0, 1, 0, 0, 10, 10, None), (0, 2, 0, 0, 10, 10, float("nan")), (0, 3, 0, 0, 10, 10, 0.1), (0, 3, 0, 0, 10, 10, 0.7)]
    gt = spark.createDataFrame([(0, 9, 0, 0, 10, 10, 0.0)], BOX).select("image_id", F.col("box_id").alias("gt_id"), "x1", "y1", "x2", "y2")
    got = B.match(B.box_candidates(spark.createDataFrame(pred, BOX), gt), ["image_id"]).collect()
    assert [(r.pred, r.gt) for r in got] == [(3, 9)]


@pytest.mark.parametrize("mode", ["seed", "components"])
def test_merging(spark, mode):
    rows = random_boxes(80, 6, copies=50)
    got = {r.box_id: r.cluster for r in E.merge_clusters(spark.createDataFrame(rows, BOX), mode).collect()}

    def near(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return a[0] == b[0] and max(w, 0) * max(h, 0) / min(size(a), size(b)) >= 0.5

    want = {}
    if mode == "seed":
        for i, a in enumerate(rows):
            if a[1] not in want:
                want[a[1]] = a[1]
                for b in rows[i + 1:]:
                    if b[1] not in want and near(a, b):
                        want[b[1]] = a[1]
    else:
        want = {r[1]: r[1] for r in rows}
        moved = True
        while moved:
            moved = False
            for a in rows:
                for b in rows:
                    if want[a[1]] != want[b[1]] and near(a, b):
                        want[a[1]] = want[b[1]] = min(want[a[1]], want[b[1]])
                        moved = True
    assert got == want


def test_average_precision_and_f_beta_extremes(spark):
    rows = random_boxes(30, 7)
    df = spark.createDataFrame(rows, BOX)
    gt = df.select("image_id", F.col("box_id").alias("gt_id"), "x1", "y1", "x2", "y2")
    img = spark.createDataFrame([(i,) for i in range(5)], "image_id bigint")
    cand = B.box_candidates(df, gt)
    assert {round(r.ap, 9) for r in B.average_precision(df, gt, cand).collect()} == {1.0}
    assert {r.f_beta for r in B.f_beta(img, df, gt, cand).collect()} == {1.0}
    none = df.withColumn("x1", F.col("x1") + 1000).withColumn("x2", F.col("x2") + 1000)
    got = {r.image_id: r.f_beta for r in B.f_beta(img, none, gt, B.box_candidates(none, gt)).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    s = P.split_exact(df, 0.2, 1, ["id"])
    assert s.filter("split = 'val'").count() == 201 and s.count() == 1003
    again = P.split_exact(df.repartition(13), 0.2, 1, ["id"])
    assert s.select("id", "split").exceptAll(again.select("id", "split")).isEmpty()
    strat = {(r.label, r.split): r["count"] for r in P.split_exact(df, 0.2, 1, ["id"], ["label"]).groupBy("label", "split").count().collect()}
    assert strat == {(1, "val"): 21, (1, "train"): 80, (0, "val"): 181, (0, "train"): 721}  # ceil of 20.2 and 180.4
    img = P.split_images(df.withColumn("image_id", F.expr("id div 3")), 5)
    per = img.groupBy("image_id").agg(F.countDistinct("split").alias("n"))
    assert per.filter("n > 1").isEmpty()
    n = {r.split: r["count"] for r in img.select("image_id", "split").distinct().groupBy("split").count().collect()}
    assert n == {"train": 268, "val": 33, "test": 34}
    part = P.sample_fraction(df, 0.3, 2, ["id"])
    assert part.count() + P.complement(df, part, ["id"]).count() == 1003


def test_weighted_draws_follow_the_weights(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 20 == 0).cast("int"))
    d = P.weighted_draws(df, 4000, 3, ["id"])
    assert d.count() == 4000
    share = d.filter("label = 1").count() / 4000
    assert 0.45 < share < 0.55
    boosted = P.weighted_draws(df, 4000, 3, ["id"], pos_boost=3.0).filter("label = 1").count() / 4000
    assert 0.7 < boosted < 0.8


def test_chunk_shuffle_keeps_chunks(spark):
    c = P.chunk_shuffle(spark.range(95), 10, 1, "id")
    assert c.filter("chunk <> id div 10").isEmpty()
    assert c.groupBy("chunk").agg(F.countDistinct("slot").alias("d"), F.count("*").alias("n")).filter("d <> n").isEmpty()


def test_auc_and_running_totals_with_crowded_scores(spark):
    g = np.random.default_rng(0)
    rows = [(int(a), float(b)) for a, b in zip(g.integers(0, 2, 3000), np.where(g.random(3000) < 0.5, 0.5 + g.random(3000) / 1e4, g.integers(0, 5, 3000) / 4))]
    df = spark.createDataFrame(rows, "label int, prob double")
    p, n = np.array([b for a, b in rows if a]), np.array([b for a, b in rows if not a])
    want = ((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean()
    assert abs(C.roc_auc(df).first().roc_auc - want) < 1e-12
    pts = C.roc_points(df).collect()
    for r in pts[::50]:
        assert abs(r.fpr - (n >= r.threshold).mean()) < 1e-12 and abs(r.tpr - (p >= r.threshold).mean()) < 1e-12
    one = df.filter("label = 1")
    assert C.roc_auc(one).first().roc_auc == 0.0


def test_ship_statistics_of_nothing(spark):
    r = C.ship_statistics(spark.createDataFrame([], "area bigint")).first()
    assert (r.num_ships, r.total_area, r.min_area, r.max_area) == (0, 0.0, float("inf"), 0.0)
