"""Results and plans that must hold for keys and sizes of larger tables."""

import numpy as np
import pytest

from __spark_entry__ import queries
from helpers import SEGMENTS, flood_labels, morph, random_masks, segments_of, to_masks

SF = "/root/testdata/sf0.001"


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_of_large_tables_pass_no_64_bits(spark, tmp_path):
    """Line items with keys as sixty copies of sf0.1 have them: products of box ids must not pass 64 bits."""
    from runmosaic.plans import views as V
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(1500).withColumn("l_partkey", V.F.col("l_partkey") + 1_180_000).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.image_id, r.id_a, r.id_b): r.overlap for r in queries()["box_pairs_sizes"](spark, str(tmp_path)).collect()}
    boxes = {}
    for r in V.boxes(spark, str(tmp_path)).collect():
        i = r.box_id
        n = 50000 if i % 40 == 0 else 1 + i * 31 % 4000 if i % 8 == 0 else 1 + i * 31 % 90
        x, y = i * 7919 % 200000, (i * 104729 + r.image_id) % 200000
        boxes.setdefault(r.image_id // 64, set()).add((i, x, y, x + n, y + 1 + n // (1 + i % 3)))
    want = {}
    for k, group in boxes.items():
        for a in group:
            for b in group:
                w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
                if a[0] < b[0] and w > 0 and h > 0:
                    want[k, a[0], b[0]] = w * h
    assert want and got == want


def test_cells_of_boxes_stay_with_their_image(spark):
    """Boxes are dealt out while narrow; a box in the cells of all levels is many rows."""
    text = nodes(queries()["box_pairs_sizes"](spark, SF))
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_cx" in line]


@pytest.mark.parametrize("name", ["bridge_gaps", "smooth", "clean_mask", "postprocess_extent", "outline"])
def test_morphology_is_one_pass(spark, name):
    """All steps of a chain work on the runs of whole images; no step sorts or windows its rows again, and images are not moved."""
    text = nodes(queries()[name](spark, SF))
    above = text.split("MapInPandas")[-1]
    assert "MapInPandas" in text and "Window" not in above and above.count("Exchange") == 1


@pytest.mark.parametrize("band", [3, 40])
def test_chains_equal_brute_force(spark, band):
    """Masks that reach all borders, in bands narrower than the reach, images of different size."""
    from runmosaic.operators import morphology as O
    size = {0: (24, 31), 1: (9, 11), 2: (24, 5)}
    masks = {k: m[:size[k][0], :size[k][1]] for k, m in random_masks(3, 24, 31, 9, 0.6).items()}
    rows = [(k, *size[k], c, a, b) for k, c, a, b in segments_of(masks)]
    df = spark.createDataFrame(rows + rows[:40], "image_id bigint, height bigint, width bigint, col bigint, r0 bigint, r1 bigint")
    keys = ("image_id", "height", "width")
    for got, steps, kernel in ((O.bridge(df, "height", "width", 3, keys, band), (True, False), O.ellipse(7)),
                               (O.smooth(df, "height", "width", 5, 1, keys, band), (True, False, False, True), O.ellipse(5))):
        drawn = {k: np.zeros(s, int) for k, s in size.items()}
        for r in got.collect():
            drawn[r.image_id][r.r0:r.r1, r.col] += 1
        for k, m in masks.items():
            want = m
            for grow in steps:
                want = morph(want, kernel, grow)
            assert np.array_equal(drawn[k], (want | m if kernel == O.ellipse(7) else want).astype(int))


def test_clean_in_one_pass_is_clean_in_steps(spark):
    from runmosaic.operators import components as K
    from runmosaic.operators import morphology as O
    masks = random_masks(4, 30, 40, 2, 0.42)
    df = spark.createDataFrame(segments_of(masks), SEGMENTS)
    got = to_masks(O.clean(df, 30, 40), 30, 40, masks)
    lab = sorted(tuple(r) for r in O.postprocess(df, ["open", "dilate"], 30, 40, least=6, most=60).collect())
    for k, m in masks.items():
        label = flood_labels(m, 8)
        m = np.vectorize(lambda v: v >= 0 and (label == v).sum() >= 10)(label)
        for grow in (True, False, False, True):
            m = morph(m, O.ellipse(3), grow)
        assert np.array_equal(got[k], m)
    steps = O.dilate(O.open_(df, 3, 30, 40), 3, 30, 40)
    assert lab == sorted(tuple(r) for r in K.limit_area(K.components(steps, 40), 6, 60).select("image_id", "col", "r0", "r1", "root").collect())


@pytest.mark.parametrize("block", [1024, 9])
def test_smoothing_by_looked_up_rows(spark, monkeypatch, block):
    """The same pixels as whole images smoothed densely, at borders and in corners too; no image is spread into pixels."""
    from runmosaic.operators import stitch as S
    masks = {**random_masks(3, 41, 37, 4, 0.55), 3: np.ones((41, 37), bool), 4: np.zeros((41, 37), bool)}
    masks[4][:5, :5], masks[4][-4:, -30:], masks[4][20:28, 10:17] = True, True, True
    segs = segments_of(masks)
    df = spark.createDataFrame(segs + segs[:30], SEGMENTS)
    monkeypatch.setattr(S, "grouped_map", lambda *a: pytest.fail("dense"))
    out = S.smooth_gaussian(df, 41, 37, block=block).collect()
    drawn = {k: np.zeros((41, 37), int) for k in masks}
    for r in out:
        drawn[r.image_id][r.r0:r.r1, r.col] += 1
    for k, m in masks.items():
        for _ in range(2):
            m = S.gaussian(m.astype(float), 1.5) > 0.5
        assert np.array_equal(drawn[k], m.astype(int))
        # runs are whole
        assert sum(r.image_id == k for r in out) == len(segments_of({k: m}))


@pytest.mark.parametrize("edge", ["none", "cover"])
def test_blends_of_a_grid_need_no_list_where_one_patch_counts(spark, edge):
    """Parts under one patch pass whole; the pixels are those that the lists of all patches give, patches of confidence 0 among them."""
    from runmosaic.operators import masks as M
    from runmosaic.operators import stitch as S
    from runmosaic.operators import tiles as T
    g, size, overlap, side = np.random.default_rng(8), 20, 8, 50
    grid = T.Grid(size, overlap, side, side, edge)
    starts = [k for k in range(0, side - size + 1, size - overlap)] + ([side - size] if edge == "cover" else [])
    rows = [(i, r, c, size, size, float(g.integers(0, 11)) / 10) for i in range(3) for r in starts for c in starts]
    patches = spark.createDataFrame(rows, "image_id bigint, row bigint, col bigint, height bigint, width bigint, confidence double")
    segs = M.union(spark.createDataFrame([(i, r, c, 0.9 if (r + c) % 5 else 0.6, c + x, r + a, r + b) for i, r, c, *_ in rows for x in range(size)
                                          for a, b in [sorted(g.choice(size + 1, 2, replace=False).tolist())]],
                                         "image_id bigint, tile_row bigint, tile_col bigint, p double, col bigint, r0 bigint, r1 bigint"),
                   ("image_id", "tile_row", "tile_col", "p"))
    blends = [lambda **k: S.weighted_blend(patches, segs, size, overlap, kernel="distance", digits=9, **k)]
    blends += [lambda order=order, **k: S.feather_blend(patches, segs, size, overlap, 0.3, digits=9, order=order, **k) for order in ("position", "confidence")]
    for blend in blends:
        got, want = (sorted(tuple(r[n] for n in ("image_id", "col", "r0", "r1")) for r in blend(**k).collect()) for k in ({"grid": grid}, {}))
        if edge == "none" and blend is blends[0]:  # without a list, patches of confidence 0 give nothing; with one a single patch passes by p alone
            dead = {(i, r + 4, c + 4) for i, r, c, *_, conf in rows if conf == 0}
            pixels = lambda out: {(i, y, c) for i, c, a, b in out for y in range(a, b)}
            assert pixels(got) <= pixels(want) and all(any(i == j and r <= y < r + 12 and c <= x < c + 12 for j, r, c in dead) for i, y, x in pixels(want) - pixels(got))
        elif blend is not blends[0]:
            assert got and got == want


def test_rows_of_a_distance_blend_are_not_moved(spark):
    """Patches and masks are dealt out by image while narrow; the lists of neighbours, long, meet only what lies under several patches."""
    text = nodes(queries()["stitch_weighted_distance"](spark, SF))
    assert "tile_row" not in "".join(line for line in text.splitlines() if "Exchange" in line) and text.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("connectivity", [4, 8])
def test_rings_of_one_square_are_followed_in_one_pass(spark, monkeypatch, connectivity):
    """Blocks that nearly all rings cross need no rounds and no tables; the rings are those of the rounds."""
    from runmosaic.operators import rings as R
    masks = random_masks(3, 19, 27, 6, 0.55)
    segs = segments_of(masks)
    df = spark.createDataFrame(segs + segs[:20], SEGMENTS)
    monkeypatch.setattr(R, "SQUARE", 8)
    want = sorted(map(str, R.mask_rings(df, connectivity, block=4).collect()))
    monkeypatch.setattr(R, "SQUARE", 2048)
    monkeypatch.setattr(R, "written", lambda *a: pytest.fail("table"))
    monkeypatch.setattr(R, "_rank", lambda *a: pytest.fail("rounds"))
    assert sorted(map(str, R.mask_rings(df, connectivity, block=4).collect())) == want
    assert sorted(map(str, R.mask_rings(df, connectivity).collect())) == want and R.mask_rings(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["components_blocks", "components_sized", "components", "instances"])
def test_labels_of_one_square_are_not_written_or_moved(spark, monkeypatch, name):
    """Blocks inside a square meet in the task that holds it; rows stay where their image lies."""
    from runmosaic.operators import components as K
    monkeypatch.setattr(K, "written", lambda *a: pytest.fail("table"))
    below = nodes(queries()[name](spark, SF)).split("MapInPandas")[-1]
    assert not [line for line in below.splitlines() if "Exchange hashpartitioning" in line and "col#" in line]


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block, square", [(2, 64), (5, 64), (64, 64), (4, 12), (5, 12)])
def test_labels_over_blocks_and_squares(spark, connectivity, block, square):
    from runmosaic.operators import components as K
    masks = random_masks(4, 25, 33, 3, 0.45)
    segs = segments_of(masks)
    rows = K.components(spark.createDataFrame(segs + segs[:50], SEGMENTS), 33, connectivity, block=block, square=square).collect()
    lab = {k: flood_labels(m, connectivity) for k, m in masks.items()}
    assert sorted((r.image_id, r.col, r.r0, r.r1) for r in rows) == sorted(segs)
    assert all((lab[r.image_id][r.r0:r.r1, r.col] == r.root).all() for r in rows)


def test_pixels_of_a_report_stay_with_their_image(spark):
    """Gradients list every mask pixel several times, pairs of patches every segment; neither is shuffled."""
    lines = [line for line in nodes(queries()["stitch_report"](spark, SF)).splitlines() if "Exchange hashpartitioning" in line]
    assert lines and not [line for line in lines if "row_1" in line or "row#" in line or "col#" in line or "pos#" in line]


def test_final_masks_are_dealt_out_once(spark):
    """Cleaned rows are disjoint; they go to their image without a shuffle by pixel before."""
    lines = [line for line in nodes(queries()["final_mask_rle"](spark, SF)).splitlines() if "Exchange hashpartitioning" in line]
    assert len(lines) == 2 and not [line for line in lines if "col#" in line]


def test_gradients_of_masks(spark):
    from runmosaic.operators import stitch as S
    masks = {**random_masks(3, 13, 17, 2, 0.4), 3: np.ones((13, 17), bool)}
    segs = segments_of(masks)
    got = {(r.image_id, r.row, r.col): (r.gy, r.gx) for r in S.seam_pixels(spark.createDataFrame(segs + segs[:9], SEGMENTS), 13, 17, 0.6).collect()}
    want = {}
    for k, m in masks.items():
        gy, gx = np.gradient(m.astype(float))
        want |= {(k, r, c): (gy[r, c], gx[r, c]) for r, c in zip(*np.nonzero(np.sqrt(gy ** 2 + gx ** 2) > 0.6))}
    assert got == want
