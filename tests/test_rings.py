import numpy as np
import pytest
from helpers import SEGMENTS, flood_labels, random_masks, segments_of, to_masks
from pyspark.sql import functions as F

from runmosaic.operators import components as K
from runmosaic.operators import geo as E
from runmosaic.operators import masks as M
from runmosaic.operators import rings as R

H, W = 17, 23


def border_length(m):
    p = np.pad(m, 1)
    return int((p[1:] != p[:-1]).sum() + (p[:, 1:] != p[:, :-1]).sum())


def rings_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, []).append(r)
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [1024, 5])
def test_rings_are_the_border(spark, connectivity, block):
    masks = random_masks(4, H, W, 3, 0.5)
    got = rings_of(R.mask_rings(spark.createDataFrame(segments_of(masks), SEGMENTS), connectivity, block=block))
    for k, m in masks.items():
        lab = flood_labels(m, connectivity)
        # one outer ring a component; holes are the background parts that do not reach the frame
        back = np.pad(~m, 1, constant_values=True)
        holes = len(set(flood_labels(back, 12 - connectivity)[back].tolist())) - 1
        rings = got[k]
        assert sum(not r.hole for r in rings) == len(set(lab[lab >= 0].tolist())) and sum(r.hole for r in rings) == holes
        assert sum(-r.area if r.hole else r.area for r in rings) == m.sum()
        length = 0
        for r in rings:
            c = [(p.x, p.y) for p in r.corners]
            assert c[0] == c[-1] and len(c) == r.points + 1
            assert (c[0][1], c[0][0]) == min((y, x) for x, y in c)
            for (x0, y0), (x1, y1), (x2, y2) in zip(c, c[1:], c[2:] + c[1:2]):
                assert (x0 == x1) != (y0 == y1) and (x1 == x2) != (y1 == y2) and (x0 == x1) != (x1 == x2)
                length += abs(x1 - x0) + abs(y1 - y0)
        assert length == border_length(m)


def test_rings_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame(segments_of(random_masks(3, H, W, 8, 0.6)), SEGMENTS)
    want = sorted(map(str, R.mask_rings(df, 8).collect()))
    assert sorted(map(str, R.mask_rings(df, 8, block=3).collect())) == want


@pytest.mark.parametrize("connectivity", [4, 8])
def test_rings_drawn_again_are_the_mask(spark, connectivity):
    masks = random_masks(5, H, W, 4, 0.5)
    rings = R.mask_rings(spark.createDataFrame(segments_of(masks), SEGMENTS), connectivity, block=6)
    got = to_masks(E.rasterise(rings, H, W, "image_id", "corners", ()), H, W, masks)
    assert all(np.array_equal(got[k], m) for k, m in masks.items())


def test_polygons_of_components(spark):
    m = np.zeros((H, W), bool)
    m[1:10, 1:10], m[3:5, 3:5], m[6:8, 6:8] = True, False, False
    m[12:14, 2:20] = True
    lab = K.components(spark.createDataFrame(segments_of({7: m}), SEGMENTS), W, 8)
    rows = sorted(R.polygons(R.mask_rings(lab, 8, ("image_id", "root"))).collect(), key=lambda r: r.root)
    assert [(r.root, r.holes, r.area, len(r.rings)) for r in rows] == [(W + 1, 2, 73.0, 3), (12 * W + 2, 0, 36.0, 1)]
    f = R.polygons(R.mask_rings(lab, 8, ("image_id", "root"))).select(F.to_json(E.polygon_feature("rings", {"area": F.col("area")}, "root")).alias("j"))
    text = sorted(r.j for r in f.collect())[0]
    assert '"coordinates":[[[1.0,1.0],[10.0,1.0],[10.0,10.0],[1.0,10.0],[1.0,1.0]],[[3.0,3.0],' in text and '"type":"Polygon"' in text


def test_one_ring_over_many_blocks(spark):
    """A snake: one ring of thousands of corners across all blocks."""
    m = np.zeros((60, 64), bool)
    m[::4, :], m[2::8, 63], m[1::8, 63], m[3::8, 63], m[5::8, 0], m[6::8, 0], m[7::8, 0] = True, True, True, True, True, True, True
    rows = R.mask_rings(spark.createDataFrame(segments_of({1: m}), SEGMENTS), block=4).collect()
    assert len(rows) == 1 and rows[0].area == m.sum()


def test_empty_and_full(spark):
    df = spark.createDataFrame([(1, c, 0, H) for c in range(W)], SEGMENTS)
    assert [(r.points, r.area, r.ring) for r in R.mask_rings(df).collect()] == [(4, float(H * W), 0)]
    assert R.mask_rings(df.limit(0)).count() == 0


def test_tall_scene_in_square_blocks(spark):
    """A scene of 20,000 rows; no group of the labelling holds more than its block."""
    rows = [(1, c, r, r + 30) for c in range(0, 40) for r in range((c * 37) % 50, 19_900, 50)] + [(1, 41, 0, 20_000), (2, 0, 5, 19_000)]
    df = spark.createDataFrame(rows, SEGMENTS)
    whole = sorted(map(tuple, K.components(df, 64, block=1 << 20).collect()))
    assert sorted(map(tuple, K.components(df, 64, block=512).collect())) == whole
    labeller = K._block_labeller

    def spy(keys, width, reach):
        run = labeller(keys, width, reach)

        def counted(cols, group):
            out = run(cols, group)
            assert np.bincount(group).max() <= 40 * 512 // 30 and (cols["r1"] - cols["r0"]).max() <= 512
            return out
        return counted

    K._block_labeller = spy
    try:
        assert K.components(df, 64, block=512).count() == len(whole)
    finally:
        K._block_labeller = labeller


def test_sizes_as_columns(spark):
    masks = random_masks(4, H, W, 5)
    size = {0: (17, 23), 1: (9, 11), 2: (17, 5), 3: (4, 23)}
    cut = {k: m[:size[k][0], :size[k][1]] for k, m in masks.items()}
    df = spark.createDataFrame([(k, size[k][0], size[k][1], c, a, b) for k, c, a, b in segments_of(cut)],
                               "image_id bigint, height bigint, width bigint, col bigint, r0 bigint, r1 bigint")
    want = {k: flood_labels(m, 8) for k, m in cut.items()}
    rows = K.components(df, "width", keys=("image_id", "height", "width"), block=4).collect()
    assert len(rows) == df.count() and all((want[r.image_id][r.r0:r.r1, r.col] == r.root).all() for r in rows)
    assert M.area(df).count() == 4
