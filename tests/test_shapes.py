import numpy as np
import pytest
from helpers import SEGMENTS, flood_labels, morph, random_masks, segments_of, to_masks

from runmosaic.operators import components as K
from runmosaic.operators import morphology as O
from runmosaic.operators import stitch as S

H, W = 17, 23


@pytest.fixture(scope="module")
def masks():
    return random_masks(5, H, W, 11)


@pytest.fixture(scope="module")
def segs(spark, masks):
    return spark.createDataFrame(segments_of(masks), SEGMENTS)


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [2048, 8, 3])
def test_components_equal_flood_fill(segs, masks, connectivity, block):
    want = {k: flood_labels(m, connectivity) for k, m in masks.items()}
    for r in K.components(segs, W, connectivity, block=block).collect():
        assert (want[r.image_id][r.r0:r.r1, r.col] == r.root).all()


def test_components_over_small_batches(spark, segs, masks):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = K.components(segs.repartition(3), W).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: flood_labels(m, 8) for k, m in masks.items()}
    assert len(rows) == segs.count()
    assert all((want[r.image_id][r.r0:r.r1, r.col] == r.root).all() for r in rows)


def test_long_snake_crosses_many_blocks(spark):
    m = np.zeros((6, 40), bool)
    m[0, :], m[2, :], m[4, :] = True, True, True
    m[1, 39], m[3, 0] = True, True
    df = spark.createDataFrame(segments_of({1: m}), SEGMENTS)
    assert K.components(df, 40, 4, block=4).select("root").distinct().count() == 1


def test_instances(segs, masks):
    inst = K.instances(K.components(segs, W)).collect()
    for k, m in masks.items():
        lab = flood_labels(m, 8)
        mine = sorted((r for r in inst if r.image_id == k), key=lambda r: r.id)
        roots = sorted(set(lab[lab >= 0].tolist()))
        assert [r.root for r in mine] == roots
        for r, root in zip(mine, roots):
            y, x = np.nonzero(lab == root)
            assert (r.x, r.y, r.w, r.h, r.area) == (x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, len(x))
            assert (r.centre_x, r.centre_y) == (r.x + r.w // 2, r.y + r.h // 2)
            assert abs(r.mass_x - x.mean()) < 1e-9 and abs(r.mass_y - y.mean()) < 1e-9


def test_remove_small(segs, masks):
    got = to_masks(K.remove_small(K.components(segs, W), 10), H, W, masks)
    for k, m in masks.items():
        lab = flood_labels(m, 8)
        size = {r: (lab == r).sum() for r in set(lab[lab >= 0].tolist())}
        assert np.array_equal(got[k], np.vectorize(lambda v: v >= 0 and size[v] >= 10)(lab))


def test_kernels():
    assert O.ellipse(3) == [(-1, 0), (0, 1), (1, 0)]
    assert O.ellipse(5) == [(-2, 1), (-1, 1), (0, 2), (1, 1), (2, 1)]
    assert len(O.ellipse(11)) == 11


@pytest.mark.parametrize("size", [3, 5, 11])
def test_dilate_and_erode(segs, masks, size):
    k = O.ellipse(size)
    grown = to_masks(O.dilate(segs, size, H, W), H, W, masks)
    full = {i: m | (np.add.outer(np.arange(H), np.arange(W)) % 9 > 1) for i, m in masks.items()}
    dense = segs.sparkSession.createDataFrame(segments_of(full), SEGMENTS)
    thin = to_masks(O.erode(dense, size, H, W), H, W, masks)
    for i in masks:
        assert np.array_equal(grown[i], morph(masks[i], k, True))
        assert np.array_equal(thin[i], morph(full[i], k, False))


def test_bridge_and_order(segs, masks):
    k = O.ellipse(11)
    got = to_masks(O.bridge(segs, H, W, 5), H, W, masks)
    opened, closed = to_masks(O.open_(segs, 3, H, W), H, W, masks), to_masks(O.close(segs, 3, H, W), H, W, masks)
    for i, m in masks.items():
        assert np.array_equal(got[i], m | morph(morph(m, k, True), k, False))
        assert (closed[i] >= m).all() and (m >= opened[i]).all()


def test_smooth(segs, masks):
    k = O.ellipse(5)
    got = to_masks(O.smooth(segs, H, W, 5, 1), H, W, masks)
    for i, m in masks.items():
        c = morph(morph(m, k, True), k, False)
        assert np.array_equal(got[i], morph(morph(c, k, False), k, True))


@pytest.mark.parametrize("block", [128, 7])
def test_gaussian_smoothing(spark, block):
    masks = random_masks(2, 30, 26, 4, 0.5)
    df = spark.createDataFrame(segments_of(masks), SEGMENTS)
    got = to_masks(S.smooth_gaussian(df, 30, 26, 1.5, 2, block), 30, 26, masks)
    g = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    g /= g.sum()
    for i, m in masks.items():
        a = m.astype(float)
        for _ in range(2):
            p = np.pad(a, 6, mode="symmetric")
            a = np.array([[(p[r:r + 13, c:c + 13] * np.outer(g, g)).sum() for c in range(26)] for r in range(30)]) > 0.5
            a = a.astype(float)
        assert np.array_equal(got[i], a > 0)


def test_boundary(segs, masks):
    got = to_masks(O.boundary(segs, H, W), H, W, masks)
    for i, m in masks.items():
        p = np.pad(m, 1)
        inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        assert np.array_equal(got[i], m & ~inner)
