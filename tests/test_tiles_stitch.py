import numpy as np
import pytest
from helpers import SEGMENTS, random_masks, segments_of, to_masks
from pyspark.sql import functions as F

from runmosaic.operators import images as I
from runmosaic.operators import masks as M
from runmosaic.operators import stitch as S
from runmosaic.operators import tiles as T

SIZES = "image_id bigint, height bigint, width bigint"


def grid(spark, size, edge, patch=224, overlap=32):
    df = spark.createDataFrame([(1, size, size)], SIZES)
    return sorted((r["pass"], r.row, r.col) for r in T.grid(df, patch, overlap, edge).collect())


def test_plain_grid(spark):
    assert {r for _, r, _ in grid(spark, 512, "none")} == {0, 192}
    assert len(grid(spark, 768, "none")) == 9
    assert grid(spark, 200, "none") == []


@pytest.mark.parametrize("size", [768, 512, 416, 384, 224, 200])
@pytest.mark.parametrize("edge", ["none", "reference", "cover"])
def test_grid_equals_tile_origins(spark, size, edge):
    assert grid(spark, size, edge) == sorted(I.tile_origins(size, size, 224, 32, edge))


def test_reference_edges_repeat_and_leave_gaps(spark):
    assert len(grid(spark, 416, "reference")) == 9 and len({g[1:] for g in grid(spark, 416, "reference")}) == 4
    assert max(c for _, _, c in grid(spark, 768, "reference")) == 384
    assert max(c for _, _, c in grid(spark, 768, "cover")) == 544


def test_label_is_strictly_above_one_percent(spark):
    img = spark.createDataFrame([(1, 100, 200)], SIZES)
    segs = spark.createDataFrame([(1, 0, 0, 100), (1, 100, 0, 100), (1, 101, 0, 1)], SEGMENTS)
    got = {r.col: (r.ship_pixels, r.has_ship) for r in T.label_grid(img, segs, 100, 0).collect()}
    assert got == {0: (100, 0), 100: (101, 1)}
    tiles = T.grid(img, 100, 0, "none")
    assert {r.col: r.has_ship for r in T.label_tiles(tiles, segs, 100).collect()} == {0: 0, 100: 1}


def test_tile_counts_add_up_without_overlap(spark):
    m = random_masks(3, 64, 96, 3)
    img = spark.createDataFrame([(k, 64, 96) for k in m], SIZES)
    lab = T.label_grid(img, spark.createDataFrame(segments_of(m), SEGMENTS), 32, 0)
    got = {r.image_id: r.n for r in lab.groupBy("image_id").agg(F.sum("ship_pixels").alias("n")).collect()}
    assert got == {k: int(v.sum()) for k, v in m.items()}


def test_coverage_and_seams(spark):
    img = spark.createDataFrame([(1, 100, 90)], SIZES)
    tiles = T.grid(img, 40, 10, "none")
    r = T.coverage(img, tiles).first()
    assert (r.covered, r.uncovered) == (100 * 70, 100 * 20)
    want = np.zeros((100, 90), bool)
    for t in tiles.collect():
        if t.col > 0:
            want[t.row:t.row + 40, max(0, t.col - 3):t.col + 3] = True
        if t.row > 0:
            want[max(0, t.row - 3):t.row + 3, t.col:t.col + 40] = True
    got = np.zeros((100, 90), int)
    for b in T.seam_bands(tiles, 100, 90).collect():
        got[b.r0:b.r1, b.c0:b.c1] += 1
    assert np.array_equal(got, want.astype(int))


P, OV, H, W = 24, 8, 56, 72


@pytest.fixture(scope="module")
def patches(spark):
    g = np.random.default_rng(8)
    rows = []
    for k in (1, 2):
        for seq, (_, r, c) in enumerate(I.tile_origins(H, W, P, OV, "cover")):
            m = (g.random((P, P)) * (g.random((P, P)) < 0.6)).astype(np.float32)
            rows.append((k, r, c, float(g.integers(3, 10)) / 10, seq, bytearray(m.tobytes())))
    return spark.createDataFrame(rows, "image_id bigint, row bigint, col bigint, confidence double, seq bigint, mask binary")


def brute(rows, mode, kernel):
    base = S.kernel_array(P, OV, kernel)
    smooth = S.gaussian(base, 2.0)
    out = {}
    for k in sorted({r.image_id for r in rows}):
        total, weight = np.zeros((H, W)), np.zeros((H, W))
        for r in sorted((r for r in rows if r.image_id == k), key=lambda r: r.seq):
            m = np.frombuffer(r.mask, np.float32).reshape(P, P).astype(float)
            conf = r.confidence if kernel == "distance" else 1.0
            at = np.s_[r.row:r.row + P, r.col:r.col + P]
            if mode == "weighted":
                total[at] += m * base * conf
                weight[at] += base * conf
            elif mode == "average":
                total[at] += m
                weight[at] += 1
            elif mode == "max":
                total[at] = np.maximum(total[at], m)
            else:
                total[at] = total[at] * (1 - smooth * conf) + m * smooth * conf
        if mode in ("weighted", "average"):
            total = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
        out[k] = total > 0.5
    return out


@pytest.mark.parametrize("mode,kernel", [("weighted", "ramp"), ("weighted", "distance"), ("average", "ramp"), ("max", "ramp"), ("feather", "distance")])
@pytest.mark.parametrize("block", [512, 20])
def test_dense_stitch(patches, mode, kernel, block):
    want = brute(patches.collect(), mode, kernel)
    got = to_masks(S.stitch_dense(patches, P, OV, H, W, mode, kernel, block=block), H, W, want)
    assert all(np.array_equal(got[k], want[k]) for k in want)


def test_sparse_forms_equal_dense(spark, patches):
    """Constant probability per patch, so both forms see the same numbers."""
    rows, segs, flat = patches.collect(), [], []
    for r in rows:
        m = np.frombuffer(r.mask, np.float32).reshape(P, P) > 0.4
        p = round(r.confidence - 0.03, 2)
        flat.append((r.image_id, r.row, r.col, r.confidence, r.seq, bytearray((m * np.float32(p)).tobytes())))
        segs += [(r.image_id, r.row, r.col, c + r.col, a + r.row, b + r.row, p) for _, c, a, b in segments_of({0: m})]
    dense = spark.createDataFrame(flat, patches.schema)
    sparse = spark.createDataFrame(segs, "image_id bigint, tile_row bigint, tile_col bigint, col bigint, r0 bigint, r1 bigint, p double")
    table = dense.select("image_id", "row", "col", "confidence").withColumn("height", F.lit(P)).withColumn("width", F.lit(P))
    order = dense.withColumn("seq", F.col("row") * 1000 + F.col("col")).collect()
    for mode, kernel, got in (("weighted", "ramp", S.weighted_blend(table, sparse, P, OV)),
                              ("weighted", "distance", S.weighted_blend(table, sparse, P, OV, kernel="distance")),
                              ("average", "ramp", S.average_blend(table, sparse)), ("max", "ramp", S.max_blend(sparse)),
                              ("feather", "distance", S.feather_blend(table, sparse, P, OV))):
        want = brute(order, mode, kernel)
        mine = to_masks(got, H, W, want)
        off = sum(int((mine[k] != want[k]).sum()) for k in want)
        assert off <= 2, (mode, kernel, off)  # float32 masks can fall on the other side of an exact tie


@pytest.mark.parametrize("size", [39, 40, 41, 68, 96, 97, 150, 151])
@pytest.mark.parametrize("patch,overlap", [(40, 12), (40, 30), (40, 0)])
@pytest.mark.parametrize("edge", ["none", "cover"])
def test_grid_in_closed_form(spark, size, patch, overlap, edge):
    """Cover, starts over a position, cuts and parts of segments, against the listed tiles."""
    g = T.Grid(patch, overlap, "height", 77, edge)
    img = spark.createDataFrame([(1, size, 77)], SIZES)
    tiles = [(t.row, t.col) for t in T.grid(img, patch, overlap, edge).collect()]
    starts = sorted({r for r, _ in tiles}) if tiles else []
    v = spark.range(size).selectExpr("id as v", f"{size}L as height")
    for r in v.selectExpr("v", f"{g.count('v', 'height')} as n", f"{g.over('v', 'height')} as s").collect():
        want = [s for s in starts if s <= r.v < s + patch]
        if tiles:  # an axis shorter than a tile has none
            assert r.n == len(want) and sorted(r.s) == want
    cuts = v.selectExpr(g.cuts("0L", "height", "height") + " as c").first().c
    assert all(a in cuts for s in starts for a in (s, s + patch) if 0 < a < size)
    segs = spark.createDataFrame([(1, size, 5, 0, size), (1, size, 60, 3, min(size, 50)), (1, size, 76, size - 1, size)],
                                 "image_id bigint, height bigint, col bigint, r0 bigint, r1 bigint")
    got = sorted(tuple(r)[2:] for r in T.over_grid(segs, g, ("image_id", "height")).collect())
    want = sorted((r, c, s.col, max(s.r0, r), min(s.r1, r + patch)) for s in segs.collect() for r, c in tiles
                  if c <= s.col < c + patch and s.r0 < r + patch and s.r1 > r)
    assert got == want


@pytest.mark.parametrize("edge", ["none", "cover"])
def test_closed_form_equals_listed_patches(spark, edge):
    """Every blend with a grid gives what it gives without."""
    img = spark.createDataFrame([(1, 97, 83), (2, 97, 83)], SIZES)
    table = T.grid(img, 40, 12, edge).withColumn("confidence", F.expr("(row * 7 + col * 3 + image_id) % 10 / cast(10.0 as double)"))
    g = np.random.default_rng(2)
    segs = [(t.image_id, t.row, t.col, t.col + c, t.row + int(a), t.row + int(a) + int(n), t.confidence) for t in table.collect() for c in range(0, 40, 3)
            for a, n in [(g.integers(0, 20), g.integers(1, 20))]]
    sparse = spark.createDataFrame(segs, "image_id bigint, tile_row bigint, tile_col bigint, col bigint, r0 bigint, r1 bigint, p double")
    grid = T.Grid(40, 12, 97, 83, edge)
    for blend in (lambda **k: S.vote(table, sparse, **k), lambda **k: S.consensus(table, sparse, **k), lambda **k: S.average_blend(table, sparse, 0.3, **k),
                  lambda **k: S.weighted_blend(table, sparse, 40, 12, 0.3, digits=9, **k), lambda **k: S.weighted_blend(table, sparse, 40, 12, 0.3, "distance", digits=9, **k),
                  lambda **k: S.feather_blend(table, sparse, 40, 12, 0.3, digits=9, **k)):
        want = sorted(map(tuple, blend().collect()))
        assert want and sorted(map(tuple, blend(grid=grid).collect())) == want
    near = lambda **k: sorted((r.image_id, r.row, r.col, tuple(map(tuple, r.patches))) for r in S.neighbours(table, **k).collect())
    assert near(grid=grid) == near()


def test_kernels_have_closed_form():
    k = S.kernel_array(224, 32, "distance")
    assert k[15, 100] == 0 and k[16, 100] == 1 / 16 and k[100, 100] == 1 and k[207, 100] == 1 / 16 and k[208, 100] == 0
    r = S.kernel_array(224, 32, "ramp")
    assert r[0, 0] == 1 / 256 and r[0, 100] == 1 / 16 and r[223, 100] == 1 / 16


@pytest.mark.parametrize("block", [1024, 37])
def test_pieces_do_not_depend_on_blocks(spark, block):
    """Small blocks give more rectangles over the same pixels with the same values."""
    img = spark.createDataFrame([(1, 150, 130), (2, 90, 60)], SIZES)
    tiles = T.grid(img, 40, 12, "cover").withColumn("confidence", F.expr("(row * 7 + col * 3) % 10 / cast(10.0 as double)"))
    want = {}
    for t in tiles.collect():
        for r in range(t.row, t.row + 40):
            for c in range(t.col, t.col + 40):
                want.setdefault((t.image_id, r, c), []).append((t.row, t.col, t.confidence))
    got, rects = {}, S.cells(tiles, block=block).collect()
    for q in rects:
        for r in range(q.r0, q.r1):
            for c in range(q.c0, q.c1):
                assert (q.image_id, r, c) not in got
                got[(q.image_id, r, c)] = [tuple(p) for p in q.patches]
    assert got == {k: sorted(v) for k, v in want.items()}
    cover = T.union_rectangles(tiles.selectExpr("image_id", "col as c0", "col + width as c1", "row as r0", "row + height as r1"), block=block).collect()
    px = [(q.image_id, r, c) for q in cover for r in range(q.r0, q.r1) for c in range(q.c0, q.c1)]
    assert len(px) == len(set(px)) and set(px) == set(want)


def test_crop_takes_each_part_once_across_row_cells(spark):
    segs = spark.createDataFrame([(1, 5, 0, 700), (1, 70, 30, 31), (1, 6, 90, 110)], SEGMENTS)
    tiles = spark.createDataFrame([(1, 0, 0, 100, 80), (1, 60, 4, 600, 3), (1, 20, 64, 20, 20)], "image_id bigint, row bigint, col bigint, height bigint, width bigint")
    rows = lambda **k: sorted(map(tuple, M.crop(segs, tiles, **k).collect()))
    assert rows(rows=50, cell=8) == rows(rows=4096, cell=64) and len(rows()) == 6
