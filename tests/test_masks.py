import numpy as np
import pytest
from helpers import SEGMENTS, random_masks, segments_of, to_masks

from runmosaic.operators import masks as M

RLE = "image_id string, rle string"


def decoded(spark, text, pixels=None):
    df = spark.createDataFrame([("a", text)], RLE)
    return sorted((r.s, r.e) for r in M.decode(df, pixels=pixels).collect())


@pytest.mark.parametrize("text", [None, "", "  ", "0"])
def test_empty_masks_have_no_runs(spark, text):
    assert decoded(spark, text) == []


def test_decode_is_column_major(spark):
    runs = M.decode(spark.createDataFrame([("a", "1 5")], RLE), pixels=9)
    px = {(r.row, r.col) for r in M.to_pixels(M.to_segments(runs, 3)).collect()}
    assert px == {(0, 0), (1, 0), (2, 0), (0, 1), (1, 1)}


def test_decode_two_runs(spark):
    assert sum(e - s for s, e in decoded(spark, "1 3 7 3")) == 6


def test_decode_clips_and_drops_unpaired(spark):
    assert decoded(spark, "8 5 4", 9) == [(7, 9)]
    assert decoded(spark, "20 5", 9) == []


def test_full_mask_encodes_as_one_run(spark):
    df = M.to_segments(M.decode(spark.createDataFrame([("a", "1 12")], RLE)), 3)
    assert M.encode(df, 3).first().rle == "1 12"


def test_runs_over_column_borders_are_one_and_lists_are_walked_once(spark):
    """No list is filtered again for each of its elements, which made a mask of n runs n * n steps."""
    df = spark.createDataFrame([(1, 0, 3, 10), (1, 1, 0, 10), (1, 2, 0, 4), (1, 4, 2, 3), (1, 9, 9, 10), (2, 0, 0, 2), (2, 5, 8, 10), (3, 7, 1, 2)], SEGMENTS)
    out = M.encode(df, 10)
    assert {r.image_id: r.rle for r in out.collect()} == {1: "4 21 43 1 100 1", 2: "1 2 59 2", 3: "72 1"}
    lines = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lambdafunction(concat" in line]
    assert lines and "filter(" not in lines[0].split("lambdafunction(concat", 1)[1]


def test_encode_decode_and_areas(spark):
    h, w = 9, 7
    a, b = random_masks(4, h, w, 1), random_masks(4, h, w, 2)
    da, db = (spark.createDataFrame(segments_of(m), SEGMENTS) for m in (a, b))
    back = M.to_segments(M.decode(M.encode(da, h).select("image_id", "rle"), pixels=h * w), h)
    got = to_masks(back, h, w, a)
    for k in a:
        assert np.array_equal(got[k], a[k])
    rules = {"union": np.logical_or, "intersect": np.logical_and, "xor": np.logical_xor, "difference": lambda x, y: x & ~y}
    for name, rule in rules.items():
        got = to_masks(M.combine(da, db, name), h, w, a)
        assert all(np.array_equal(got[k], rule(a[k], b[k])) for k in a), name
    area = {r.image_id: r.area for r in M.area(da.unionByName(db)).collect()}
    assert area == {k: int((a[k] | b[k]).sum()) for k in a}
    n = {r.image_id: (r.n_pred, r.n_truth, r.n_both) for r in M.pair_counts(da, db).collect()}
    assert n == {k: (int(a[k].sum()), int(b[k].sum()), int((a[k] & b[k]).sum())) for k in a}


def test_words_hold_tall_columns(spark):
    df = spark.createDataFrame([(1, 0, 3, 200), (1, 0, 190, 256), (1, 1, 63, 65)], SEGMENTS)
    assert M.area(df).first().area == 253 + 2


def test_results_are_merged(spark):
    df = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 3, 5), (1, 0, 1, 2), (1, 0, 7, 9)], SEGMENTS)
    assert sorted((r.r0, r.r1) for r in M.union(df).collect()) == [(0, 5), (7, 9)]


@pytest.mark.parametrize("dst", [(4, 3), (9, 7), (20, 13)])
def test_resize_reads_floor_source(spark, dst):
    h, w = 9, 7
    a = random_masks(2, h, w, 5)
    got = to_masks(M.resize_nearest(spark.createDataFrame(segments_of(a), SEGMENTS), (h, w), dst), *dst, a)
    r, c = np.arange(dst[0]) * h // dst[0], np.arange(dst[1]) * w // dst[1]
    assert all(np.array_equal(got[k], a[k][np.ix_(r, c)]) for k in a)


def test_hot_image_of_copies(spark):
    """One image holds most rows as copies; results equal those of the distinct rows."""
    base = [(1, c, 5, 30 + c) for c in range(6)]
    df = spark.createDataFrame(base * 400 + [(2, 0, 0, 4)], SEGMENTS)
    assert {r.image_id: r.area for r in M.area(df).collect()} == {1: sum(25 + c for c in range(6)), 2: 4}
    assert M.union(df).count() == 7
    assert M.combine(df, df, "xor").count() == 0
