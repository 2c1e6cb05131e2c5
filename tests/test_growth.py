"""Plans and results that must hold when the tables grow: no unfolded side is broadcast, images are placed once."""

import numpy as np
import pytest

from __spark_entry__ import queries
from helpers import SEGMENTS, flood_labels, morph, random_masks, segments_of, to_masks
from runmosaic.operators import components as K
from runmosaic.operators import masks as M
from runmosaic.operators import morphology as O

SF = "/root/testdata/sf0.001"


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["quality_map", "mask_crop", "tile_table_labels", "stitch_report"])
def test_unfolded_tiles_are_not_broadcast(spark, name):
    """Orders are narrow, their tiles are not; only whole images may be broadcast."""
    joins = [line for line in nodes(queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "row" in line or "_br" in line or "_cell" in line or "_rc" in line]


@pytest.mark.parametrize("name, most", [("close", 3), ("smooth", 3), ("bridge_gaps", 6), ("outline", 3), ("mask_pixels", 4), ("mask_encode", 4)])
def test_images_are_placed_once(spark, name, most):
    """The view, copies that collapse, and one placement; a mask that meets its own steps lists them twice and makes them once."""
    assert nodes(queries()[name](spark, SF)).count("Exchange hashpartitioning") <= most


@pytest.fixture(scope="module")
def masks():
    return random_masks(3, 24, 31, 5, 0.5)


def test_steps_in_narrow_bands(spark, masks):
    """Bands narrower than the kernel's reach give what one band gives."""
    df = spark.createDataFrame(segments_of(masks), SEGMENTS)
    cross, wide = O.ellipse(3), O.ellipse(5)
    closed = {k: morph(morph(m, cross, True), cross, False) for k, m in masks.items()}
    opened = {k: morph(morph(m, cross, False), cross, True) for k, m in closed.items()}
    smooth = {k: m for k, m in masks.items()}
    for _ in range(2):
        for first in (True, False):
            smooth = {k: morph(morph(m, wide, first), wide, not first) for k, m in smooth.items()}
    for band in (2, 7):
        for got, want in ((O.close(df, 3, 24, 31, band=band), closed), (O.close_open(df, 3, 24, 31, band=band), opened), (O.smooth(df, 24, 31, band=band), smooth)):
            got = to_masks(got, 24, 31, masks)
            assert all(np.array_equal(got[k], want[k]) for k in masks)
        edge = to_masks(O.boundary(df, 24, 31, band=band), 24, 31, masks)
        for k, m in masks.items():
            p = np.pad(m, 1)
            assert np.array_equal(edge[k], m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]))


def test_band_of_a_step_is_not_left_in_the_result(spark, masks):
    df = spark.createDataFrame(segments_of(masks), SEGMENTS)
    assert O.bridge(df, 24, 31, 2, band=5).columns == ["image_id", "col", "r0", "r1"]
    got, want = (O.bridge(df, 24, 31, 2, band=b).collect() for b in (5, 64))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block, square", [(3, 6), (4, 2048), (3, 3)])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_links_settled_in_squares(spark, masks, block, square, connectivity):
    got = {(r.image_id, r.col, r.r0): r.root for r in K.components(spark.createDataFrame(segments_of(masks), SEGMENTS), 31, connectivity, block=block, square=square).collect()}
    lab = {k: flood_labels(m, connectivity) for k, m in masks.items()}
    assert len(got) == len(segments_of(masks)) and all(v == lab[k][r, c] for (k, c, r), v in got.items())


def test_no_rounds_for_links_inside_a_square(spark, masks, monkeypatch):
    monkeypatch.setattr(K, "connected", lambda *a: pytest.fail("rounds"))
    assert K.components(spark.createDataFrame(segments_of(masks), SEGMENTS), 31, block=4).count() == len(segments_of(masks))


def test_copies_collapse_before_they_are_placed(spark):
    df = spark.createDataFrame([(1, 4, 2, 9)] * 50 + [(1, 4, 5, 12), (2, 0, 0, 3)], SEGMENTS)
    assert sorted(map(tuple, M.union(df, place=True).collect())) == [(1, 4, 2, 12), (2, 0, 0, 3)]


def test_turned_pixels_stay_where_their_image_is(spark):
    """Pixels are many times their segments; they are merged without another shuffle."""
    above, below = nodes(queries()["augmented_masks"](spark, SF)).split("Union", 1)
    assert "Exchange" not in above and "Exchange" in below


def test_votes_are_placed_once(spark):
    assert nodes(queries()["ensemble_intersection"](spark, SF)).count("Exchange hashpartitioning") <= 5


def test_images_travel_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        queries()["image_bytes"](spark, SF)
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, old)


def test_results_of_images_leave_in_parts(spark, monkeypatch):
    """A batch of images is handed back in several parts, with all rows and bad images."""
    from runmosaic.operators import images as I
    rows = [(k, 4, 4, 3, bytes([k] * 48)) for k in range(50)] + [(99, 4, 4, 3, b"short")]
    df = spark.createDataFrame(rows, "image_id bigint, " + I.PIXELS).coalesce(1)
    monkeypatch.setattr(I, "OUT_BYTES", 100)
    out = {r.image_id: r for r in I.per_image(df, lambda a, _: a[::-1]).collect()}
    assert len(out) == 51 and out[99].status == "error" and all(out[k].data == bytes([k] * 48) for k in range(50))


@pytest.mark.parametrize("name, most", [("ensemble_voting", 3), ("mask_iou_pairs", 4), ("mask_difference", 2)])
def test_unfolded_rows_stay_with_their_image(spark, name, most):
    """Narrow rows are dealt out by image, one shuffle a view; what they unfold into meets there, in joins too."""
    assert nodes(queries()[name](spark, SF)).count("Exchange hashpartitioning") <= most


def test_parts_grow_with_the_table(spark):
    """A part holds a stated number of narrow rows, whatever the size of the table; later steps use as many parts."""
    from runmosaic.session import image_parts
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    try:
        df = spark.range(1000).withColumnRenamed("id", "image_id")
        assert image_parts(df, 10_000) == int(old) and image_parts(df, 10) == 100
        assert M.placed(df, ["image_id"]).rdd.getNumPartitions() == 100
    finally:
        spark.conf.set(key, old)


def test_envelope_takes_one_step_a_row(spark):
    """A frame that reaches from a row to the end of its block is summed anew for every row."""
    from runmosaic.operators import scores as C
    df = C.in_blocks(spark.createDataFrame([(i / 50, float(i * 7 % 50)) for i in range(50)] + [(2.0, float("nan")), (3.0, None)], "s double, v double"), "s")
    env = C.best_from_here_down(df, ["v"], "s")
    assert "unboundedfollowing" not in nodes(env).lower().replace(" ", "")
    got = {r.s: r.v for r in env.filter("s < 1").collect()}
    assert got == {i / 50: max(float(k * 7 % 50) for k in range(i + 1)) for i in range(50)}


def test_label_texts_are_made_once(spark):
    """A filter on a made text must not take the text down to the scan, where few tasks make it, nor make it twice."""
    steps = [line for line in nodes(queries()["label_lines"](spark, SF)).splitlines() if "Filter" in line]
    assert not [line for line in steps if "768.0" in line or "split(" in line]


def test_short_label_lines_give_no_row(spark):
    from runmosaic.sources import manifest as N
    df = spark.createDataFrame([("a", "0 0.5 0.5"), ("b", "0 0.5"), ("c", ""), ("d", None), ("e", "0 x 0.5 1 1")], "file string, value string")
    got = sorted((r.file, r.class_id, r.seq, r.x, r.y) for r in N.label_lines(df, (10, 10)).collect() if r.file != "e")
    assert got == [("a", 0, 0, 5, 5)]
    assert N.label_lines(df.filter("file = 'e'"), (10, 10)).count() == 2


@pytest.mark.parametrize("connectivity", [4, 8])
def test_borders_meet_at_their_corners_without_a_join(spark, masks, connectivity):
    """An edge is two numbers; every edge follows one other, also where two corners of a mask touch."""
    from runmosaic.operators import rings as R
    edges = R.successors(R.border(M.union(spark.createDataFrame(segments_of(masks), SEGMENTS), place=True)), connectivity, M.KEYS)
    assert edges.columns == ["image_id", "id", "nxt"] and "Join" not in nodes(edges)
    rows = [tuple(r) for r in edges.collect()]
    assert len(rows) == len(set(rows)) and sorted(r[:2] for r in rows) == sorted((r[0], r[2]) for r in rows)


@pytest.mark.parametrize("name", ["stitch_weighted", "stitch_consensus", "stitch_average"])
def test_patch_rows_lie_in_a_stated_number_of_parts(spark, name):
    """They unfold into pixels: adaptive execution must not join their parts again."""
    lines = [line for line in nodes(queries()[name](spark, SF)).splitlines() if "Exchange hashpartitioning(image_id" in line and ", col#" in line]
    assert lines and all("REPARTITION_BY_NUM" in line for line in lines)


@pytest.mark.parametrize("name, step", [("merge_tiles_masks", "bit_or("), ("merge_tiles_dissolve", "_cx#")])
def test_pairs_of_a_merge_are_made_once(spark, name, step):
    """They are written before the rounds; what follows reads that table."""
    assert step not in nodes(queries()[name](spark, SF))


def test_crossings_of_rings_are_not_shuffled(spark):
    """Orders are dealt out by image before their rings unfold into one row a column and edge; both readers of the rings list that."""
    assert nodes(queries()["geojson_multi_rings"](spark, SF)).count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("block", [8, 16, 1024])
def test_masks_meet_in_blocks(spark, monkeypatch, block):
    """Masks that lie in one block are final there, those that reach into others are summed; rows that repeat or overlap count once."""
    from runmosaic.operators import boxes as B
    monkeypatch.setattr(B, "BLOCK", block)
    g = np.random.default_rng(4)
    rows, drawn = {"p": [], "g": []}, {"p": {}, "g": {}}
    for side in rows:
        for image in range(2):
            for k in range(9):
                m = drawn[side][image, k] = np.zeros((40, 40), bool)
                for _ in range(1 + k % 3):  # masks of several pieces
                    c, r, w, h = g.integers(0, 30, 2).tolist() + g.integers(1, 10, 2).tolist()
                    m[r:r + h, c:c + w] = True
                    rows[side] += [(image, f"m{k}", x, r, r + h) for x in range(c, c + w)] + [(image, f"m{k}", c, r, r + 1)]
    pred = spark.createDataFrame(rows["p"], "image_id bigint, box_id string, col bigint, r0 bigint, r1 bigint")
    gt = spark.createDataFrame(rows["g"], "image_id bigint, gt_id string, col bigint, r0 bigint, r1 bigint")

    def want(a, b, own):
        out = {}
        for (i, k), x in a.items():
            for (j, n), y in b.items():
                if i == j and (x & y).any() and not (own and k == n):
                    out[i, f"m{k}", f"m{n}"] = (int((x & y).sum()), (x & y).sum() / (x | y).sum())
        return out

    def check(df, expected):
        got = {(r.image_id, r.pred, r.gt): (r.overlap, r.iou) for r in df.collect()}
        assert df.count() == len(got) and got.keys() == expected.keys()
        assert all(got[k][0] == expected[k][0] and abs(got[k][1] - expected[k][1]) < 1e-12 for k in got)

    both = want(drawn["p"], drawn["g"], False)
    check(B.mask_iou_pairs(pred, gt), both)
    check(B.mask_iou_pairs(pred, gt, least_iou=0.1), {k: v for k, v in both.items() if v[1] >= 0.1})
    check(B.mask_iou_pairs(pred, None), want(drawn["p"], drawn["p"], True))
    assert B.mask_iou_pairs(pred.limit(0), gt).count() == 0


def test_mask_pairs_hold_one_sort_of_the_segments(spark):
    """Words of both sides are not merged, sorted and joined several times in one task, which passed its share of memory."""
    assert "bit_or(" not in nodes(queries()["mask_iou_pairs"](spark, SF))


def test_seams_stay_with_their_image(spark):
    """Images are dealt out before tiles unfold; strips of a block are merged in one pass, without windows and joins."""
    text = nodes(queries()["tile_seams"](spark, SF))
    assert "Window" not in text and "Join" not in text and text.count("Exchange hashpartitioning") <= 3


def test_rectangles_of_several_blocks(spark):
    from runmosaic.operators import tiles as T
    g = np.random.default_rng(6)
    rects = [(i, int(c), int(c + w), int(r), int(r + h)) for i in range(3) for c, r, w, h in g.integers(1, 25, (12, 4))]
    out = T.union_rectangles(spark.createDataFrame(rects + rects[:5], "image_id bigint, c0 bigint, c1 bigint, r0 bigint, r1 bigint"), block=16).collect()
    want, got = np.zeros((3, 64, 64), int), np.zeros((3, 64, 64), int)
    for i, c0, c1, r0, r1 in rects:
        want[i, r0:r1, c0:c1] = 1
    for r in out:
        got[r.image_id, r.r0:r.r1, r.c0:r.c1] += 1
    assert np.array_equal(got, want)


def test_tiles_meet_masks_where_their_image_lies(spark):
    """The view of ships, the images and one row for each tile with pixels are shuffled, not the cells that tiles touch."""
    text = nodes(queries()["tile_table_labels_sized"](spark, SF))
    assert "_cell" not in text and text.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("block", [16, 1024])
def test_tile_labels_over_several_blocks(spark, monkeypatch, masks, block):
    from runmosaic.operators import tiles as T
    monkeypatch.setattr(T, "BLOCK", block)
    segs = segments_of(masks) + [(k, 3, 2, 20) for k in masks] + [(k, 3, 10, 24) for k in masks]  # rows that overlap and repeat
    full = {k: m.copy() for k, m in masks.items()}
    for m in full.values():
        m[2:24, 3] = True
    boxes = [(k, r, c, 9, 12) for k in masks for r in (0, 7, 15, 30) for c in (0, 10, 19, 40)]
    df = spark.createDataFrame(boxes + boxes[:3], "image_id bigint, row bigint, col bigint, height bigint, width bigint")
    out = T.label_tiles(df, spark.createDataFrame(segs, SEGMENTS), 10).collect()
    assert len(out) == len(boxes) + 3
    assert all(r.ship_pixels == full[r.image_id][r.row:r.row + 9, r.col:r.col + 12].sum() for r in out)
