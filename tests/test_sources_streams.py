import json
import os
import uuid

import numpy as np
import pytest
from helpers import write_png
from pyspark.sql import functions as F

from runmosaic.functions import geometry as G
from runmosaic.operators import components as K
from runmosaic.operators import geo as E
from runmosaic.operators import images as I
from runmosaic.operators import masks as M
from runmosaic.operators import scoring as D
from runmosaic.sources import geojson as SG
from runmosaic.sources import images as SI
from runmosaic.sources import manifest as SM
from runmosaic.sources import sinks as O
from runmosaic.streaming import streams as S


def test_manifest_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.jpg", "1 3"), ("a.jpg", "9 2"), ("b.jpg", None)], "image_id string, rle string")
    O.write_csv(O.submission_rows(df), str(tmp_path / "m"))
    back = SM.read_manifest(spark, str(tmp_path / "m"))
    assert sorted((r.image_id, r.rle) for r in back.na.fill("").collect()) == [("a.jpg", "1 3"), ("a.jpg", "9 2"), ("b.jpg", "")]
    assert SM.positives(df).count() == 2
    none = df.filter("rle is null")
    assert SM.positives(none).count() == 1 and SM.positives(none, "none").count() == 0
    with pytest.raises(Exception, match="no positive rows"):
        SM.positives(none, "error").collect()


def test_patch_prediction_folders(spark, tmp_path):
    df = spark.createDataFrame([("i1", 0, 0, 0, 0.5), ("i1", 1, 0, 192, 0.2), ("i2", 0, 0, 0, 0.9)],
                               "image_id string, patch_id int, row int, col int, probability double")
    O.write_patch_predictions(df, f"file://{tmp_path}/p")
    back = SM.read_patch_predictions(spark, f"file://{tmp_path}/p")
    assert sorted((r.image_id, r.patch_id, r.probability, r.has_ship) for r in back.collect()) == [
        ("i1", 0, 0.5, True), ("i1", 1, 0.2, False), ("i2", 0, 0.9, True)]


def test_label_files(spark, tmp_path):
    rings = spark.createDataFrame([("a", [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 0.0)]), ("b", [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)])],
                                  "image_id string, ring array<struct<x:double,y:double>>")
    lines = E.label_lines(rings, 16, 16)
    assert [(r.image_id, r.line) for r in lines.collect()] == [("a", "0 0.0 0.0 0.5 0.0 0.5 0.25")]
    O.write_text(lines.withColumn("split", F.lit("train")), "line", str(tmp_path / "l"), ["split"])
    back = SM.read_label_files(spark, str(tmp_path / "l" / "split=train"), (16, 16))
    assert sorted((r.seq, r.x, r.y) for r in back.collect()) == [(0, 0, 0), (1, 8, 0), (2, 8, 4)]


def test_geojson_files(spark, tmp_path):
    box = spark.createDataFrame([("t1", 1, 0, 0, 4, 3), ("t1", 2, 5, 5, 9, 9)], "image_id string, id bigint, x1 int, y1 int, x2 int, y2 int")
    f = box.withColumn("ring", G.box_ring()).withColumn("feature", E.feature("ring", {"class": F.lit("ship"), "note": F.lit("x")}, "id"))
    doc = E.collections(f, "id", "EPSG:4326").first().geojson
    d = json.loads(doc)
    assert d["type"] == "FeatureCollection" and d["crs"]["properties"]["name"] == "EPSG:4326"
    assert d["properties"] == {"num_ships": 2, "total_area": 28.0}
    assert d["features"][0]["properties"]["centroid"] == [2.0, 1.5] and d["features"][0]["properties"]["bbox"] == [0.0, 0.0, 4.0, 3.0]
    (tmp_path / "t1.geojson").write_text(json.dumps(d, indent=2))
    back = SG.read_features(spark, str(tmp_path))
    assert sorted((r.idx, r.properties["class"], len(r.ring)) for r in back.collect()) == [(0, "ship", 5), (1, "ship", 5)]
    assert E.validate(SG.read_collections(spark, str(tmp_path)), "geojson", ["file"]).isEmpty()


def test_rasterise_concave(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, 1, ring)], "image_id bigint, id bigint, ring array<struct<x:double,y:double>>")
    got = {(r.row, r.col) for r in M.to_pixels(E.rasterise(df, 12, 12, "id")).collect()}

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hit = not hit
        return hit

    assert got == {(r, c) for r in range(12) for c in range(12) if inside(c + 0.5, r + 0.5)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("img")
    g = np.random.default_rng(1)
    rgb = g.integers(0, 60, (64, 80, 3)).astype(np.uint8)
    rgb[10:22, 12:30] = 250
    write_png(d / "ship.png", rgb)
    write_png(d / "grey.PNG", g.integers(0, 255, (64, 80)).astype(np.uint8))
    write_png(d / "alpha.png", np.dstack([rgb, np.full((64, 80), 255, np.uint8)]))
    write_png(d / "flat.png", np.full((64, 80, 3), 7, np.uint8))
    (d / "broken.png").write_bytes(b"not an image")
    (d / "notes.txt").write_text("no image")
    return d, rgb


def test_read_images(spark, folder):
    d, rgb = folder
    rows = {r.image_id: r for r in SI.read_images(spark, str(d)).collect()}
    assert set(rows) == {"ship.png", "grey.PNG", "alpha.png", "flat.png", "broken.png"}
    assert rows["broken.png"].status == "error" and rows["broken.png"].data is None
    for n in ("ship.png", "alpha.png"):
        r = rows[n]
        assert (r.height, r.width, r.channels) == (64, 80, 3) and bytes(r.data) == rgb.tobytes()
    grey = np.frombuffer(rows["grey.PNG"].data, np.uint8).reshape(64, 80, 3)
    assert (grey[:, :, 0] == grey[:, :, 2]).all()


def test_missing_image_policies(spark, folder):
    images = SI.read_images(spark, str(folder[0]))
    ids = spark.createDataFrame([("ship.png",), ("broken.png",), ("absent.png",)], "image_id string")
    assert SI.expected(ids, images).count() == 1
    zero = {r.image_id: (r.height, len(r.data)) for r in SI.expected(ids, images, "zero").collect()}
    assert zero == {"ship.png": (64, 64 * 80 * 3), "broken.png": (224, 224 * 224 * 3), "absent.png": (224, 224 * 224 * 3)}
    assert {r.image_id for r in SI.missing(ids, images).collect()} == {"broken.png", "absent.png"}
    with pytest.raises(Exception, match="image not found"):
        SI.expected(ids, images, "fail").collect()


def good(spark, folder):
    return SI.read_images(spark, str(folder)).filter("status = 'success'")


def test_tiles_of_uniform_images_are_left_out(spark, folder):
    t = I.extract_tiles(good(spark, folder[0]), 32, 8, "cover", 1.0)
    n = {r.image_id: (r["count"], r.m) for r in t.groupBy("image_id").agg(F.count("*").alias("count"), F.max("patch_id").alias("m")).collect()}
    assert n == {"ship.png": (9, 8), "grey.PNG": (9, 8), "alpha.png": (9, 8)}


def run(spark):
    score, mask = D.score_udf(D.bright_share(200), 32)("data"), D.mask_udf(D.bright_mask(200), 32)("data")
    return lambda images: D.cascade(images, score, mask, (64, 80), 32, 8, 0.02, "cover", 1.0, 10)


def test_cascade_finds_the_ship(spark, folder):
    out = run(spark)(good(spark, folder[0]).filter("image_id in ('ship.png', 'flat.png')"))
    r = out["instances"].collect()
    assert [(i.image_id, i.x, i.y, i.w, i.h) for i in r] == [("ship.png", 12, 10, 18, 12)]
    log = {i.image_id: i for i in out["log"].collect()}
    assert log["flat.png"].status == "no_valid_patches" and log["ship.png"].num_ships_detected == 1
    assert log["ship.png"].num_ship_patches < log["ship.png"].num_patches


def test_segmenter_sees_positive_tiles_only(spark, folder):
    def strict():
        def model(x):
            if ((x > 200).reshape(len(x), -1).mean(axis=1) < 0.02).any():
                raise ValueError("negative tile reached the segmenter")
            return D.bright_mask(200)()(x)
        return model
    score = D.score_udf(D.bright_share(200), 32)("data")
    images = good(spark, folder[0]).filter("image_id = 'ship.png'")
    assert D.cascade(images, score, D.mask_udf(strict, 32)("data"), (64, 80), 32, 8, 0.02)["segments"].count() > 0


def counting(make, folder):
    """A model that leaves one byte a tile in a file of its own."""
    def factory():
        model = make()

        def run(x):
            with open(folder / f"{os.getpid()}-{uuid.uuid4().hex}", "wb") as f:
                f.write(b"x" * len(x))
            return model(x)
        return run
    return factory


@pytest.mark.parametrize("streamed", [False, True])
def test_each_model_is_called_once_a_tile(spark, folder, tmp_path, streamed):
    calls = {n: tmp_path / n for n in ("score", "mask")}
    for f in calls.values():
        f.mkdir()
    score, mask = D.score_udf(counting(D.bright_share(200), calls["score"]), 32)("data"), D.mask_udf(counting(D.bright_mask(200), calls["mask"]), 32)("data")
    out = {}

    def go(images):
        out["c"] = D.cascade(images, score, mask, (64, 80), 32, 8, 0.02, "cover", 1.0, 10)
        return out["c"]

    if streamed:
        S.image_cascade(spark, str(folder[0]), str(tmp_path / "cp"), go, str(tmp_path / "out"), 2).awaitTermination()
        log = [r for r in spark.read.parquet(str(tmp_path / "out" / "log")).collect() if r.status != "error"]
    else:
        tables = go(good(spark, folder[0]))
        log = tables["log"].collect()
        assert tables["segments"].count() and tables["instances"].count() and tables["scores"].count() == sum(r.num_patches for r in log)
        tables.close()
    seen = {n: sum(p.stat().st_size for p in f.iterdir()) for n, f in calls.items()}
    assert seen == {"score": sum(r.num_patches for r in log), "mask": sum(r.num_ship_patches for r in log)} and seen["mask"] > 0
    assert not any(d.is_cached for d in out["c"].held)


def test_detector_isolates_errors(spark, folder):
    def make():
        def model(a):
            if (a == 7).all():
                raise ValueError("flat image")
            return D.bright_detector(200)()(a)
        return model
    rows = {r.image_id: r for r in D.detect(good(spark, folder[0]), make).collect()}
    assert rows["flat.png"].status == "error" and "flat image" in rows["flat.png"].error
    assert rows["ship.png"].num_ships == 1 and rows["ship.png"].boxes == [[12.0, 10.0, 30.0, 22.0]]
    runs = M.decode(spark.createDataFrame([("s", rows["ship.png"].rle_masks[0])], "image_id string, rle string"))
    assert M.area(M.to_segments(runs, 64)).first().area == 18 * 12


def test_manifest_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.csv").write_text("ImageId,EncodedPixels\n" + "".join(f"{i}_{j}.jpg,{j * 40 + 1} {j + 1} {j * 40 + 20} 3\n" for j in range(4)) + f"{i}_e.jpg,\n")
    q = S.append_to(S.manifest_runs(spark, str(src), 9000, 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = M.decode(SM.read_manifest(spark, str(src)), pixels=9000)
    assert got.count() == 40 and got.exceptAll(want.select(*got.columns)).isEmpty()
    q = S.append_to(S.manifest_labels(spark, str(src)), str(tmp_path / "lab"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lab")).groupBy().sum("has_ship").first()[0] == 20


def test_image_stream_runs_the_cascade(spark, folder, tmp_path):
    q = S.image_cascade(spark, str(folder[0]), str(tmp_path / "cp"), run(spark), str(tmp_path / "out"), 2)
    q.awaitTermination()
    log = {r.image_id: r.status for r in spark.read.parquet(str(tmp_path / "out" / "log")).collect()}
    assert log["broken.png"] == "error" and log["ship.png"] == "success" and len(log) == 5
    found = spark.read.parquet(str(tmp_path / "out" / "instances"))
    assert found.filter("image_id = 'ship.png'").count() == 1


def test_area_resize():
    g = np.random.default_rng(3)
    a = g.integers(0, 255, (30, 42, 3)).astype(np.uint8)
    got = I.area_resize(a, 13, 20)
    for i in range(13):
        for j in range(20):
            y0, y1, x0, x1 = i * 30 / 13, (i + 1) * 30 / 13, j * 42 / 20, (j + 1) * 42 / 20
            wy = np.clip(np.minimum(y1, np.arange(30) + 1) - np.maximum(y0, np.arange(30)), 0, None)
            wx = np.clip(np.minimum(x1, np.arange(42) + 1) - np.maximum(x0, np.arange(42)), 0, None)
            v = (a * (wy[:, None] * wx)[:, :, None]).sum((0, 1)) / (wy.sum() * wx.sum())
            assert (np.abs(got[i, j] - v) <= 0.5 + 1e-9).all()


def test_crops_and_instances(spark, folder):
    img = good(spark, folder[0]).filter("image_id = 'ship.png'")
    segs = spark.createDataFrame([("ship.png", c, 10, 22) for c in range(12, 30)], "image_id string, col bigint, r0 bigint, r1 bigint")
    boxes = K.crop_boxes(K.instances(K.components(segs, 80)), 10, 64, 80)
    b = boxes.first()
    assert (b.x1, b.y1, b.x2, b.y2) == (2, 0, 40, 32)
    crop = I.crop_images(img, boxes).first()
    assert bytes(crop.data) == np.ascontiguousarray(folder[1][0:32, 2:40]).tobytes()
