"""Plan shapes that must hold at any scale."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
JOINS = ["mask_crop", "tile_table_labels", "tile_overlaps", "box_pairs", "mask_iou_pairs", "stitch_vote", "stitch_weighted", "prompts", "f_beta",
         "segmentation_error_report", "segmentation_histogram", "roc_points", "split_images", "weighted_draws", "positives_fallback", "error_heatmap"]
JVM = ["tile_labels", "mask_decode", "mask_union", "mask_encode", "mask_intersect", "mask_area", "segmentation_metrics", "dilate", "erode",
       "stitch_weighted", "stitch_feather", "rasterise", "feature_collections"]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", JOINS)
def test_no_pairwise_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", JVM)
def test_stays_in_the_jvm(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "EvalPython" not in text and "InPandas" not in text and "MapInArrow" not in text


def test_scan_reads_only_used_columns(spark):
    text = plan(queries()["tile_labels"](spark, SF))
    reads = [line for line in text.splitlines() if line.startswith("ReadSchema") and "l_" in line]
    assert reads and not any(c in line for line in reads for c in ("l_extendedprice", "l_shipdate", "l_returnflag", "l_tax"))


def test_rank_limit_reaches_the_map_side(spark):
    assert "WindowGroupLimit" in plan(queries()["max_detections"](spark, SF))


@pytest.mark.parametrize("name", ["stitch_vote", "stitch_weighted", "stitch_average", "stitch_consensus"])
def test_stitching_places_rows_once(spark, name):
    """Two for the views, two for the join with the patches, one by image and column, and the table of patches."""
    df = queries()[name](spark, SF)
    nodes = df._jdf.queryExecution().executedPlan().toString()
    assert nodes.count("Exchange hashpartitioning") <= 6


def test_average_precision_reads_tables_of_its_own(spark):
    """All passes over the scores read tables written once; no input is read again behind them."""
    text = plan(queries()["average_precision"](spark, SF))
    assert "lineitem" not in text and text.count("(unknown) Exchange") <= 20
