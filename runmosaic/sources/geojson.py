"""GeoJSON files as feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmosaic.operators.geo import parse, parse_rings


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file, geojson``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("geojson"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature with its outer ring and properties."""
    return parse(read_collections(spark, path), "geojson", ["file"])


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """One row per ring of each feature: all parts of multi-polygons, and holes."""
    return parse_rings(read_collections(spark, path), "geojson", ["file"])
