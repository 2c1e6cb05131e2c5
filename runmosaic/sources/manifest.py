"""Manifest, prediction and label-file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runmosaic.functions import expr as X

# fixed values: column names of the exchange files
MANIFEST = T.StructType([T.StructField("ImageId", T.StringType()), T.StructField("EncodedPixels", T.StringType())])
PATCH_PREDICTIONS = T.StructType([
    T.StructField("patch_id", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
    T.StructField("probability", T.DoubleType()), T.StructField("has_ship", T.BooleanType())])


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("ImageId").alias("image_id"), F.col("EncodedPixels").alias("rle"))


def read_manifest(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """``image_id, rle`` from CSV or parquet with an explicit schema."""
    reader = spark.read.schema(MANIFEST)
    return _named(reader.csv(path, header=True) if form == "csv" else reader.parquet(path))


def stream_manifest(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return _named(spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files_per_trigger).csv(path, header=True))


def read_patch_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Patch scores of all images, from the hash folders they are written in."""
    schema = T.StructType(PATCH_PREDICTIONS.fields + [T.StructField("image_id", T.StringType()), T.StructField("bucket", T.LongType())])
    return spark.read.schema(schema).csv(path, header=True).drop("bucket")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Any report CSV (errors, metrics, history) with the schema its writer declares."""
    return spark.read.schema(schema).csv(path, header=True)


def positives(manifest: DataFrame, otherwise: str = "all") -> DataFrame:
    """Rows with a mask. Without any, all rows (``all``), none (``none``) or an error (``error``).

    The test is a one-value subquery inside the plan; nothing is brought to the driver.
    """
    flag = F.col("rle").isNotNull()
    if otherwise == "none":
        return manifest.filter(flag)
    found = manifest.agg(F.coalesce(F.max(flag.cast("int")), F.lit(0)).alias("found")).scalar()
    if otherwise == "error":
        return manifest.filter(F.when(found == 0, F.raise_error(F.lit("no positive rows in the manifest"))).otherwise(flag))
    return manifest.filter(flag | (found == 0))


def label_lines(lines: DataFrame, size: tuple[int, int], text: str = "value", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Polygon label lines ``class x1 y1 x2 y2 ...`` -> vertices in whole pixels.

    A token that is no number leaves its vertex or class NULL and harms no other line."""
    h, w = size
    df = lines.select(*keys, X.once(F.transform(F.split(F.trim(F.col(text)), r"\s+"), lambda t: t.try_cast("double"))).alias("_t"))
    points = F.expr(f"if(size(_t) >= 3, transform(sequence(0, (size(_t) - 1) div 2 - 1), i -> struct("
                    f"cast(get(_t, 2*i + 1) * {w} as bigint) as x, cast(get(_t, 2*i + 2) * {h} as bigint) as y)), null)")
    return df.select(*keys, F.col("_t")[0].cast("int").alias("class_id"), F.posexplode_outer(points).alias("seq", "_p")).filter("seq is not null").select(
        *keys, "class_id", "seq", "_p.x", "_p.y")


def read_label_files(spark: SparkSession, path: str, size: tuple[int, int]) -> DataFrame:
    lines = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("file"), "value")
    return label_lines(lines, size)
