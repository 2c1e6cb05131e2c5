"""Continuous forms: manifest -> runs and labels, image folder -> cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runmosaic.functions import expr as X
from runmosaic.operators import masks as M
from runmosaic.sources import images as SI
from runmosaic.sources import manifest as SM


def manifest_labels(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Stateless row labels of arriving manifest files."""
    m = SM.stream_manifest(spark, folder, files_per_trigger)
    return m.select("image_id", X.has_ship("rle").alias("has_ship"), "rle")


def manifest_runs(spark: SparkSession, folder: str, pixels: int, files_per_trigger: int = 8) -> DataFrame:
    return M.decode(SM.stream_manifest(spark, folder, files_per_trigger), pixels=pixels)


def append_to(stream: DataFrame, target: str, checkpoint: str, form: str = "parquet", available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.format(form).option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def image_cascade(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[DataFrame], dict[str, DataFrame]], target: str,
                  files_per_trigger: int = 64, available_now: bool = True) -> StreamingQuery:
    """Run a cascade over each batch of new images.

    ``run`` gets the good images and returns named tables; each is written under ``target/<name>`` in a
    folder per batch, so a repeated batch overwrites itself. Bad images go to ``target/log`` as errors.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        tables = {}
        try:
            tables = run(batch.filter("status = 'success'"))
            for name, df in tables.items():
                if name == "log":
                    bad = batch.filter("status = 'error'").select("image_id", "status", "error")
                    df = df.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
                df.write.mode("overwrite").parquet(f"{target}/{name}/epoch={epoch}")
        finally:
            if hasattr(tables, "close"):
                tables.close()
            batch.unpersist()

    w = SI.stream_images(spark, folder, files_per_trigger).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
