"""Image folders as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmosaic.operators.images import as_array, to_rgb

# fixed values: extensions read as images, any case
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
FALLBACK_SIDE = 224

_any_case = lambda ext: "".join(f"[{c}{c.upper()}]" for c in ext)
GLOB = "*.{" + ",".join(_any_case(e) for e in EXTENSIONS) + "}"
IMAGE_ROW = ("image struct<origin string, height int, width int, nChannels int, mode int, data binary>")


def _rgb(raw: DataFrame) -> DataFrame:
    """Image source rows -> ``image_id, path, height, width, channels, data (RGB), status, error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ok = r.height is not None and r.height > 0
                try:
                    a = np.ascontiguousarray(to_rgb(as_array(r.data, r.height, r.width, r.nChannels))) if ok else None
                    err = None if ok else "cannot be decoded"
                except Exception as e:  # one bad image must not stop the scan
                    a, err = None, str(e)
                rows.append((r.origin, *(a.shape if a is not None else (None,) * 3), a.tobytes() if a is not None else None,
                             "success" if a is not None else "error", err))
            out = pd.DataFrame(rows, columns=["path", "height", "width", "channels", "data", "status", "error"])
            yield out.astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    flat = raw.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    out = flat.mapInPandas(run, "path string, height int, width int, channels int, data binary, status string, error string")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("image_id"), "*")


def read_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """All images of a folder, decoded in the JVM; bad files become ``status`` error rows."""
    reader = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", GLOB)
    return _rgb(reader.option("recursiveFileLookup", recursive).load(folder))


def stream_images(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    raw = (spark.readStream.format("image").schema(IMAGE_ROW).option("dropInvalid", False).option("pathGlobFilter", GLOB)
           .option("maxFilesPerTrigger", files_per_trigger).load(folder))
    return _rgb(raw)


def metadata(images: DataFrame) -> DataFrame:
    return images.select("image_id", "width", "height", "channels", F.lit("uint8").alias("dtype"))


def expected(ids: DataFrame, images: DataFrame, policy: str = "skip") -> DataFrame:
    """Images for the expected ids under a policy for missing or bad ones.

    ``skip`` leaves them out, ``zero`` gives a black 224 x 224 image, ``fail`` raises when the
    table is computed. Ask :func:`missing` for the report.
    """
    good = images.filter(F.col("status") == "success").select("image_id", "height", "width", "channels", "data")
    if policy == "skip":
        return ids.select("image_id").join(good, "image_id")
    j = ids.select("image_id").join(good, "image_id", "left")
    gone = F.col("data").isNull()
    if policy == "fail":
        stop = F.raise_error(F.concat(F.lit("image not found: "), F.col("image_id").cast("string")))
        return j.withColumn("data", F.when(gone, stop.cast("binary")).otherwise(F.col("data")))
    side = FALLBACK_SIDE
    black = F.unhex(F.repeat(F.lit("00"), side * side * 3))
    pick = lambda c, v: F.when(gone, v).otherwise(F.col(c)).alias(c)
    return j.select("image_id", pick("height", F.lit(side)), pick("width", F.lit(side)), pick("channels", F.lit(3)), pick("data", black))


def missing(ids: DataFrame, images: DataFrame) -> DataFrame:
    good = images.filter(F.col("status") == "success").select("image_id")
    return ids.select("image_id").join(good, "image_id", "left_anti")
