"""Shared tables and small pieces used by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: white space that parts words
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LOCAL_FOLDER = "file:///tmp/checkpoints"


ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of at most ``ARROW_ROWS`` rows and about ``ARROW_BYTES`` for this session.

    Texts are long, and every task holds a batch outside the heap; lower settings of the session are kept.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; elsewhere it is an error,
    since tables written by executors must be readable by all of them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/runmosaic-{tag}-{uuid.uuid4().hex}"


_tables: list[str] = []
_noted = False


@contextmanager
def noted() -> Iterator[None]:
    """Tables written inside are noted for :func:`drop_tables`."""
    global _noted
    _noted = True
    try:
        yield
    finally:
        _noted = False


def made(*paths: str) -> None:
    """Note folders for :func:`drop_tables`."""
    if _noted:
        _tables.extend(paths)


def drop_tables(spark: SparkSession) -> None:
    """Delete the noted tables, once all results that read them are stored elsewhere."""
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and no lineage behind it to recompute."""
    path = shared_folder(df.sparkSession, tag)
    made(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_case(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """White-space separated words as UTF-8 bytes, A-Z in lower case (``bytes`` methods touch ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def part_of(key: str, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def rows(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``bytes_at_once`` of ``column`` (one row at least)."""
    for b in batches:
        size = max(1, b.column(b.schema.names.index(column)).nbytes)
        step = max(1, int(b.num_rows * bytes_at_once / size)) if size > bytes_at_once else max(1, b.num_rows)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names an operator adds cannot meet names of the table."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast when a count shows at most ``most`` rows; otherwise left to a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
