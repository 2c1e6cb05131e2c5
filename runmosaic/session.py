"""Session settings and the lineage cut used by iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


LOCAL_FOLDER = "file:///tmp/checkpoints"


def build_session(master: str = "local[8]", app: str = "runmosaic", partitions: int = 16,
                  memory: str = "12g", checkpoints: str | None = None) -> SparkSession:
    """``checkpoints`` must be a folder that driver and executors share; only a local master has a default."""
    if checkpoints is None and master.startswith("local["):
        checkpoints = LOCAL_FOLDER
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # run rows unfold into many times their bytes after a shuffle, so small partitions still pay
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def image_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches between the JVM and Python of at most ``rows`` images or tiles for this session; a lower setting is kept.

    Every Python worker of a task holds a batch outside the heap, and an image is many times a usual row.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# narrow rows of a part that unfolds: sorts of its segments, words or pixels stay in a task's share of memory
PART_ROWS = 60_000


def image_parts(df: DataFrame, rows: int = PART_ROWS) -> int:
    """Number of parts for rows that unfold after they were dealt out by image: that of the session, raised as the table grows.

    The session keeps the higher number, so that all tables placed by image meet in equal parts, and joins whose keys hold
    the image take rows as they lie instead of sending the unfolded ones by all keys.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return parts


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder the session names; a local master without one has a fixed folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/runmosaic-{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Without that setting a local master uses a fixed folder of its own; on a cluster a missing setting
    is an error, never a machine-local folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = LOCAL_FOLDER
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and no lineage behind it to recompute."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
