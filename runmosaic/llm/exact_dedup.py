"""Exact deduplication by a stream over keyed state on disk that never expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import SPACE, made, shared_folder, small, whole_row, written

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
BROADCAST_ROWS = 100_000
FEED = "loc bigint, doc_id bigint, digest binary"
STATE = {"digest": "binary", "first": "struct<none: boolean, doc_id: bigint, loc: bigint>", "n": "bigint"}


def normalised(text: Column) -> Column:
    """Null is empty; every run of white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keyed_state(feed: DataFrame, files_per_batch: int = 10_000) -> DataFrame:
    """Streams ``loc, doc_id, digest`` through state keyed by digest: ``digest, first, n``.

    For each digest the state holds, without expiry, the stable identifier (smallest id, null last), the
    locator of its content, and the number of rows. Rows of one digest are summed up in each task before
    they reach the state, so a digest with a third of all rows costs one row a task. The changed keys of
    a micro-batch go to a folder of their own, overwritten when that batch is run again.
    """
    spark = feed.sparkSession
    source, out, log = (shared_folder(spark, f"dedup-{x}") for x in ("feed", "state", "log"))
    made(source, out, log)
    feed.write.parquet(source)
    spark.range(0).selectExpr(*(f"cast(null as {kind}) as {name}" for name, kind in STATE.items())).write.parquet(f"{out}/batch=-1")
    old = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "loc")).alias("first")
        state = stream.groupBy("digest").agg(first, F.count("*").alias("n"))
        (state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True)
         .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.read.schema(", ".join(f"{name} {kind}" for name, kind in {**STATE, "batch": "int"}.items())).parquet(out)
    last = F.max(F.struct("n", "first")).alias("last")  # a group only grows, so its last word is its largest count
    return seen.groupBy("digest").agg(last).select("digest", "last.first", "last.n")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """The rows as stored, and for each its group of equal texts.

    First result: ``row`` (all columns), ``loc`` (the content locator), ``digest``. Second, one per row:
    ``loc, doc_id, digest, keep_id, keep_loc, group_size``; the row at ``keep_loc`` stays.

    Rows whose digest was seen are compared byte by byte with the text at the stored locator. Those that
    differ from it (a collision) go through the state once more by themselves, until none is left, so
    any digest gives right groups.

    Null and empty text are one group. Ids may be null (last) or repeat: exactly one row of a group
    stays. An empty table gives two empty results.
    """
    loc = F.monotonically_increasing_id().alias("loc")
    rows = written(docs.select(whole_row(docs).alias("row"), loc, digest(normalised(F.col("text"))).alias("digest")), "dedup-rows")
    feed = rows.select("loc", F.col("row.doc_id").cast("bigint").alias("doc_id"), "digest")
    state = written(keyed_state(feed), "dedup-keys")
    shared = small(state.filter("n > 1").select("digest", F.col("first.loc").alias("head")), BROADCAST_ROWS)
    hits = rows.select("loc", F.col("row.doc_id").cast("bigint").alias("doc_id"), "digest", normalised(F.col("row.text")).alias("text")).join(shared, "digest")
    done = []
    while True:
        hits = written(hits, "dedup-hits")
        heads = hits.filter("loc = head").select("digest", F.col("text").alias("head_text"))
        wrong = written(hits.join(heads, "digest").filter("text != head_text").select("loc", "doc_id", "digest", "text"), "dedup-collisions")
        members = feed.join(state, "digest").select("loc", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.loc").alias("keep_loc"), F.col("n").alias("group_size"))
        if wrong.isEmpty():
            done.append(members)
            break
        done.append(members.join(wrong.select("loc"), "loc", "left_anti"))
        feed = wrong.select("loc", "doc_id", "digest")
        state = written(keyed_state(feed), "dedup-keys")
        hits = wrong.join(state.select("digest", F.col("first.loc").alias("head")), "digest")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    if len(done) > 1:  # counts above still hold the rows that left for the next turn
        out = written(out.drop("group_size"), "dedup-groups")
        out = out.join(out.groupBy("keep_loc").agg(F.count("*").alias("group_size")), "keep_loc")
    return rows, out


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents without their copies, columns as they were."""
    rows, groups = exact_groups(docs)
    dropped = small(written(groups.filter("loc != keep_loc").select("loc"), "dedup-dropped"), 10 * BROADCAST_ROWS)
    return rows.join(dropped, "loc", "left_anti").select("row.*")


def dedup_report(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    _, groups = exact_groups(docs.select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", (F.col("loc") == F.col("keep_loc")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))
