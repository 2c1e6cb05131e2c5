"""Fixed virtual slots: records hash into slots, bytes are summed per slot, a versioned map gives slots to shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmosaic.llm.common import shared_folder

SLOTS = 4096
MAP = "version int, slot int, shard int, bytes bigint, n bigint"


def slot_of(keys: Sequence[str | Column], slots: int = SLOTS) -> Column:
    """The virtual slot of a record: fixed for all time, whatever the shards."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str, size: str, slots: int = SLOTS) -> DataFrame:
    """``slot, bytes, n`` for every slot, empty ones too: at most ``slots`` rows, summed before the shuffle."""
    found = records.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias(slot))
    return every.join(found, slot, "left").select(
        F.col(slot).alias("slot"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt in turn, blind to their bytes."""
    return sizes.select(F.lit(0).alias("version"), "slot", (F.col("slot") % shards).alias("shard"), "bytes", "n")


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards and the sizes of now, moving as little as it can.

    Every shard keeps its largest slots up to an even share of all bytes. The rest are taken up in one
    sweep, largest first, each by the shard that is lightest then. The sweep is one ``aggregate`` over
    an array of at most ``slots`` entries, so its size is bounded by a parameter and not by the data.
    Shards added start empty; slots of shards taken away are all moved.
    """
    now = slot_map.select("version", "slot", "shard").join(sizes, "slot")
    share = sizes.agg((F.sum("bytes") / shards).alias("share")).scalar()
    upto = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0))
    marked = now.withColumn("keep", (F.col("shard") < shards) & (upto <= share))
    entry = F.struct((-F.col("bytes")).alias("minus"), F.col("slot"), F.col("shard"), F.col("keep"), F.col("bytes"), F.col("n"), F.col("version"))
    one = marked.agg(F.array_sort(F.collect_list(entry)).alias("e"))
    loads = f"transform(sequence(0, {shards - 1}), i -> aggregate(filter(e, x -> x.keep and x.shard = i), 0L, (a, x) -> a + x.bytes))"
    step = ("named_struct('loads', transform(s.loads, (v, i) -> if(i + 1 = array_position(s.loads, array_min(s.loads)), v + x.bytes, v)), "
            "'to', array_append(s.to, cast(array_position(s.loads, array_min(s.loads)) - 1 as int)))")
    swept = one.selectExpr("e", "filter(e, x -> not x.keep) as moved", f"{loads} as loads").selectExpr(
        "e", "moved", f"aggregate(moved, named_struct('loads', loads, 'to', cast(array() as array<int>)), (s, x) -> {step}).to as to")
    all_slots = swept.selectExpr("inline(concat(filter(transform(e, x -> struct(x, x.shard as shard)), p -> p.x.keep), "
                                 "transform(moved, (x, i) -> struct(x, to[i] as shard)))) as (x, shard)")
    return all_slots.select((F.col("x.version") + 1).alias("version"), "x.slot", "shard", "x.bytes", "x.n")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append one version; versions are folders, so older ones stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, the newest when none is named."""
    m = spark.read.schema(MAP).parquet(path)
    wanted = m.agg(F.max("version").alias("v")).scalar() if version is None else F.lit(version)
    return m.filter(F.col("version") == wanted)


def place(records: DataFrame, slot_map: DataFrame, slot: str, order: Sequence[str]) -> DataFrame:
    """Adds ``shard`` and ``position``, the gapless place in the shard.

    Places are ranked inside a slot only; the slots before it in the shard give the start, from the
    counts of the map. The map has one row per slot, so the join side is bounded by the slot count.
    """
    before = W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.select(F.col("slot").alias(slot), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = records.withColumn("_rank", F.row_number().over(W.partitionBy(slot).orderBy(*order)))
    return ranked.join(F.broadcast(starts), slot).withColumn("position", F.col("_start") + F.col("_rank") - 1).drop("_start", "_rank")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Documents with their virtual slot, shard and place; the map's versions 0 and 1 stay at ``path``.

    Sizes are UTF-8 bytes plus 1. Records hash by id and text checksum, so null or repeated ids still
    spread; rows alike in both share a slot. Null text counts as no bytes, an empty table gives no rows,
    other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    records = records.withColumn("virtual_slot", slot_of(["doc_id", "text_crc32"], slots))
    path = path or shared_folder(spark, "slot-map")
    sizes = slot_sizes(records, "virtual_slot", "size", slots)
    save_map(first_map(sizes, shards), path)
    old = load_map(spark, path, 0)
    save_map(rebalance(old, old.select("slot", "bytes", "n"), shards), path)
    return place(records, load_map(spark, path, 1), "virtual_slot", ["doc_id", "text_crc32", "size"])
