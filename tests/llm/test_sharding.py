import zlib
from collections import defaultdict

import pytest

from runmosaic.llm import queries, sharding

DOCS = "doc_id bigint, text string, virtual_slot string, shard int"


def check(rows, shards):
    place = defaultdict(list)
    for r in rows:
        place[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    assert set(place) <= set(range(shards))


def test_query_places_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_virtual_slot_shards"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, place = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        load[r.shard] += r.size
        place[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    assert len(load) == 16 and max(load.values()) < 1.02 * sum(load.values()) / 16 > 0.98 * min(load.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", "x", 9), (1, "a", "x", 9), (None, None, None, None), (None, "", None, 1), (2, "é" * 5000, "y", 2)], DOCS)
    rows = sharding.shard_documents(df, shards=4, slots=32).collect()
    check(rows, 4)
    assert sorted(r["size"] for r in rows) == [1, 1, 2, 2, 10001]
    assert {r.text_crc32 for r in rows if r["size"] == 1} == {0}
    assert sharding.shard_documents(df.limit(0), shards=4, slots=32).count() == 0


@pytest.mark.parametrize("shards,after", [(4, 5), (5, 4), (16, 16)])
def test_map_versions_and_few_moves(spark, tmp_path, shards, after):
    sizes = spark.range(256).selectExpr("cast(id as int) as slot", "1000 + (id * 7919) % 997 as bytes", "1L as n")
    path = f"file://{tmp_path}/map"
    sharding.save_map(sharding.first_map(sizes, shards), path)
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), sizes, after), path)
    old, new = ({r.slot: (r.shard, r.bytes) for r in sharding.load_map(spark, path, v).collect()} for v in (0, 1))
    assert sharding.load_map(spark, path).first().version == 1 and set(old) == set(new) == set(range(256))
    load = defaultdict(int)
    for shard, b in new.values():
        load[shard] += b
    mean = sum(load.values()) / after
    assert set(load) == set(range(after)) and max(load.values()) - min(load.values()) < 0.05 * mean
    moved = sum(old[s][0] != new[s][0] for s in old)
    assert moved <= 256 * (1 / max(shards, after) + 0.1)


def test_hot_slot_is_ranked_and_others_even(spark):
    df = spark.range(3000).selectExpr("if(id < 1000, 7L, id) as doc_id", "if(id < 1000, 'same', repeat('x', cast(id % 50 as int))) as text")
    check(sharding.shard_documents(df, shards=3, slots=64).collect(), 3)
