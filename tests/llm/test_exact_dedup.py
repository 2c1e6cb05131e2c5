import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from runmosaic.llm import exact_dedup

DOCS = "doc_id bigint, text string, loc int, digest string, `odd.name` int"
ROWS = [(5, "a  b", 1, "x", 1), (3, "a b", 2, "y", 1), (3, "a b", 3, "z", 2), (9, None, 4, None, 3), (8, "", 5, "w", 4), (7, " ", 6, "w", 5),
        (None, "q", 7, "w", 6), (None, "q", 8, "v", 7), (2, "\t", 9, "u", 8), (1, "unique" * 20000, 1, "u", 9), (4, "a b", 1, "u", 10)]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    return groups


def test_report(spark):
    got = exact_dedup.dedup_report(spark.createDataFrame(ROWS, DOCS)).collect()
    want = []
    for text, ids in brute(ROWS).items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: (r[3], -1 if r[0] is None else r[0])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(brute(ROWS))


def test_kept_documents_have_their_columns(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    kept = exact_dedup.kept_documents(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len(brute(ROWS)) and {r[0] for r in rows} == {3, 8, 2, None, 1, 4}


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.dedup_report(df).count() == 0 and exact_dedup.kept_documents(df).count() == 0


def test_collisions_are_told_apart_by_their_bytes(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = lambda t: F.unhex(F.lit("00")) if t is None else F.unhex(F.lpad((F.length(t) % 1).cast("string"), 2, "0"))
    _, groups = exact_dedup.exact_groups(df, weak)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in groups.collect()}
    want = {i: (i % 7, len(range(i % 7, 60, 7))) for i in range(60)}
    assert got == want


def test_state_follows_later_micro_batches(spark):
    feed = spark.range(0, 1000, numPartitions=5).selectExpr("id as loc", "1000 - id as doc_id", "cast(cast(id % 3 as string) as binary) as digest")
    got = {bytes(r.digest): (r.first.doc_id, r.n) for r in exact_dedup.keyed_state(feed, files_per_batch=1).collect()}
    assert got == {b"0": (1, 334), b"1": (3, 333), b"2": (2, 333)}
