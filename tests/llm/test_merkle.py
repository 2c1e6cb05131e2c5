import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from runmosaic.llm import merkle, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, idx int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(d, more=0):
    parts = (d[0], d[3], d[2], None if d[4] is None else d[4] + more, d[1])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(digests, k):
    """Root, and for each leaf its levels of siblings as (before, after)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i:i + k] for i in range(0, len(level), k)]
        for j, i in enumerate(at):
            run, slot = runs[i // k], i % k
            paths[j].append((run[:slot], run[slot + 1:]))
        at, level = [i // k for i in at], [h("".join(r)) for r in runs]
    return level[0], paths


def brute(rows, k=2):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted(((-1 if r[0] is None else r[0], leaf(r), r) for r in rows if r[2] == lang), key=lambda x: x[:2]) for lang in langs]
    subs = [tree([g[1] for g in group], k) for group in groups]
    root, top = tree([s[0] for s in subs], k)
    out = []
    for group, (sub, paths), above in zip(groups, subs, top):
        for (_, d, r), path in zip(group, paths):
            steps = path + above
            acc = leaf(r, 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else d
            for a, b in steps:
                acc = h("".join(a) + acc + "".join(b))
            out.append((r[0], d, sub, root, h("".join("".join(a + b) for a, b in steps)), acc, acc == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


ODD = [(7, "a", "en", "s", 1), (8, None, "en", None, None), (9, "", None, "s", 0), (10, "é🙂 " * 9000, "de", "s", 5), (10, "é🙂 " * 9000, "de", "s", 5),
       (None, "x", None, "s", 3), (11, "x", "", "s", 3), (12, "y", "é", "q", 3), (-5, "y", "en", "q", 3), (13, "z" * 70, "en", "q", 70)]


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_odd_rows(spark, arity):
    more = [(100 + i, f"text {i}", ("en", "fr")[i % 3 == 0], "s", i) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD + more], DOCS).repartition(5)
    assert rows_of(merkle.audit(df, arity)) == brute(ODD + more, arity)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_rows(spark, n):
    rows = ODD[:n]
    assert rows_of(merkle.audit(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS))) == brute(rows)


def test_empty(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_one_frequent_id(spark):
    """A repeated row is as many leaves, spread over tasks."""
    rows = [(5, "same", "en", "s", 4)] * 300 + [(i, f"t{i}", "en", "s", 2) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(7)
    assert rows_of(merkle.audit(df)) == brute(rows)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf)
    assert rows_of(got) == brute(rows)
    # exactly the tampered rows fail
    assert got.filter(F.col("verified") == (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)).count() == 0
