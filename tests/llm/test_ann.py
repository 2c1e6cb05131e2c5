from collections import defaultdict

import numpy as np
import pytest

from runmosaic.llm import ann, queries
from pyspark.sql import functions as F

V = "vec_id bigint, embedding array<float>, v int, rank string"


def brute(ids, x, asks, k):
    out = {}
    for i in np.flatnonzero(asks):
        s = x @ x[i]
        other = [j for j in range(len(ids)) if ids[j] != ids[i]]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in sorted(other, key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def collected(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def made_table(folder):
    """10,000 unit vectors without close neighbours, and one vector that repeats often."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    g = np.random.default_rng(3)
    x = g.normal(size=(10_000, 64)).astype(np.float32)
    x[5000:5400] = x[4999]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": pa.array(range(10_000)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "made"])
def test_query_recall(spark, sf, tmp_path):
    sf = made_table(tmp_path) if sf == "made" else f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"file://{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids % 20 == 0, 20) if len(ids) < 3000 else brute_fast(ids, x)
    got = collected(queries.QUERIES["op9_cross_polytope_search"](spark, f"file://{sf}"))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    at = {i: n for n, i in enumerate(ids.tolist())}
    for q, hits in got.items():
        assert q not in dict(hits) and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert np.allclose([s for _, s in hits], [x[at[q]] @ x[at[i]] for i, _ in hits], atol=1e-12)
    recall = np.mean([len(dict(got[q]).keys() & dict(want[q]).keys()) / 20 for q in want])
    assert recall >= 0.93, recall


def brute_fast(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s, kind="stable")[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in top]
    return out


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = ann.hadamard(x)
    h = np.array([[(-1.0) ** bin(i & j).count("1") for j in range(32)] for i in range(32)]) / np.sqrt(32)
    assert np.allclose(y, x @ h) and np.allclose(ann.hadamard(y), x) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def test_blocks_and_all_probes_give_the_exact_answer(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 10)) * g.uniform(0.1, 4, (300, 1))
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x.astype(np.float32))], V)
    got = collected(ann.nearest(df, F.col("vec_id") % 3 == 0, k=7, probes=1.0, data_block=40, query_block=30))
    want = brute(np.arange(300), x.astype(np.float32).astype(float), np.arange(300) % 3 == 0, 7)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}


def test_common_vector_and_ties(spark):
    """A third of all rows are one vector: ties go to the smaller ids, and the query's own row is left out."""
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else [float(i % 7), 1.0, -0.0]) for i in range(900)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], V)
    got = collected(ann.nearest(df, F.col("vec_id") % 20 == 0, probes=1.0, data_block=100))
    want = brute(np.arange(900), np.array([v for _, v in rows]), np.arange(900) % 20 == 0, 20)
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (None, [1.0, 1.0]),
            (1, [0.5, 0.5]), (2, [3.0]), (3, [-1.0, 0.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], V)
    got = collected(ann.nearest(df, F.col("vec_id") % 20 == 0, probes=1.0))
    assert got == {0: [(2, 3.0), (1, 0.5), (3, -1.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id = 0"), F.lit(True)).count() == 0
