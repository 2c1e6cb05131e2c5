import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runmosaic.llm import queries, whitening

VECTORS = "vec_id bigint, embedding array<float>, row int, v string, w int, component string"


def brute(rows, components=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    dev = n * x - s
    cov = (dev.T.dot(dev)).astype(float) / n ** 3
    e, q = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    z = (dev / n).astype(float) @ q[:, order] / np.sqrt(e[order])
    return n, [int(d) for d in (dev * dev).sum(1)], z, e[order] / np.trace(cov)


def check(df, rows, components=8):
    n, dev, z, share = brute(rows, components)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows)
    k = z.shape[1]
    mine = np.array([[got[i][c + 1].whitened for c in range(k)] for i, _ in rows])
    for c in range(k):
        assert min(abs(mine[:, c] - z[:, c]).max(), abs(mine[:, c] + z[:, c]).max()) < 1e-6
        assert abs(got[rows[0][0]][c + 1].explained - share[c]) < 1e-9
    assert [got[i][1].deviation for i, _ in rows] == dev and all(got[i][1].n == n for i, _ in rows)
    centred = mine - mine.mean(0)
    error = abs(centred.T @ centred / n - np.eye(k)).max()
    assert error < 1e-4 and abs(got[rows[0][0]][1].identity_error - error) < 1e-6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_bit_sliced_whitening"](spark, f"/root/testdata/{sf}"), rows)


def test_odd_rows(spark):
    g = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in g.normal(size=5) * (1, 2, 50, 300, 0.5)]) for i in range(200)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, [1.0]), (905, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2, "c") for r in good + bad], VECTORS).repartition(6)
    check(whitening.whitened(df), good)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.filter("vec_id >= 900 and vec_id <> 904")).count() == 0


def test_repeated_rows_and_no_variance(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0], 1, "x", 2, "c")] * 9, VECTORS)
    rows = whitening.whitened(df).collect()
    assert len(rows) == 27 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 9 for r in rows)
    df = spark.createDataFrame([(i, [float(i % 2), 2.0, 0.0], 1, "x", 2, "c") for i in range(10)], VECTORS)
    rows = whitening.whitened(df).collect()
    assert {r.component: r.whitened is None for r in rows} == {1: False, 2: True, 3: True}
    assert all(abs(abs(r.whitened) - 1) < 1e-9 and r.explained == 1 for r in rows if r.component == 1)


def test_deviation_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [1e6 * i, float(i)], 1, "x", 2, "c") for i in range(300)], VECTORS)
    want = brute([(i, [1e6 * i, float(i)]) for i in range(300)])[1]
    got = {r.vec_id: r for r in whitening.whitened(df).collect()}
    assert [int(got[i].deviation_exact) for i in range(300)] == want
    assert all(got[i].deviation == (w if w < 1 << 63 else None) for i, w in enumerate(want)) and any(w >= 1 << 63 for w in want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1000), min_size=3, max_size=3), min_size=1, max_size=200))
def test_planes_give_exact_products(rows):
    y = np.array(rows)
    bits = [int(m).bit_length() for m in y.max(0)]
    p, owner = whitening.planes(y, bits), np.repeat(range(3), bits)
    place = np.concatenate([np.arange(b) for b in bits]).astype(int)
    got = np.zeros((3, 3), object)
    for a in range(len(p)):
        for b in range(len(p)):
            got[owner[a], owner[b]] += int(np.bitwise_count(p[a] & p[b]).sum()) << int(place[a] + place[b])
    assert (got == y.astype(object).T.dot(y.astype(object))).all()
