import random
import re
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from runmosaic.llm import mixing, queries


def brute_targets(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        over = [n for n in open_ if left * w[n] / sum(w[m] for m in open_) > 2 * sizes[n] + 1e-9]
        if not over:
            out |= {n: left * w[n] / sum(w[m] for m in open_) for n in open_}
            break
        for n in over:
            out[n] = 2 * sizes[n]
        open_ -= set(over)
        left -= sum(2 * sizes[n] for n in over)
    return out


def check(rows, docs, tolerance):
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes = defaultdict(int)
    for d, _, s in docs:
        sizes[s] += words[d]
    targets, taken, source = brute_targets(sizes), defaultdict(int), {d: s for d, _, s in docs}
    smallest = {}  # whole documents only, none twice more often than another: the least that could still be added
    for s in sizes:
        own = [r for r in rows if source[r.doc_id] == s and r.size]
        fewest = min((r.taken // r.size for r in own), default=0)
        smallest[s] = min((r.size for r in own if r.taken // r.size == fewest), default=1)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words[r.doc_id], sizes[s]) and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= tolerance * targets[s] + 1 or 0 <= targets[s] - taken[s] < smallest[s], (s, taken[s], targets[s])


def test_query_meets_targets_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op8_flow_mixing"](spark, sf).collect()
    check(rows, docs, 0.01)
    assert sorted(rows) == sorted(queries.QUERIES["op8_flow_mixing"](spark, sf).collect())


def test_odd_rows(spark):
    g = random.Random(2)
    docs = [(i, "w " * g.randint(0, 40), g.choice(["a", "b", None, "é"])) for i in range(400)] + [(400, None, "a"), (401, "x " * 3000, "a"), (402, None, "only null")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, source string, size int, pattern string")
    check(mixing.mix_report(df).collect(), docs, 0.02)
    out = mixing.mixed_documents(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_report(df).collect() if r.size}
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert all(count[d] == n for d, n in taken.items())
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.mix_report(df.filter("doc_id in (400, 402)")).agg(F.sum("taken")).first()[0] == 0


def test_repeated_ids_and_hot_source(spark):
    df = spark.range(3000, numPartitions=7).selectExpr("id % 900 as doc_id", "repeat('w ', cast(id % 13 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 30)) as source")
    rows = mixing.mix_report(df).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[round(r.target, 6)] += r.taken
        target[(r.source_size, r.target)] = r.target
    assert len(rows) == 3000 and abs(sum(taken.values()) - sum(target.values())) < 0.5 * sum(target.values())


def cheapest(tokens, members, quotas, repeats):
    """Most flow, then least repetition, by trying every split of small amounts."""
    best = None
    options = [[(a, b) for a in range(repeats * t + 1) for b in range(repeats * t + 1 - a) if (a == 0 or 0 in m) and (b == 0 or 1 in m)] for t, m in zip(tokens, members)]
    for choice in product(*options):
        got = [sum(c[i] for c in choice) for i in (0, 1)]
        if got[0] <= quotas[0] and got[1] <= quotas[1]:
            cost = sum(max(0, sum(c) - t) for c, t in zip(choice, tokens))
            key = (-sum(got), cost)
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    g = random.Random(seed)
    tokens = [g.randint(0, 3) for _ in range(3)]
    members, quotas = [[0], [1], [0, 1]], [g.randint(0, 8), g.randint(0, 8)]
    flow = mixing.min_cost_flow(tokens, members, quotas, 2)
    sent = [sum(f.values()) for f in flow]
    assert all(set(f) <= set(m) for f, m in zip(flow, members))
    assert (-sum(sent), sum(max(0, s - t) for s, t in zip(sent, tokens))) == cheapest(tokens, members, quotas, 2)


def test_overlapping_sources(spark):
    df = spark.range(600).selectExpr("id as doc_id", "repeat('w ', 10) as text", "case id % 3 when 0 then array('a') when 1 then array('b') else array('b', 'a') end as s")
    out = mixing.mix(df, F.col("s"), weigh=lambda n: {x: 1 for x in n}, share=1.0).collect()
    assert sum(r["size"] * r.copies for r in out) == 6000 and all(r.copies == 1 for r in out)
