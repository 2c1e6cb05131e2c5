import random
import re

import numpy as np
import pytest
import xxhash

from runmosaic.llm import queries, simhash

DOCS = "doc_id bigint, text string, fp int, loc string"


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(len(w) - 2)] or [xxhash.xxh64_intdigest(" ".join(w).encode(), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """{id: fp} -> {id: smallest id reachable}"""
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    comp = list(range(len(ids)))
    seen = set()
    for i in range(len(ids)):
        if i in seen:
            continue
        todo = [i]
        seen.add(i)
        while todo:
            x = todo.pop()
            comp[x] = i
            for y in np.flatnonzero(np.bitwise_count(f ^ f[x]) <= 3).tolist():
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    return {ids[i]: ids[comp[i]] for i in range(len(ids))}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op4_simhash_pivots"](spark, sf).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == brute_components(prints)
    assert len(set(brute_components(prints).values())) < len(prints)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "A b C", "x " * 70_000, "é ß É " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def planted(seed, centres=40, copies=30):
    g = random.Random(seed)
    out = []
    for _ in range(centres):
        x = g.getrandbits(64)
        for _ in range(g.randint(1, copies)):
            out.append(x)
            for b in g.sample(range(64), g.randint(0, 4)):
                x ^= 1 << b
    return out


@pytest.mark.parametrize("group", [4096, 5])
def test_components_of_chains_and_balls(spark, group, monkeypatch):
    """Chains, and a ball of some hundred around one print; with a tiny group the finer tables run."""
    g = random.Random(3)
    prints = planted(1) + [0xABCDEF0123456789 ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)] + [0] * 3
    ids = list(range(len(prints)))
    g.shuffle(ids)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(prints)], "fp bigint")
    roots = {r.fp: r.root for r in simhash.components(simhash.links(df, group)).collect()}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    mine = {}
    for f in set(prints):
        mine.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    want = {}
    for f, c in brute_components({f: f for f in set(prints)}).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_forest_matches_brute_force():
    f = np.array(sorted(set(planted(5))), np.uint64)
    got = dict(simhash.forest(f))
    want = brute_components({int(x): int(x) for x in f})
    groups = lambda of: sorted(sorted(k for k in of if of[k] == r) for r in set(of.values()))
    assert groups({int(x): got.get(int(x.view(np.int64)), int(x.view(np.int64))) for x in f}) == groups(want)


def test_odd_rows(spark):
    rows = [(4, None, 1, "a"), (2, "", 2, "b"), (None, " ", 3, "c"), (7, "same words here now", 4, "d"), (7, "same words here now", 5, "e"), (None, "alone", 6, "f"), (1, "long " * 60_000, 7, "g")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_report(df).collect())
    assert got == sorted((r[0] or -1, f"{brute_print(r[1]):016x}", {4: 2, 2: 2, 7: 7, 1: 1}.get(r[0], 2 if r[1] == " " else -1)) for r in rows)
    kept = simhash.kept_documents(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 7]
    assert simhash.near_report(df.limit(0)).count() == 0 and simhash.kept_documents(df.limit(0)).count() == 0
