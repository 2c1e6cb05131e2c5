import random
import re

import pytest

import corpus_pipeline
from runmosaic.llm import near_copies, simhash

DOCS = "doc_id bigint, text string"


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_kept(texts, n=5, similarity=0.8):
    """Smallest id of each component of all pairs with the similarity."""
    s, root = {d: shingles(t, n) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(s[a] & s[b])
            if both >= similarity * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(d) for d in ids})


def planted(seed=5, texts=12):
    """Texts of their own, each with copies that have one word changed, and chains of such changes."""
    g = random.Random(seed)
    out = {}
    for _ in range(texts):
        w = [f"w{g.randint(0, 3000)}" for _ in range(g.randint(45, 200))]
        out[len(out)] = " ".join(w)
        for k in range(g.randint(1, 6)):
            v = list(w)
            v[g.randrange(len(v))] = f"edit{k}"
            out[len(out)] = " ".join(v)
            if k % 2:
                w = v
    return out


def test_stage_drops_one_word_edits(spark):
    """One word changed in a hundred: similarity 0.9, more than 3 bits of a fingerprint apart."""
    w = [f"word{i}" for i in range(100)]
    texts = {0: " ".join(w), 1: " ".join(w[:50] + ["other"] + w[51:]), 2: " ".join(w[:30] + ["third"] + w[31:]), 9: "something else " * 20}
    assert all((simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[k])).bit_count() > 3 for k in (1, 2))
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    got = stage(spark, spark.createDataFrame(list(texts.items()), DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 9]


@pytest.mark.parametrize("similarity", [0.8, 0.95])
def test_against_all_pairs(spark, similarity):
    texts = planted() | {900: None, 901: " ", 902: "few words", 903: "few  WORDS", 904: "few other words"}
    df = spark.createDataFrame(list(texts.items()), DOCS).repartition(5)
    assert sorted(r.doc_id for r in near_copies.kept_documents(df, similarity=similarity).collect()) == brute_kept(texts, similarity=similarity)


def dense(seed, texts, length, changed):
    """Texts that each have words of one text changed, so that many pairs are near the bound on either side."""
    g = random.Random(seed)
    w = [f"w{i}" for i in range(length)]
    out = {}
    for k in range(texts):
        v = list(w)
        for at in g.sample(range(length), changed):
            v[at] = f"c{k}x{at}"
        out[k] = " ".join(v)
    return out


@pytest.mark.parametrize("changed", [2, 4, 6])
def test_dense_group(spark, changed):
    texts = dense(changed, 150, 150, changed)
    df = spark.createDataFrame(list(texts.items()), DOCS).repartition(5)
    assert sorted(r.doc_id for r in near_copies.kept_documents(df).collect()) == brute_kept(texts)


def test_sketches_never_rule_out_an_alike_pair(spark):
    g = random.Random(3)
    sets = []
    for n in (0, 1, 3, 5, 60, 64, 65, 120, 130, 500, 520, 2000, 2100, 9000):
        base = [g.getrandbits(64) for _ in range(n)]
        for share in (0, 0.05, 0.1, 0.12, 0.3):
            sets.append(near_copies.np.unique(near_copies.np.array([g.getrandbits(64) if g.random() < share else h for h in base], near_copies.np.uint64)))
    rows = [(i, len(s), near_copies.odd_sketch(s).tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, n bigint, s array<bigint>")
    pairs = df.selectExpr("id a", "n n_a", "s s_a").crossJoin(df.selectExpr("id b", "n n_b", "s s_b")).filter("a < b")
    got = {(r.a, r.b): r.ok for r in pairs.select("a", "b", near_copies.may_be_alike("n_a", "s_a", "n_b", "s_b", 0.8).alias("ok")).collect()}
    want = {(i, j): near_copies.alike(x, y, 0.8) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j}
    assert all(got[p] for p, ok in want.items() if ok)
    assert sum(not v for v in got.values()) > 0.9 * sum(not v for v in want.values())


def test_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 5, "x"), (2, long + " end", 6, "y"), (3, "short text", 7, "z"), (4, None, 8, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, loc bigint, root string")
    assert sorted(map(tuple, near_copies.kept_documents(df).collect())) == [rows[0], rows[2], rows[3]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in near_copies.kept_documents(docs).select("doc_id").collect()) == brute_kept(texts)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "one two three"), (5, "one two three"), (None, "alone"), (7, ""), (None, None)], DOCS)
    assert sorted((r.doc_id or -1, r.text) for r in near_copies.kept_documents(df).collect()) == [(-1, "alone"), (5, "one two three"), (7, "")]
    assert near_copies.kept_documents(df.limit(0)).count() == 0


def test_simhash_takes_shingle_and_distance(spark):
    texts = planted(7, 6)
    df = spark.createDataFrame(list(texts.items()), DOCS).selectExpr("doc_id loc", "doc_id", "text")
    got = {r.doc_id: r for r in simhash.near_groups(df, shingle=5, distance=1).collect()}
    assert all(r.fp % (1 << 64) == simhash.fingerprint(texts[d], 5) for d, r in got.items())
    with pytest.raises(ValueError):
        simhash.near_groups(df, distance=9)


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Groups of the SimHash operator are candidates; the exact check still decides."""
    seen, groups = [], near_copies.near_groups
    monkeypatch.setattr(near_copies, "near_groups", lambda docs, *a, **k: seen.append(docs.columns) or groups(docs, *a, **k))
    texts = {1: "a b c d e f", 2: "a b c d e f", 3: None, 4: "", 5: "quite another text of seven words"}
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(list(texts.items()), DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(texts) and seen == [["loc", "doc_id", "text"]]
