import re
import zlib
from collections import Counter
from math import exp, isclose, log, log10

import pytest

from runmosaic.llm import lattice, queries

DOCS = "doc_id bigint, text string, word string, c int"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_word(m, w):
    """Sum over every segmentation, one by one."""
    s = lattice.START + w

    def all_from(i):
        if i == len(s):
            return 1.0
        total = sum(exp(m.log_p[s[i:j]]) * all_from(j) for j in range(i + 1, len(s) + 1) if s[i:j] in m.log_p)
        if s[i] not in m.log_p:
            total += exp(sum(m.bytes[b] for b in s[i].encode())) * all_from(i + 1)
        return total

    return log(all_from(0))


def brute(docs):
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for _, t in train for w in split(t))
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    sp = lattice._processor(lattice.VOCABULARY)
    pieces = Counter()
    for w, k in c.items():
        for p in sp.encode(w):
            pieces[p] += k
    m = lattice.Lattice.of_counts(pieces, len(train))
    f = lambda k: log10((k + 0.5) / (n + 0.5 * (v + 1)))
    cache = {}
    out = []
    for d, t in docs:
        ws = split(t)
        for w in ws:
            if w not in cache:
                cache[w] = m.word(w)
        out.append((d, zlib.crc32(str(d).encode()) % 5 == 1, len(ws) + 1, sum(c[w] > 0 for w in ws) + bool(train), n,
                    sum(f(c[w]) for w in ws) + f(len(train)), (sum(cache[w] for w in ws) + m.end) / log(10)))
    return out


def same(got, want):
    got = sorted([tuple(r) for r in got], key=str)
    want = sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=1e-9)


@pytest.mark.parametrize("head", [1 << 17, 50, 0])
def test_whole_table(spark, head):
    """Any share of words in the looked-up head gives the same values."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    same(lattice.score_texts(df, lattice.part_of("doc_id") == 1, head=head).collect(), want)


def test_query_beats_equal_pieces_on_held_out_rows(spark):
    """Scores learnt from the corpus against the same lattice with every piece equally likely."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op10_lattice_likelihood"](spark, sf).collect()}
    assert len(rows) == 1000 and len({r.train_tokens for r in rows.values()}) == 1
    flat = lattice.Lattice.of_counts({}, 0)
    held = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if rows[r.doc_id].held_out]
    for r in held:
        assert rows[r.doc_id].score > (sum(map(flat.word, split(r.text))) + flat.end) / log(10)


def test_forward_sum_matches_every_segmentation():
    m = lattice.Lattice({"▁": -2.0, "▁a": -1.5, "a": -3.0, "b": -2.5, "ab": -2.0, "▁ab": -4.0, "ba": -3.5, "aba": -5.0}, [-9.0] * 256, -1.0)
    for w in ("a", "ab", "aba", "abab", "bbab", "aéb", "é", "ababababab"):
        assert isclose(m.word(w), brute_word(m, w), rel_tol=1e-12), w
    assert m.word("ab" * 20_000) < -1e4


def test_odd_rows(spark):
    docs = [(0, None), (0, None), (1, ""), (2, "A a\x0bB  ß　x"), (3, "x" * 30_000), (4, "日本 😀"), (5, "w " * 50_000), (None, "only id missing")]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], DOCS)
    got = lattice.lm_report(df).collect()
    same(got, [r if r[0] is not None else r for r in brute_with_null(docs)])
    assert lattice.lm_report(df.limit(0)).count() == 0


def brute_with_null(docs):
    """A null id counts as empty text in the hash."""
    key = lambda d: "" if d is None else d
    rows = brute([(key(d), t) for d, t in docs])
    return [(None if r[0] == "" else r[0], *r[1:]) for r in rows]


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    df = spark.createDataFrame([(i, "some words", "w", 1) for i in ids], DOCS)
    for r in lattice.lm_report(df).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
