import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runmosaic.llm import packing, queries

DOCS = "doc_id bigint, text string, items string, bin int"


def verify(rows, texts, capacity):
    """Pieces rebuild every document, sequences are gapless and within capacity; returns the sequence count."""
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = np.array(t.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids)
        assert all(p.length == capacity for p in ps[1:]) and 0 < ps[0].length <= capacity
        assert len(ps) == max(1, -(-len(ids) // capacity))
        at = 0
        for p in ps:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
    for parts in by_seq.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(by_seq)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_best_fit_packing"](spark, sf).collect()
    n = verify(rows, texts, 1024)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024)


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "<|endoftext|> x <|endoftext|>", 5: "日本語 ਠ emoji 😀", 6: " \t\n\x85\xa0 x  "}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], DOCS)
    verify(packing.pack_documents(df).collect(), texts, 1024)
    assert packing.pack_documents(df.limit(0)).count() == 0
    again = packing.pack_documents(df.union(df)).collect()
    assert len(again) == 2 * packing.pack_documents(df).count() and sum(r.length for r in again) % 2 == 0


@pytest.mark.parametrize("size", [11, 8, 3])
def test_levels_end_when_nothing_fits(spark, size):
    """Items over half a sequence, just under half and small ones, with tiny tasks so that many levels run."""
    df = spark.range(3000, numPartitions=8).selectExpr("id as doc_id", f"trim(repeat('a ', {size - 1})) as text")
    rows = packing.pack_documents(df, capacity=20, slack=1, chunk=100).collect()
    seqs = defaultdict(int)
    for r in rows:
        seqs[r.sequence_id] += r.length
    assert len(rows) == 3000 and max(seqs.values()) <= 20
    assert len(seqs) <= -(-3000 // (20 // size)) + 40


def test_levels_pack_close_to_one_task(spark):
    df = spark.range(6000, numPartitions=16).selectExpr("id as doc_id", "trim(repeat('a ', 1 + cast(id * 7919 % 60 as int))) as text")
    rows = packing.pack_documents(df, capacity=64, slack=0, chunk=200).collect()
    alone = len(packing.best_fit([r.length for r in rows], 64))
    assert len({r.sequence_id for r in rows}) <= 1.03 * alone


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_against_plain_search(sizes):
    bins = packing.best_fit(sizes, 30)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 30 for b in bins)
    assert sum(2 * sum(sizes[i] for i in b) <= 30 for b in bins) <= 1


def test_both_libraries_agree_on_plain_characters():
    fast, slow = packing.fast_encoder("byte_bpe_50k"), packing.slow_encoder("byte_bpe_50k")
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20ac]]
    for c in chars:
        assert packing.PLAIN.match(c)
        for text in (c, f"a{c}b", f" {c} {c}{c}9", f"x{c}\n\n{c} y", f"'s{c}'ll"):
            assert fast.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids, hex(ord(c))
