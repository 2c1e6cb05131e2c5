import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from runmosaic.llm import queries, token_files
from runmosaic.llm.common import shared_folder

DOCS = "doc_id bigint, text string, frame string, _row int, n_tokens int"


def plain():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(t, text):
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_query_on_whole_table(spark):
    sf, t = "/root/testdata/sf0.01", plain()
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, queries.QUERIES["op13_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, at = [], 0
    for d, text in rows:
        ids = ids_of(t, text)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


TEXTS = [(1, None), (2, ""), (3, "word " * 9000), (4, "<|endoftext|> x<|endoftext|>"), (5, "日本語 ਠ emoji 😀"), (6, " \t\n\x85\xa0 x \x1c\x1f y"), (7, "don't  we'll"),
         (None, "no id"), (-3, "below zero"), (7, "again")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


def test_odd_rows_and_single_documents(spark):
    t, folder = plain(), shared_folder(spark, "tokens")
    token_files.write_token_files(frame(spark, TEXTS).repartition(4), folder)
    got = token_files.read_token_files(spark, folder, slice_docs=2, piece=10).collect()
    ends = sorted(r.start + r.n_tokens for r in got)
    assert sorted(r.start for r in got) == [0, *ends[:-1]]  # gapless
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, -3, 1, 2, 3, 4, 5, 6, 7, 7]
    assert sorted(bytes(r.ids) for r in got) == sorted(ids_of(t, x).tobytes() for _, x in TEXTS)
    assert [a.tolist() for a in token_files.read_document(folder, 4)] == [ids_of(t, TEXTS[3][1]).tolist()]
    assert {tuple(a) for a in token_files.read_document(folder, 7)} == {tuple(ids_of(t, "don't  we'll")), tuple(ids_of(t, "again"))}
    assert token_files.read_document(folder, 99) == []


def test_empty_table(spark):
    folder = token_files.write_token_files(frame(spark, []), shared_folder(spark, "tokens"))
    assert token_files.token_checks(spark, folder).count() == 0 and token_files.manifest(folder)[0]["shards"] == []


def test_one_frequent_id_spreads(spark):
    rows = [(5, f"text number {i}") for i in range(900)] + [(i, "x") for i in range(10)]
    folder = token_files.write_token_files(frame(spark, rows).repartition(5), shared_folder(spark, "tokens"))
    shards = token_files.manifest(folder)[0]["shards"]
    assert max(s["docs"] for s in shards) < 400 and sum(s["docs"] for s in shards) == 910
    assert len(token_files.read_document(folder, 5)) == 901


def test_damage_is_noticed(spark):
    rows = [(i, f"text number {i} " * 40) for i in range(200)]
    folder = token_files.write_token_files(frame(spark, rows).coalesce(1), shared_folder(spark, "tokens"))
    listed, dictionary = token_files.manifest(folder)
    assert dictionary
    fs, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{listed['shards'][0]['file']}"
    with fs.open_input_stream(path) as f:
        raw = bytearray(f.read())
    with pytest.raises(ValueError):
        token_files.open_shard(folder, listed["shards"][0]["file"], b"another")
    raw[len(token_files.MAGIC) + 30] ^= 1
    with fs.open_output_stream(path) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception):
        token_files.token_checks(spark, folder).collect()


def test_dictionary_helps_short_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "substring(text, 1, 400) as text")
    size = {}
    for name, n in (("with", 65_536), ("without", 0)):
        folder = token_files.write_token_files(docs, shared_folder(spark, "tokens"), dictionary_bytes=n)
        size[name] = sum(s["bytes"] for s in token_files.manifest(folder)[0]["shards"])
    assert size["with"] < 0.95 * size["without"]
