"""Token ids as binary files: one zstandard frame a document under a shared dictionary, with an offset index.

A data set is a folder of ``dictionary.zdict``, ``manifest.json`` and shard files, one per range of doc_id:

    magic | frames, one after the other | index | footer
    index   three little-endian arrays over the shard's documents: frame ends u64, ids before each document u64 (one
            more entry than documents), doc_id i64 (null: the least i64, and a bit array of nulls after it)
    footer  documents u64, place of the index u64, width of an id u8, SHA-256 of the dictionary 32 bytes, magic

A frame holds the ids of one document as little-endian integers of ``width`` bytes and a checksum, so any
document can be read with three ranged reads: footer, index, frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runmosaic.llm.common import rows, shared_folder, written
from runmosaic.llm.packing import END_ID, TOKENIZER, slow_encoder, token_ids

MAGIC = b"RMTIDS01"
FOOTER = "<QQB32s8s"
SHARD = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
NO_ID = -(1 << 63)


def id_width(name: str) -> int:
    return 2 if slow_encoder(name).get_vocab_size(True) <= 1 << 16 else 4


def files(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI; the same on the driver and in tasks."""
    return pafs.FileSystem.from_uri(folder)


def train_dictionary(docs: DataFrame, name: str, end_id: int, sample: int, longest: int, size: int) -> bytes:
    """A zstandard dictionary from at most ``sample`` documents of at most ``longest`` bytes, drawn by hash.

    Short documents are those a dictionary helps. Where there are too few for training, their ids themselves
    serve as the dictionary; without any it is empty.
    """
    import zstandard
    if not size:
        return b""
    short = docs.filter(F.octet_length("text").between(1, longest)).select("text", F.xxhash64("text", "doc_id", F.monotonically_increasing_id()).alias("_h"))
    # about twice the sample leaves the tasks, however many rows and tasks there are
    share = min(1.0, 2 * sample / max(1, docs.count()))
    drawn = short.filter(F.col("_h") < F.lit(int((2 * share - 1) * 2**63) if share < 1 else 2**63 - 1)).orderBy("_h").limit(sample)
    kind = f"<u{id_width(name)}"
    parts = [np.array(token_ids(r.text, name) + [end_id], kind).tobytes() for r in drawn.collect()]
    if sum(map(len, parts)) >= 20 * size and len(parts) >= 20:
        return zstandard.train_dictionary(size, parts).as_bytes()
    return b"".join(parts)[:size]


def compressor(dictionary: bytes, level: int):
    import zstandard
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)


def decompressor(dictionary: bytes):
    import zstandard
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def frames(docs: DataFrame, name: str, end_id: int, dictionary: bytes, level: int) -> DataFrame:
    """``doc_id, n_tokens, frame`` for every row, where the row is read."""

    kind = f"<u{id_width(name)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = compressor(dictionary, level)
        for b in rows(batches):
            counts, packed = [], []
            for text in b.column(1).to_pylist():
                ids = token_ids(text, name) + [end_id]
                counts.append(len(ids))
                packed.append(press.compress(np.array(ids, kind).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, frame binary")


def shards(table: DataFrame, folder: str, width: int, digest: bytes) -> DataFrame:
    """Write each partition of sorted frames as one shard file; ``part, file, docs, tokens, bytes`` per file.

    A file is named by its task attempt, so a repeated task never writes over another's file, and only files
    whose rows arrive belong to the data set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, base = files(folder)
        file = f"shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.ids"
        out, at = None, 0
        ends, counts, ids, nulls = [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(f"{base}/{file}", compression=None)
                out.write(MAGIC)
            frame = b.column(2)
            size = np.array([len(x) for x in (v.as_py() for v in frame)], np.uint64)
            out.write(b"".join(v.as_py() for v in frame))
            ends.append(at + np.cumsum(size))
            at += int(size.sum())
            counts.append(b.column(1).to_numpy())
            nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
            ids.append(b.column(0).fill_null(NO_ID).to_numpy())
        if out is None:
            return
        n = np.concatenate(counts)
        out.write(np.concatenate(ends).astype("<u8").tobytes())
        out.write(np.concatenate([[0], np.cumsum(n)]).astype("<u8").tobytes())
        out.write(np.concatenate(ids).astype("<i8").tobytes())
        out.write(np.packbits(np.concatenate(nulls)).tobytes())
        out.write(struct.pack(FOOTER, len(n), len(MAGIC) + at, width, digest, MAGIC))
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": ctx.partitionId(), "file": file, "docs": len(n), "tokens": int(n.sum()), "bytes": at}], schema=SHARD)

    return table.mapInArrow(run, "part int, file string, docs bigint, tokens bigint, bytes bigint")


def write_token_files(docs: DataFrame, folder: str, name: str = TOKENIZER, end_id: int = END_ID, sample: int = 1000, longest: int = 16_384,
                      dictionary_bytes: int = 65_536, level: int = 3) -> str:
    """Write all documents as token files in ascending doc_id order (null first) below the new ``folder``.

    Tokens are made once, where texts are read, and only frames are sorted: by doc_id, and within one repeated id by its
    row's place, so that a very frequent id spreads over shards too. The dictionary is fitted on ``sample`` documents of at
    most ``longest`` bytes and is only an aid to compression. Null text is an empty document (its end id alone); an empty
    table gives a data set without shards; other columns are not read.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, name, end_id, sample, longest, dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    made = written(frames(docs, name, end_id, dictionary, level), "frames").withColumn("_row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = made.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.asc("_row")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "_row")
    fs, base = files(folder)
    fs.create_dir(base, recursive=True)
    done = written(shards(placed.select("doc_id", "n_tokens", "frame"), folder, id_width(name), digest), "shards")
    listed = sorted((r.asDict() for r in done.collect()), key=lambda r: r["part"])  # one row a file
    for file, content in (("dictionary.zdict", dictionary), ("manifest.json", json.dumps({
            "tokenizer": name, "end_id": end_id, "width": id_width(name), "dictionary_sha256": digest.hex(), "shards": listed}).encode())):
        with fs.open_output_stream(f"{base}/{file}", compression=None) as f:
            f.write(content)
    return folder


@dataclass
class Shard:
    """Index of one shard file, and its documents on demand."""

    handle: object
    dictionary: bytes

    def __post_init__(self):
        f = self.handle
        end = f.size() - struct.calcsize(FOOTER)
        n, at, self.width, digest, magic = struct.unpack(FOOTER, f.read_at(struct.calcsize(FOOTER), end))
        if magic != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(self.dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        raw = f.read_at(end - at, at)
        if len(raw) != 8 * n + 8 * (n + 1) + 8 * n + -(-n // 8):
            raise ValueError("the index of the file is incomplete")
        self.ends = np.concatenate([[0], np.frombuffer(raw, "<u8", n)]).astype(np.int64) + len(MAGIC)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 16 * n + 8)
        self.nulls = np.unpackbits(np.frombuffer(raw, np.uint8, offset=24 * n + 8), count=n).astype(bool)
        self.unpack = decompressor(self.dictionary)

    def ids(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Ids of the documents from ``first`` up to ``last``, read in one piece."""
        low = int(self.ends[first])
        raw = memoryview(self.handle.read_at(int(self.ends[last]) - low, low))
        for a, b, n in zip(self.ends[first:last] - low, self.ends[first + 1:last + 1] - low, np.diff(self.starts[first:last + 1])):
            ids = np.frombuffer(self.unpack.decompress(raw[a:b]), f"<u{self.width}").astype("<u4")
            if len(ids) != n:
                raise ValueError("a frame does not hold the ids its index states")
            yield ids


def manifest(folder: str) -> tuple[dict, bytes]:
    """Manifest and dictionary, checked against each other."""
    fs, base = files(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        listed = json.loads(f.read())
    with fs.open_input_stream(f"{base}/dictionary.zdict", compression=None) as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != listed["dictionary_sha256"]:
        raise ValueError("the dictionary is not the one of the manifest")
    return listed, dictionary


def open_shard(folder: str, file: str, dictionary: bytes) -> Shard:
    fs, base = files(folder)
    return Shard(fs.open_input_file(f"{base}/{file}"), dictionary)


def read_document(folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the rows of one doc_id: the shards' indexes are searched, and only its frames are read."""
    listed, dictionary = manifest(folder)
    found = []
    for s in listed["shards"]:
        shard = open_shard(folder, s["file"], dictionary)
        skip = int(shard.nulls.sum())  # nulls come first
        a, b = (skip + int(np.searchsorted(shard.doc_ids[skip:], doc_id, side)) for side in ("left", "right"))
        found += shard.ids(a, b) if b > a else ()
    return found


def read_token_files(spark: SparkSession, folder: str, slice_docs: int = 20_000, piece: int = 8 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of all documents, read back from the files.

    Tasks read slices of at most ``slice_docs`` documents, about ``piece`` compressed bytes at a time.
    """
    return _read(spark, folder, slice_docs, piece, "ids binary", pa.binary(), lambda a: a.tobytes())


def token_checks(spark: SparkSession, folder: str, slice_docs: int = 20_000, piece: int = 8 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, read back from the files."""
    return _read(spark, folder, slice_docs, piece, "ids_crc32 bigint", pa.int64(), lambda a: zlib.crc32(a.tobytes()))


def _read(spark, folder, slice_docs, piece, column, kind, value) -> DataFrame:
    listed, dictionary = manifest(folder)
    slices, before = [], 0
    for s in listed["shards"]:
        slices += [(s["file"], before, a, min(a + slice_docs, s["docs"])) for a in range(0, s["docs"], slice_docs)]
        before += s["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard = open_shard(folder, r["file"], dictionary)
                a = r["first"]
                while a < r["last"]:
                    z = max(a + 1, min(r["last"], int(np.searchsorted(shard.ends, shard.ends[a] + piece, "right")) - 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids[a:z], mask=shard.nulls[a:z]), pa.array(shard.starts[a:z] + r["before"]),
                        pa.array(np.diff(shard.starts[a:z + 1])), pa.array(map(value, shard.ids(a, z)), kind)],
                        names=["doc_id", "start", "n_tokens", column.split()[0]])
                    a = z

    todo = spark.createDataFrame(slices, "file string, before bigint, first bigint, last bigint").repartition(max(1, len(slices)))
    return todo.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {column}")


def token_report(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and report what the files hold."""
    return token_checks(docs.sparkSession, write_token_files(docs, shared_folder(docs.sparkSession, "tokens")))
