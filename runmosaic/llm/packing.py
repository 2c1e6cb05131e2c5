"""Best-fit packing in levels: tasks pack what they hold, nearly full bins leave, the others are merged as items."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import rows, written

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                  ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int64()), ("closed", pa.bool_()), ("items", pa.list_(ITEM))])
BIN_DDL = ("bin bigint, fill bigint, closed boolean, items array<struct<doc_id: bigint, piece: int, start: bigint, "
           "length: bigint, ids_crc32: bigint, offset: bigint>>")
# letters and signs on which both libraries were tested to agree; any other text goes to the slower one
PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*\Z")


@lru_cache(maxsize=1)
def fast_encoder(name: str):
    import public_tokenizers as P
    import tiktoken
    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def slow_encoder(name: str):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path(f"{name}.json"))


@lru_cache(maxsize=1)
def added_tokens(name: str) -> tuple[str, ...]:
    """Texts that the library takes as one token wherever they stand."""
    return tuple(t.content for t in slow_encoder(name).get_added_tokens_decoder().values())


def token_ids(text: str | None, name: str = TOKENIZER) -> list[int]:
    """Ids of a whole text as the ``tokenizers`` library gives them.

    Texts of common letters and signs go to ``tiktoken``, which holds the same vocabulary and is four times as fast; texts with
    other characters, or with an added token, go to ``tokenizers`` itself.
    """
    if not text:
        return []
    if PLAIN.match(text) and not any(a in text for a in added_tokens(name)):
        return fast_encoder(name).encode_ordinary(text)
    return slow_encoder(name).encode(text, add_special_tokens=False).ids


def pieces(doc_id, ids: list[int], capacity: int) -> Iterator[tuple]:
    """Pieces of one document: only longer ones are cut, and the first piece takes what is left over."""
    a = np.asarray(ids, "<u4")
    head = len(a) if len(a) <= capacity else len(a) % capacity or capacity
    ends = [head, *range(head + capacity, len(a) + 1, capacity)]
    for k, (s, e) in enumerate(zip([0, *ends], ends)):
        yield doc_id, k, s, e - s, zlib.crc32(a[s:e].tobytes())


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices per bin: largest item first, into the bin with the least room that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
    return bins


def merge(items: list[tuple[int, list]], capacity: int, slack: int, last: bool) -> Iterator[tuple[int, bool, list]]:
    """One best-fit round over (fill, members): nearly full bins are closed.

    Before the last round a bin that stays underfull gives its items back as they came, so that the
    next round can still place each of them.
    """
    for group in best_fit([f for f, _ in items], capacity):
        fill = sum(items[i][0] for i in group)
        if last or fill >= capacity - slack:
            members, at = [], 0
            for i in group:
                members += [(*m[:5], m[5] + at) for m in items[i][1]]
                at += items[i][0]
            yield fill, True, members
        else:
            yield from ((items[i][0], False, items[i][1]) for i in group)


class _Out:
    """Bins numbered by round and task, given out in batches."""

    def __init__(self, level: int):
        self.next, self.held = (level << 57) + (TaskContext.get().partitionId() << 33), []

    def add(self, bins) -> None:
        for fill, closed, members in bins:
            self.held.append((self.next, fill, closed, members))
            self.next += 1

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.held) >= least:
            named = [f.name for f in ITEM]
            yield pa.RecordBatch.from_pylist([{"bin": b, "fill": f, "closed": c, "items": [dict(zip(named, m)) for m in ms]}
                                              for b, f, c, ms in self.held], schema=BIN)
            self.held = []


def first_level(docs: DataFrame, capacity: int, slack: int, name: str, chunk: int) -> DataFrame:
    """Tokens of whole texts, cut and packed where they are read; at most ``chunk`` open items are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_items = _Out(0), []

        def pack():
            nonlocal open_items
            done = list(merge(open_items, capacity, slack, False))
            out.add(b for b in done if b[1])
            open_items = [(f, m) for f, closed, m in done if not closed]

        for b in rows(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in pieces(doc_id, token_ids(text, name) + [END_ID], capacity):
                    if p[3] == capacity:
                        out.add([(capacity, True, [(*p, 0)])])
                    else:
                        open_items.append((p[3], [(*p, 0)]))
            if len(open_items) >= chunk:
                pack()
                if 2 * len(open_items) >= chunk:  # these fit nothing here; another round sees them beside others
                    out.add((f, False, m) for f, m in open_items)
                    open_items = []
            yield from out.batch(2000)
        pack()
        out.add((f, False, m) for f, m in open_items)
        yield from out.batch()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, BIN_DDL)


def next_level(bins: DataFrame, level: int, parts: int, capacity: int, slack: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, items = _Out(level), []
        for b in batches:
            items += [(r["fill"], [tuple(m.values()) for m in r["items"]]) for r in b.to_pylist()]
        out.add(merge(items, capacity, slack, last))
        yield from out.batch()

    return bins.repartition(parts, F.xxhash64("bin", F.lit(level))).mapInArrow(run, BIN_DDL)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, slack: int = 6, name: str = TOKENIZER, chunk: int = 20_000,
                   fan_in: int = 8) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    Each reading task packs its pieces best-fit and closes the bins that lack at most ``slack`` tokens.
    What stays open is merged in rounds over ever fewer tasks (``fan_in`` to one), never more than about
    ``chunk`` items in a task. When one task is left, or a round has closed hardly anything (texts that
    fit nothing, for example all just over half a sequence), the last round closes every bin. Each round
    is a table in the shared folder, so a lost executor costs one round at most.

    Null text is an empty document of one token; null and repeated ids are packed row by row; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    done = written(first_level(docs, capacity, slack, name, chunk), "bins")
    levels, level, parts = [done.filter("closed")], 0, 1 << 30
    left, last = done.filter("not closed"), False
    n = left.count()
    while n and not last:
        level += 1
        parts = max(1, ceil(n / chunk)) if level == 1 else max(1, ceil(parts / fan_in), ceil(n / chunk))
        last = parts == 1
        done = written(next_level(left, level, parts, capacity, slack, last), "bins")
        if not last and (m := done.filter("not closed").count()) > 0.9 * n:
            levels.append(done.filter("closed"))
            done, last = written(next_level(done.filter("not closed"), level + 1, parts, capacity, slack, True), "bins"), True
        levels.append(done.filter("closed"))
        left = done.filter("not closed")
        n = 0 if last else m
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out.select(F.col("bin").alias("sequence_id"), F.explode("items").alias("i")).select("i.*", "sequence_id")
