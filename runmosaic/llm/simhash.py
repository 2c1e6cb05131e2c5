"""SimHash near duplicates found through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import rows, small, whole_row, words, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
GROUP = 4096
BROADCAST_ROWS = 100_000
PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, 32, dtype=np.uint64)


def shingle_hashes(w: list[bytes], n: int = SHINGLE) -> list[int]:
    """Hashes of all runs of ``n`` words, or of all words if there are fewer; none without words."""
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) < n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    return [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip((end - size)[:len(w) - n + 1].tolist(), end[n - 1:].tolist())]


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64 majority bits over the shingle hashes of a whole text; 0 without words."""
    h = shingle_hashes(words(text), n)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 25_500):
        a = np.array(h[i:i + 25_500], "<u8")
        a = np.concatenate([a, np.zeros(-len(a) % 255, "<u8")])
        bits = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``loc, doc_id, text`` -> ``loc, doc_id, fp`` (the 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(2).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["loc", "doc_id", "fp"])

    return docs.select("loc", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "loc bigint, doc_id bigint, fp bigint")


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bits."""
    at = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(at, at[1:])]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def table_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One table for every choice of blocks that must agree in two fingerprints within the distance.

    References for a block are zero and its one-bit fingerprints e_i: the distance of x to e_i, less its
    distance to zero, is +1 or -1 by bit i. At most ``distance`` blocks of a linked pair hold a differing
    bit, so on the references of the other blocks all coordinates agree. They can be read off as ``x & mask``.
    """
    runs = _cut(list(range(64)), blocks)
    return [sum(c) for c in combinations(runs, blocks - distance)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The same for the bits outside ``mask`` in 8 blocks; about 12 bits stay open, so no group passes 4096."""
    runs = _cut([i for i in range(64) if not mask >> i & 1], 8)
    return [mask | sum(c) for c in combinations(runs, 8 - distance)]


def _near(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, distance: int) -> np.ndarray:
    """Pairwise: not discarded by the largest coordinate difference, then verified on the fingerprints."""
    ok = np.abs(va - vb).max(axis=-1) <= distance
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= distance
    return ok


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(member, root) for the linked members of one group.

    Walks from each member only to those not reached yet, so a dense ball of copies is left after a few
    steps and no pair inside a settled component is looked at.
    """
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    left, out = np.arange(len(fps)), []
    while len(left):
        reached, front, left = [left[0]], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for i in front:
                rest = np.flatnonzero(~hit)
                hit[rest] = _near(np.broadcast_to(fps[i], len(rest)), fps[left[rest]], table[i], table[left[rest]], distance)
            front, left = left[hit], left[~hit]
            reached += front.tolist()
        members = fps[reached].view(np.int64)
        root = int(members.min())
        out += [(m, root) for m in members.tolist() if m != root]
    return out


def group_links(groups: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fps`` (at most some thousand each) -> links ``a, b`` that connect what is near in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, out = [], [], []
            for g in b.column(0).to_pylist():
                if len(g) <= 12:
                    for x, y in combinations(g, 2):
                        left.append(x)
                        right.append(y)
                else:
                    out += forest(np.array(g, np.int64).view(np.uint64), distance)
            x, y = (np.array(v, np.int64) for v in (left, right))
            ux, uy = x.view(np.uint64), y.view(np.uint64)
            ok = np.zeros(len(x), bool)
            for i in range(0, len(x), 20_000):
                s = slice(i, i + 20_000)
                va, vb = (np.bitwise_count(u[s][:, None] ^ PIVOTS).astype(np.int8) for u in (ux, uy))
                ok[s] = _near(ux[s], uy[s], va, vb, distance)
            more = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.maximum(x, y)[ok], more[:, 0]])),
                                              pa.array(np.concatenate([np.minimum(x, y)[ok], more[:, 1]]))], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, group: int = GROUP, distance: int = DISTANCE) -> DataFrame:
    """Links between different fingerprints (``fp``), enough to connect every pair within the distance.

    Fingerprints meet in 20 tables of about 32 equal bits. A key with more than ``group`` members is dealt
    out again by 20 further bits, where a group cannot pass 4096 whatever the data. A smaller distance
    leaves more bits equal and so smaller groups; a larger one would not keep them bounded.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance {distance} is not from 0 to {DISTANCE}")
    masks = table_masks(distance=distance)
    keys = lambda masks: F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))
    literal = lambda ms: "array(" + ", ".join(f"cast('{_signed(m)}' as bigint)" for m in ms) + ")"
    probes = distinct.select("fp", F.posexplode(keys(F.expr(literal(masks)))).alias("t", "key"))
    sizes = written(probes.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    met = probes.join(small(sizes, BROADCAST_ROWS), ["t", "key"])
    met = written(met, "simhash-met")
    usual = met.filter(F.col("n") <= group).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    finer = keys(F.get(F.expr("array(" + ", ".join(literal(finer_masks(m, distance)) for m in masks) + ")"), F.col("t")))
    dense = (met.filter(F.col("n") > group).select("t", "fp", F.posexplode(finer).alias("c", "key"))
             .groupBy("t", "c", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1))
    return group_links(usual.select("fps").union(dense.select("fps")), distance).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``fp, root`` (smallest member) by alternating stars; hubs are summed before shuffles."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "simhash-edges")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(e)
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "simhash-stars")
        after = mark(e)
        if after == before:
            return e.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = after


def near_groups(docs: DataFrame, group: int = GROUP, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``loc, doc_id, text`` -> ``loc, doc_id, fp, component_id, keep_loc`` for every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; a component is all that links reach. Its
    id is its smallest doc_id (null last) and ``keep_loc`` that row. Equal fingerprints are merged before
    any table is built, so copies cost nothing further. Null text and texts without words have
    fingerprint zero and link like any other. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, shingle), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "loc")).alias("first")
    distinct = written(fps.groupBy("fp").agg(first), "simhash-distinct")
    roots = distinct.join(components(links(distinct, group, distance)), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = roots.groupBy("root").agg(F.min("first").alias("keep"))
    of = roots.join(best, "root").select("fp", F.col("keep.doc_id").alias("component_id"), F.col("keep.loc").alias("keep_loc"))
    return fps.join(of, "fp").select("loc", "doc_id", "fp", "component_id", "keep_loc")


def near_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` for every document."""
    found = near_groups(docs.select(F.monotonically_increasing_id().alias("loc"), "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, columns as they were."""
    stored = written(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("loc")), "simhash-rows")
    found = near_groups(stored.select("loc", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), shingle=shingle, distance=distance)
    dropped = small(written(found.filter("loc != keep_loc").select("loc"), "simhash-dropped"), 10 * BROADCAST_ROWS)
    return stored.join(dropped, "loc", "left_anti").select("row.*")
