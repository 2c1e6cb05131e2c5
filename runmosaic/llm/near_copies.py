"""Near copies by exact Jaccard similarity of word shingles, for stages that no query's contract binds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import rows, small, whole_row, words, written
from runmosaic.llm.simhash import BROADCAST_ROWS, SEED, components, near_groups, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, DEPTH = 32, 4
CHUNK = 1024
_g = np.random.default_rng(11)
FACTORS = _g.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32) | np.uint32(1)
SHIFTS = _g.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Different shingle hashes of a whole text in order; one of all words if there are fewer than ``n``."""
    return np.unique(np.array(shingle_hashes(words(text), n), np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band of ``DEPTH`` MinHash values. Two sets of similarity s share one with probability
    1 - (1 - s ** DEPTH) ** BANDS."""
    low = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for i in range(0, len(h), CHUNK):
        v = FACTORS[:, None] * h[i:i + CHUNK] + SHIFTS[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(low, (v * np.uint32(0x2C1B3C6D)).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, DEPTH))]


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of shingles falls into each of at least as many slots as there are shingles.

    The bits in which two sketches differ are never more than the shingles in which the sets do, so they give an exact
    upper bound of the similarity. The upper half of a sketch may be folded onto the lower half.
    """
    longs = max(4, 1 << max(0, (len(shingles) - 1).bit_length() - 6))
    at = (shingles % np.uint64(64 * longs)).astype(np.int64)
    out = np.zeros(longs, np.uint64)
    np.bitwise_xor.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def may_be_alike(n_a: str, sketch_a: str, n_b: str, sketch_b: str, similarity: float) -> Column:
    """False only for pairs whose sizes or sketches show that their similarity is below the bound."""
    fold = lambda s: f"transform(sequence(0, size({s}) div 2 - 1), i -> {s}[i] ^ {s}[i + size({s}) div 2])"
    count = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(bit_count(p ^ q) as bigint)), 0L, (t, v) -> t + v)"
    a, b = sketch_a, sketch_b
    differ = (f"case when size({a}) = size({b}) then {count(a, b)} when size({a}) = 2 * size({b}) then {count(fold(a), b)} "
              f"when size({b}) = 2 * size({a}) then {count(a, fold(b))} else 0L end")
    # similarity s of sets with d different members of n in all: s = (n - d) / (n + d)
    return F.expr(f"least({n_a}, {n_b}) >= {similarity} * greatest({n_a}, {n_b}) and ({differ}) * {1 + similarity} <= ({n_a} + {n_b}) * {1 - similarity} + 1e-6")


def keyed(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``loc, text`` -> ``loc, n`` (different shingles), ``keys`` and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            size, keys, sketches = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, n)
                size.append(len(s))
                keys.append(band_keys(s))
                sketches.append(odd_sketch(s))
            keys = np.array(keys, np.uint64).reshape(-1, BANDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(keys.tolist(), pa.list_(pa.int64())),
                                                  pa.array(sketches, pa.list_(pa.int64()))], names=["loc", "n", "keys", "sketch"])

    return docs.select("loc", F.col("text").cast("string").alias("text")).mapInArrow(run, "loc bigint, n bigint, keys array<bigint>, sketch array<bigint>")


def shingled(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``loc, text`` -> ``loc, shingles`` (the hashes in order, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            sets = pa.array([shingle_set(t, n).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["loc", "shingles"])

    return docs.select("loc", F.col("text").cast("string").alias("text")).mapInArrow(run, "loc bigint, shingles binary")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches the bound; two empty sets are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets are alike. Only the sets of rows in a pair are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()] for i in (2, 3))
            ok = pa.array([alike(u, v, similarity) for u, v in zip(x, y)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    needed = written(pairs.select(F.col("a").alias("loc")).union(pairs.select("b")).distinct(), "near-needed")
    sets = written(shingled(docs.join(small(needed, BROADCAST_ROWS), "loc", "left_semi"), shingle), "near-sets")
    with_a = pairs.join(sets.select(F.col("loc").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("loc").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``loc, text`` -> links ``a, b`` between alike rows, enough to connect all alike pairs that share a band.

    The groups of the SimHash operator come first: each row is compared with the row its group keeps. Three bits of a
    fingerprint find only the nearest copies, so bands of MinHash values propose the others.
    Rows that share a key are first compared with the key's hub: the row whose keys are the most crowded. Among copies
    of one text with different changes that is the text they come from, since it shares more bands with each of them than
    they do with one another; so such a group is settled in as many comparisons as it has rows. Keys whose rows are then
    still in several components compare every row outside the largest of them with the rows of other components.
    """
    made = written(keyed(docs, shingle), "near-probes")
    probes, sketches = made.select("loc", "n", F.explode("keys").alias("key")), made.select("loc", "n", "sketch")
    sizes = written(probes.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "near-keys")
    shared = written(probes.join(small(sizes, BROADCAST_ROWS), "key"), "near-shared")
    crowd = shared.groupBy("loc").agg(F.sum("rows").alias("crowd"))
    met = shared.drop("rows").join(crowd, "loc")
    hubs = met.groupBy("key").agg(F.max_by("loc", F.struct("crowd", -F.col("loc"))).alias("first"))
    met = written(met.drop("crowd").join(small(written(hubs, "near-hubs"), BROADCAST_ROWS), "key"), "near-met")
    tried = met.filter("loc != first").select(F.least("first", "loc").alias("a"), F.greatest("first", "loc").alias("b"))
    groups = written(near_groups(docs.select("loc", F.col("loc").alias("doc_id"), "text")), "near-groups").filter("loc != keep_loc")
    tried = tried.union(groups.select(F.least("keep_loc", "loc").alias("a"), F.greatest("keep_loc", "loc").alias("b")))
    side = lambda n: sketches.select(*[F.col(c).alias(t) for c, t in (("loc", n), ("n", f"n_{n}"), ("sketch", f"s_{n}"))])
    like = may_be_alike("n_a", "s_a", "n_b", "s_b", similarity)
    tried = written(tried.distinct().join(side("a"), "a").join(side("b"), "b").filter(like).select("a", "b"), "near-tried")
    found = written(verified(tried, docs, shingle, similarity), "near-links")
    roots = components(found).withColumnRenamed("fp", "loc")
    of = met.select("key", "loc").join(roots, "loc", "left").select("key", "loc", F.coalesce("root", "loc").alias("root"))
    of = written(of, "near-roots")
    parts = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    split = written(of.join(small(parts, BROADCAST_ROWS), "key"), "near-split")
    top = split.groupBy("key", "root").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("top"))
    split = written(split.join(small(written(top, "near-top"), BROADCAST_ROWS), "key").join(side("loc"), "loc"), "near-parts")
    rest = split.filter("root != top").select("key", *[F.col(c).alias(c + "2") for c in ("loc", "n_loc", "s_loc", "root")])
    # only pairs that may be alike leave the join
    more = split.join(rest, (split["key"] == rest["key"]) & (F.col("root") != F.col("root2")) & ((F.col("root") == F.col("top")) | (F.col("loc") < F.col("loc2")))
                      & may_be_alike("n_loc", "s_loc", "n_loc2", "s_loc2", similarity))
    more = more.select(F.least("loc", "loc2").alias("a"), F.greatest("loc", "loc2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return found.union(verified(written(more, "near-more"), docs, shingle, similarity))


def kept_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of near copies, columns as they were.

    Documents whose sets of ``shingle`` words have a Jaccard similarity of at least ``similarity`` are linked; of all
    that links reach, the one with the smallest doc_id (null last) stays. Candidates are found by SimHash and MinHash, and
    every candidate is verified on whole sets. Texts without words are alike. An empty table gives an empty result.
    """
    stored = written(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("loc")), "near-rows")
    roots = written(components(links(stored.select("loc", F.col("row.text").alias("text")), shingle, similarity)), "near-components")
    members = roots.select(F.col("fp").alias("loc"), "root").union(roots.select(F.col("root").alias("loc"), "root").distinct())
    ids = stored.select("loc", F.col("row.doc_id").cast("bigint").alias("doc_id"))
    members = written(members.distinct().join(ids, "loc"), "near-members")
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "loc")).alias("first"))
    dropped = members.join(best, "root").filter(F.col("loc") != F.col("first.loc")).select("loc")
    return stored.join(small(written(dropped, "near-dropped"), 10 * BROADCAST_ROWS), "loc", "left_anti").select("row.*")
