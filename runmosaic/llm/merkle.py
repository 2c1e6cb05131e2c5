"""Merkle trees over rows, level by level as self-joins of nodes with their siblings.

Every key (here: lang) has a tree of its own over its rows in order; the trees' roots, in order of the key, are the
leaves of one more tree. A node is a row ``tree, idx, digest``. At each level it meets its siblings by an equijoin on
their computed index (``idx XOR 1`` in binary trees, slot offsets otherwise), and the nodes in slot zero emit parents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runmosaic.llm.common import small, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_NODES = 4096


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes; digests travel as bytes and are hashed as lowercase hex."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def ranked(df: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """A table with ``idx``, the place of each row within its ``key`` by ``order``, and ``size``, the rows of the key.

    Rows are sorted by range over all tasks, so a key with most rows spreads; a key's rows before a task come from
    one count per (key, task). Rows equal in all columns are told apart by their place in ``df`` only.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(key), *[F.asc_nulls_first(c) for c in order], F.col("_tie")]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    # task number and place in the task, both from the sorted rows
    rows = written(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), tag)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    spans = rows.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)  # one row per task and key
    spans = spans.select(key, "_part", "_first", F.sum("_n").over(whole).alias("size"),
                         F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    spans = written(spans, f"{tag}-spans")
    return (rows.join(small(spans, 100_000), [key, "_part"])
            .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"))


@dataclass
class Trees:
    """``levels[k]``: nodes of level k that have a parent, with ``slot`` and ``siblings`` (slot and digest, by slot);
    ``tops``: one row ``tree, digest, level`` per tree."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int


def grow(leaves: DataFrame, arity: int = 2, tag: str = "merkle") -> Trees:
    """Trees over ``tree, idx, size, digest``; further columns stay with the leaves. Each level is a table."""
    if arity < 2:
        raise ValueError("a node has at least two children")
    nodes, levels, tops = leaves, [], []
    while True:
        level = len(levels)
        tops.append(nodes.filter("size = 1").select("tree", "digest", F.lit(level).alias("level")))
        open_nodes = nodes.filter("size > 1").withColumn("slot", (F.col("idx") % arity).cast("int"))
        met = open_nodes
        for off in range(1, arity):
            at = F.col("idx").bitwiseXOR(1) if arity == 2 else F.col("idx") - F.col("slot") + (F.col("slot") + off) % arity
            other = open_nodes.select("tree", F.col("idx").alias("_s"), F.struct("slot", "digest").alias(f"_o{off}"))
            met = met.withColumn("_s", at).join(other, ["tree", "_s"], "left")
        found = F.array_sort(F.filter(F.array(*[f"_o{o}" for o in range(1, arity)]), lambda s: s.isNotNull()))
        table = written(met.withColumn("siblings", found).drop("_s", *[f"_o{o}" for o in range(1, arity)]), f"{tag}-{level}")
        if table.isEmpty():
            break
        levels.append(table)
        nodes = table.filter("slot = 0").select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
                                                joined(F.col("digest"), F.col("siblings"), F.col("slot")).alias("digest"))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return Trees(levels, written(roots, f"{tag}-tops"), arity)


def joined(own: Column, siblings: Column, slot: Column) -> Column:
    """Digest of a run: a node and its siblings in slot order."""
    texts = lambda keep: F.array_join(F.transform(F.filter(siblings, keep), lambda s: as_text(s["digest"])), "")
    return hashed(F.concat(texts(lambda s: s["slot"] < slot), as_text(own), texts(lambda s: s["slot"] > slot)))


def proofs(trees: Trees, above: DataFrame) -> DataFrame:
    """Leaves of all trees with ``path``: slot and siblings of each node from the leaf upwards, then the steps that
    ``above`` (``tree, path``) holds for the tree's top. Paths go down one level at a time, from parents to children;
    levels that are small by their count are broadcast."""
    tops = trees.tops.join(small(above, BROADCAST_NODES), "tree").select("tree", "level", F.lit(0).cast("bigint").alias("idx"), "path")
    below = None
    for k in range(len(trees.levels) - 1, -1, -1):
        parents = tops.filter(F.col("level") == k + 1).drop("level")
        if below is not None:
            parents = parents.unionByName(below.select("tree", "idx", "path"))
        up = parents.withColumnRenamed("idx", "_up")
        count = trees.levels[k].limit(BROADCAST_NODES + 1).count()
        step = F.array(F.struct("slot", "siblings"))
        below = (trees.levels[k].withColumn("_up", F.expr(f"idx div {trees.arity}"))
                 .join(F.broadcast(up) if count <= BROADCAST_NODES else up, ["tree", "_up"]).drop("_up")
                 .withColumn("path", F.concat(step, "path")))
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: joined(acc, s["siblings"], s["slot"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.array_join(F.transform(s["siblings"], lambda x: as_text(x["digest"])), "")), "")


EMPTY_PATH = "cast(array() as array<struct<slot: int, siblings: array<struct<slot: int, digest: binary>>>>)"


@dataclass
class Manifest:
    """Leaves with ``tree, doc_id, digest, tampered`` in ``rows`` trees; ``keys`` is the tree over their subroots."""

    rows: Trees
    keys: Trees
    singles: DataFrame  # leaves that are their tree's only one
    key_leaves: DataFrame
    root: bytes | None


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, tampered``: the leaf digest of each row, and that of a row whose n_chars was raised by one
    where the checksum of its id says so (null otherwise)."""
    c = {n: F.col(n) for n in FIELDS}
    line = lambda **new: hashed(F.concat(*[field({**c, **new}[n]) for n in FIELDS]))
    chosen = F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0
    return docs.select(F.coalesce(F.concat(F.lit("="), c["lang"].cast("string")), F.lit("")).alias("tree"), c["doc_id"].cast("bigint").alias("doc_id"),
                       line().alias("digest"), F.when(chosen & c["n_chars"].isNotNull(), line(n_chars=c["n_chars"].cast("bigint") + 1)).alias("tampered"))


def build(docs: DataFrame, arity: int = 2) -> Manifest:
    """All node tables of the manifest of ``docs``.

    The tree of a null lang comes before all others. Within a tree rows ascend by doc_id (null first), and rows of one
    id by their leaf digest.
    """
    table = written(leaves(docs), "leaves")
    placed = ranked(table, "tree", ["doc_id", "digest"], "ranked")
    rows = grow(placed, arity, "rows")
    subroots = rows.tops.select(F.lit("").alias("all"), F.col("tree").alias("key"), "digest")
    keys = ranked(subroots, "all", ["key"], "subroots").withColumnRenamed("all", "tree")
    over = grow(keys, arity, "keys")
    root = over.tops.select("digest").first()
    return Manifest(rows, over, placed.filter("size = 1"), keys, root and bytes(root[0]))


def with_proofs(m: Manifest) -> DataFrame:
    """Every leaf with ``doc_id, digest, tampered, subroot, path``, the path leading to the root of all."""
    none = F.expr(EMPTY_PATH)
    above = m.key_leaves.filter("size = 1").select(F.col("key").alias("tree"), none.alias("path"))
    if m.keys.levels:
        end = m.keys.tops.select("tree", none.alias("path"))
        above = proofs(m.keys, end).select(F.col("key").alias("tree"), "path")
    above = written(above, "above")
    cols = ["tree", "doc_id", "digest", "tampered", "path"]
    out = m.singles.join(small(above, BROADCAST_NODES), "tree").select(*cols)
    if m.rows.levels:
        out = out.unionByName(proofs(m.rows, above).select(*cols))
    return out.join(small(m.rows.tops.select("tree", F.col("digest").alias("subroot")), BROADCAST_NODES), "tree")


def audit(docs: DataFrame, arity: int = 2) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    The folded root starts from the tampered leaf where there is one and climbs over the original siblings. Null
    fields are written as ``-``; a tree of one row is its leaf; an empty table gives no rows; repeated rows each have
    a leaf; other columns are not read.
    """
    m = build(docs, arity)
    root = F.lit(m.root.hex() if m.root else None).cast("string")
    folded = as_text(fold(F.coalesce("tampered", "digest"), F.col("path")))
    out = with_proofs(m).select("doc_id", as_text(F.col("digest")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"),
                                F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
