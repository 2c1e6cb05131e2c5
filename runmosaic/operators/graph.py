"""Two graph routines used by several operators, both in rounds over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.operators.grouped import Columns, batched_map
from runmosaic.session import cut_lineage, shared_path, written


def connected(edges: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Smallest node reachable from each node (``u, lab``) for undirected edges ``u, v`` per ``keys``.

    Each round takes the least label of the neighbours (summed up map-side, so a node with very many
    neighbours is no hot spot) and then jumps to the label of that label. None without edges.
    """
    both = cut_lineage(edges.select(*keys, "u", "v").unionByName(
        edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    if both.isEmpty():
        return None
    lab = both.select(*keys, "u").distinct().withColumn("lab", F.col("u"))
    while True:
        near = (both.join(lab.select(*keys, F.col("u").alias("v"), F.col("lab").alias("_n")), [*keys, "v"])
                .groupBy(*keys, "u").agg(F.min("_n").alias("_n")))
        step = lab.join(near, [*keys, "u"]).withColumn("_m", F.least("lab", "_n"))
        jump = step.select(*keys, F.col("u").alias("_m"), F.col("_m").alias("_j"))
        new = cut_lineage(step.join(jump, [*keys, "_m"]).select(*keys, "u", "lab", F.least("_m", "_j").alias("new")))
        moved = not new.filter(F.col("new") < F.col("lab")).isEmpty()
        lab = new.select(*keys, "u", F.col("new").alias("lab"))
        if not moved:
            return lab


def greedy_drop(edges: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Nodes removed by the greedy pass over directed edges ``better -> worse`` (``id_a, id_b``).

    In falling rank every node still present removes all worse nodes it points to. Returns ``id_b`` rows or None.

    ``blk_a, blk_b`` name the block each node belongs to (any function of the node; without them its hash). One pass
    settles in every block all that does not hang on open nodes of other blocks, however long the chains in it are;
    then only what crosses block borders is exchanged, so there are as many rounds as a chain crosses blocks. Each
    round is a table in the shared folder. A block is held by one task, so blocks with very many edges are dealt out
    further by node.
    """
    if "blk_a" not in edges.columns:
        for side in "ab":
            edges = edges.withColumn(f"blk_{side}", F.pmod(F.xxhash64(f"id_{side}"), F.lit(64)))
    names = [*keys, "id_a", "id_b", "blk_a", "blk_b"]
    edges = written(edges.filter("id_a <> id_b").select(*names), "conflicts")
    if edges.count() > BLOCK_EDGES:
        crowded = edges.groupBy(*keys, "blk_b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_EDGES)
        crowded = written(crowded.select(*keys, F.col("blk_b").alias("_blk"), F.ceil(F.col("n") / BLOCK_EDGES).alias("_n")), "crowded")
        for side in "ab":
            edges = (edges.withColumn("_blk", F.col(f"blk_{side}")).join(crowded, [*keys, "_blk"], "left")
                     .withColumn(f"blk_{side}", F.when(F.col("_n").isNull(), F.col("_blk")).otherwise(
                         F.xxhash64("_blk", F.pmod(F.xxhash64(f"id_{side}"), "_n")))).drop("_blk", "_n"))
    # a node of another block that nobody points to stays; the others are open
    beaten = edges.select(*keys, F.col("id_b").alias("id_a"))
    border = edges.filter("blk_a <> blk_b")
    hanging = border.select(*keys, "id_a").distinct().join(beaten, [*keys, "id_a"], "left_semi").withColumn("_s", F.lit(OPEN))
    live = (edges.filter("blk_a = blk_b").select(*names, F.lit(OPEN).alias("state_a"))
            .unionByName(border.join(hanging, [*keys, "id_a"], "left").select(*names, F.coalesce("_s", F.lit(KEPT)).alias("state_a"))))
    kinds = dict(live.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", state_a int, state_b int"
    folder, rounds = shared_path(edges.sparkSession, "greedy"), 0
    while True:
        path = f"{folder}/round={rounds}"
        batched_map(live, [*keys, "blk_b"], [], _settle(names), schema).write.parquet(path)
        rounds += 1
        done = edges.sparkSession.read.schema(schema).parquet(path)
        left = done.filter(F.col("state_b") == OPEN)
        if left.isEmpty():
            break
        if done.filter(F.col("state_b") != OPEN).isEmpty() and rounds > 1:
            raise ValueError("the ranks of the nodes contradict each other: an id has rows of different rank")
        # ends in other blocks that this round has settled
        news = done.filter(F.col("state_b") != OPEN).select(*keys, F.col("id_b").alias("id_a"), F.col("state_b").alias("_s"))
        live = left.join(news, [*keys, "id_a"], "left").select(*names, F.coalesce("_s", "state_a").alias("state_a"))
    dropped = edges.sparkSession.read.schema(schema + ", round int").parquet(folder).filter(F.col("state_b") == GONE)
    return None if rounds == 1 and dropped.isEmpty() else dropped.select(*keys, "id_b")


OPEN, KEPT, GONE = 0, 1, 2
BLOCK_EDGES = 1_000_000


def _settle(names: Sequence[str]):
    """Settle the nodes of whole blocks; an edge comes back with the states of its ends.

    The blocks of a batch are solved side by side. A node of another block keeps the state it came with.
    """

    def run(cols: Columns, group: np.ndarray) -> Columns:
        n, foreign = len(group), cols["blk_a"] != cols["blk_b"]
        # the same id in two groups is two nodes
        code, known = pd.factorize(np.concatenate([cols["id_b"], cols["id_a"]]))
        ids, node = np.unique(np.concatenate([group, group]) * len(known) + code, return_inverse=True)
        v, u = node[:n], node[n:]
        state = np.zeros(len(ids), np.int32)
        state[u[foreign]] = cols["state_a"][foreign]
        outer = np.zeros(len(ids), bool)
        outer[u[foreign]] = True
        live = np.arange(n)
        while True:
            live = live[(state[u[live]] != GONE) & (state[v[live]] == OPEN)]
            waits = np.zeros(len(ids), bool)
            waits[v[live]] = True
            free = (state == OPEN) & ~waits & ~outer
            if free.any():
                state[free] = KEPT
            hit = v[live][state[u[live]] == KEPT]
            if not len(hit):
                break
            state[hit] = GONE
        # open edges in full; of a settled node one row is enough
        ends = state[v]
        keep = (ends == OPEN) & (state[u] == OPEN)
        first = np.zeros(n, bool)
        first[np.unique(v, return_index=True)[1]] = True
        keep |= first & (ends != OPEN)
        return {**{c: cols[c][keep] for c in names}, "state_a": state[u][keep], "state_b": ends[keep]}

    return run
