"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runmosaic.llm.common import WORD, small, whole_row, written

BUCKET_BITS = 12
HASH_BITS = 40
PATTERNS = 100_000
BROADCAST_ROWS = 1_000_000


def water_fill(total: float, weights: Sequence[float], most: Sequence[float]) -> list[float]:
    """Shares of ``total`` by weight; what is above a limit is shared again among the others."""
    out, open_, left = [0.0] * len(weights), set(range(len(weights))), float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most[i])
            open_.remove(i)
        left -= sum(most[i] for i in over)
    return out


def min_cost_flow(tokens: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Tokens each pattern sends to each of its sources, filling quotas at the least cost of repetition.

    The k-th use of a pattern's tokens costs k - 1 a token, so repetition is convex and no pattern is
    repeated while another could still be used once. Cheapest augmenting paths; nodes are patterns and
    sources, never documents.
    """
    n, s = len(tokens), len(quotas)
    start, end = n + s, n + s + 1
    head: list[list[int]] = [[] for _ in range(n + s + 2)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, u in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(u)
        return len(to) - 2

    for p in range(n):
        for k in range(repeats):
            arc(start, p, tokens[p], k)
    use = [{m: arc(p, n + m, repeats * tokens[p], 0) for m in set(members[p])} for p in range(n)]
    for m in range(s):
        arc(n + m, end, quotas[m], 0)
    while True:
        far, via, queue, waits = {start: 0}, {}, deque([start]), {start}
        while queue:
            x = queue.popleft()
            waits.discard(x)
            for i in head[x]:
                if cap[i] and far[x] + cost[i] < far.get(to[i], 1 << 60):
                    far[to[i]], via[to[i]] = far[x] + cost[i], i
                    if to[i] not in waits:
                        waits.add(to[i])
                        queue.append(to[i])
        if end not in far:
            return [{m: cap[i ^ 1] for m, i in u.items() if cap[i ^ 1]} for u in use]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        step = min(cap[i] for i in path)
        for i in path:
            cap[i] -= step
            cap[i ^ 1] += step


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weights(sources: Sequence[str | None], cycle: Sequence[float] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights given in turn to the sources by code point, null last."""
    order = sorted(sources, key=lambda x: (x is None, x or ""))
    return {x: cycle[i % len(cycle)] for i, x in enumerate(order)}


def mix(docs: DataFrame, sources: Column, weigh: Callable[[Sequence], dict] = cycled_weights, share: float = 1.5, repeats: int = 2,
        seed: int = 17, size: Column | None = None, near: float = 0.005) -> DataFrame:
    """``row, sources, size, source_size, target, copies`` for every document.

    ``sources`` is the array of sources a document belongs to. Patterns (sets of sources) are summed up
    first; the flow decides how many words each gives. A pattern's documents then get as many whole copies
    as fit, and a seeded subset gets one more: those whose hash falls before a cut. The cut lies in one of
    4096 hash buckets and is settled by a running sum inside that bucket alone. What the document at the
    cut would overshoot is filled from the smaller ones left, in the same way, until a source lacks at most
    ``near`` of its target or nothing more fits. Only whole documents are taken, so a source may miss its target by less than
    its smallest document left.

    ``source_size`` and ``target`` are those of the document's first source in order (its only one, for
    single membership). The number of patterns must not pass ``PATTERNS``; they are the flow's nodes.
    Null text counts 0 words. A document without sources takes no part. Rows that repeat are taken one
    by one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_size = word_count(F.col("text")) if size is None else size
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << HASH_BITS))
    base = docs.select(whole_row(docs).alias("row"), F.array_sort(F.array_distinct(sources)).alias("sources"), text_size.alias("size"), draw.alias("u"),
                       F.monotonically_increasing_id().alias("loc"))
    base = base.select("*", F.to_json("sources", {"ignoreNullFields": "false"}).alias("pattern"), F.shiftright("u", HASH_BITS - BUCKET_BITS).alias("bucket"))
    table = written(base, "mix-rows")
    per = written(table.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"), F.first("sources").alias("sources")), "mix-buckets")
    found = per.groupBy("pattern").agg(F.sum("n").alias("n"), F.first("sources").alias("sources")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")

    sizes: dict = {}
    for p in found:
        for x in p.sources or []:
            sizes[x] = sizes.get(x, 0) + p.n
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weights = weigh(names)
    targets = dict(zip(names, water_fill(share * sum(p.n for p in found if p.sources), [weights[x] for x in names], [repeats * sizes[x] for x in names])))
    at = {x: i for i, x in enumerate(names)}
    flow = min_cost_flow([p.n for p in found], [[at[x] for x in p.sources or []] for p in found], [round(targets[x]) for x in names], repeats)
    plan = []
    for p, f in zip(found, flow):
        whole, rest = divmod(sum(f.values()), p.n) if p.n else (0, 0)
        x = min(p.sources, key=lambda v: at[v]) if p.sources else None
        plan.append((p.pattern, whole, rest, sizes[x] if p.sources else 0, targets[x] if p.sources else 0.0))
    plan = spark.createDataFrame(plan, "pattern string, whole bigint, rest bigint, source_size bigint, target double")

    free, lacks, extra, known = table.select("loc", "pattern", "size", "u", "bucket"), plan.select("pattern", F.col("rest").alias("lack")), [], plan
    most = 1 << BUCKET_BITS
    goal = F.broadcast(plan.select("pattern", "target"))
    while True:
        k = len(extra)
        fits = free.join(F.broadcast(lacks), "pattern").filter("size > 0 and size <= lack")
        per = written(fits.groupBy("pattern", "bucket", "lack").agg(F.sum("size").alias("n")), "mix-buckets")
        upto = F.sum("n").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        at_cut = per.select("*", upto.alias("upto")).filter("upto > lack and upto - n <= lack").select("pattern", F.col("bucket").alias("cut"), (F.col("upto") - F.col("n")).alias("before"))
        all_fit = per.groupBy("pattern").agg(F.sum("n").alias("total"))
        before = F.coalesce("before", "total", F.lit(0))
        cuts = written(lacks.join(at_cut, "pattern", "left").join(all_fit, "pattern", "left").select(
            "pattern", "lack", F.coalesce("cut", F.lit(most)).alias("cut"), (F.col("lack") - before).alias("room")), "mix-cuts")
        running = F.sum("size").over(W.partitionBy("pattern").orderBy("u", "loc").rowsBetween(W.unboundedPreceding, 0))
        edge = fits.drop("lack").join(F.broadcast(cuts), "pattern").filter("bucket = cut").select("pattern", "loc", "size", "room", running.alias("upto"))
        extra.append(written(edge.filter("upto <= room").select("pattern", "loc", "size"), "mix-extra"))
        taken = F.col("size").between(1, F.col("lack")) & (F.col("bucket") < F.col("cut"))
        free = free.join(F.broadcast(cuts), "pattern").filter(~taken).drop("lack", "cut", "room").join(small(extra[-1].select("loc"), BROADCAST_ROWS), "loc", "left_anti")
        lacks = written(cuts.join(extra[-1].groupBy("pattern").agg(F.sum("size").alias("got")), "pattern", "left").select(
            "pattern", (F.col("room") - F.coalesce("got", F.lit(0))).alias("lack"), F.col("lack").alias("was")), "mix-lacks")
        known = known.join(cuts.select("pattern", F.col("lack").alias(f"lack{k}"), F.col("cut").alias(f"cut{k}")), "pattern")
        if lacks.join(goal, "pattern").filter((F.col("lack") < F.col("was")) & (F.col("lack") > near * F.col("target"))).isEmpty():
            break
        lacks = lacks.drop("was")
    picked = reduce(DataFrame.union, [x.select("loc") for x in extra])
    picked = small(written(picked.select("loc", F.lit(1).alias("picked")), "mix-picked"), BROADCAST_ROWS)
    out = table.join(F.broadcast(known), "pattern").join(picked, "loc", "left")
    more = reduce(lambda c, k: c | (F.col("size").between(1, F.col(f"lack{k}")) & (F.col("bucket") < F.col(f"cut{k}"))), range(len(extra)), F.col("picked").isNotNull())
    return out.select("row", "sources", "size", "source_size", "target", (F.col("whole") + more.cast("bigint")).alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` with each document in its one source."""
    used = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix(used, F.array(F.col("source").cast("string")), size=F.col("size"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, columns as they were; a document taken twice is there twice.

    A document without words has nothing to count against a target and goes with its source's whole copies.
    """
    out = mix(docs, F.array(F.col("source").cast("string"))).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
