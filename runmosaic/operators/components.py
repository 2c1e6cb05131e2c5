"""Connected components of masks and the instance tables made from them.

Masks are merged first, so all later work per image is bounded by the image area. Labelling runs
in two steps: Spark sorts segments by (image, square block) and each task labels whole blocks with
array operations; labels that meet at a block border are then joined as a graph: the links inside a square
of ``BLOCK`` pixels are settled by the task that holds it, those that leave it in rounds of min-label exchange with a
reliable checkpoint each round. A component is named by ``root``, the
row-major index of its first pixel, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runmosaic.functions import expr as X
from runmosaic.operators import masks as M
from runmosaic.operators.graph import connected
from runmosaic.operators.grouped import Columns, batched_map
from runmosaic.operators.lines import Lines, least_reachable
from runmosaic.session import written

BLOCK = 2048


def _block_labeller(keys: Sequence[str], width: int | str, reach: int):
    """Labels of whole blocks side by side: ``root`` is the least pixel number of a component inside its block."""

    def run(cols: Columns, group: np.ndarray) -> Columns:
        col, r0, r1 = (cols[c].astype(np.int64) for c in ("col", "r0", "r1"))
        wide = cols[width].astype(np.int64) if isinstance(width, str) else width
        span = int(r1.max()) + 2
        at = (group * (int(col.max()) + 2) + col) * span
        nxt = at + span
        lo = np.searchsorted(at + r1, nxt + r0 + (1 - reach), "left")
        hi = np.searchsorted(at + r0, nxt + r1 - (1 - reach), "right")
        n = np.maximum(hi - lo, 0)
        u = np.repeat(np.arange(len(col)), n)
        v = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        lab = least_reachable(len(col), u, v)
        first = np.full(len(col), np.iinfo(np.int64).max)
        np.minimum.at(first, lab, r0 * wide + col)
        return {**{k: cols[k] for k in keys}, "col": col, "r0": r0, "r1": r1, "top": cols["top"], "bottom": cols["bottom"], "root": first[lab]}

    return run


def _square_labeller(keys: Sequence[str], width: int | str, reach: int, block: int, side: int):
    """Labels of whole squares of ``side`` pixels: those of their blocks first, then those that meet at the borders of blocks. Merged runs,
    cut at the borders of squares."""
    label = _block_labeller((), width, reach)
    sizes = [width] if isinstance(width, str) else []

    def run(cols: Columns, group: np.ndarray) -> Columns:
        lines = Lines(cols, group, 1, 1)
        at = lines.first
        g, col, r0 = lines.places(lines.runs[0])
        r1 = r0 + lines.runs[1] - lines.runs[0]
        top = cols["_br"][at][g] * side
        r0, r1 = np.maximum(r0, top), np.minimum(r1, top + side)
        # pieces of runs in the blocks of their square
        strip = r0 // block
        n = (r1 - 1) // block - strip + 1
        run_ = np.repeat(np.arange(len(g)), n)
        strip = np.arange(len(run_)) - np.repeat(np.cumsum(n) - n, n) + strip[run_]
        p0, p1 = np.maximum(r0[run_], strip * block), np.minimum(r1[run_], (strip + 1) * block)
        order = np.lexsort((p0, col[run_], strip, col[run_] // block, g[run_]))
        run_, strip, p0, p1 = run_[order], strip[order], p0[order], p1[order]
        pg, pc = g[run_], col[run_]
        fresh = np.ones(len(run_), bool)
        fresh[1:] = (pg[1:] != pg[:-1]) | (pc[1:] // block != pc[:-1] // block) | (strip[1:] != strip[:-1])
        piece = {**{k: cols[k][at][pg] for k in sizes}, "col": pc, "r0": p0, "r1": p1, "top": r0[run_], "bottom": r1[run_]}
        out = label(piece, np.cumsum(fresh) - 1)
        # a label is a pixel of its mask; labels that share a run, or whose runs meet at the border of two blocks, are one
        name = pg * (int(out["root"].max()) + 1) + out["root"]
        node, code = np.unique(name, return_inverse=True)
        of_run = np.empty(len(g), np.int64)
        of_run[run_] = code
        u, v = [code], [of_run[run_]]
        edge = np.flatnonzero((col + 1) % block == 0)
        whole = (g * lines.wide + col - lines.left) * lines.top
        begin, end = whole + r0, whole + r1
        lo = np.searchsorted(end, begin[edge] + lines.top + 1 - reach, "left")
        n = np.maximum(np.searchsorted(begin, end[edge] + lines.top - 1 + reach, "right") - lo, 0)
        u.append(of_run[np.repeat(edge, n)])
        v.append(of_run[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)])
        if block < side and reach:  # pieces of neighbouring columns that meet diagonally where two rows of blocks do
            ends = np.flatnonzero((r1 % block == 0) & (r1 < top + side))
            for d in (-1, 1):
                below = whole[ends] + d * lines.top + r1[ends]
                hit = np.minimum(np.searchsorted(begin, below), len(begin) - 1)
                met = begin[hit] == below
                u.append(of_run[ends[met]])
                v.append(of_run[hit[met]])
        lab = least_reachable(len(node), np.concatenate(u), np.concatenate(v))
        least = np.full(len(node), np.iinfo(np.int64).max)
        first = np.zeros(len(node), np.int64)
        first[code] = out["root"]
        np.minimum.at(least, lab, first)
        root = least[lab][of_run]
        return {**{k: cols[k][at][g] for k in keys}, "col": col, "r0": r0, "r1": r1, "root": root}

    return run


def _border_links(local: DataFrame, keys: Sequence[str], block: int, reach: int) -> DataFrame:
    """Pairs of labels ``u, v`` that meet at a border of square blocks; a pair may come several times."""
    a = local.filter(F.col("col") % block == block - 1).select(
        *keys, (F.col("col") + 1).alias("col"), F.expr(f"r0 div {block}").alias("_rb"), F.col("r0").alias("a0"), F.col("r1").alias("a1"), F.col("root").alias("u"))
    b = local.filter((F.col("col") % block == 0) & (F.col("col") > 0)).select(
        *keys, "col", F.expr(f"r0 div {block}").alias("_rb"), F.col("r0").alias("b0"), F.col("r1").alias("b1"), F.col("root").alias("v"))
    touch = (F.col("a0") + (1 - reach) <= F.col("b1")) & (F.col("b0") + (1 - reach) <= F.col("a1"))
    beside = a.join(b, [*keys, "col", "_rb"]).filter(touch).select(*keys, "u", "v")
    # a piece that ends at a row border and the pieces that begin there, straight below or diagonally
    over = local.filter(F.col("r1") % block == 0).select(*keys, F.col("r1").alias("_at"), F.col("root").alias("u"),
                                                         F.explode(F.array(*[F.col("col") + d for d in range(-reach, reach + 1)])).alias("col"))
    under = local.filter((F.col("r0") % block == 0) & (F.col("r0") > 0)).select(*keys, F.col("r0").alias("_at"), "col", F.col("root").alias("v"))
    below = over.join(under, [*keys, "_at", "col"]).select(*keys, "u", "v")
    return beside.unionByName(below).filter(F.col("u") != F.col("v"))


def _settle_links(keys: Sequence[str]):
    """``u, lab``: the smallest label that links of the same group reach from each label."""

    def run(cols: Columns, group: np.ndarray) -> Columns:
        n = len(group)
        labels = np.concatenate([cols["u"], cols["v"]])
        values, code = np.unique(labels, return_inverse=True)
        # the same label in two groups is two nodes; nodes are in order of group, then label
        nodes, first, at = np.unique(np.concatenate([group, group]) * len(values) + code, return_index=True, return_inverse=True)
        lab = least_reachable(len(nodes), at[:n], at[n:])
        own = labels[first]
        return {**{k: cols[k][first % n] for k in keys}, "u": own, "lab": own[lab]}

    return run


def _joined(links: DataFrame, keys: Sequence[str], width: int | str, square: int) -> DataFrame | None:
    """Smallest label reachable from each label (``u, lab``). Labels are pixel numbers, so each lies in one square."""
    at = lambda n: F.expr(f"named_struct('r', ({n} div {width}) div {square}, 'c', ({n} % {width}) div {square})")
    placed = written(links.withColumn("_a", at("u")).withColumn("_b", at("v")), "links")
    kinds = dict(placed.dtypes)
    inside = placed.filter("_a = _b").select(*keys, F.col("_a.r").alias("_r"), F.col("_a.c").alias("_c"), "u", "v")
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", u bigint, lab bigint"
    lab = written(batched_map(inside, [*keys, "_r", "_c"], [], _settle_links(keys), schema), "settled")
    outer = placed.filter("_a <> _b").select(*keys, "u", "v")
    if outer.isEmpty():
        return None if lab.isEmpty() else lab
    for n in "uv":
        here = lab.select(*keys, F.col("u").alias(n), "lab")
        outer = outer.join(here, [*keys, n], "left").select(*keys, F.coalesce("lab", n).alias(n), "v" if n == "u" else "u")
    far = connected(outer.filter("u <> v"), keys)
    if far is None:
        return lab
    # labels that only leave their square, and those that an inner label stands for
    known = lab.unionByName(far.select(*keys, "u", F.col("u").alias("lab"))).distinct()
    far = far.select(*keys, F.col("u").alias("lab"), F.col("lab").alias("_far"))
    return known.join(far, [*keys, "lab"], "left").select(*keys, "u", F.coalesce("_far", "lab").alias("lab")).groupBy(*keys, "u").agg(F.min("lab").alias("lab"))


def components(segments: DataFrame, width: int | str, connectivity: int = 8, keys: Sequence[str] = M.KEYS,
               block: int = BLOCK, square: int = BLOCK, place: Sequence[str] | None = None) -> DataFrame:
    """Merged segments with the ``root`` of their component; the same plan whatever the width.

    ``width`` is a number, or the name of a column among the keys. A task holds a few square blocks of ``block`` pixels,
    however large the scene, and the links inside a few of ``square`` pixels: taller segments are cut at block borders for labelling and come back whole.
    ``place`` names those of the keys by which rows of an image lie together already; without it columns of squares are dealt out.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    reach = 1 if connectivity == 8 else 0
    side = max(block, square // block * block)
    if place is None:
        place = list(keys) if isinstance(width, int) and width <= side else [*keys, "_bc"]
    copies = segments.select(*keys, F.expr(f"col div {side}").alias("_bc"), "col", "r0", "r1").groupBy(*keys, "_bc", "col", "r0").agg(F.max("r1").alias("r1"))
    # rows of one square, those of a long column in each square they reach; where they meet nobody knows yet
    rows = M.placed(copies, place).withColumn("_br", F.explode(F.expr(f"sequence(r0 div {side}, (r1 - 1) div {side})")))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", col bigint, r0 bigint, r1 bigint, root bigint"
    local = batched_map(rows, [*keys, "_bc", "_br"], [], _square_labeller(keys, width, reach, block, side), schema, by=place)
    if segments.filter(f"col >= {side} or r1 > {side}").isEmpty():
        return local  # every mask lies in one square: nothing is written
    local = written(local, "labels")
    lab = _joined(_border_links(local, keys, side, reach), keys, width, square)
    if lab is not None:
        local = local.join(lab.withColumnRenamed("u", "root"), [*keys, "root"], "left").withColumn("root", F.coalesce("lab", "root"))
    # columns cut at the borders of squares come back whole
    whole = local.filter(f"r0 % {side} <> 0 and r1 % {side} <> 0").select(*keys, "col", "r0", "r1", "root")
    cut = local.filter(f"r0 % {side} = 0 or r1 % {side} = 0").select(*keys, "root", "col", "r0", "r1")
    return whole.unionByName(M.join_touching(cut, [*keys, "root"]).select(*keys, "col", "r0", "r1", "root"))


def with_area(labelled: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Areas per component: ``root, area``, summed up in the tasks before they meet."""
    return labelled.groupBy(*keys, "root").agg(F.sum(F.col("r1") - F.col("r0")).alias("area"))


def limit_area(labelled: DataFrame, least: int | None = None, most: int | None = None, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Segments of components whose area lies in the limits. Only the roots to drop are joined."""
    area, out = F.col("area"), F.lit(False)
    if least is not None:
        out = out | (area < least)
    if most is not None:
        out = out | (area > most)
    labelled = written(labelled, "labelled")  # read for the areas and again for the rows
    return labelled.join(with_area(labelled, keys).filter(out).select(*keys, "root"), [*keys, "root"], "left_anti")


def remove_small(labelled: DataFrame, least: int = 10, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Segments of components with at least ``least`` pixels."""
    return limit_area(labelled, least, None, keys)


def instances(labelled: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """One row per component: id in scan order of first pixels, bbox, area, box centre, mass centre."""
    n = F.col("r1") - F.col("r0")
    t = labelled.groupBy(*keys, "root").agg(
        F.min("col").alias("x"), F.min("r0").alias("y"), F.max("col").alias("_x"), F.max("r1").alias("_y"),
        F.sum(n).alias("area"), F.sum(F.col("col") * n).alias("_sx"),
        F.sum(F.expr("(r0 + r1 - 1) * (r1 - r0) div 2")).alias("_sy"))
    w = Window.partitionBy(*keys).orderBy("root")  # components of one image
    t = t.withColumn("id", F.row_number().over(w)).withColumn("w", F.col("_x") - F.col("x") + 1).withColumn("h", F.col("_y") - F.col("y"))
    return t.select(*keys, "id", "root", "x", "y", "w", "h", "area",
                    F.expr("x + w div 2").alias("centre_x"), F.expr("y + h div 2").alias("centre_y"),
                    (F.col("_sx") / F.col("area")).alias("mass_x"), (F.col("_sy") / F.col("area")).alias("mass_y"))


def crop_boxes(inst: DataFrame, padding: int, height: int, width: int, keys: Sequence[str] = M.KEYS) -> DataFrame:
    box = inst.select(*keys, "id", "area", "centre_x", "centre_y", F.struct(*X.xywh_to_xyxy("x", "y", "w", "h")).alias("b"))
    pad = F.struct(*X.pad_box("b.x1", "b.y1", "b.x2", "b.y2", padding, height, width))
    return box.select(*keys, "id", "area", "centre_x", "centre_y", pad.alias("p")).select(
        *keys, "id", "area", "centre_x", "centre_y", "p.x1", "p.y1", "p.x2", "p.y2")
