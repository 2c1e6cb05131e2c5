"""Tile grids, tile labels, overlaps, coverage and seams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runmosaic.operators import masks as M
from runmosaic.operators.grouped import Columns, batched_map, merged_runs

EDGES = ("none", "reference", "cover")


def _starts(size: str, patch: int, stride: int, edge: str = "none") -> str:
    """SQL array of the different start positions along an axis of length ``size``."""
    base = f"sequence(0L, cast({size} as bigint) - {patch}, {stride}L)"
    if edge != "none":
        more = f"array_distinct(array_append({base}, cast({size} as bigint) - {patch}))"
        base = more if edge == "cover" else f"if({size} % {stride} <> 0 and {size} > {patch}, {more}, {base})"
    return f"case when {size} >= {patch} then {base} else cast(array() as array<bigint>) end"


def grid(images: DataFrame, patch: int = 224, overlap: int = 32, edge: str = "cover",
         keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Tile table ``row, col, height, width, pass`` for images with ``height, width``.

    ``none`` drops the last partial stride. ``cover`` adds a tile flush with the far border and
    leaves no pixel out. ``reference`` adds border tiles when the image size is not a multiple
    of the stride, which can repeat a tile or leave a strip uncovered.
    """
    stride = patch - overlap
    src = images.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w"))

    axis = lambda size: _starts(size, patch, stride, "cover" if edge == "cover" else "none")
    passes = [(0, axis("_h"), axis("_w"), "true")]
    if edge == "reference":
        far = lambda size: f"array(cast({size} as bigint) - {patch})"
        right = f"_w % {stride} <> 0 and _w > {patch}"
        below = f"_h % {stride} <> 0 and _h > {patch}"
        passes += [(1, axis("_h"), far("_w"), right), (2, far("_h"), axis("_w"), below), (3, far("_h"), far("_w"), f"({right}) and ({below})")]
    # images are read once for all passes, and their tiles stay where the images lie
    listed = ", ".join(f"if({cond}, struct({n} as pass, {rows} as _rows, {cols} as _cols), null)" for n, rows, cols, cond in passes)
    return (src.select(*keys, F.expr(f"inline(array_compact(array({listed})))")).select(*keys, "pass", "_cols", F.explode("_rows").alias("row"))
            .select(*keys, "row", F.explode("_cols").alias("col"), F.lit(patch).cast("bigint").alias("height"),
                    F.lit(patch).cast("bigint").alias("width"), "pass"))


@dataclass(frozen=True)
class Grid:
    """A complete regular grid in closed form, as :func:`grid` lays it with edge ``none`` or ``cover``.

    Sizes are numbers, or names of columns among the keys. Methods give SQL text for one axis, ``v`` a position.
    """

    patch: int
    overlap: int
    height: int | str
    width: int | str
    edge: str = "none"

    def __post_init__(self):
        if self.edge not in ("none", "cover") or not 0 <= self.overlap < self.patch:
            raise ValueError("a closed form exists for the edges none and cover")

    def _regular(self, v: str, size: int | str) -> tuple[str, str]:
        """Numbers of the first and last tile over a position, without the one flush with the far border."""
        p, s = self.patch, self.patch - self.overlap
        return f"greatest(0L, ({v} - {p - s}) div {s})", f"least(({v}) div {s}, ({size} - {p}) div {s})"

    def _flush(self, v: str, size: int | str) -> str:
        return f"({self.edge == 'cover'} and ({size} - {self.patch}) % {self.patch - self.overlap} <> 0 and {v} >= {size} - {self.patch})".lower()

    def count(self, v: str, size: int | str) -> str:
        """Number of tiles over a position."""
        lo, hi = self._regular(v, size)
        return f"if({size} >= {self.patch}, greatest(0L, {hi} - {lo} + 1) + if({self._flush(v, size)}, 1L, 0L), 0L)"

    def over(self, v: str, size: int | str) -> str:
        """Starts of the tiles over a position."""
        lo, hi = self._regular(v, size)
        none = "cast(array() as array<bigint>)"
        regular = f"if({lo} <= {hi}, transform(sequence({lo}, {hi}), k -> k * {self.patch - self.overlap}L), {none})"
        flush = f"if({self._flush(v, size)}, array(cast({size} as bigint) - {self.patch}), {none})"
        return f"if({size} >= {self.patch}, concat({regular}, {flush}), {none})"

    def total(self, v: str, size: int | str, term) -> str:
        """Sum of ``term(v - start)`` over the tiles over a position, term by term, without arrays."""
        lo, hi = self._regular(v, size)
        p, s = self.patch, self.patch - self.overlap
        parts = [f"if({lo} + {j} <= {hi}, {term(f'({v} - ({lo} + {j}) * {s})')}, 0.0d)" for j in range(-(-p // s))]
        if self.edge == "cover":
            parts.append(f"if({self._flush(v, size)}, {term(f'({v} - ({size} - {p}))')}, 0.0d)")
        return f"({' + '.join(parts)})"

    def whole(self, a: str, b: str, size: int | str) -> str:
        """Whether no border of a tile lies strictly inside [a, b), by arithmetic alone."""
        p, s = self.patch, self.patch - self.overlap
        ends = f"({b} - 1 - {p} + {4 * p * s}) div {s} = ({a} - {p} + {4 * p * s}) div {s}"
        flush = "" if self.edge == "none" else f" and not ({size} - {p} > {a} and {size} - {p} < {b})"
        return f"(({b} - 1) div {s} = ({a}) div {s} and {ends}{flush})"

    def cuts(self, a: str, b: str, size: int | str) -> str:
        """Positions strictly inside [a, b) where the tiles over a position may change, ascending."""
        p, s = self.patch, self.patch - self.overlap
        starts = f"transform(sequence(({a}) div {s}, ({b} - 1) div {s}), k -> k * {s}L)"
        ends = f"transform(sequence(greatest({a} - {p}, 0L) div {s}, greatest({b} - 1 - {p}, 0L) div {s}), k -> k * {s}L + {p})"
        return f"array_sort(array_distinct(filter(concat({starts}, {ends}, array(cast({size} as bigint) - {p})), x -> x > {a} and x < {b})))"


def over_grid(segments: DataFrame, grid: Grid, keys: Sequence[str] = M.KEYS, carry: Sequence[str] = ()) -> DataFrame:
    """Parts of segments in the tiles of a grid, in image coordinates, without a join: ``tile_row, tile_col, col, r0, r1``."""
    g = grid
    p, s = g.patch, g.patch - g.overlap
    lo, hi = g._regular("r0", g.height)[0], g._regular("r1 - 1", g.height)[1]
    none = "cast(array() as array<bigint>)"
    if g.edge == "none":  # numbers of tiles first: no arrays of positions
        axis = lambda lo, hi, size: F.expr(f"explode(if({size} >= {p} and {lo} <= {hi}, sequence({lo}, {hi}), {none}))")
        out = segments.select(*keys, *carry, "col", "r0", "r1", axis(*g._regular("col", g.width), g.width).alias("_tc"))
        out = out.select(*keys, *carry, "col", "r0", "r1", (F.col("_tc") * s).alias("tile_col"), axis(lo, hi, g.height).alias("_tr"))
        out = out.withColumn("tile_row", F.col("_tr") * s)
    else:
        rows = (f"if({g.height} >= {p}, concat(if({lo} <= {hi}, transform(sequence({lo}, {hi}), k -> k * {s}L), {none}), "
                f"if({g._flush('r1 - 1', g.height)}, array(cast({g.height} as bigint) - {p}), {none})), {none})")
        out = segments.select(*keys, *carry, "col", "r0", "r1", F.explode(F.expr(g.over("col", g.width))).alias("tile_col"))
        out = out.select(*keys, *carry, "col", "r0", "r1", "tile_col", F.explode(F.expr(rows)).alias("tile_row"))
    return (out.withColumn("r0", F.greatest("r0", "tile_row")).withColumn("r1", F.least(F.col("r1"), F.col("tile_row") + p))
            .filter("r1 > r0").select(*keys, *carry, "tile_row", "tile_col", "col", "r0", "r1"))


def number_tiles(tiles: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """0-based ``patch_id`` per image in pass, row, col order; apply after dropping tiles.

    The window group is one image's tile list, bounded by the grid and not by the data volume.
    """
    w = Window.partitionBy(*keys).orderBy("pass", "row", "col")
    return tiles.withColumn("patch_id", (F.row_number().over(w) - 1).cast("bigint"))


def tile_pixels(images: DataFrame, segments: DataFrame, patch: int, overlap: int, edge: str = "none",
                keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Distinct mask pixels per grid tile of images with ``height, width``, only tiles with pixels.

    The grid is regular, so the tiles over a word follow from its position and its image's size; tiles
    that several passes of the ``reference`` edge repeat are counted once.
    """
    stride = patch - overlap
    size = images.select(*keys, F.col("height").cast("bigint").alias("_h"), F.col("width").cast("bigint").alias("_w"))
    words = M.union_words(segments, keys).join(size, list(keys))
    rows, cols = _starts("_h", patch, stride, edge), _starts("_w", patch, stride, edge)
    over = words.select(
        *keys, "_h", "wd", "bits",
        F.explode_outer(F.expr(f"filter({cols}, t -> t <= col and t + {patch} > col)")).alias("tile_col")).filter("tile_col is not null")
    over = over.select(
        *keys, "wd", "bits", "tile_col",
        F.explode_outer(F.expr(f"filter({rows}, t -> t < wd * 64 + 64 and t + {patch} > wd * 64)")).alias("tile_row")).filter("tile_row is not null")
    inside = M.bit_range("greatest(tile_row - wd * 64, 0L)", f"least(tile_row + {patch} - wd * 64, 64L)")
    return (over.groupBy(*keys, "tile_row", "tile_col")
            .agg(F.sum(F.bit_count(F.expr(f"bits & {inside}"))).cast("bigint").alias("ship_pixels")))


def with_label(df: DataFrame, patch: int, positive_ratio: float = 0.01) -> DataFrame:
    """Ratio and label; a tile is positive strictly above the ratio."""
    total = patch * patch
    return (df.withColumn("ship_pixel_ratio", F.col("ship_pixels") / F.lit(float(total)))
            .withColumn("has_ship", (F.col("ship_pixels") > F.lit(total * positive_ratio)).cast("int")))


def label_grid(images: DataFrame, segments: DataFrame, patch: int = 224, overlap: int = 32,
               edge: str = "none", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """All different grid tiles of all images, each by its own ``height, width``, with mask pixels, ratio and label.

    Untouched tiles enter as zero rows and share the counting shuffle.
    """
    zero = grid(images, patch, overlap, edge, keys).select(
        *keys, "row", "col", F.lit(0).cast("bigint").alias("ship_pixels"))
    hit = tile_pixels(images, segments, patch, overlap, edge, keys).select(
        *keys, F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), "ship_pixels")
    both = zero.unionByName(hit).groupBy(*keys, "row", "col").agg(F.sum("ship_pixels").alias("ship_pixels"))
    return with_label(both, patch)


def label_tiles(tiles: DataFrame, segments: DataFrame, patch: int, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Label any tile table (for example after dropping uniform tiles). A tile that is there twice is counted once and labelled twice."""
    block = BLOCK
    down = lambda a, b: F.explode(F.expr(f"sequence(cast(floor({a} / {block}) as bigint), cast(floor(({b} - 1) / {block}) as bigint))"))
    # copies collapse before rows are placed; the other overlaps inside a column are settled in the block
    rows = segments.filter("r1 > r0").groupBy(*keys, "col", "r0").agg(F.max("r1").alias("r1")).select(
        *keys, F.lit(False).alias("tile"), F.col("col").cast("bigint").alias("c0"), (F.col("col") + 1).cast("bigint").alias("c1"), "r0", "r1")
    boxes = tiles.select(*keys, "row", "col", "height", "width").distinct().select(
        *keys, F.lit(True).alias("tile"), F.col("col").alias("c0"), (F.col("col") + F.col("width")).alias("c1"),
        F.col("row").alias("r0"), (F.col("row") + F.col("height")).alias("r1"))
    both = rows.withColumn("_bc", F.floor(F.col("c0") / block)).unionByName(boxes.filter("c1 > c0 and r1 > r0").withColumn("_bc", down("c0", "c1")))
    both = both.withColumn("_br", down("r0", "r1"))
    kinds = dict(tiles.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row bigint, col bigint, ship_pixels bigint"
    n = batched_map(both, [*keys, "_br", "_bc"], [], _covered(keys, block), schema, by=list(keys))
    # a tile has a part in each block it reaches into
    n = M.placed(n, keys).groupBy(*keys, "row", "col").agg(F.sum("ship_pixels").alias("ship_pixels"))
    joined = tiles.join(M.by_shuffle(n), [*keys, "row", "col"], "left").withColumn(
        "ship_pixels", F.coalesce("ship_pixels", F.lit(0)))
    return with_label(joined, patch)


BLOCK = 1024


def _covered(keys: Sequence[str], block: int):
    """Mask pixels in each tile of whole blocks; only tiles with pixels."""

    def run(cols: Columns, group: np.ndarray) -> Columns:
        is_tile = cols["tile"].astype(bool)
        edge = cols["_br"] * block
        r0, r1 = np.maximum(cols["r0"], edge) - edge, np.minimum(cols["r1"], edge + block) - edge
        c0 = np.maximum(cols["c0"], cols["_bc"] * block) - cols["_bc"] * block
        c1 = np.minimum(cols["c1"], cols["_bc"] * block + block) - cols["_bc"] * block
        at = group * (block + 1)
        run_, tile = np.flatnonzero(~is_tile), np.flatnonzero(is_tile)
        run_ = run_[np.lexsort((r0[run_], (at + c0)[run_]))]
        column = (at + c0)[run_]
        line = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(run_) else column
        first, ends = merged_runs(line, r0[run_], r1[run_])
        column, s0, s1 = column[first], r0[run_][first], ends
        lo, hi = np.searchsorted(column, (at + c0)[tile]), np.searchsorted(column, (at + c1)[tile])
        n = hi - lo
        pixels = np.zeros(len(tile), np.int64)
        # tiles in portions, so that the pairs at hand stay few
        past = np.cumsum(n)
        for a in _portions(past):
            k = np.repeat(np.arange(len(tile))[a], n[a])
            i = np.arange(len(k)) - np.repeat(np.cumsum(n[a]) - n[a], n[a]) + lo[k]
            met = np.minimum(s1[i], r1[tile][k]) - np.maximum(s0[i], r0[tile][k])
            pixels += np.bincount(k, np.maximum(met, 0), len(tile)).astype(np.int64)
        tile, pixels = tile[pixels > 0], pixels[pixels > 0]
        return {**{k: cols[k][tile] for k in keys}, "row": cols["r0"][tile], "col": cols["c0"][tile], "ship_pixels": pixels}

    return run


def _portions(past: np.ndarray, most: int = 1 << 20):
    """Slices of rows whose running totals ``past`` grow by about ``most`` in each."""
    total = int(past[-1]) if len(past) else 0
    ends = np.unique(np.concatenate([np.searchsorted(past, np.arange(most, total, most)), [len(past)]]))
    return [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()) if b > a]


def mask_path(has_ship: str = "has_ship", patch_path: str = "patch_path"):
    """Mask file next to the patch file; NULL for negatives."""
    return F.when(F.col(has_ship) == 1, F.replace(F.col(patch_path), F.lit(".tif"), F.lit("_mask.png")))


def patch_path(image: str, patch_id: str, folder: str):
    return F.concat(F.lit(folder + "/"), F.col(image).cast("string"), F.lit("_patch_"),
                    F.lpad(F.col(patch_id).cast("string"), 6, "0"), F.lit(".tif"))


def tile_bounds(tiles: DataFrame, affine: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Geographic bounds and the tile's own origin, for affine ``a..f`` per image."""
    df = tiles.join(affine, list(keys))
    col = lambda n: F.col(n)
    px = lambda x, y: col("a") * x + col("b") * y + col("c")
    py = lambda x, y: col("d") * x + col("e") * y + col("f")
    x0, y0 = col("col"), col("row")
    x1, y1 = col("col") + col("width"), col("row") + col("height")
    return df.select(
        *keys, "row", "col",
        F.least(px(x0, y0), px(x1, y1)).alias("minx"), F.least(py(x0, y0), py(x1, y1)).alias("miny"),
        F.greatest(px(x0, y0), px(x1, y1)).alias("maxx"), F.greatest(py(x0, y0), py(x1, y1)).alias("maxy"),
        px(x0, y0).alias("origin_x"), py(x0, y0).alias("origin_y"))


def overlapping_pairs(tiles: DataFrame, keys: Sequence[str] = M.KEYS, cell: int = 128) -> DataFrame:
    """Overlap rectangle of each pair of tiles of an image.

    Pairs meet in the grid cell holding the top-left corner of their overlap, so the join has an
    equi key and each pair appears once.
    """
    t = tiles.select(*keys, "row", "col", "height", "width")
    spread = t.withColumn("_cy", F.explode(F.expr(f"sequence(row div {cell}, (row + height - 1) div {cell})"))) \
              .withColumn("_cx", F.explode(F.expr(f"sequence(col div {cell}, (col + width - 1) div {cell})")))
    a = spread.select(*keys, "_cy", "_cx", *[F.col(n).alias(n + "_1") for n in ("row", "col", "height", "width")])
    b = spread.select(*keys, "_cy", "_cx", *[F.col(n).alias(n + "_2") for n in ("row", "col", "height", "width")])
    ends = {
        "row_start": F.greatest("row_1", "row_2"),
        "row_end": F.least(F.col("row_1") + F.col("height_1"), F.col("row_2") + F.col("height_2")),
        "col_start": F.greatest("col_1", "col_2"),
        "col_end": F.least(F.col("col_1") + F.col("width_1"), F.col("col_2") + F.col("width_2")),
    }
    first = (F.col("row_1") < F.col("row_2")) | ((F.col("row_1") == F.col("row_2")) & (F.col("col_1") < F.col("col_2")))
    home = (F.expr(f"greatest(row_1, row_2) div {cell}") == F.col("_cy")) & (
        F.expr(f"greatest(col_1, col_2) div {cell}") == F.col("_cx"))
    hit = a.join(M.by_shuffle(b), [*keys, "_cy", "_cx"]).filter(
        first & home & (ends["row_start"] < ends["row_end"]) & (ends["col_start"] < ends["col_end"]))
    return hit.select(*keys, "row_1", "col_1", "row_2", "col_2", *[v.alias(n) for n, v in ends.items()])


def in_square_blocks(rects: DataFrame, block: int) -> DataFrame:
    """Rectangles ``c0, c1, r0, r1`` cut at the borders of square blocks, with the block's ``_br, _bc``."""
    cut = (rects.withColumn("_br", F.explode(F.expr(f"sequence(r0 div {block}, (r1 - 1) div {block})")))
           .withColumn("_bc", F.explode(F.expr(f"sequence(c0 div {block}, (c1 - 1) div {block})"))))
    inside = {"r0": f"greatest(r0, _br * {block})", "r1": f"least(r1, _br * {block} + {block})",
              "c0": f"greatest(c0, _bc * {block})", "c1": f"least(c1, _bc * {block} + {block})"}
    return cut.withColumns({n: F.expr(e) for n, e in inside.items()})


def union_rectangles(rects: DataFrame, keys: Sequence[str] = M.KEYS, block: int = 1024) -> DataFrame:
    """Disjoint rectangles ``c0, c1, r0, r1`` with the same pixels as the given ones.

    Rectangles are cut at the borders of square blocks, and inside a block columns only where some
    rectangle begins or ends, so a tile of 224 columns stays a handful of rows and the list of cuts is
    that of one block.
    """
    rects = in_square_blocks(rects.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("c0", "c1", "r0", "r1")]).distinct(), block)
    kinds = dict(rects.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", c0 bigint, c1 bigint, r0 bigint, r1 bigint"
    return batched_map(rects, [*keys, "_br", "_bc"], [], _strips(keys), schema, by=list(keys))


def _strips(keys: Sequence[str]):
    """Rectangles of whole blocks cut at each other's left and right borders, and merged strip by strip."""

    def run(cols: Columns, group: np.ndarray) -> Columns:
        left, top = cols["c0"].min(initial=0), cols["r0"].min(initial=0)
        wide = int(cols["c1"].max(initial=0) - left) + 1
        a, b = group * wide + cols["c0"] - left, group * wide + cols["c1"] - left
        cuts = np.unique(np.concatenate([a, b]))
        lo = np.searchsorted(cuts, a)
        n = np.searchsorted(cuts, b) - lo
        rect = np.repeat(np.arange(len(n)), n)
        strip = np.arange(len(rect)) - np.repeat(np.cumsum(n) - n, n) + lo[rect]
        order = np.lexsort((cols["r0"][rect], strip))
        rect, strip = rect[order], strip[order]
        first, ends = merged_runs(strip, cols["r0"][rect] - top, cols["r1"][rect] - top)
        rect, strip = rect[first], strip[first]
        before = group[rect] * wide - left
        return {**{k: cols[k][rect] for k in keys}, "c0": cuts[strip] - before, "c1": cuts[strip + 1] - before, "r0": cols["r0"][rect], "r1": ends + top}

    return run


def coverage(images: DataFrame, tiles: DataFrame, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Covered and uncovered pixels per image."""
    rects = tiles.select(*keys, F.col("col").alias("c0"), (F.col("col") + F.col("width")).alias("c1"),
                         F.col("row").alias("r0"), (F.col("row") + F.col("height")).alias("r1"))
    covered = union_rectangles(rects, keys).groupBy(*keys).agg(F.expr("sum((c1 - c0) * (r1 - r0))").alias("area"))
    out = images.join(covered, list(keys), "left")
    n = F.coalesce(F.col("area"), F.lit(0))
    total = F.col("height").cast("bigint") * F.col("width")
    return out.select(*keys, n.alias("covered"), (total - n).alias("uncovered"), F.try_divide(n, total).alias("coverage"))


def seam_bands(tiles: DataFrame, h: int, w: int, half: int = 3, keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Disjoint rectangles within ``half`` pixels of an inner top or left tile border."""
    left = tiles.filter(F.col("col") > 0).select(
        *keys, F.col("row").alias("r0"), F.least(F.col("row") + F.col("height"), F.lit(h)).alias("r1"),
        F.greatest(F.col("col") - half, F.lit(0)).alias("c0"), F.least(F.col("col") + half, F.lit(w)).alias("c1"))
    top = tiles.filter(F.col("row") > 0).select(
        *keys, F.greatest(F.col("row") - half, F.lit(0)).alias("r0"), F.least(F.col("row") + half, F.lit(h)).alias("r1"),
        F.col("col").alias("c0"), F.least(F.col("col") + F.col("width"), F.lit(w)).alias("c1"))
    return union_rectangles(left.unionByName(top), keys)


def ensemble_scores(windows: DataFrame, score: str = "probability", keys: Sequence[str] = M.KEYS) -> DataFrame:
    """Image score from its window scores."""
    return windows.groupBy(*keys).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"),
                                      F.count(F.lit(1)).alias("windows"))
