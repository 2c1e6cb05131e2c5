"""Mask algebra on interval rows.

Three table forms are used, all keyed by ``keys`` (default ``image_id``):

* runs      ``s, e``          0-based half-open, column-major over an image of height ``h``
* segments  ``col, r0, r1``   runs cut at column borders; the form most operators take
* words     ``col, wd, bits`` 64 rows of one column as a BIGINT bit set

Counting operators (area, overlap, tile labels) work on words: set union is a ``bit_or``
aggregate, so copies and overlaps collapse map-side and one hot image is spread over
(col, wd). Operators that return intervals first keep the longest segment per start
(again map-side) and then run a window over one column of one image, whose size is
bounded by the image height and not by the number of input rows.

Image sizes are numbers, or names of columns where images differ in size. Such columns are listed among
``keys``, so that every step carries them: ``keys=("image_id", "height", "width"), h="height"``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("image_id",)


def dim(size: int | str) -> Column:
    """A size given as a number, or as the name of a column that is among the keys."""
    return F.lit(size) if isinstance(size, int) else F.col(size)


def _c(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def rle_tokens(rle: str | Column) -> Column:
    """Integer tokens of an RLE text; NULL and blank give an empty array, a token that is no number gives NULL."""
    text = F.trim(F.coalesce(F.col(rle) if isinstance(rle, str) else rle, F.lit("")))
    return F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: t.try_cast("bigint"))


def decode(manifest: DataFrame, rle: str = "rle", keys: Sequence[str] = KEYS,
           pixels: int | Column | None = None) -> DataFrame:
    """RLE text -> runs. An unpaired last token and pairs that are no numbers are ignored, runs are clipped to ``pixels``."""
    df = manifest.select(*keys, rle_tokens(rle).alias("_t"))
    pairs = F.expr(
        "case when size(_t) >= 2 then transform(sequence(0, size(_t) div 2 - 1), "
        "i -> struct(get(_t, 2*i) - 1 as s, get(_t, 2*i) - 1 + get(_t, 2*i + 1) as e)) "
        "else cast(array() as array<struct<s:bigint,e:bigint>>) end")
    # the outer form: else the optimizer adds a filter on the array that parses each text once per token
    runs = df.select(*keys, F.inline_outer(pairs))
    runs = runs.filter("s is not null and e is not null")
    if pixels is not None:
        limit = F.lit(pixels) if isinstance(pixels, int) else pixels
        runs = runs.withColumn("e", F.least("e", limit))
    return runs.filter((F.col("s") >= 0) & (F.col("e") > F.col("s")))


def to_segments(runs: DataFrame, h: int | str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cut runs at column borders."""
    cut = runs.select(*keys, "s", "e", F.explode(F.expr(f"sequence(s div {h}, (e - 1) div {h})")).alias("col"))
    return cut.select(
        *keys, "col",
        (F.greatest("s", F.col("col") * dim(h)) - F.col("col") * dim(h)).alias("r0"),
        (F.least("e", (F.col("col") + 1) * dim(h)) - F.col("col") * dim(h)).alias("r1"))


def to_runs(segments: DataFrame, h: int | str, keys: Sequence[str] = KEYS) -> DataFrame:
    return segments.select(*keys, (F.col("col") * dim(h) + F.col("r0")).alias("s"),
                           (F.col("col") * dim(h) + F.col("r1")).alias("e"))


def to_pixels(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return segments.select(*keys, F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)).alias("row"), "col")


def bit_range(lo: str, hi: str) -> str:
    """SQL text for a BIGINT with bits [lo, hi) set, 0 <= lo < hi <= 64."""
    return f"(shiftleft(-1L, cast({lo} as int)) & shiftrightunsigned(-1L, cast(64 - ({hi}) as int)))"


def to_words(segments: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[str] = ()) -> DataFrame:
    """Segments -> bit words, not yet merged."""
    df = segments.select(*keys, *extra, "col", "r0", "r1",
                         F.explode(F.expr("sequence(r0 div 64, (r1 - 1) div 64)")).alias("wd"))
    lo, hi = "greatest(r0 - wd * 64, 0L)", "least(r1 - wd * 64, 64L)"
    return df.select(*keys, *extra, "col", "wd", F.expr(bit_range(lo, hi)).alias("bits"))


def union_words(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return to_words(segments, keys).groupBy(*keys, "col", "wd").agg(F.bit_or("bits").alias("bits"))


def by_shuffle(df: DataFrame) -> DataFrame:
    """Side of a join that unfolds from few narrow rows: its size cannot be told from its source, so it is never sent whole."""
    return df.hint("merge")


def placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out by ``keys``; no shuffle where they lie so already.

    The number of parts is stated: else adaptive execution joins parts again whose rows look small and unfold later.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def union(segments: DataFrame, keys: Sequence[str] = KEYS, few: bool = False, place: bool | Sequence[str] = False) -> DataFrame:
    """Merged, disjoint, non-touching segments per column.

    Copies collapse before the shuffle. With ``few`` (at most a handful of rows per merged segment, as
    a morphology step makes of merged input) rows are placed by ``keys`` at once: one shuffle, or none if they lie there.
    With ``place`` they are left there, without copies, so that what works on one image after it needs no further shuffle;
    ``place`` may name some of the keys to place by.
    """
    segments = placed(segments, keys) if few else segments
    longest = segments.groupBy(*keys, "col", "r0").agg(F.max("r1").alias("r1"))
    longest = placed(longest, keys if place is True else place) if place else longest
    w = Window.partitionBy(*keys, "col").orderBy("r0")
    reach = F.max("r1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("_new", F.when(reach >= F.col("r0"), 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (island.groupBy(*keys, "col", "_i")
            .agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).drop("_i"))


def sweep(events: DataFrame, sums: Sequence[str], keys: Sequence[str] = KEYS, few: bool = False) -> DataFrame:
    """Step functions along each column.

    ``events`` has ``col, pos`` and one delta per name in ``sums``. Deltas of one position are
    added before the shuffle for the window, so a window group holds at most h + 1 rows. ``few`` as in
    :func:`union`. Returns ``col, r0, r1`` and the running totals.
    """
    events = placed(events, keys) if few else events
    at = events.groupBy(*keys, "col", "pos").agg(*[F.sum(n).alias(n) for n in sums])
    w = Window.partitionBy(*keys, "col").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (at.select(*keys, "col", F.col("pos").alias("r0"), F.lead("pos").over(w).alias("r1"),
                      *[F.sum(n).over(run).alias(n) for n in sums])
            .filter(F.col("r1").isNotNull()))


def edges(segments: DataFrame, deltas: dict[str, Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """Start (+delta) and end (-delta) events of each segment."""
    ends = F.array(
        F.struct(F.col("r0").alias("pos"), *[v.alias(n) for n, v in deltas.items()]),
        F.struct(F.col("r1").alias("pos"), *[(-v).alias(n) for n, v in deltas.items()]))
    return segments.select(*keys, "col", F.inline(ends))


def join_touching(intervals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge disjoint intervals of a column that touch end to start."""
    w = Window.partitionBy(*keys, "col").orderBy("r0")
    prev = F.lag("r1").over(w)
    marked = intervals.select(*keys, "col", "r0", "r1",
                              F.when(prev >= F.col("r0"), 0).otherwise(1).alias("_new"))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (island.groupBy(*keys, "col", "_i")
            .agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).drop("_i"))


# name -> predicate over "inside a" and "inside b"
SET_OPERATIONS = {
    "union": lambda a, b: a | b,
    "intersect": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "xor": lambda a, b: a != b,
}


def combine(a: DataFrame, b: DataFrame, how: str, keys: Sequence[str] = KEYS, few: bool = False) -> DataFrame:
    """Set operation of two segment tables; inputs may overlap inside themselves. ``few`` as in :func:`union`."""
    one, zero = F.lit(1), F.lit(0)
    events = edges(a, {"na": one, "nb": zero}, keys).unionByName(edges(b, {"na": zero, "nb": one}, keys))
    state = sweep(events, ["na", "nb"], keys, few)
    keep = SET_OPERATIONS[how](F.col("na") > 0, F.col("nb") > 0)
    return join_touching(state.filter(keep), keys)


def intersect_all(segments: DataFrame, member: str, members: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels covered by every one of ``members`` masks told apart by column ``member``."""
    per = union(segments, (*keys, member), place=keys)
    state = sweep(edges(per, {"n": F.lit(1)}, keys), ["n"], keys, few=True)
    return join_touching(state.filter(F.col("n") == members), keys)


def vote(segments: DataFrame, member: str, members: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels covered by more than half of the masks."""
    per = union(segments, (*keys, member), place=keys)
    state = sweep(edges(per, {"n": F.lit(1)}, keys), ["n"], keys, few=True)
    return join_touching(state.filter(F.col("n") * 2 > members), keys)


def area(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of distinct pixels."""
    return union_words(segments, keys).groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("area"))


def pair_counts(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key: distinct pixels of prediction, truth and both."""
    src = (to_words(pred.withColumn("_p", F.lit(True)), keys, ["_p"])
           .unionByName(to_words(truth.withColumn("_p", F.lit(False)), keys, ["_p"])))
    both = src.groupBy(*keys, "col", "wd").agg(
        F.coalesce(F.bit_or(F.when(F.col("_p"), F.col("bits"))), F.lit(0)).alias("p"),
        F.coalesce(F.bit_or(F.when(~F.col("_p"), F.col("bits"))), F.lit(0)).alias("t"))
    return both.groupBy(*keys).agg(
        F.sum(F.bit_count("p")).cast("bigint").alias("n_pred"),
        F.sum(F.bit_count("t")).cast("bigint").alias("n_truth"),
        F.sum(F.bit_count(F.col("p").bitwiseAND(F.col("t")))).cast("bigint").alias("n_both"))


def encode(segments: DataFrame, h: int | str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments -> canonical RLE text, one row per key that has pixels.

    The list per key is collected after merging, so it is no longer than the text it becomes. Lists are walked once;
    only masks that reach both the first and the last row can hold runs that go on over a column border.
    """
    merged = union(segments, keys, place=True)
    s, e = F.col("col") * dim(h) + F.col("r0"), F.col("col") * dim(h) + F.col("r1")
    piece = lambda s, e: F.concat((s + 1).cast("string"), F.lit(" "), (e - s).cast("string"))
    packed = merged.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(s.alias("s"), e.alias("e"), piece(s, e).alias("piece")))).alias("_r"),
        (F.bool_or(F.col("r0") == 0) & F.bool_or(F.col("r1") >= dim(h))).alias("_wraps"))
    # a run that ends on a column border continues in the next column
    starts = F.expr("transform(filter(_r, (x, i) -> i = 0 or get(_r, i - 1).e < x.s), x -> x.s)")
    ends = F.expr("transform(filter(_r, (x, i) -> i = size(_r) - 1 or get(_r, i + 1).s > x.e), x -> x.e)")
    joined = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: piece(x["s"], x["e"]))
    return packed.select(*keys, F.when(F.col("_wraps"), F.array_join(joined, " ")).otherwise(F.array_join(F.col("_r.piece"), " ")).alias("rle"))


def crop(segments: DataFrame, tiles: DataFrame, keys: Sequence[str] = KEYS, cell: int = 64, rows: int = 512,
         carry: Sequence[str] = ()) -> DataFrame:
    """Part of each segment inside each tile (``row, col, height, width``), tile coordinates kept.

    Range join made an equi join on (key, column cell, row cell); a pair is taken in the cell where its
    part begins, so no pair is produced twice. ``carry`` names tile columns to keep.
    """
    left = segments.select(*keys, F.col("col").alias("c"), "r0", "r1", F.expr(f"col div {cell}").alias("_cell"),
                           F.explode(F.expr(f"sequence(r0 div {rows}, (r1 - 1) div {rows})")).alias("_rc"))
    right = tiles.select(*keys, F.col("row").alias("t_row"), F.col("col").alias("t_col"),
                         F.col("height").alias("t_h"), F.col("width").alias("t_w"), *carry)
    right = (right.withColumn("_cell", F.explode(F.expr(f"sequence(t_col div {cell}, (t_col + t_w - 1) div {cell})")))
             .withColumn("_rc", F.explode(F.expr(f"sequence(t_row div {rows}, (t_row + t_h - 1) div {rows})"))))
    hit = left.join(by_shuffle(right), [*keys, "_cell", "_rc"]).filter(
        (F.col("c") >= F.col("t_col")) & (F.col("c") < F.col("t_col") + F.col("t_w"))
        & (F.col("r0") < F.col("t_row") + F.col("t_h")) & (F.col("r1") > F.col("t_row"))
        & F.expr(f"greatest(r0, t_row) div {rows} = _rc"))
    return hit.select(
        *keys, F.col("t_row").alias("tile_row"), F.col("t_col").alias("tile_col"),
        (F.col("c") - F.col("t_col")).alias("col"),
        (F.greatest("r0", "t_row") - F.col("t_row")).alias("r0"),
        (F.least(F.col("r1"), F.col("t_row") + F.col("t_h")) - F.col("t_row")).alias("r1"), *carry)


def bbox(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bounding box as x, y, w, h."""
    box = segments.groupBy(*keys).agg(
        F.min("col").alias("x"), F.min("r0").alias("y"), F.max("col").alias("_x"), F.max("r1").alias("_y"))
    return box.select(*keys, "x", "y", (F.col("_x") - F.col("x") + 1).alias("w"),
                      (F.col("_y") - F.col("y")).alias("h"))


def resize_nearest(segments: DataFrame, src: tuple[int, int], dst: tuple[int, int],
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Nearest-neighbour resize (h, w) -> (h, w) where target i reads source floor(i*src/dst).

    The targets of a source interval are again an interval, so no coordinate table is joined.
    """
    (sh, sw), (dh, dw) = src, dst
    up = lambda x, a, b: f"(({x}) * {a} + {b} - 1) div {b}"
    df = segments.select(
        *keys,
        F.expr(up("col", dw, sw)).alias("_c0"), F.expr(up("col + 1", dw, sw)).alias("_c1"),
        F.expr(up("r0", dh, sh)).alias("r0"), F.expr(up("r1", dh, sh)).alias("r1"))
    df = df.filter((F.col("_c1") > F.col("_c0")) & (F.col("r1") > F.col("r0")))
    wide = df.select(*keys, F.explode(F.expr("sequence(_c0, _c1 - 1)")).alias("col"), "r0", "r1")
    return union(wide, keys)


def stack(*tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of several mask tables into one mask per key."""
    out = tables[0].select(*keys, "col", "r0", "r1")
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, "col", "r0", "r1"))
    return union(out, keys)


def load_mask(images: DataFrame, from_file: DataFrame, from_rle: DataFrame,
              keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Mask of each image by precedence file, then RLE, then nothing.

    ``from_file`` and ``from_rle`` are segment tables. Returns (origin per image, segments).
    """
    files = from_file.select(*keys).distinct().withColumn("_f", F.lit(True))
    rles = from_rle.select(*keys).distinct().withColumn("_r", F.lit(True))
    origin = (images.select(*keys).join(files, list(keys), "left").join(rles, list(keys), "left")
              .select(*keys, F.when(F.col("_f"), "file").when(F.col("_r"), "rle").otherwise("none").alias("origin")))
    rest = from_rle.join(files.select(*keys), list(keys), "left_anti")
    segs = from_file.select(*keys, "col", "r0", "r1").unionByName(rest.select(*keys, "col", "r0", "r1"))
    return origin, union(segs.join(images.select(*keys), list(keys), "left_semi"), keys)


def alignment_report(images: DataFrame, masks: DataFrame, runs: DataFrame,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Images whose size differs from their mask's, or whose runs pass the last pixel."""
    last = runs.groupBy(*keys).agg(F.max("e").alias("max_end"))
    df = (images.select(*keys, "height", "width")
          .join(masks.select(*keys, F.col("height").alias("mask_height"), F.col("width").alias("mask_width")),
                list(keys))
          .join(last, list(keys), "left"))
    size = (F.col("height") != F.col("mask_height")) | (F.col("width") != F.col("mask_width"))
    over = F.coalesce(F.col("max_end") > F.col("height") * F.col("width"), F.lit(False))
    return df.withColumn("size_mismatch", size).withColumn("runs_outside", over).filter(size | over)


def rle_issues(manifest: DataFrame, pixels: int, rle: str = "rle", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (manifest row, problem): not_a_number, odd_tokens, not_positive, unsorted, overlap, out_of_range."""
    df = manifest.select(*keys, F.col(rle).alias("rle"), rle_tokens(rle).alias("_t")).withColumn("_r", F.expr(
        "case when size(_t) >= 2 then transform(sequence(0, size(_t) div 2 - 1), "
        "i -> struct(get(_t, 2*i) - 1 as s, get(_t, 2*i) - 1 + get(_t, 2*i + 1) as e)) "
        "else cast(array() as array<struct<s:bigint,e:bigint>>) end")).withColumn(
        "_o", F.array_sort("_r")).filter(F.expr("rle is null or trim(rle) <> '0'"))
    found = F.expr(f"""filter(array(
        case when exists(_t, x -> x is null) then 'not_a_number' end,
        case when size(_t) % 2 = 1 then 'odd_tokens' end,
        case when exists(_r, x -> x.s < 0 or x.e <= x.s) then 'not_positive' end,
        case when exists(transform(_r, (x, i) -> i > 0 and get(_r, i - 1).s > x.s), b -> b) then 'unsorted' end,
        case when exists(transform(_o, (x, i) -> i > 0 and get(_o, i - 1).e > x.s), b -> b)
             then 'overlap' end,
        case when exists(_r, x -> x.e > {pixels}) then 'out_of_range' end), x -> x is not null)""")
    return df.select(*keys, F.explode(found).alias("issue"))
