"""Pixel payload operators: channels, tiles, resizing, preprocessing, flips, jitter, crops.

Images travel as ``image_id, height, width, channels, data BINARY`` with RGB bytes row by row. The
functions here treat one image or tile; Spark decides where each runs. Use small Arrow batches for
large images (``spark.sql.execution.arrow.maxBytesPerBatch`` bounds them in bytes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = "height int, width int, channels int, data binary"
OUT_BYTES = 16 << 20  # tiles are handed back to Spark in batches of about this size


def as_array(data: bytes, h: int, w: int, c: int = 3) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, c)


def to_rgb(a: np.ndarray) -> np.ndarray:
    """Grey, BGR or BGRA (as the image source delivers them) to RGB."""
    if a.shape[2] == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, 2::-1]


def to_byte(a: np.ndarray) -> np.ndarray:
    """Round half to even and saturate."""
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def per_image(images: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], key: str = "image_id") -> DataFrame:
    """Apply ``fn(array, row)`` to each image; a raising image becomes ``status`` error with its text
    and does not stop the query."""
    kind = dict(images.dtypes)[key]
    passed = [(n, t) for n, t in images.dtypes if n not in ("height", "width", "channels", "data", "status", "error")]

    def table(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[n for n, _ in passed] + ["height", "width", "channels", "data", "status", "error"])
        for n in ("height", "width", "channels"):
            out[n] = out[n].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for values in zip(*[pdf[n] for n in pdf.columns]):
                r = dict(zip(pdf.columns, values))
                base = {n: r[n] for n, _ in passed}
                try:
                    a = np.ascontiguousarray(fn(as_array(r["data"], r["height"], r["width"], r["channels"]), r))
                    rows.append({**base, "height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": a.tobytes(),
                                 "status": "success", "error": None})
                except Exception as e:  # isolation of single images is the purpose
                    rows.append({**base, "height": None, "width": None, "channels": None, "data": None, "status": "error", "error": str(e)})
                held += len(rows[-1]["data"] or b"")
                if held > OUT_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)

    schema = ", ".join(f"{n} {t}" for n, t in passed) + f", {PIXELS}, status string, error string"
    assert kind
    return images.mapInPandas(run, schema)


# --- tiles ---------------------------------------------------------------------------------

def axis_starts(size: int, patch: int, stride: int) -> list[int]:
    return list(range(0, size - patch + 1, stride))


def tile_origins(h: int, w: int, patch: int, overlap: int, edge: str) -> list[tuple[int, int, int]]:
    """(pass, row, col) as in the tile grid operator."""
    stride = patch - overlap
    rows, cols = axis_starts(h, patch, stride), axis_starts(w, patch, stride)
    if edge == "cover":
        rows = sorted({*rows, h - patch}) if h >= patch else []
        cols = sorted({*cols, w - patch}) if w >= patch else []
    out = [(0, r, c) for r in rows for c in cols]
    if edge == "reference":
        right, below = w % stride != 0 and w > patch, h % stride != 0 and h > patch
        out += [(1, r, w - patch) for r in rows if right] + [(2, h - patch, c) for c in cols if below]
        out += [(3, h - patch, w - patch)] if right and below else []
    return out


def extract_tiles(images: DataFrame, patch: int = 224, overlap: int = 32, edge: str = "cover", min_std: float = 1.0,
                  key: str = "image_id") -> DataFrame:
    """Tiles of each image with population std over all channels; tiles under ``min_std`` are left
    out and ``patch_id`` counts the others. Sparse background never leaves the task."""
    kind = dict(images.dtypes)[key]

    names = [key, "patch_id", "row", "col", "height", "width", "channels", "std", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = as_array(r.data, r.height, r.width, r.channels)
                n = 0
                for _, y, x in tile_origins(r.height, r.width, patch, overlap, edge):
                    t = np.ascontiguousarray(a[y:y + patch, x:x + patch])
                    std = float(t.std())
                    if std >= min_std:
                        rows.append((getattr(r, key), n, y, x, patch, patch, r.channels, std, t.tobytes()))
                        n += 1
                        held += t.nbytes
                if held > OUT_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return images.select(key, "height", "width", "channels", "data").mapInPandas(
        run, f"{key} {kind}, patch_id bigint, row bigint, col bigint, height int, width int, channels int, std double, data binary")


# --- resizing ------------------------------------------------------------

def area_weights(src: int, dst: int) -> np.ndarray:
    """Row i holds the share of each source cell in target cell i."""
    edge = np.arange(dst + 1) * (src / dst)
    lo, hi = edge[:-1, None], edge[1:, None]
    cell = np.arange(src)
    part = np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None)
    return part / part.sum(axis=1, keepdims=True)


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box-filter resize; exact means for whole ratios."""
    rows, cols = area_weights(a.shape[0], h), area_weights(a.shape[1], w)
    return to_byte(np.einsum("ir,rcb,jc->ijb", rows, a.astype(np.float64), cols, optimize=True))


def resize_images(images: DataFrame, h: int, w: int, key: str = "image_id") -> DataFrame:
    return per_image(images, lambda a, _: area_resize(a, h, w), key)


def windows_to_patches(images: DataFrame, window: int = 384, stride: int = 192, size: int = 224, key: str = "image_id") -> DataFrame:
    """Sliding windows resized to one patch size, for ensembles of window scores."""
    return resize_images(extract_tiles(images, window, window - stride, "none", 0.0, key), size, size, key)


def augment(a: np.ndarray, hflip: bool, vflip: bool, turns: int) -> np.ndarray:
    a = a[:, ::-1] if hflip else a
    a = a[::-1] if vflip else a
    return np.rot90(a, turns)


def augment_images(images: DataFrame, plan: DataFrame, key: str = "image_id") -> DataFrame:
    """Bytes turned by the same plan as the masks."""
    return per_image(images.join(plan, key), lambda a, r: augment(a, r["hflip"], r["vflip"], int(r["turns"])), key).drop("hflip", "vflip", "turns")


def jitter_images(images: DataFrame, seed: int, brightness: float = 0.2, contrast: float = 0.2, key: str = "image_id") -> DataFrame:
    """Contrast factor and brightness shift per image from a hash of (seed, key)."""
    from runmosaic.operators.sampling import draw, uniform
    u = lambda tag: uniform(F.md5(F.concat(draw(seed, key), F.lit(tag)))) * 2 - 1
    drawn = images.withColumn("_a", 1 + u(":c") * contrast).withColumn("_s", u(":b") * brightness)
    return per_image(drawn, lambda a, r: to_byte(a * r["_a"] + 255 * r["_s"]), key).drop("_a", "_s")


def crop_images(images: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels of each padded box. Boxes go to their image, grouped by image before the join."""
    per = boxes.groupBy(key).agg(F.collect_list(F.struct("id", "x1", "y1", "x2", "y2")).alias("boxes"))  # components of one image
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for r in pdf.itertuples(index=False):
                a = as_array(r.data, r.height, r.width, r.channels)
                for b in r.boxes:
                    t = np.ascontiguousarray(a[b["y1"]:b["y2"], b["x1"]:b["x2"]])
                    rows.append((getattr(r, key), b["id"], t.shape[0], t.shape[1], t.shape[2], t.tobytes()))
                    held += t.nbytes
                if held > OUT_BYTES:
                    yield pd.DataFrame(rows, columns=[key, "id", "height", "width", "channels", "data"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[key, "id", "height", "width", "channels", "data"])

    return images.select(key, "height", "width", "channels", "data").join(per, key).mapInPandas(run, f"{key} {kind}, id int, {PIXELS}")


def byte_sums(images: DataFrame, key: str = "image_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sum and position-weighted sum of the bytes, to compare images without moving them."""
    kinds = dict(images.dtypes)
    cols = [key, *keep, "height", "width"]

    def sums(data: bytes) -> tuple[int, int]:
        a = np.frombuffer(data, np.uint8).astype(np.int64)
        return int(a.sum()), int((a * np.arange(len(a))).sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [sums(d) for d in pdf["data"]]  # one image at a time is widened
            yield pdf[cols].assign(total=[t for t, _ in both], weighted=[w for _, w in both])

    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", total bigint, weighted bigint"
    return images.select(*cols, "data").mapInPandas(run, schema)
