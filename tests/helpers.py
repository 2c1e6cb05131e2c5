"""Fixtures written without an imaging library and numpy counterparts used as brute force."""

import struct
import zlib

import numpy as np


def write_png(path, a):
    """a: uint8[h, w] grey, [h, w, 3] RGB or [h, w, 4] RGBA."""
    a = np.asarray(a, np.uint8)
    kind = {2: 0}.get(a.ndim) if a.ndim == 2 else {3: 2, 4: 6}[a.shape[2]]
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def segments_of(masks):
    """{image_id: bool[h, w]} -> (image_id, col, r0, r1) rows."""
    rows = []
    for k, m in masks.items():
        for c in range(m.shape[1]):
            edge = np.flatnonzero(np.diff(np.pad(m[:, c].astype(np.int8), 1)))
            rows += [(k, c, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return rows


SEGMENTS = "image_id bigint, col bigint, r0 bigint, r1 bigint"


def to_masks(df, h, w, keys):
    out = {k: np.zeros((h, w), bool) for k in keys}
    for r in df.select("image_id", "col", "r0", "r1").collect():
        out[r.image_id][r.r0:r.r1, r.col] = True
    return out


def random_masks(n, h, w, seed, share=0.35):
    g = np.random.default_rng(seed)
    return {i: g.random((h, w)) < share for i in range(n)}


def flood_labels(m, connectivity):
    """First-pixel index of each pixel's component, -1 outside."""
    h, w = m.shape
    lab = np.full((h, w), -1, np.int64)
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for r in range(h):
        for c in range(w):
            if m[r, c] and lab[r, c] < 0:
                lab[r, c], todo = r * w + c, [(r, c)]
                while todo:
                    y, x = todo.pop()
                    for dy, dx in near:
                        a, b = y + dy, x + dx
                        if 0 <= a < h and 0 <= b < w and m[a, b] and lab[a, b] < 0:
                            lab[a, b] = r * w + c
                            todo.append((a, b))
    return lab


def morph(m, kernel, grow):
    """Dilate (grow) or erode; pixels outside the image take no part."""
    h, w = m.shape
    out = np.zeros_like(m)
    for r in range(h):
        for c in range(w):
            v = [m[r + dr, c + dc] for dc, hh in kernel for dr in range(-hh, hh + 1) if 0 <= r + dr < h and 0 <= c + dc < w]
            out[r, c] = any(v) if grow else all(v)
    return out
