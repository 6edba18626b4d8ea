"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales of a grey image; each gets a direction
(from the intensity centroid) and 256 brightness comparisons in a patch turned
that way.  An image's descriptors stay packed in one row.  The descriptors of
the query images go, block by block, into Hamming tables (one for each band of
bits); every image looks its own bands up there, and the full distance confirms
a match.  Matches of two images count if they agree on one similarity transform
(scale, turn and shift), found by voting with a check of every voter.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, settle, table

#: Four steps to half the size, so that a copy of any size between meets a scale of the original within a tenth.
SCALES = tuple(2.0 ** (-k / 4) for k in range(5))
#: Corners whose patches are held at once, and pairs of descriptors compared at once.
BLOCK, PAIRS_AT_ONCE = 4096, 1 << 20
#: Bits of a descriptor, bands (Hamming tables), bits of a band, and the greatest distance of a match.
BITS, BANDS, BAND_BITS, MAX_DISTANCE = 256, 16, 16, 40
MIN_INLIERS = 6
#: Query descriptors in the tables at once; a block holds at least one image.
QUERY_DESCRIPTORS = 1 << 17
#: A corner has the largest response within so many pixels either way.
APART = 3
#: A corner's response, as a share of its image's largest.
WEAKEST = 1e-3
_RADIUS, _TURNS = 12, 64
_DISC = np.array([(y, x) for y in range(-_RADIUS, _RADIUS + 1) for x in range(-_RADIUS, _RADIUS + 1) if x * x + y * y <= _RADIUS**2])
#: Comparisons that the descriptor's are chosen from, patches of noise they are chosen on, and the most two chosen ones may agree.
_CHOICES, _PATCHES, _AGREE = 2048, 4000, 0.25


@functools.cache
def _compared() -> np.ndarray:
    """The compared points (end, direction, bit, (y, x)).

    Of random pairs of points those are taken, in order of balance, that agree
    little with the ones before, on patches of smooth noise.
    """
    r = np.random.Generator(np.random.PCG64(11))
    pairs = r.normal(0, _RADIUS / 2.0, (2, _CHOICES, 2))
    pairs *= np.minimum(1.0, (_RADIUS - 0.5) / np.maximum(np.hypot(pairs[..., 0], pairs[..., 1]), 1e-9))[..., None]
    turned = np.stack([np.round(np.stack([math.sin(t) * pairs[..., 0] + math.cos(t) * pairs[..., 1], math.cos(t) * pairs[..., 0] - math.sin(t) * pairs[..., 1]], -1)).astype(np.int64) for t in 2 * np.pi * np.arange(_TURNS) / _TURNS], 1)
    side, bits = 256, []
    for cell in (3, 4, 6, 8):
        im = _around(resize(r.normal(0, 1, (side // cell, side // cell)).astype(np.float32), side, side), 1, np.add)
        ys, xs = (r.integers(_RADIUS + 1, side - _RADIUS - 1, _PATCHES // 4) for _ in range(2))
        bits.append(_bits(np.ascontiguousarray(im).ravel(), (ys * side + xs)[:, None], side, turned)[1])
    b = np.concatenate(bits).astype(np.float32) * 2 - 1
    order = np.argsort(np.abs(b.mean(0)), kind="stable")
    like = np.abs(b.T @ b) / len(b)
    most = _AGREE
    while True:
        chosen: list[int] = []
        free = np.ones(_CHOICES, bool)
        for k in order:
            if free[k] and len(chosen) < BITS:
                chosen.append(int(k))
                free &= like[k] < most
        if len(chosen) == BITS:
            return turned[:, :, chosen]
        most += 0.02


def _bits(flat: np.ndarray, at: np.ndarray, w: int, compared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction, outcomes of the comparisons) of the patches about the pixels ``at`` of an image ``w`` wide."""
    moments = flat[at + (_DISC[:, 0] * w + _DISC[:, 1])] @ _DISC.astype(np.float32)
    turn = np.round(np.arctan2(moments[:, 0], moments[:, 1]) * (_TURNS / (2 * np.pi))).astype(np.int64) % _TURNS
    ends = compared[..., 0] * w + compared[..., 1]
    return turn, flat[at + ends[0, turn]] < flat[at + ends[1, turn]]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a PGM (P5) or of a PNG of any kind; None for anything else or broken."""
    try:
        if data is None:
            return None
        if data[:2] == b"P5":
            parts, at = [], 2
            while len(parts) < 3:
                while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                    at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
                end = at
                while not data[end : end + 1].isspace():
                    end += 1
                parts.append(int(data[at:end]))
                at = end
            w, h, _ = parts
            return np.frombuffer(data, np.uint8, w * h, at + 1).reshape(h, w).astype(np.float32)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error, KeyError):
        pass
    return None


def _unfiltered(raw: np.ndarray, k: int) -> np.ndarray:
    """Bytes of a PNG's lines, each behind its filter's number; ``k`` bytes lie between a byte and its left neighbour."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.int32)
    for y in range(len(out)):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros(out.shape[1], np.int32)
        if kind == 2:
            line = (line + up) & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                a, b, c = (line[x - k] if x >= k else 0), up[x], (up[x - k] if x >= k else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                line[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else paeth)) & 255
        out[y] = line
    return out


#: First column and row, and steps, of an interlaced PNG's passes.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, b"", None, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] not in (1, 2, 4, 8, 16):
        return None
    w, h, depth, color = head[:4]
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stream, at = zlib.decompress(packed), 0
    grey = np.zeros((h, w), np.float32)
    for x0, y0, dx, dy in _PASSES if head[6] else ((0, 0, 1, 1),):
        pw, ph = len(range(x0, w, dx)), len(range(y0, h, dy))
        if not pw or not ph:
            continue
        size = (pw * k * depth + 7) // 8
        lines = _unfiltered(np.frombuffer(stream, np.uint8, ph * (1 + size), at).reshape(ph, 1 + size), max(1, k * depth // 8))
        at += ph * (1 + size)
        if depth == 16:
            lines = (lines[:, ::2] * 256 + lines[:, 1::2]) / 257
        elif depth < 8:
            bits = np.unpackbits(lines.astype(np.uint8), axis=1).reshape(ph, -1, depth)
            lines = (bits @ (1 << np.arange(depth)[::-1]))[:, : pw * k]
            if color != 3:
                lines = lines * (255 / ((1 << depth) - 1))
        pixels = lines.reshape(ph, pw, k)
        if color == 3:
            pixels = np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[..., 0]]
        pixels = pixels.astype(np.float32)
        grey[y0::dy, x0::dx] = pixels[..., 0] if color in (0, 4) else pixels[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)
    return grey


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.round(image), 0, 255).astype(np.uint8).tobytes()


def _steps(n: int, size: int) -> np.ndarray:
    """The matrix that takes ``size`` bilinear samples, at the centres of the new pixels, of ``n`` values."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), n - 1)
    out = np.zeros((size, n), np.float32)
    out[np.arange(size), low] += 1 - (at - low)
    out[np.arange(size), np.minimum(low + 1, n - 1)] += at - low
    return out


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear samples at the centres of the new pixels."""
    y = np.clip((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * image.shape[1] / w - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), image.shape[0] - 1), np.minimum(x.astype(int), image.shape[1] - 1)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None, :]
    rows = image[y0] * (1 - fy) + image[np.minimum(y0 + 1, image.shape[0] - 1)] * fy
    return rows[:, x0] * (1 - fx) + rows[:, np.minimum(x0 + 1, image.shape[1] - 1)] * fx


def _wider(a: np.ndarray, r: int) -> np.ndarray:
    """``a`` with its first and last row repeated ``r`` times more."""
    out = np.empty((len(a) + 2 * r, a.shape[1]), a.dtype)
    out[r : r + len(a)] = a
    out[:r], out[r + len(a) :] = a[0], a[-1]
    return out


def _around(a: np.ndarray, r: int, f: np.ufunc) -> np.ndarray:
    """``f`` over the square of side 2 r + 1 about each pixel, rows first; the border's pixels are repeated."""
    for _ in range(2):
        n, p = len(a), _wider(a, r)
        a = f(p[:n], p[1 : n + 1])
        for k in range(2, 2 * r + 1):
            f(a, p[k : k + n], out=a)
        a = np.ascontiguousarray(a.T)
    return a


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, zoom, direction) of each corner in the image's own pixels, and its 256 bits as four 64-bit numbers."""
    points, bits = [], []
    m = _RADIUS + 1
    for scale in SCALES:
        h, w = round(image.shape[0] * scale), round(image.shape[1] * scale)
        if min(h, w) < 2 * _RADIUS + 6:
            continue
        im = _around((image if scale == 1.0 else resize(image, h, w)).astype(np.float32), 1, np.add) / 9
        p, q = _wider(im, 1), _wider(im.T, 1).T
        gy, gx = p[2:] - p[:-2], q[:, 2:] - q[:, :-2]
        a, b, c = _around(gx * gx, 2, np.add), _around(gy * gy, 2, np.add), _around(gx * gy, 2, np.add)
        corner = a * b - c * c - np.float32(0.05) * (a + b) ** 2
        peak = (corner >= _around(corner, APART, np.maximum)) & (corner > WEAKEST * max(float(corner.max()), 1e-9))
        all_ys, all_xs = np.nonzero(peak[m : h - m, m : w - m])
        flat = np.ascontiguousarray(im).ravel()
        for i in range(0, len(all_ys), BLOCK):
            ys, xs = all_ys[i : i + BLOCK] + m, all_xs[i : i + BLOCK] + m
            turn, test = _bits(flat, (ys * w + xs)[:, None], w, _compared())
            bits.append(np.packbits(test, axis=1).view(np.uint64))
            points.append(np.stack([(xs + 0.5) / scale, (ys + 0.5) / scale, np.full(len(xs), 1 / scale), turn * (2 * np.pi / _TURNS)], axis=1).astype(np.float32))
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 64), np.uint64)
    return np.concatenate(points), np.concatenate(bits)


class Tables:
    """The Hamming tables of packed descriptors: for each band, descriptors in the order of its values and where each value begins."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.words = [np.ascontiguousarray(bits[:, k]) for k in range(BITS // 64)]
        values = np.ascontiguousarray(bits).view(np.uint16).reshape(-1, BANDS)
        self.order = np.concatenate([np.argsort(values[:, b], kind="stable").astype(np.int32) for b in range(BANDS)])
        self.start = np.stack([np.concatenate([[0], np.cumsum(np.bincount(values[:, b], minlength=1 << BAND_BITS))]) for b in range(BANDS)])

    def near(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the table's descriptors i and ``bits`` j that share a band and differ in at most MAX_DISTANCE bits."""
        values = np.ascontiguousarray(bits).view(np.uint16).reshape(-1, BANDS).astype(np.int64)
        band = np.arange(BANDS)
        low = self.start[band, values]
        n = (self.start[band, values + 1] - low).ravel()
        low = (low + band * self.n).ravel()
        whose = np.arange(len(n)) // BANDS
        words = [np.ascontiguousarray(bits[:, k]) for k in range(BITS // 64)]
        ends = np.cumsum(n)
        found, at = [np.zeros(0, np.int64)], 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            m = n[at:stop]
            i = self.order[np.repeat(low[at:stop] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            j = np.repeat(whose[at:stop], m)
            d = np.bitwise_count(self.words[0][i] ^ words[0][j]) + np.bitwise_count(self.words[1][i] ^ words[1][j])
            near = np.flatnonzero(d <= MAX_DISTANCE)
            i, j, d = i[near], j[near], d[near]
            for k in range(2, BITS // 64):
                d += np.bitwise_count(self.words[k][i] ^ words[k][j])
            near = np.flatnonzero(d <= MAX_DISTANCE)
            found.append(i[near].astype(np.int64) * len(bits) + j[near])
            at = stop
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(bits)), pairs % max(1, len(bits))


def consensus(q: np.ndarray, x: np.ndarray) -> int:
    """How many of the matches of corners ``q`` and ``x`` (x, y, zoom, direction) agree on one similarity transform; each corner counts once.

    Every match votes for the transform it tells; the most any voter gets counts.
    """
    q, x = q.astype(np.float64), x.astype(np.float64)
    turn, zoom = x[:, 3] - q[:, 3], x[:, 2] / q[:, 2]
    c, s = np.cos(turn) * zoom, np.sin(turn) * zoom
    dx, dy = x[:, 0] - (c * q[:, 0] - s * q[:, 1]), x[:, 1] - (s * q[:, 0] + c * q[:, 1])
    far = (4 * np.maximum(x[:, 2], 1)) ** 2
    step, agree = max(1, PAIRS_AT_ONCE // max(1, len(q))), []
    for lo in range(0, len(q), step):
        v = slice(lo, lo + step)
        ex = np.outer(c[v], q[:, 0]) - np.outer(s[v], q[:, 1]) + dx[v, None] - x[:, 0]
        ey = np.outer(s[v], q[:, 0]) + np.outer(c[v], q[:, 1]) + dy[v, None] - x[:, 1]
        off = np.abs((turn - turn[v, None] + np.pi) % (2 * np.pi) - np.pi)
        agree.append(np.packbits((ex * ex + ey * ey < far) & (off < 0.35) & (np.abs(np.log(zoom / zoom[v, None])) < 0.4), axis=1))
    agree = np.concatenate(agree) if agree else np.zeros((0, 0), np.uint8)
    votes = np.bitwise_count(agree).sum(1, dtype=np.int64)
    best = 0
    for i in np.argsort(-votes, kind="stable"):
        if votes[i] <= best:
            break
        ok = np.unpackbits(agree[i], count=len(q)).astype(bool)
        best = max(best, min(len(np.unique(q[ok, :2], axis=0)), len(np.unique(x[ok, :2], axis=0))))
    return best


def packed(images: DataFrame, image_id: str, column: str) -> DataFrame:
    """(id, picture, n, corners, bits): one row for each image that can be read.

    picture names its shape and grey levels; n corners and their descriptors are
    packed.  Both are null where the task has met the same picture before.
    """
    names = ["id", "picture", "n", "corners", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out: list[list] = [[] for _ in names]
                for i in range(lo, min(lo + 64, batch.num_rows)):
                    grey = decode(batch.column(1)[i].as_py())
                    if grey is None or not grey.size:
                        continue
                    picture = hashlib.sha256(repr(grey.shape).encode() + np.ascontiguousarray(grey, np.float32).tobytes()).digest()
                    row = [batch.column(0)[i].as_py(), picture, None, None, None]
                    if picture not in seen:
                        seen.add(picture)
                        p, b = describe(grey)
                        row[2:] = len(p), p.tobytes(), b.tobytes()
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)

    source = images.select(F.col(image_id).cast("long").alias("id"), F.col(column).alias("image")).filter("id IS NOT NULL")
    return source.mapInArrow(lean(run), "id long, picture binary, n long, corners binary, bits binary")


def _unpacked(corners: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(corners, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint64).reshape(-1, BITS // 64)


def _searched(block: list, images: DataFrame, min_inliers: int) -> DataFrame:
    """(query, picture, n_matches, n_inliers) of the described ``images`` that match a query of ``block``."""
    shared = images.sparkSession.sparkContext.broadcast([(bytes(r.picture), bytes(r.corners), bytes(r.bits)) for r in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [_unpacked(c, b) for _, c, b in shared.value]
        corners = np.concatenate([c for c, _ in sides])
        whose = np.repeat(np.arange(len(sides)), [len(c) for c, _ in sides])
        tables = Tables(np.concatenate([b for _, b in sides]))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for picture, c, b in zip(*(batch.column(k) for k in range(3)), strict=True):
                points, bits = _unpacked(c.as_buffer(), b.as_buffer())
                i, j = tables.near(bits)
                # the pairs come in the table's order, so those of a query stand together
                at = np.flatnonzero(np.diff(whose[i], prepend=-1))
                for lo, hi in zip(at.tolist(), [*at.tolist()[1:], len(i)] if len(i) else [], strict=True):
                    if hi - lo >= min_inliers and (n := consensus(corners[i[lo:hi]], points[j[lo:hi]])) >= min_inliers:
                        for o, v in zip(out, (shared.value[whose[i[lo]]][0], picture.as_py(), hi - lo, n), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["query", "picture", "n_matches", "n_inliers"])

    return images.filter("n > 0").select("picture", "corners", "bits").mapInArrow(lean(run), "query binary, picture binary, n_matches long, n_inliers long")


def copies(queries: DataFrame, images: DataFrame, image_id: str = "id", column: str = "image", min_inliers: int = MIN_INLIERS, own: bool = True, block: int = QUERY_DESCRIPTORS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, query classes, image classes) of images that are copies of a query image, cropped or edited or not.

    Images of equal grey levels are a class (id, class_id), named by its smallest
    id and searched once.  pairs (query_id, image_id, n_matches, n_inliers) are
    between classes and hold for all their members.  With ``own`` the ids of both
    sides name the same images, and a row is no copy of itself.  Images
    without corners are copies if all their pixels are equal, with no matches and
    no inliers.  Null ids and broken or empty images take no part; an id whose
    rows show several pictures is in the class of each; empty tables give no rows.
    The queries' descriptors go to the workers ``block`` at a time (one image at
    least).
    """
    spark = images.sparkSession
    x, q = settle(packed(images, image_id, column)), settle(packed(queries, image_id, column))
    x_class, q_class = (settle(df.groupBy("picture").agg(F.min("id").alias(name), F.max("id").alias(f"{name}_last"))) for df, name in ((x, "image_id"), (q, "query_id")))
    pictures = settle(q.filter("n > 0").select("picture", "n", "corners", "bits").dropDuplicates(["picture"]))
    blocks = math.ceil((pictures.agg(F.sum("n")).first()[0] or 0) / block)
    kind = "query binary, picture binary, n_matches long, n_inliers long"
    found = spark.createDataFrame([], kind)
    for k in range(blocks):
        rows = pictures.filter(F.pmod(F.xxhash64("picture"), F.lit(blocks)) == k).collect()
        if rows:
            found = found.union(settle(_searched(rows, x, min_inliers)))
    none = F.lit(0).cast("long")
    found = found.union(q_class.join(x_class, "picture").select(F.col("picture").alias("query"), "picture", none, none))
    found = found.groupBy("query", "picture").agg(F.max(F.struct("n_inliers", "n_matches")).alias("m"))
    pairs = found.join(q_class.withColumnRenamed("picture", "query"), "query").join(x_class, "picture")
    if own:
        pairs = pairs.filter("NOT (query_id = image_id AND query_id_last = query_id AND image_id_last = image_id)")
    members = lambda df, classes, name: df.select("id", "picture").distinct().join(classes, "picture").select("id", F.col(name).alias("class_id"))
    return pairs.select("query_id", "image_id", "m.n_matches", "m.n_inliers"), members(q, q_class, "query_id"), members(x, x_class, "image_id")


def rendered(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cropped: bool = False) -> DataFrame:
    """(id, image): a PGM of each vector, for tables that hold no images: smooth cells of its values and a texture that is a fixed linear function of them, so near vectors give near pictures.

    ``cropped`` cuts a border off, changes brightness and contrast and adds noise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[int, np.ndarray] = {}
        fine = _steps(32, 128)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, out = batch.slice(lo, 64), []
                for v in part.column(1).to_pylist():
                    e = np.array([x or 0.0 for x in (v or [])], np.float64)
                    seed = zlib.crc32(e.astype("<f4").tobytes())
                    side = max(2, math.isqrt(max(4, len(e))))
                    grid = np.resize(e, (side, side)) if len(e) else np.zeros((side, side))
                    if len(e) not in weights:
                        weights[len(e)] = np.random.Generator(np.random.PCG64(len(e))).normal(0, 40, (32 * 32, len(e)))
                    texture = (weights[len(e)] @ (e / (np.linalg.norm(e) or 1.0))).reshape(32, 32)
                    coarse = _steps(side, 128)
                    im = 128 + 60 * (coarse @ (grid / (np.abs(grid).max() or 1.0)) @ coarse.T) + fine @ texture @ fine.T
                    if cropped:
                        im = 0.85 * im[14:118, 10:114] + 14 + np.random.Generator(np.random.PCG64(seed + 1)).normal(0, 2, (104, 104))
                    out.append(encode_pgm(im))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "image"])

    return vectors.select(F.col(vec_id).cast("long").alias("id"), embedding).mapInArrow(lean(run), "id long, image binary")


def op7_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector drawn as an image; the queries, ids divisible by 100, are cropped, darkened and noisy copies of theirs.

    Rows of two kinds: a "member" has the vec_id and class_id of each vector (a
    class are the vectors of equal pictures, named by the smallest); a "copy" has
    the query's class as query_id and the class_id it is a copy of.
    """
    vectors = table(spark, sf_dir, "embeddings")
    pairs, _, classes = copies(rendered(vectors.filter("vec_id % 100 = 0"), cropped=True), rendered(vectors), own=False)
    members = classes.select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), F.lit(None).cast("long").alias("query_id"), "class_id", F.lit(None).cast("long").alias("n_matches"), F.lit(None).cast("long").alias("n_inliers"))
    return members.union(pairs.select(F.lit("copy"), F.lit(None).cast("long"), "query_id", F.col("image_id"), "n_matches", "n_inliers"))
