"""Image copies against plain comparisons, and odd images."""

import math
import struct
import zlib
from collections import Counter

import numpy as np

from tessera.llm import images

SF = "/root/testdata/sf0.001"


def test_images(spark):
    got = images.op7_images(spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.filter("kind = 'member'").count() == n
    assert {(r.query_id, r.class_id) for r in got.filter("kind = 'copy'").collect()} >= {(i, i) for i in range(0, n, 100)}
    png = images.decode(b"\x89PNG\r\n\x1a\n broken")
    assert png is None and images.decode(None) is None and images.decode(b"") is None and images.decode(b"P5 2 2 255 ") is None
    im = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(images.decode(images.encode_pgm(im)), im)
    odd = spark.createDataFrame([(1, None), (2, b""), (None, images.encode_pgm(im))], "id long, image binary")
    pairs, queries, classes = images.copies(odd, odd)
    assert pairs.count() == queries.count() == classes.count() == 0
    assert images.copies(odd.limit(0), odd)[0].count() == images.copies(odd, odd.limit(0))[0].count() == 0
    assert images.rendered(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 2


def png(rows, w, h, depth, color, palette=b"", interlaced=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0" * 4
    head = struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def picture(r, side=128, cell=4):
    return np.clip(128 + images.resize(r.normal(0, 45, (side // cell, side // cell)), side, side), 0, 255).round()


def edited(im, r):
    """Copies of ``im``: cropped, dimmed and noisy, smaller, and both."""
    h, w = im.shape
    yield "crop", np.clip(0.85 * im[14 : h - 10, 10 : w - 14] + 14 + r.normal(0, 2, (h - 24, w - 24)), 0, 255)
    for zoom in (0.9, 0.8, 0.7, 0.6, 0.5):
        yield f"zoom {zoom}", images.resize(im, round(h * zoom), round(w * zoom))
    yield "part at 0.8", images.resize(im[20:110, 20:110], 72, 72)


def test_images_tables_find_what_all_comparisons_find():
    """Pairs that share a band, exactly; the share of all near pairs, and the edited copies, that the tables find: 0.9 at least."""
    r = np.random.Generator(np.random.PCG64(5))
    ims = [picture(r, cell=(4, 6, 8)[i % 3]) for i in range(12)]
    known = [images.describe(x) for x in ims]
    all_bits = np.concatenate([b for _, b in known])
    tables = images.Tables(all_bits)
    bands = lambda b: np.ascontiguousarray(b).view(np.uint16).reshape(-1, images.BANDS)
    whose = np.repeat(np.arange(len(ims)), [len(b) for _, b in known])
    near, kept, found, asked = Counter(), Counter(), Counter(), Counter()
    for n, im in enumerate(ims):
        for name, y in edited(im, r):
            p, b = images.describe(y)
            i, j = np.nonzero(np.bitwise_count(all_bits[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64) <= images.MAX_DISTANCE)
            shared = (bands(all_bits)[i] == bands(b)[j]).any(1)
            got = tables.near(b)
            assert set(zip(*(x.tolist() for x in got), strict=True)) == set(zip(i[shared].tolist(), j[shared].tolist(), strict=True))
            near[name] += len(i)
            kept[name] += int(shared.sum())
            own = whose[got[0]] == n
            asked[name] += 1
            found[name] += images.consensus(known[n][0][got[0][own] - np.flatnonzero(whose == n)[0]], p[got[1][own]]) >= images.MIN_INLIERS
    for name in asked:
        assert found[name] >= 0.9 * asked[name] and kept[name] >= 0.85 * near[name], (name, found[name], kept[name] / near[name])
    assert sum(kept.values()) >= 0.9 * sum(near.values())


def test_images_consensus_against_every_voter():
    r = np.random.Generator(np.random.PCG64(9))
    q = np.stack([r.uniform(0, 100, 40), r.uniform(0, 100, 40), np.ones(40), r.uniform(0, 6, 40)], 1)
    x = np.stack([0.8 * q[:, 0] + 3, 0.8 * q[:, 1] - 2, np.full(40, 0.8), q[:, 3]], 1)
    x[25:, :2] = r.uniform(0, 100, (15, 2))
    q, x = np.concatenate([q, q[:5]]), np.concatenate([x, x[:5]])
    best = 0
    for i in range(len(q)):
        turn, zoom = x[i, 3] - q[i, 3], x[i, 2] / q[i, 2]
        ok = []
        for k in range(len(q)):
            dx = x[i, 0] + zoom * (math.cos(turn) * (q[k, 0] - q[i, 0]) - math.sin(turn) * (q[k, 1] - q[i, 1])) - x[k, 0]
            dy = x[i, 1] + zoom * (math.sin(turn) * (q[k, 0] - q[i, 0]) + math.cos(turn) * (q[k, 1] - q[i, 1])) - x[k, 1]
            off = abs((x[k, 3] - q[k, 3] - turn + math.pi) % (2 * math.pi) - math.pi)
            if dx * dx + dy * dy < 16 and off < 0.35:
                ok.append(k)
        best = max(best, min(len({tuple(q[k, :2]) for k in ok}), len({tuple(x[k, :2]) for k in ok})))
    assert images.consensus(q, x) == best >= 25 and images.consensus(q[:0], x[:0]) == 0


def test_images_classes_and_blocks(spark):
    """Equal pictures are one class, found once; blocks of queries give what one block gives; a row is no copy of itself."""
    r = np.random.Generator(np.random.PCG64(4))
    a, b, c = picture(r), picture(r, cell=6), picture(r, cell=8)
    crop = a[10:120, 6:118] * 0.9 + 8
    rows = [(5, a), (2, a), (9, a), (3, b), (4, c), (7, crop), (3, b)]
    table = spark.createDataFrame([(i, images.encode_pgm(x)) for i, x in rows], "id long, image binary").repartition(3)
    for block in (1, images.QUERY_DESCRIPTORS):
        pairs, queries, classes = images.copies(table, table, block=block)
        assert {(x.query_id, x.image_id) for x in pairs.collect()} == {(2, 2), (2, 7), (7, 2)}
        want = {(2, 2), (5, 2), (9, 2), (3, 3), (4, 4), (7, 7)}
        assert {tuple(x) for x in classes.collect()} == {tuple(x) for x in queries.collect()} == want
    pairs = images.copies(table.filter("id = 3"), table, own=False)[0]
    assert {(x.query_id, x.image_id) for x in pairs.collect()} == {(3, 3)}


def test_images_near_vectors_give_near_pictures(spark):
    e = np.random.Generator(np.random.PCG64(6)).normal(0, 1, 64)
    rows = [(1, e.tolist()), (2, (e + 1e-4).tolist())]
    a, b = (images.decode(x.image) for x in images.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("id").collect())
    assert np.abs(a - b).mean() < 2


def test_images_png_kinds():
    im = (np.arange(35).reshape(5, 7) * 7 % 256).astype(np.uint8)
    passes = [im[y0::dy, x0::dx] for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))]
    kinds = [
        png([r.tobytes() for r in im], 7, 5, 8, 3, bytes(v for g in range(256) for v in (g, g, g))),
        png([(r.astype(">u2") * 257).tobytes() for r in im], 7, 5, 16, 0),
        png([np.stack([r, r // 2], 1).tobytes() for r in im], 7, 5, 8, 4),
        png([r.tobytes() for p in passes if p.size for r in p], 7, 5, 8, 0, interlaced=1),
    ]
    assert all(np.allclose(images.decode(x), im, atol=1e-2) for x in kinds)
    assert np.array_equal(images.decode(png([b"\xa0", b"\x40"], 3, 2, 1, 0)), [[255, 0, 255], [0, 255, 0]])


def test_images_small_crop_of_a_large_image_and_no_corners(spark):
    """A weak part of a large picture is found by its own corners; images without corners by their pixels."""
    r = np.random.Generator(np.random.PCG64(3))
    large = 128 + images.resize(r.normal(0, 45, (120, 120)), 480, 480)
    weak = (slice(200, 290), slice(180, 270))
    large[weak] = 128 + (large[weak] - 128) * 0.35
    flat, tiny = np.full((50, 50), 9.0), r.integers(0, 255, (12, 1))
    rows = [(1, large), (2, 128 + images.resize(r.normal(0, 45, (120, 120)), 480, 480)), (3, flat), (4, flat + 1), (5, tiny), (6, tiny), (7, flat[:, :49])]
    table = spark.createDataFrame([(i, images.encode_pgm(x)) for i, x in rows], "id long, image binary")
    queries = spark.createDataFrame([(-1, images.encode_pgm(large[weak])), (-3, images.encode_pgm(flat)), (5, images.encode_pgm(tiny))], "id long, image binary")
    assert {(x.query_id, x.image_id) for x in images.copies(queries, table)[0].collect()} == {(-1, 1), (-3, 3), (5, 5)}
