"""Kernels as array expressions against plain versions, on images of odd sizes with three channels."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import kernels, pixels

SIZES = [(7, 5), (1, 4), (6, 6), (3, 1)]


@pytest.fixture(scope="module")
def images(spark):
    r = np.random.default_rng(5)
    made = {i: r.integers(0, 256, (h, w, 3)).astype(np.uint8) for i, (w, h) in enumerate(SIZES)}
    df = spark.createDataFrame([(i, m.shape[1], m.shape[0], m.ravel().tolist()) for i, m in made.items()], "key int, width int, height int, px array<int>")
    return made, df


def after(df, f):
    return {r.key: r.px for r in df.select("key", f(F.col("px"), F.col("width"), F.col("height")).alias("px")).collect()}


def same(images, f, plain, slack=0):
    made, df = images
    got = after(df, f)
    for k, m in made.items():
        want = plain(m)
        assert (want is None and got[k] is None) or np.abs(np.array(got[k]) - np.asarray(want).ravel()).max() <= slack, k


ONES = np.ones((3, 3), np.uint8)


def test_filters_and_light(images):
    same(images, lambda p, w, h: pixels.eroded(p, w, h, 3), lambda m: kernels.erode(m, ONES))
    same(images, lambda p, w, h: pixels.dilated(p, w, h, 3), lambda m: 255 - kernels.erode(255 - m, ONES))
    same(images, lambda p, w, h: pixels.blurred(p, w, h, 3, 0.55), lambda m: kernels.gaussian_blur(m, 3, 0.55))
    same(images, lambda p, w, h: pixels.blurred(p, w, h, 3, 4.0, 33), lambda m: kernels.gaussian_blur(m, 33, 4.0))
    same(images, lambda p, w, h: pixels.brightness(p, 1.3, -40), lambda m: kernels.brightness(m, 1.3, -40))
    same(images, lambda p, w, h: pixels.shadow(p, w, 3, 2, 0.24), lambda m: kernels.shadow(m, 2, 0.24))


def test_places(images):
    for angle in (-3, 2.5, 0):
        same(images, lambda p, w, h, a=angle: pixels.rotated(p, w, h, 3, a), lambda m, a=angle: kernels.rotate(m, a))
    same(images, lambda p, w, h: pixels.nearest(p, w, h, 3, 10, 4), lambda m: kernels.resize(m, 10, 4, "nearest"))
    made, df = images
    assert after(df.where("key = 2"), lambda p, w, h: pixels.reduced(p, w, h, 3, 2)) == {2: kernels.resize(made[2], 3, 3, "area").ravel().tolist()}


def test_letterbox(images):
    def plain(m, target=9, margin=2):
        scale = (target - 2 * margin) / max(m.shape[:2])
        w, h = int(m.shape[1] * scale), int(m.shape[0] * scale)
        return None if min(w, h) < 1 else kernels.paste(np.full((target, target, 3), kernels.border_colour(m), np.uint8), kernels.resize(m, w, h, "nearest"))

    same(images, lambda p, w, h: pixels.letterboxed(p, w, h, 3, 9, 2), plain)
    made, df = images
    thin = df.where("key = 1").select(F.col("key"), F.lit(1).alias("width"), F.lit(9).alias("height"), F.array_repeat(F.lit(3), 27).alias("px"))
    assert after(thin, lambda p, w, h: pixels.letterboxed(p, w, h, 3, 7, 0)) == {1: None}


def test_frames(images):
    box = lambda x1, y1, x2, y2, bad: F.struct(F.lit(x1).alias("x1"), F.lit(y1).alias("y1"), F.lit(x2).alias("x2"), F.lit(y2).alias("y2"), F.lit(bad).alias("suspicious"))
    boxes = F.array(box(1, 1, 6, 4, False), box(0, 2, 4, 5, True))

    def plain(m):
        out = m.copy()
        for x1, y1, x2, y2, ink in ((1, 1, 6, 4, kernels.BOX), (0, 2, 4, 5, kernels.SUSPICIOUS)):
            for y in range(m.shape[0]):
                for x in range(m.shape[1]):
                    if x1 - 1 <= x < x2 + 1 and y1 - 1 <= y < y2 + 1 and not (x1 + 1 <= x < x2 - 1 and y1 + 1 <= y < y2 - 1):
                        out[y, x] = ink
        return out

    same(images, lambda p, w, h: pixels.framed(p, w, h, 3, boxes, list(kernels.BOX), list(kernels.SUSPICIOUS)), plain)
    bare = F.filter(boxes, lambda _: F.lit(False))

    def marked(m):
        out = m.copy()
        out[:4] = kernels.SUSPICIOUS
        return out

    same(images, lambda p, w, h: pixels.framed(p, w, h, 3, bare, list(kernels.BOX), list(kernels.SUSPICIOUS)), marked)


def test_channels_and_bytes(images):
    made, df = images
    got = after(df, lambda p, w, h: pixels.channels_first(p, w, h, 3))
    assert all(np.array_equal(np.array(got[k], np.float32), kernels.chw(m).ravel()) for k, m in made.items())
    assert {r.key: bytes(r.b) for r in df.select("key", pixels.bytes_of(F.col("px")).alias("b")).collect()} == {k: m.tobytes() for k, m in made.items()}
    back = df.select("key", "width", "height", pixels.values_of(pixels.bytes_of(F.col("px"))).alias("px"))
    assert after(back, lambda p, w, h: p) == {k: m.ravel().tolist() for k, m in made.items()}


def drawn(seed, *parts):
    return (int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296


def test_random_steps(images):
    made, df = images
    key = F.col("key")
    got = after(df, lambda p, w, h: pixels.noisy(p, key, 6.0, 1))
    for k, m in made.items():
        noise = [math.trunc(6.0 * math.sqrt(-2 * math.log(drawn(1, k, i, "a"))) * math.cos(2 * math.pi * drawn(1, k, i, "b"))) for i in range(m.size)]
        assert got[k] == np.clip(m.ravel().astype(int) + noise, 0, 255).tolist()
    got = after(df, lambda p, w, h: pixels.salt_and_pepper(p, w, h, 3, key, 0.1, 1))
    for k, m in made.items():
        n, size = int(0.1 * m.size * 0.5), m.shape[0] * m.shape[1]
        out = m.reshape(size, 3).copy()
        for name, v in (("salt", 255), ("pepper", 0)):
            for j in range(1, n + 1):
                out[int(drawn(1, k, name, j) * size)] = v
        assert got[k] == out.ravel().tolist()

    def fields(m, k):
        h, w = m.shape[:2]
        raw = [np.array([[drawn(1, k, a, x, y) * 2 - 1 for x in range(w)] for y in range(h)]) for a in "xy"]
        return [kernels.convolve(f, kernels.gaussian_taps(41, 4.5)) * 7 for f in raw]

    got = after(df, lambda p, w, h: pixels.elastic(p, w, h, 3, key, 7.0, 4.5, 1))
    assert all(np.abs(np.array(got[k]) - kernels.elastic(m, *fields(m, k)).ravel().astype(int)).max() <= 1 for k, m in made.items())


def test_chain_is_repeatable(images):
    _, df = images
    one, two = ({r.key: r.px for r in pixels.augmented(d, "key", 3, 9).collect()} for d in (df, df.repartition(3)))
    assert one == two and all(len(v) == SIZES[k][0] * SIZES[k][1] * 3 and 0 <= min(v) and max(v) <= 255 for k, v in one.items())
    assert one != {r.key: r.px for r in pixels.augmented(df, "key", 3, 10).collect()}


def test_mosaics(spark):
    r = random.Random(3)
    tiles = {(m, s): [r.randrange(256) for _ in range(2 * 2 * 3)] if r.random() < 0.7 else None for m in range(3) for s in range(9) if r.random() < 0.8}
    tiles[7, 0] = None
    df = spark.createDataFrame([(*k, v, k[1]) for k, v in tiles.items()], "mosaic int, slot int, px array<int>, image int")
    got = {x.mosaic: x for x in pixels.mosaics(df, "mosaic", 3, 2, 3).collect()}
    for m in {k[0] for k in tiles}:
        want = kernels.mosaic([None if tiles.get((m, s)) is None else np.array(tiles[m, s], np.uint8).reshape(2, 2, 3) for s in range(9)], 3, 6)
        assert got[m].px == want.ravel().tolist() and (got[m].width, got[m].height) == (6, 6)
    boxes = spark.createDataFrame([(s, s, 0.5, 0.5, 0.4, 0.2) for s in range(9)], "image int, cls_id int, xc double, yc double, bw double, bh double")
    found = pixels.mosaic_labels(df, boxes, "mosaic", "image", 3, 6).collect()
    assert sorted((x.mosaic, x.slot) for x in found) == sorted(k for k, v in tiles.items() if v is not None)
    assert all(math.isclose(x.nx, (x.slot % 3 + 0.5) / 3) and math.isclose(x.ny, (x.slot // 3 + 0.5) / 3) for x in found)
