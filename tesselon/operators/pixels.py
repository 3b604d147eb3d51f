"""Images as arrays of values in a column, and kernels as expressions over them: no Python, no shuffle, a row at a time.

px holds an image's values row by row, the channels of a pixel together; w and h are its sides (columns or numbers), c its channels
(a number). Each kernel binds its image once, so kernels can be nested.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.operators.geometry import tile_remap

Number = Column | int | float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: Number) -> Column:
    return F.floor(a / b).cast("int")


def saturate(x: Column) -> Column:
    """Rounded half to even, held within 0 and 255."""
    return F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(255.0)).cast("int")


def mirrored(i: Column, n: Number) -> Column:
    """A place beyond 0..n-1 reflected into it, the edge itself not repeated."""
    return let(F.abs(i) % F.greatest(2 * _col(n) - 2, F.lit(1)), lambda j: F.when(j < n, j).otherwise(2 * _col(n) - 2 - j))


def values_of(data: Column) -> Column:
    """px of bytes."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))


def bytes_of(px: Column) -> Column:
    return F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


# --- places ----------------------------------------------------------------------------------------


def placed(px: Column, w: Number, c: int, f: Callable[[Column, Column, Column], Column]) -> Column:
    """Each value by f(value, x, y)."""
    return F.transform(px, lambda v, i: f(v, _div(i, c) % w, _div(_div(i, c), w)))


def gathered(w: Number, h: Number, c: int, f: Callable[[Column, Column, Column], Column]) -> Column:
    """A new image whose values are f(x, y, channel)."""
    return F.transform(F.sequence(F.lit(0), _col(w) * _col(h) * c - 1), lambda i: f(_div(i, c) % w, _div(_div(i, c), w), i % c))


def value_at(p: Column, x: Column, y: Column, ch: Column, w: Number, c: int) -> Column:
    return F.get(p, ((y * w + x) * c + ch).cast("int"))


def sampled(px: Column, w: Number, h: Number, c: int, x: Callable[[Column, Column], Column], y: Callable[[Column, Column], Column], out_w: Number | None = None, out_h: Number | None = None) -> Column:
    """Linear interpolation at x(i, j), y(i, j) for each pixel (i, j); not rounded."""

    def one(p: Column, sx: Column, sy: Column, ch: Column) -> Column:
        x0, y0 = F.floor(sx), F.floor(sy)
        at = lambda dx, dy: value_at(p, mirrored(x0 + dx, w), mirrored(y0 + dy, h), ch, w, c)
        fx, fy = sx - x0, sy - y0
        return (at(0, 0) * (1 - fx) + at(1, 0) * fx) * (1 - fy) + (at(0, 1) * (1 - fx) + at(1, 1) * fx) * fy

    place = lambda i, j: F.struct(x(i, j).cast("double").alias("x"), y(i, j).cast("double").alias("y"))
    return let(px, lambda p: gathered(w if out_w is None else out_w, h if out_h is None else out_h, c, lambda i, j, ch: let(place(i, j), lambda s: one(p, s["x"], s["y"], ch))))


def rotated(px: Column, w: Number, h: Number, c: int, angle: Number) -> Column:
    """Counter-clockwise by degrees about the centre, the border reflected."""
    turn = F.radians(_col(angle))
    dx, dy = (lambda i: i - _col(w) / 2), (lambda j: j - _col(h) / 2)
    out = sampled(px, w, h, c, lambda i, j: F.cos(turn) * dx(i) - F.sin(turn) * dy(j) + _col(w) / 2, lambda i, j: F.sin(turn) * dx(i) + F.cos(turn) * dy(j) + _col(h) / 2)
    return F.transform(out, saturate)


def nearest(px: Column, w: Number, h: Number, c: int, out_w: Number, out_h: Number) -> Column:
    """Another size by the nearest source pixel."""
    side = lambda i, n, out: F.least(F.floor(i * _col(n) / out), _col(n) - 1)
    return let(px, lambda p: gathered(out_w, out_h, c, lambda x, y, ch: value_at(p, side(x, w, out_w), side(y, h, out_h), ch, w, c)))


def reduced(px: Column, w: Number, h: Number, c: int, by: int) -> Column:
    """Both sides divided by a whole number that divides them: means of squares."""
    cell = lambda p, x, y, ch: sum((value_at(p, x * by + i, y * by + j, ch, w, c) for j in range(by) for i in range(by) if i or j), value_at(p, x * by, y * by, ch, w, c))
    return let(px, lambda p: gathered(_div(_col(w), by), _div(_col(h), by), c, lambda x, y, ch: saturate(cell(p, x, y, ch) / (by * by))))


# --- filters ---------------------------------------------------------------------------------------


def _window(px: Column, w: Number, h: Number, c: int, size: int, pick: Callable[[Column], Column]) -> Column:
    reach = range(-(size // 2), size - size // 2)

    def one(p: Column, x: Column, y: Column, ch: Column) -> Column:
        inside = lambda dx, dy: (x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h)
        return pick(F.array(*(F.when(inside(dx, dy), value_at(p, x + dx, y + dy, ch, w, c)) for dy in reach for dx in reach)))

    return let(px, lambda p: gathered(w, h, c, lambda x, y, ch: one(p, x, y, ch)))


def eroded(px: Column, w: Number, h: Number, c: int, size: int = 3) -> Column:
    """Least value of a square window; what lies outside does not count."""
    return _window(px, w, h, c, size, F.array_min)


def dilated(px: Column, w: Number, h: Number, c: int, size: int = 3) -> Column:
    return _window(px, w, h, c, size, F.array_max)


def gaussian_taps(size: int, sigma: Number) -> Column:
    """Weights of a Gaussian window of odd size, summing to 1."""
    raw = F.array(*(F.exp(-0.5 * F.pow(F.lit(float(k - size // 2)) / sigma, 2)) for k in range(size)))
    return let(raw, lambda a: F.transform(a, lambda t: t / F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))


def convolved(px: Column, w: Number, h: Number, c: int, taps: Column, size: int) -> Column:
    """Both axes with the same taps, reflecting at the border; not rounded."""

    def along(image: Column, n: Number, step: Callable[[Column, Column, Column, int], Column]) -> Column:
        """step gives a tap's place in the image, from the table of places along the axis, reflected once for all pixels."""
        table = F.transform(F.sequence(F.lit(-(size // 2)), _col(n) + size // 2 - 1), lambda i: mirrored(i, n).cast("int"))

        def one(p: Column, t: Column, m: Column, x: Column, y: Column, ch: Column) -> Column:
            return sum((F.get(t, F.lit(k)) * F.get(p, step(m, x, y, k) * c + ch) for k in range(size)), F.lit(0.0))

        return let(image, lambda p: let(taps, lambda t: let(table, lambda m: gathered(w, h, c, lambda x, y, ch: one(p, t, m, x, y, ch)))))

    down = along(px, h, lambda m, x, y, k: F.get(m, y + k) * w + x)
    return along(down, w, lambda m, x, y, k: y * w + F.get(m, x + k))


def blurred(px: Column, w: Number, h: Number, c: int, sigma: Number, size: int = 3) -> Column:
    return F.transform(convolved(px, w, h, c, gaussian_taps(size, sigma), size), saturate)


# --- augmentation ----------------------------------------------------------------------------------


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 digest of seed and parts, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def brightness(px: Column, alpha: Number, beta: Number) -> Column:
    return F.transform(px, lambda v: saturate(F.abs(v * _col(alpha) + beta)))


def shadow(px: Column, w: Number, c: int, start: Number, alpha: Number) -> Column:
    """Columns from start on become lighter by 20 * alpha."""
    return placed(px, w, c, lambda v, x, _: saturate(v + F.when(x >= start, 20 * _col(alpha)).otherwise(0.0)))


def noisy(px: Column, key: Column, sigma: Number, seed: int = 42) -> Column:
    """Gaussian noise, truncated to whole numbers before it is added."""
    draw = lambda i: sigma * F.sqrt(-2 * F.log(uniform(seed, key, i, F.lit("a")))) * F.cos(2 * math.pi * uniform(seed, key, i, F.lit("b")))
    return F.transform(px, lambda v, i: F.least(F.greatest(v + draw(i).cast("int"), F.lit(0)), F.lit(255)))


def salt_and_pepper(px: Column, w: Number, h: Number, c: int, key: Column, share: Number, seed: int = 42) -> Column:
    """White, then black dots at random pixels, with repetition: half of share of the values' number of each."""
    n = F.floor(_col(share) * F.size(px) * 0.5).cast("int")
    spots = lambda kind: F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.floor(uniform(seed, key, F.lit(kind), k) * w * h).cast("int"))
    return let(spots("salt"), lambda s: let(spots("pepper"), lambda p: F.transform(px, lambda v, i: F.when(F.array_contains(p, _div(i, c)), 0).when(F.array_contains(s, _div(i, c)), 255).otherwise(v))))


def elastic(px: Column, w: Number, h: Number, c: int, key: Column, alpha: Number, sigma: Number, seed: int = 42, size: int = 41) -> Column:
    """Pixels moved by two smooth random fields, at most to the border."""
    raw = lambda axis: gathered(w, h, 1, lambda x, y, _: uniform(seed, key, F.lit(axis), x, y) * 2 - 1)
    field = lambda axis: convolved(raw(axis), w, h, 1, gaussian_taps(size, sigma), size)
    within = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), _col(n) - 1.0)
    moved = lambda f, i, j: F.get(f, (j * w + i).cast("int")) * alpha
    return let(field("x"), lambda dx: let(field("y"), lambda dy: F.transform(sampled(px, w, h, c, lambda i, j: within(i + moved(dx, i, j), w), lambda i, j: within(j + moved(dy, i, j), h)), saturate)))


def grained(px: Column, w: Number, h: Number, c: int, key: Column, seed: int = 42) -> Column:
    """92 % of the image with 8 % of a texture of 0 to 24 at a sixth of its size, enlarged linearly."""
    small = lambda n: F.greatest(_div(_col(n), 6), F.lit(1))
    raw = gathered(small(w), small(h), 1, lambda x, y, _: F.floor(uniform(seed, key, F.lit("grain"), x, y) * 25).cast("int"))
    centre = lambda i, n: F.least(F.greatest((i + 0.5) * small(n) / n - 0.5, F.lit(0.0)), small(n) - 1.0)
    wide = sampled(raw, small(w), small(h), 1, lambda i, j: centre(i, _col(w)), lambda i, j: centre(j, _col(h)), w, h)
    return let(F.transform(wide, saturate), lambda g: F.transform(px, lambda v, i: saturate(v * 0.92 + F.get(g, _div(i, c)) * 0.08)))


def augmented(images: DataFrame, key: str, c: int, seed: int = 42) -> DataFrame:
    """images (key, width, height, px) with px after all steps, geometry first, then light, then texture; each but two has its own chance.

    What is drawn depends on the seed and the key alone.
    """
    k, w, h = F.col(key), F.col("width"), F.col("height")
    between = lambda name, low, high: low + (high - low) * uniform(seed, k, F.lit(name))
    step = lambda name, chance, f: lambda px: F.when(uniform(seed, k, F.lit(f"{name}?")) < chance, f(px)).otherwise(px)
    steps = [
        lambda px: rotated(px, w, h, c, between("angle", -3.0, 3.0)),
        step("elastic", 0.50, lambda px: elastic(px, w, h, c, k, between("alpha", 5.0, 9.0), between("sigma", 4.0, 6.0), seed)),
        step("erode", 0.45, lambda px: eroded(px, w, h, c)),
        lambda px: brightness(px, between("contrast", 0.88, 1.32), F.floor(between("light", -15.0, 16.0))),
        step("blur", 0.45, lambda px: blurred(px, w, h, c, between("blur", 0.3, 0.7))),
        step("noise", 0.65, lambda px: noisy(px, k, between("noise", 3.0, 8.0), seed)),
        step("dots", 0.60, lambda px: salt_and_pepper(px, w, h, c, k, between("dots", 0.0005, 0.008), seed)),
        step("grain", 0.55, lambda px: grained(px, w, h, c, k, seed)),
        step("shadow", 0.45, lambda px: shadow(px, w, c, F.floor(between("start", 0.0, 1.0) * (_div(w, 2) + 1)), between("shade", 0.06, 0.24))),
    ]
    for f in steps:
        images = images.withColumn("px", let(F.col("px"), f))
    return images


# --- composition -----------------------------------------------------------------------------------


def border_median(px: Column, w: Number, h: Number, c: int) -> Column:
    """Per channel the median of the four border lines, corners twice, truncated."""

    def one(p: Column, ch: int) -> Column:
        line = lambda n, f: F.transform(F.sequence(F.lit(0), _col(n) - 1), f)
        at = lambda x, y: value_at(p, x, y, F.lit(ch), w, c)
        sides = F.concat(line(w, lambda x: at(x, F.lit(0))), line(w, lambda x: at(x, _col(h) - 1)), line(h, lambda y: at(F.lit(0), y)), line(h, lambda y: at(_col(w) - 1, y)))
        return let(F.array_sort(sides), lambda s: ((F.get(s, _div(F.size(s) - 1, 2)) + F.get(s, _div(F.size(s), 2))) / 2).cast("int"))

    return let(px, lambda p: F.array(*(one(p, ch) for ch in range(c))))


def pasted(px: Column, w: Number, h: Number, c: int, target: int, colour: Column) -> Column:
    """The image in the middle of a square of a colour."""
    ox, oy = (F.floor((target - _col(n)) / 2) for n in (w, h))
    inside = lambda x, y: (x >= ox) & (x < ox + w) & (y >= oy) & (y < oy + h)
    return let(px, lambda p: let(colour, lambda k: gathered(target, target, c, lambda x, y, ch: F.when(inside(x, y), value_at(p, x - ox, y - oy, ch, w, c)).otherwise(F.get(k, ch)))))


def letterboxed(px: Column, w: Number, h: Number, c: int, target: int, margin: int = 0) -> Column:
    """The whole image, its longer side made target less margins by nearest pixels, on a square of its border's colour; null if a side shrinks to nothing."""
    scale = F.lit(target - 2 * margin) / F.greatest(_col(w), _col(h))
    nw, nh = ((_col(n) * scale).cast("int") for n in (w, h))
    return F.when((nw >= 1) & (nh >= 1), pasted(nearest(px, w, h, c, nw, nh), nw, nh, c, target, border_median(px, w, h, c)))


def framed(px: Column, w: Number, h: Number, c: int, boxes: Column, colour: list[int], suspicious: list[int]) -> Column:
    """Frames two pixels wide round boxes (structs of x1, y1, x2, y2, suspicious), later ones on top; without boxes the four top rows are marked."""
    ring = lambda b, x, y, low, high: (x >= b["x1"] - low) & (x < b["x2"] + high) & (y >= b["y1"] - low) & (y < b["y2"] + high)
    on = lambda b, x, y: ring(b, x, y, 1, 1) & ~ring(b, x, y, -1, -1)
    ink = lambda k, ch: F.get(F.array(*map(F.lit, k)), ch)
    drawn = lambda v, x, y, ch: F.aggregate(boxes, v, lambda now, b: F.when(on(b, x, y), F.when(b["suspicious"], ink(suspicious, ch)).otherwise(ink(colour, ch))).otherwise(now))
    bare = lambda v, y, ch: F.when((F.size(boxes) == 0) & (y < 4), ink(suspicious, ch)).otherwise(v)
    return let(px, lambda p: gathered(w, h, c, lambda x, y, ch: let(value_at(p, x, y, ch, w, c), lambda v: drawn(bare(v, y, ch), x, y, ch))))


def channels_first(px: Column, w: Number, h: Number, c: int) -> Column:
    """Values over 255 as floats, channel by channel."""
    n = _col(w) * _col(h)
    return let(px, lambda p: F.transform(F.sequence(F.lit(0), n * c - 1), lambda i: (F.get(p, (i % n * c + F.floor(i / n)).cast("int")) / 255).cast("float")))


def mosaics(tiles: DataFrame, mosaic: str, grid: int, side: int, c: int) -> DataFrame:
    """mosaic, width, height, px: tiles (mosaic, slot, px of side x side, null if unreadable) row by row on black; a mosaic's empty slots stay black.

    Tiles travel as lines of pixels; a mosaic is a row of the result, so its size is the grid's and the tiles'.
    """
    lines = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.struct((F.floor(F.col("slot") / grid) * side + y).cast("int").alias("y"), (F.col("slot") % grid).cast("int").alias("x"), F.slice("px", y * side * c + 1, side * c).alias("part")))
    real = tiles.where("px is not null").select(mosaic, F.inline(lines))
    blank = tiles.select(mosaic).distinct().select(mosaic, F.inline(F.transform(F.sequence(F.lit(0), F.lit(grid * grid * side - 1)), lambda i: F.struct(F.floor(i / grid).cast("int").alias("y"), (i % grid).cast("int").alias("x")))))
    full = blank.join(real, [mosaic, "y", "x"], "left").withColumn("part", F.coalesce("part", F.array_repeat(F.lit(0), side * c)))
    out = full.groupBy(mosaic).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "part"))), lambda p: p["part"])).alias("px"))
    return out.select(mosaic, F.lit(grid * side).alias("width"), F.lit(grid * side).alias("height"), "px")


def mosaic_labels(tiles: DataFrame, boxes: DataFrame, mosaic: str, image: str, grid: int, canvas: int) -> DataFrame:
    """mosaic, slot, cls_id, nx, ny, nw, nh: the boxes of a mosaic's readable tiles in its own coordinates; an unreadable tile gives none."""
    of = tiles.where("px is not null").select(mosaic, "slot", image).join(boxes, image)
    return tile_remap(of, F.col("slot"), grid, canvas).select(mosaic, "slot", "cls_id", "nx", "ny", "nw", "nh")
