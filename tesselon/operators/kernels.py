"""Image kernels in numpy over rows of (height, width, 3) unsigned bytes in BGR order, and the stage that runs them.

Everything random is an argument or comes from the seed and the image's key, so a kernel gives the
same bytes on every run. Borders are mirrored without repeating the edge unless said otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Weights of blue, green and red in gray.
GRAY = np.array([0.114, 0.587, 0.299])


def saturate(x: np.ndarray) -> np.ndarray:
    """Rounded half to even, held within 0 and 255."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(img: np.ndarray) -> np.ndarray:
    return saturate(img @ GRAY)


# --- geometry --------------------------------------------------------------------------------------


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond 0..n-1 reflected into it, the edge itself not repeated."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def _taps(n: int, out: int, method: str) -> np.ndarray:
    """Weights (out, n) of the source samples in each target sample along one axis."""
    scale = n / out
    rows = np.zeros((out, n))
    if method == "area" and scale >= 1:
        edges = np.arange(out + 1) * scale
        cells = np.arange(n)
        rows = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, 1)
        return rows / rows.sum(1, keepdims=True)
    if method == "nearest":
        rows[np.arange(out), np.minimum((np.arange(out) * scale).astype(int), n - 1)] = 1
        return rows
    reach = 4 if method == "lanczos" else 1
    centre = (np.arange(out) + 0.5) * scale - 0.5
    first = np.floor(centre).astype(int)
    for k in range(1 - reach, reach + 1):
        away = np.abs(centre - (first + k))
        weight = np.sinc(away) * np.sinc(away / reach) if method == "lanczos" else np.maximum(0, 1 - away)
        np.add.at(rows, (np.arange(out), np.clip(first + k, 0, n - 1)), weight)
    return rows / rows.sum(1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int, method: str = "area") -> np.ndarray:
    """area (linear where it enlarges), linear, lanczos (eight taps) or nearest."""
    x = img.reshape(*img.shape[:2], -1).astype(float)
    x = np.einsum("yh,hwc->ywc", _taps(x.shape[0], height, method), x)
    x = np.einsum("xw,ywc->yxc", _taps(x.shape[1], width, method), x)
    return saturate(x).reshape(height, width, *img.shape[2:])


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear interpolation at places (x, y)."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    h, w = img.shape[:2]
    at = lambda dy, dx: img[mirrored(y0 + dy, h), mirrored(x0 + dx, w)].astype(float)
    return saturate((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy)


def rotate(img: np.ndarray, angle: float) -> np.ndarray:
    """Counter-clockwise by degrees about the centre."""
    h, w = img.shape[:2]
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    x, y = np.meshgrid(np.arange(w) - w / 2, np.arange(h) - h / 2)
    return sample(img, c * x - s * y + w / 2, s * x + c * y + h / 2)


def border_colour(img: np.ndarray) -> np.ndarray:
    """Median of the four border lines by channel, corners twice, truncated."""
    lines = np.concatenate([img[0], img[-1], img[:, 0], img[:, -1]])
    return np.median(lines, axis=0).astype(np.uint8)


def paste(canvas: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """The tile in the middle of the canvas."""
    y, x = ((canvas.shape[i] - tile.shape[i]) // 2 for i in (0, 1))
    canvas[y : y + tile.shape[0], x : x + tile.shape[1]] = tile
    return canvas


def letterbox(img: np.ndarray, target: int, margin: int = 0, fit: str = "margin") -> np.ndarray | None:
    """The whole image on a square of its border's colour; None if a side shrinks to nothing.

    fit: `margin` keeps images that have the size already and truncates sides, `always` does so
    without the exception and never by area, `whole` rounds sides half to even, one pixel at least.
    """
    h, w = img.shape[:2]
    if fit == "margin" and h == w == target:
        return img
    scale = (target - 2 * margin) / max(h, w)
    size = [max(1, round(n * scale)) if fit == "whole" else int(n * scale) for n in (w, h)]
    if min(size) < 1:
        return None
    small = resize(img, *size, "area" if scale < 1 and fit != "always" else "lanczos")
    return paste(np.full((target, target, 3), border_colour(img), np.uint8), small)


def mosaic(tiles: list[np.ndarray | None], grid: int, canvas: int) -> np.ndarray:
    """Tiles row by row on black; a place without an image stays black."""
    if canvas % grid:
        raise ValueError("the grid must divide the canvas")
    side = canvas // grid
    out = np.zeros((canvas, canvas, 3), np.uint8)
    for i, tile in enumerate(tiles[: grid * grid]):
        if tile is not None:
            y, x = i // grid * side, i % grid * side
            out[y : y + side, x : x + side] = resize(tile, side, side, "area")
    return out


# --- filters ---------------------------------------------------------------------------------------


def gaussian_taps(size: int, sigma: float) -> np.ndarray:
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    return k / k.sum()


def convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Both axes with the same taps."""
    for axis in (0, 1):
        n = x.shape[axis]
        x = sum(t * np.take(x, mirrored(np.arange(n) + k - len(taps) // 2, n), axis=axis) for k, t in enumerate(taps))
    return x


def gaussian_blur(img: np.ndarray, size: int, sigma: float) -> np.ndarray:
    return saturate(convolve(img.astype(float), gaussian_taps(size, sigma)))


def _shifted(img: np.ndarray, window: np.ndarray, outside: int) -> Iterator[np.ndarray]:
    """The image moved to each place of a window of zeros and ones."""
    h, w = window.shape
    padded = np.pad(img, [(h // 2, h - h // 2 - 1), (w // 2, w - w // 2 - 1)] + [(0, 0)] * (img.ndim - 2), constant_values=outside)
    for y, x in np.argwhere(window):
        yield padded[y : y + img.shape[0], x : x + img.shape[1]]


def erode(img: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Least value under the window; what lies outside the image does not count."""
    out = np.full_like(img, 255)
    for part in _shifted(img, window, 255):
        np.minimum(out, part, out=out)
    return out


def dilate(img: np.ndarray, window: np.ndarray) -> np.ndarray:
    out = np.zeros_like(img)
    for part in _shifted(img, window[::-1, ::-1], 0):
        np.maximum(out, part, out=out)
    return out


def ellipse(size: int) -> np.ndarray:
    """A disc of ones as wide as the window in its middle row."""
    r = size // 2
    return np.array([[abs(x) <= round(r * math.sqrt(1 - (y / r) ** 2)) for x in range(-r, r + 1)] for y in range(-r, r + 1)]).astype(np.uint8)


def line_opening(mask: np.ndarray, length: int, axis: int) -> np.ndarray:
    """Opening by a line of ones: what belongs to a run of at least `length` along the axis stays."""
    rows = (mask > 0) if axis == 1 else (mask > 0).T
    out = np.zeros_like(rows)
    for i, row in enumerate(rows):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out[i, a:b] = b - a >= length
    return ((out if axis == 1 else out.T) * 255).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between both sides."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    below = np.cumsum(n)
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below)))
    return int(between.argmax())


def components(mask: np.ndarray) -> np.ndarray:
    """A label from 1 for each eight-connected part of a mask, 0 outside: runs of rows joined with those above."""
    out = np.zeros(mask.shape, np.int64)
    parent = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask > 0):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]]))).tolist()
        here = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            label = len(parent)
            parent.append(label)
            for c, d, other in above:
                if c <= b and a <= d:
                    i, j = find(label), find(other)
                    parent[max(i, j)] = min(i, j)
            here.append((a, b, label))
            out[y, a:b] = label
        above = here
    roots = np.array([find(i) for i in range(len(parent))])
    return np.unique(roots, return_inverse=True)[1].reshape(-1)[out]


# --- detection -------------------------------------------------------------------------------------


def content(img: np.ndarray, black: int = 20, share: float = 0.05) -> tuple[int, int, int, int] | None:
    """x, y, width, height of the rows and columns in which enough is not black; None if under five of either."""
    mask = (img > black).any(axis=2) if img.ndim == 3 else img > black
    rows, columns = (np.flatnonzero(mask.mean(axis=a) >= share) for a in (1, 0))
    if len(rows) < 5 or len(columns) < 5:
        return None
    return int(columns[0]), int(rows[0]), int(columns[-1] - columns[0] + 1), int(rows[-1] - rows[0] + 1)


def region(img: np.ndarray, margin: float = 0.04, black: int = 20) -> tuple[float, float, float, float]:
    """The sign in an image as a normalised box (xc, yc, w, h).

    Black padding is cut off; Otsu's level parts sign and ground; parts of over 1 % of the crop,
    counted in pixels, make the box, and the crop itself where none is left or the box is under 1 % of the image.
    """
    h, w = img.shape[:2]
    found = content(img, black)
    if found is None:
        return 0.5, 0.5, 0.9, 0.9
    if found[2] * found[3] / (w * h) > 0.95:
        found = (0, 0, w, h)
    x, y, cw, ch = found
    if cw < 5 or ch < 5:
        return 0.5, 0.5, 0.9, 0.9
    crop = gray(img)[y : y + ch, x : x + cw]
    dark = np.median(np.concatenate([crop[0], crop[-1], crop[:, 0], crop[:, -1]])) < 80
    soft = gaussian_blur(crop, 5, 1.1)
    binary = (((soft > otsu(soft)) == dark) * 255).astype(np.uint8)
    disc = ellipse(5)
    for step in (dilate, dilate, erode, erode, erode, dilate):  # two closings, one opening
        binary = step(binary, disc)
    labels = components(binary)
    big = np.flatnonzero(np.bincount(labels.ravel())[1:] > 0.01 * cw * ch) + 1
    box = found
    if len(big):
        ys, xs = np.nonzero(np.isin(labels, big))
        box = (x + int(xs.min()), y + int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1)
    if box[2] * box[3] / (w * h) < 0.01:
        box = found
    out = []
    for start, length, size in ((box[0], box[2], w), (box[1], box[3], h)):
        low, high = max(0, start - int(size * margin)), min(size, start + length + int(size * margin))
        out.append((min(max((low + high) / 2 / size, 0.0), 1.0), min(max((high - low) / size, 0.01), 1.0)))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def line_scores(img: np.ndarray, block: int = 15, offset: float = 4) -> tuple[int, int]:
    """Pixels of horizontal and of vertical lines, a third of the image long, that are darker than their surroundings."""
    g = gray(img).astype(float)
    edge = np.pad(g, block // 2, mode="edge")
    mean = convolve(edge, gaussian_taps(block, 0.3 * ((block - 1) * 0.5 - 1) + 0.8))[block // 2 : -(block // 2), block // 2 : -(block // 2)]
    mask = ((g <= np.rint(mean) - offset) * 255).astype(np.uint8)
    h, w = g.shape
    return tuple(int((line_opening(mask, max(1, n // 3), axis) > 0).sum()) for n, axis in ((w, 1), (h, 0)))


# --- contrast by tiles -------------------------------------------------------------------------------


def _lab(img: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (white D65) of BGR bytes."""
    x = img[..., ::-1] / 255.0
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    xyz = x @ _RGB_XYZ.T / _WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def _bgr(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    x = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE @ np.linalg.inv(_RGB_XYZ).T
    x = np.clip(x, 0, 1)
    return saturate(np.where(x > 0.0031308, 1.055 * x ** (1 / 2.4) - 0.055, 12.92 * x)[..., ::-1] * 255)


#: Linear RGB to XYZ, and the white point.
_RGB_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def equalised(x: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles, no level counting more than `limit` times the mean, mixed linearly between tiles."""
    h, w = x.shape
    padded = np.pad(x, [(0, -h % tiles), (0, -w % tiles)], mode="reflect" if min(h, w) > tiles else "edge")
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    most = max(1, int(limit * th * tw / 256))
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + extra // 256
            n[np.arange(extra % 256) * 256 // max(1, extra % 256)] += 1  # spread evenly
            maps[i, j] = np.rint(np.cumsum(n) * 255.0 / (th * tw))
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda dy, dx: maps[np.clip(y0 + dy, 0, tiles - 1)[:, None], np.clip(x0 + dx, 0, tiles - 1)[None, :], x]
    return saturate((at(0, 0) * (1 - wx) + at(0, 1) * wx) * (1 - wy) + (at(1, 0) * (1 - wx) + at(1, 1) * wx) * wy)


def clahe(img: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Tile-wise equalised lightness, colours kept."""
    lab = _lab(img)
    lab[..., 0] = equalised(saturate(lab[..., 0] * 2.55), limit, tiles) / 2.55
    return _bgr(lab)


# --- augmentation ------------------------------------------------------------------------------------


def brightness(img: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    return saturate(np.abs(img * alpha + beta))


def add_noise(img: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Noise is truncated to whole numbers first."""
    return np.clip(img.astype(np.int16) + noise.astype(np.int16), 0, 255).astype(np.uint8)


def dots(img: np.ndarray, at: np.ndarray, value: int) -> np.ndarray:
    out = img.copy()
    out[at[0], at[1]] = value
    return out


def shadow(img: np.ndarray, x: int, alpha: float) -> np.ndarray:
    """Columns from x on become lighter by 20 * alpha."""
    out = img.astype(float)
    out[:, x:] += 20 * alpha
    return saturate(out)


def elastic(img: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return sample(img, np.clip(x + dx, 0, w - 1), np.clip(y + dy, 0, h - 1))


def grain(img: np.ndarray, small: np.ndarray) -> np.ndarray:
    """92 % of the image with 8 % of a coarse texture."""
    return saturate(img * 0.92 + resize(small, img.shape[1], img.shape[0], "linear")[..., None] * 0.08)


def _waves(r: np.random.Generator, h: int, w: int, alpha: float, sigma: float) -> np.ndarray:
    size = 2 * round(4 * sigma) + 1
    return convolve(r.random((h, w)) * 2 - 1, gaussian_taps(size, sigma)) * alpha


def augment(img: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Geometry first, then light, then texture: fixed order, each step but two with its own chance."""
    h, w = img.shape[:2]
    out = rotate(img, r.uniform(-3, 3))
    if r.random() < 0.50:
        alpha, sigma = r.uniform(5, 9), r.uniform(4, 6)
        out = elastic(out, _waves(r, h, w, alpha, sigma), _waves(r, h, w, alpha, sigma))
    if r.random() < 0.45:
        out = erode(out, np.ones((3, 3), np.uint8))
    out = brightness(out, r.uniform(0.88, 1.32), int(r.integers(-15, 16)))
    if r.random() < 0.45:
        out = gaussian_blur(out, 3, r.uniform(0.3, 0.7))
    if r.random() < 0.65:
        out = add_noise(out, r.normal(0, r.uniform(3, 8), out.shape))
    if r.random() < 0.60:
        n = int(r.uniform(0.0005, 0.008) * out.size * 0.5)
        for value in (255, 0):
            out = dots(out, np.stack([r.integers(0, h, n), r.integers(0, w, n)]), value)
    if r.random() < 0.55:
        out = grain(out, r.integers(0, 25, (max(1, h // 6), max(1, w // 6))).astype(np.uint8))
    if r.random() < 0.45:
        out = shadow(out, int(r.integers(0, w // 2 + 1)), r.uniform(0.06, 0.24))
    return out


# --- previews ----------------------------------------------------------------------------------------

#: Colours of a box, of a suspicious one and of the strip of an image without boxes, BGR.
BOX, SUSPICIOUS, MISSING = (0, 200, 0), (0, 80, 220), (0, 80, 220)


def draw(img: np.ndarray, boxes: list[tuple[int, int, int, int, bool]]) -> np.ndarray:
    """Boxes (x1, y1, x2, y2, suspicious) as frames two pixels wide on the image, three times as large up to 224 pixels.

    Captions are the caller's; an image without boxes gets a coloured strip at the top.
    """
    scale = 3 if img.shape[1] <= 224 else 1
    out = np.repeat(np.repeat(img, scale, axis=0), scale, axis=1)
    h, w = out.shape[:2]
    for x1, y1, x2, y2, bad in boxes:
        ink = np.zeros((h, w), bool)
        a, b, c, d = (v * scale for v in (x1, y1, x2, y2))
        ink[max(0, b - 1) : max(0, d + 1), max(0, a - 1) : max(0, c + 1)] = True
        ink[b + 1 : max(b + 1, d - 1), a + 1 : max(a + 1, c - 1)] = False
        out[ink] = SUSPICIOUS if bad else BOX
    if not boxes:
        out[:4] = MISSING
    return out


# --- over rows ---------------------------------------------------------------------------------------


def decoded(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """Three channels of an image row: gray is repeated, transparency dropped."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.ascontiguousarray(np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3])


def generator(seed: int, key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{key}".encode()).digest()[:8], "little"))


def over_images(images: DataFrame, kernel: Callable[[np.ndarray, np.random.Generator], object], columns: str, seed: int = 42, key: str = "path", spread: int = 0) -> DataFrame:
    """key and what the kernel makes of each readable image of (key, width, height, channels, data).

    columns names the kernel's results; a kernel that returns an image (columns `image`) gives width,
    height, channels and data. Images without data, and those the kernel refuses with None, give no row.
    One Arrow stage, no shuffle: a batch of rows at a time, an image at a time within it. spread: deal the images
    to so many tasks first, for slow kernels on a table that has fewer splits.
    """
    from pyspark.sql.types import StructType

    as_image = columns == "image"
    kind = images.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ("width int, height int, channels int, data binary" if as_image else columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for k, w, h, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if data is None or not w or not h:
                    continue
                got = kernel(decoded(w, h, c, data), generator(seed, k))
                if got is None:
                    continue
                rows.append([k, *((got.shape[1], got.shape[0], 3, np.ascontiguousarray(got).tobytes()) if as_image else got)])
            fields = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    from pyspark.sql.pandas.types import to_arrow_type

    parsed = StructType.fromDDL(schema)
    out = [(f.name, to_arrow_type(f.dataType)) for f in parsed]
    rows = images.select(key, "width", "height", "channels", "data")
    return (rows.repartition(spread) if spread else rows).mapInArrow(run, parsed)


def chw(img: np.ndarray) -> np.ndarray:
    """Values over 255 as float32, channels first, with a leading axis for the batch."""
    return (img.astype(np.float32) / 255).transpose(2, 0, 1)[None]
