"""Image kernels against loops over pixels, closed forms and properties."""

import math

import numpy as np
import pytest

from tesselon.operators import geometry, kernels
from tesselon.sources import jpeg, sinks, tables

R = np.random.default_rng(3)
IMG = R.integers(0, 256, (13, 17, 3)).astype(np.uint8)


def at(img, y, x):
    """A pixel, places outside mirrored about the edge pixel."""
    h, w = img.shape[:2]
    while not 0 <= y < h:
        y = -y if y < 0 else 2 * h - 2 - y
    while not 0 <= x < w:
        x = -x if x < 0 else 2 * w - 2 - x
    return img[y, x].astype(float)


def test_brightness_shadow_noise_dots():
    got = kernels.brightness(IMG, 1.2, -15)
    assert all(got[y, x, c] == min(255, round(abs(1.2 * int(IMG[y, x, c]) - 15))) for y in range(13) for x in range(17) for c in range(3))
    lit = kernels.shadow(IMG, 5, 0.2)
    assert (lit[:, :5] == IMG[:, :5]).all() and (lit[:, 5:] == np.minimum(255, IMG[:, 5:].astype(int) + 4)).all()
    noise = R.normal(0, 8, IMG.shape)
    assert (kernels.add_noise(IMG, noise) == np.clip(IMG.astype(int) + np.trunc(noise).astype(int), 0, 255)).all()
    spots = kernels.dots(IMG, np.array([[0, 3], [1, 4]]), 255)
    assert (spots[0, 1] == 255).all() and (spots[3, 4] == 255).all() and (spots != IMG).any(axis=2).sum() <= 2


def test_erosion_and_dilation():
    window = np.ones((3, 3), np.uint8)
    low, high = kernels.erode(IMG, window), kernels.dilate(IMG, window)
    for y in range(13):
        for x in range(17):
            part = IMG[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].reshape(-1, 3)
            assert (low[y, x] == part.min(0)).all() and (high[y, x] == part.max(0)).all()
    disc = kernels.ellipse(5)
    assert disc.sum(1).tolist()[2] == 5 and (disc == disc[::-1]).all() and (disc == disc.T).all() or disc[0].sum() == 1


def test_blur():
    taps = kernels.gaussian_taps(3, 0.6)
    got = kernels.gaussian_blur(IMG, 3, 0.6)
    for y in (0, 5, 12):
        for x in (0, 8, 16):
            want = sum(taps[i] * taps[j] * at(IMG, y + i - 1, x + j - 1) for i in range(3) for j in range(3))
            assert (abs(got[y, x] - want) <= 0.5 + 1e-9).all()


def test_resizing():
    double = kernels.resize(IMG, 34, 26, "nearest")
    assert (double == IMG.repeat(2, 0).repeat(2, 1)).all() and (kernels.resize(double, 17, 13, "area") == IMG).all()
    flat = np.full((9, 7, 3), 77, np.uint8)
    assert all((kernels.resize(flat, 20, 5, m) == 77).all() for m in ("area", "linear", "lanczos", "nearest"))
    small = kernels.resize(IMG, 5, 4, "area")
    edges_y, edges_x = np.arange(5) * 13 / 4, np.arange(6) * 17 / 5
    total = 0.0
    for y in range(13):
        for x in range(17):
            total += max(0, min(edges_y[2], y + 1) - max(edges_y[1], y)) * max(0, min(edges_x[3], x + 1) - max(edges_x[2], x)) * IMG[y, x].astype(float)
    assert (abs(small[1, 2] - total / (13 / 4 * 17 / 5)) <= 0.5 + 1e-9).all()


def test_rotation_and_elastic():
    assert (kernels.rotate(IMG, 0.0) == IMG).all()
    odd = R.integers(0, 256, (11, 11, 3)).astype(np.uint8)
    quarter = kernels.rotate(odd, 90.0)
    assert quarter.shape == odd.shape and not (quarter == odd).all()
    zero = np.zeros((13, 17))
    assert (kernels.elastic(IMG, zero, zero) == IMG).all() and (kernels.elastic(IMG, zero + 1, zero)[:, :-1] == IMG[:, 1:]).all()
    half = kernels.sample(IMG, np.array([[2.5]]), np.array([[3.0]]))[0, 0]
    assert (abs(half - (IMG[3, 2].astype(float) + IMG[3, 3]) / 2) <= 0.5).all()


def test_letterboxes_follow_their_plans(spark):
    sizes = [(1, 17, 13), (2, 300, 40), (3, 224, 224), (4, 3, 700)]
    df = spark.createDataFrame(sizes, "image_id int, width int, height int")
    plan = {r.image_id: r for r in geometry.letterbox_margin(df).collect()}
    assert plan[3].status == "same" and (plan[3].new_w, plan[3].off_x) == (224, 0)
    for i, w, h in sizes:
        img = R.integers(1, 255, (h, w, 3)).astype(np.uint8)
        got = kernels.letterbox(img, 224, 6)
        if plan[i].status == "reject":
            assert got is None
            continue
        r = plan[i]
        assert got.shape == (224, 224, 3)
        if r.status == "same":
            assert (got == img).all()
            continue
        ground = kernels.border_colour(img)
        inside = np.zeros((224, 224), bool)
        inside[r.off_y : r.off_y + r.new_h, r.off_x : r.off_x + r.new_w] = True
        assert (got[~inside] == ground).all()
    assert kernels.letterbox(np.full((1, 256, 3), 9, np.uint8), 640, fit="whole").shape == (640, 640, 3)
    assert kernels.letterbox(np.full((224, 224, 3), 9, np.uint8), 224, 6, "always").shape == (224, 224, 3)


def test_mosaic():
    tiles = [np.full((8, 8, 3), v, np.uint8) for v in (1, 2, 3)] + [None]
    got = kernels.mosaic(tiles, 2, 16)
    assert [int(got[y, x, 0]) for y, x in ((0, 0), (0, 8), (8, 0), (8, 8))] == [1, 2, 3, 0]
    with pytest.raises(ValueError):
        kernels.mosaic(tiles, 3, 16)


def test_components_and_otsu_and_lines():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], np.uint8)
    got = kernels.components(mask)
    assert got[0, 0] == got[1, 1] and len(np.unique(got)) == 5 and (got > 0).sum() == mask.sum()
    u = np.ones((4, 5), np.uint8)
    u[:3, 1:4] = 0
    u[:3, 2] = 1
    assert len(np.unique(kernels.components(u))) == 2  # parts that meet only in the last row are one
    two = np.concatenate([np.full(50, 30), np.full(70, 200)]).astype(np.uint8).reshape(10, 12)
    assert 30 <= kernels.otsu(two) < 200
    lines = np.zeros((6, 12), np.uint8)
    lines[2, 1:9] = 255
    lines[4, 1:4] = 255
    kept = kernels.line_opening(lines, 4, 1)
    assert (kept[2] == lines[2]).all() and not kept[4].any() and not kernels.line_opening(lines, 4, 0).any()


def test_region_finds_a_sign_on_padding():
    img = np.zeros((120, 160, 3), np.uint8)
    img[10:110, 20:140] = 180
    img[40:80, 60:100] = 40
    xc, yc, w, h = kernels.region(img, 0.0)
    assert math.isclose(xc, 0.5, abs_tol=0.02) and math.isclose(yc, 0.5, abs_tol=0.02) and abs(w - 40 / 160) < 0.05 and abs(h - 40 / 120) < 0.06
    assert kernels.region(np.zeros((50, 50, 3), np.uint8)) == (0.5, 0.5, 0.9, 0.9)
    assert kernels.content(img) == (20, 10, 120, 100)


def test_line_scores_tell_rows_from_columns():
    img = np.full((90, 90, 3), 220, np.uint8)
    img[10::20] = 20
    h, v = kernels.line_scores(img)
    assert h > 300 and v == 0
    assert kernels.line_scores(img.transpose(1, 0, 2)) == (v, h)


def test_contrast_by_tiles():
    flat = np.full((64, 64), 100, np.uint8)
    assert len(np.unique(kernels.equalised(flat))) == 1
    noisy = R.integers(100, 140, (256, 256)).astype(np.uint8)
    assert kernels.equalised(noisy).std() > 1.5 * noisy.std()
    colours = R.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert abs(kernels._bgr(kernels._lab(colours)).astype(int) - colours).max() <= 1
    assert kernels.clahe(colours).shape == colours.shape


def test_augmentation_depends_on_seed_and_key_only():
    a, b, c = (kernels.augment(IMG, kernels.generator(s, k)) for s, k in ((1, "x"), (1, "x"), (1, "y")))
    assert (a == b).all() and a.shape == IMG.shape and (a != c).any()


def test_drawing():
    small = kernels.draw(IMG, [(2, 2, 6, 8, False), (-5, -5, 3, 3, True)])
    assert small.shape == (39, 51, 3) and tuple(small[12, 6]) == kernels.BOX and (kernels.draw(IMG, [])[0, 0] == kernels.MISSING).all()


def test_over_images(spark, tmp_path):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    four = np.dstack([gray] * 4)
    rows = [("a", 4, 3, 1, bytearray(gray.tobytes())), ("b", 4, 3, 4, bytearray(four.tobytes())), ("c", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")
    got = {r.path: r for r in tables.colour_images(df).collect()}
    assert set(got) == {"a", "b"} and bytes(got["a"].data) == np.dstack([gray] * 3).tobytes() == bytes(got["b"].data)
    marks = spark.createDataFrame([("a", 0, 0, 2, 2, True)], "path string, x1 int, y1 int, x2 int, y2 int, suspicious boolean")
    pngs = sinks.previews(df, marks)
    assert sinks.write_files(pngs, str(tmp_path)) == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["a_bbox.png", "b_bbox.png"]
    back = {r.path.rsplit("/", 1)[-1]: r for r in tables.read_images(spark, str(tmp_path)).collect()}
    assert (back["a_bbox.png"].width, back["a_bbox.png"].height) == (12, 9)
    sizes = {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in tables.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes["a_bbox.png"] == (12, 9)
    for form in ("jpg", "png"):
        sinks.write_files(sinks.encoded(df, form), str(tmp_path / form))
        assert {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in tables.read_images(spark, str(tmp_path / form)).collect()} == {f"a.{form}": (4, 3), f"b.{form}": (4, 3)}
    assert bytes(back["b_bbox.png"].data)[12 * 3 * 5 : 12 * 3 * 5 + 3] == bytes(four[1, 0, :3])


def test_channels_first():
    got = kernels.chw(IMG)
    assert got.shape == (1, 3, 13, 17) and got.dtype == np.float32 and math.isclose(got[0, 1, 2, 3], IMG[2, 3, 1] / 255, rel_tol=1e-6)


@pytest.mark.parametrize(("w", "h"), [(17, 13), (64, 40), (8, 8), (1, 1)])
def test_jpeg_as_a_decoder_sees_it(spark, tmp_path, w, h):
    y, x = np.mgrid[0:h, 0:w]
    smooth = np.stack([128 + 90 * np.sin(x / 9 + k) * np.cos(y / 7) for k in range(3)], axis=-1).astype(np.uint8)
    noisy = R.integers(0, 256, (h, w, 3)).astype(np.uint8)
    for name, img in (("smooth", smooth), ("noisy", noisy)):
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(img, 95))
    got = {r.path.rsplit("/", 1)[-1]: r for r in tables.read_images(spark, str(tmp_path)).collect()}
    for name, img, most in (("smooth", smooth, 3), ("noisy", noisy, 12)):
        back = np.frombuffer(bytes(got[f"{name}.jpg"].data), np.uint8).reshape(h, w, 3).astype(float)
        assert np.sqrt(((back - img) ** 2).mean()) < most
    sizes = {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in tables.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes["smooth.jpg"] == (w, h)


def test_jpeg_codes():
    lengths = jpeg.code_lengths({i: 2**i for i in range(30)})
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    assert (jpeg.quantisers(50)[0] == np.array(jpeg.BRIGHT.split(), int)).all() and jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    assert np.allclose(jpeg.COSINES @ jpeg.COSINES.T, np.eye(8))
