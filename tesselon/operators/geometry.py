"""Boxes, letterboxes and tiles. int() of the source formulas truncates; so does a cast here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.expressions import clip


def pixel_boxes(df: DataFrame) -> DataFrame:
    """x1, y1, x2, y2: corners cut off on one side each, so a box outside the image can end before it begins."""

    def corner(c: str, s: str, size: str, sign: int) -> Column:
        return ((F.col(c) + sign * F.col(s) / 2) * F.col(size)).cast("int")

    low = lambda c, s, size: F.greatest(F.lit(0), corner(c, s, size, -1))
    high = lambda c, s, size: F.least(F.col(size), corner(c, s, size, 1))
    return df.withColumns({"x1": low("xc", "bw", "width"), "y1": low("yc", "bh", "height"), "x2": high("xc", "bw", "width"), "y2": high("yc", "bh", "height")})


def normalised_roi(df: DataFrame, margin: float = 0.04) -> DataFrame:
    """cx, cy, w, h of corner boxes widened by a margin and clipped to the image."""
    out = {}
    for axis, a, b, size in (("x", "x1", "x2", "width"), ("y", "y1", "y2", "height")):
        pad = ((F.col(b) - F.col(a)) * margin).cast("int")
        low, high = F.greatest(F.lit(0), F.col(a) - pad), F.least(F.col(size), F.col(b) + pad)
        out[f"c{axis}"] = clip((low + high) / 2.0 / F.col(size), 0.0, 1.0)
        out["w" if axis == "x" else "h"] = clip((high - low) / F.col(size), 0.01, 1.0)
    return df.withColumns(out)


def tile_remap(boxes: DataFrame, slot: Column, grid: int = 8, canvas: int = 640) -> DataFrame:
    """Boxes of a tile in canvas coordinates; slot is the tile's position, row by row."""
    if canvas % grid:
        raise ValueError("the grid must divide the canvas")
    share = canvas // grid / canvas
    row, col = F.floor(slot / grid), slot % grid
    return boxes.withColumns(
        {"tile_row": row, "tile_col": col.cast("long"), "nx": clip(col * share + F.col("xc") * share, 0.0, 1.0), "ny": clip(row * share + F.col("yc") * share, 0.0, 1.0), "nw": clip(F.col("bw") * share, 0.001, 1.0), "nh": clip(F.col("bh") * share, 0.001, 1.0)}
    )


def letterbox_margin(images: DataFrame, target: int = 224, margin: int = 6) -> DataFrame:
    """new_w, new_h, off_x, off_y, method, status; a side that shrinks to nothing is a reject.

    An image that has the size already stays as it is, without a margin.
    """
    same = (F.col("width") == target) & (F.col("height") == target)
    scale = F.when(same, 1.0).otherwise(F.lit(target - 2 * margin) / F.greatest("width", "height"))
    df = images.withColumns({"scale": scale, "new_w": (F.col("width") * scale).cast("int"), "new_h": (F.col("height") * scale).cast("int")})
    status = F.when(same, "same").when((F.col("new_w") < 1) | (F.col("new_h") < 1), "reject").otherwise("resize")
    return df.select("image_id", "new_w", "new_h", *_offsets(target), F.when(same, "none").when(F.col("scale") < 1, "area").otherwise("lanczos").alias("method"), status.alias("status"))


def letterbox_fit(images: DataFrame, target: int = 640) -> DataFrame:
    """As above without a margin; sides are rounded half to even and at least 1."""
    scale = F.least(F.lit(target) / F.col("width"), F.lit(target) / F.col("height"))
    side = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))
    return images.withColumns({"new_w": side("width"), "new_h": side("height")}).select("image_id", "new_w", "new_h", *_offsets(target))


def letterbox_always(images: DataFrame, target: int = 224, margin: int = 6) -> DataFrame:
    """As with a margin, but images of the size are no exception and none is reduced by area."""
    scale = F.lit(target - 2 * margin) / F.greatest("width", "height")
    df = images.withColumns({"new_w": (F.col("width") * scale).cast("int"), "new_h": (F.col("height") * scale).cast("int")})
    status = F.when((F.col("new_w") < 1) | (F.col("new_h") < 1), "reject").otherwise("resize")
    return df.select("image_id", "new_w", "new_h", *_offsets(target), F.lit("lanczos").alias("method"), status.alias("status"))


def stretch(images: DataFrame, target: int = 224) -> DataFrame:
    """image_id, new_w, new_h, factors by which sides change: both sides become the target."""
    return images.select("image_id", F.lit(target).alias("new_w"), F.lit(target).alias("new_h"), (F.lit(target) / F.col("width")).alias("x_factor"), (F.lit(target) / F.col("height")).alias("y_factor"))


def content_region(boxes: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 of content boxes (in images width x height) and what was made of them.

    Content of over 95 % of the image is the whole image (`whole`); under 1 % is too little to be a sign: the
    whole image again (`fallback`).
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("width") * F.col("height"))
    kind = F.when(area > 0.95, "whole").when(area < 0.01, "fallback").otherwise("sign")
    df = boxes.withColumns({"share": area, "kind": kind})
    whole = F.col("kind") != "sign"
    return df.withColumns({"x1": F.when(whole, F.lit(0)).otherwise(F.col("x1")), "y1": F.when(whole, F.lit(0)).otherwise(F.col("y1")), "x2": F.when(whole, F.col("width")).otherwise(F.col("x2")), "y2": F.when(whole, F.col("height")).otherwise(F.col("y2"))})


def is_fallback(w: Column, h: Column) -> Column:
    """Whether a box looks like the answer of a detector that found nothing."""
    return (w > 0.87) & (h > 0.87)


def anchors(size: Column, strides: tuple[int, ...] = (8, 16, 32)) -> Column:
    """Anchors of a square input: one for each cell of each stride's grid."""
    return sum((F.floor(size / s) * F.floor(size / s) for s in strides[1:]), F.floor(size / strides[0]) * F.floor(size / strides[0]))


def output_fits(channels: Column, found: Column, classes: int, size: Column) -> Column:
    """Whether a model's output has four channels and one for each class, and the anchors of its input."""
    return (channels == 4 + classes) & (found == anchors(size))


def draw_scale(width: Column) -> Column:
    return F.when(width <= 224, 3).otherwise(1)


def _offsets(target: int) -> list[Column]:
    return [F.floor((target - F.col(c)) / 2).cast("int").alias(o) for c, o in (("new_w", "off_x"), ("new_h", "off_y"))]


def strip_segments(images: DataFrame, columns: int = 10, least: int = 50) -> DataFrame:
    """Column strips cut into segments of h // 25 * 4 rows; segments of `least` rows or fewer go, as do images under 25 rows."""
    df = images.where("height >= 25").withColumns({"col_w": F.floor(F.col("width") / columns), "step": F.floor(F.col("height") / 25) * 4})
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("col"))
    df = df.select("*", F.explode(F.expr("sequence(0L, height - 1, step)")).alias("y"))
    return df.withColumn("seg_h", F.least(F.col("step"), F.col("height") - F.col("y"))).where(F.col("seg_h") > least).select("image_id", "col", (F.col("col") * F.col("col_w")).alias("x"), "y", "col_w", "seg_h")


def sliding_tiles(images: DataFrame, size: int = 640, overlap: float = 0.25) -> DataFrame:
    """Tiles with an overlap; the last of a row or column is moved back to the edge."""
    step = int(size * (1 - overlap))

    def starts(c: str) -> Column:
        n = F.when(F.col(c) <= size, F.lit(1)).otherwise(F.ceil((F.col(c) - size) / step) + 1)
        return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.greatest(F.lit(0), F.least(i * step, F.col(c) - size)))

    df = images.select("*", F.explode(starts("width")).alias("x"))
    return df.select("*", F.explode(starts("height")).alias("y")).select("image_id", "x", "y", F.least(F.lit(size), F.col("width")).alias("tile_w"), F.least(F.lit(size), F.col("height")).alias("tile_h"))


def layout(h: Column, v: Column) -> Column:
    return F.when((h > 500) & (h > 1.5 * v), "rows").when((v > 500) & (v > 1.5 * h), "columns").otherwise("rows")
