"""Scores, confusion matrices and non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def class_maxima(scores: DataFrame) -> DataFrame:
    return scores.groupBy("cls").agg(F.max("score").alias("best"))


def distribution(scores: DataFrame) -> DataFrame:
    """Minimum, maximum, mean (to nine decimals) and counts above .25, .50 and .80."""
    over = [F.count_if(F.col("score") > t).alias(f"over_{int(t * 100)}") for t in (0.25, 0.50, 0.80)]
    return scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("n"), F.round(F.avg(F.col("score").cast("double")), 9).alias("mean"), *over)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("row_label"), F.col(pred).alias("col_label")).agg(F.count(F.lit(1)).alias("n"))


def normalised(cells: DataFrame, labels: int) -> DataFrame:
    """All cells of the matrix as shares of their row's sum, 0 in rows without counts."""
    spark = cells.sparkSession
    grid = spark.range(labels * labels).select(F.floor(F.col("id") / labels).alias("row_label"), (F.col("id") % labels).alias("col_label"))
    df = grid.join(cells, ["row_label", "col_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy("row_label"))
    return df.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def nms(detections: DataFrame, iou: float = 0.30, conf: float = 0.25) -> DataFrame:
    """Greedy suppression per image and class: the surest box goes first and drops those that overlap it by more than iou.

    Ties in conf go by corners. An image's boxes of a class are few (a detector caps them), so they are
    one array, sorted and folded within the row: no Python, and one shuffle by image and class.
    """
    found = detections.where(F.col("conf") >= conf)
    keys, corners = ["image_id", "cls_id"], ["x1", "y1", "x2", "y2"]
    box = F.struct((-F.col("conf")).alias("order"), *corners, "conf")
    rows = found.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    area = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))

    def drops(a: Column, b: Column) -> Column:
        side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0))
        both = side("x1", "x2") * side("y1", "y2")
        return both > F.lit(iou) * F.greatest(area(a) + area(b) - both, F.lit(1e-12))

    one = F.slice("boxes", 1, 1)
    folded = F.aggregate(F.slice("boxes", F.lit(2), F.greatest(F.size("boxes") - 1, F.lit(0))), one, lambda kept, b: F.when(F.exists(kept, lambda k: drops(k, b)), kept).otherwise(F.array_append(kept, b)))
    kept = rows.select(*keys, F.explode(F.when(F.size("boxes") == 1, F.col("boxes")).otherwise(folded)).alias("b"))
    return kept.select(*keys, "b.conf", *(f"b.{c}" for c in corners))


def content_shares(pixels: DataFrame, key: str, width: int, black: float, least: float = 0.05) -> DataFrame:
    """key, line (row or column), at, share, for lines with enough pixels above black; pixels: key, pos, value."""
    bright = F.avg((F.col("value") > black).cast("double")).alias("share")
    row = pixels.groupBy(key, F.floor(F.col("pos") / width).cast("int").alias("at")).agg(bright).withColumn("line", F.lit("row"))
    column = pixels.groupBy(key, (F.col("pos") % width).cast("int").alias("at")).agg(bright).withColumn("line", F.lit("column"))
    return row.unionByName(column).where(F.col("share") >= least)


def content_extent(shares: DataFrame, key: str) -> DataFrame:
    """First and last row and column with content."""
    return shares.groupBy(key, "line").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def mask_score(pixels: DataFrame, key: str) -> DataFrame:
    """Pixels that a mask of 0 and 255 sets."""
    return pixels.groupBy(key).agg((F.sum("value") / 255).alias("score"))


def as_matrix(cells: DataFrame, labels: list[int], value: str) -> DataFrame:
    """Cells in wide form: a row for each label, a column for each of the labels given (a dimension)."""
    return cells.groupBy("row_label").pivot("col_label", labels).agg(F.first(value)).na.fill(0)


def border_median(pixels: DataFrame, key: str, size: int) -> DataFrame:
    """Median of the four border lines of square grids (corners count twice), truncated; pixels: key, pos, value."""
    row, col = F.floor(F.col("pos") / size), F.col("pos") % size
    times = F.when(row.isin(0, size - 1), 1).otherwise(0) + F.when(col.isin(0, size - 1), 1).otherwise(0)
    seen = pixels.withColumn("times", times).where("times > 0")
    return seen.groupBy(key).agg(F.expr("percentile(value, 0.5, times)").cast("int").alias("median"))

