"""Dataset health audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.expressions import bar, percent, tier


def health(images: DataFrame, files: DataFrame, lines: DataFrame, classes: int = 150, unknown: int = 120, low: int = 10, group: str | None = None) -> DataFrame:
    """Per group or in all: images, label files, empty ones, instances and their mean per label file, invalid ids,
    classes without and with under `low` instances, share of the unknown class and whether it exceeds a tenth.

    images: image_id (and group); files: image_id, empty (no line); lines: image_id, n_tokens, cls_id.
    Lines of under five tokens do not count; out-of-range ids are invalid, not instances.
    """
    if group:
        return health_in_all(images, files, lines, group, classes, unknown, low).where(F.col(group).isNotNull())
    one = F.count(F.lit(1))
    of = images.agg(one.alias("n_images")).crossJoin(files.agg(one.alias("n_label_files"), F.count_if("empty").alias("n_empty")))  # a row each
    counts = _long_enough(lines).groupBy("cls_id").agg(one.alias("n")).where("cls_id is not null")
    return _shares(of.crossJoin(counts.agg(*_class_figures(classes, unknown, low))))


def health_in_all(images: DataFrame, files: DataFrame, lines: DataFrame, group: str, classes: int = 150, unknown: int = 120, low: int = 10) -> DataFrame:
    """health() of every group and, with null as the group, of all, from one pass.

    Files and lines meet images by id, and are counted by group and class before anything else; grouping sets then
    work on these few counts. Files and lines without an image, and images without a group, count in all only.
    """
    of = images.select("image_id", F.col(group).alias("part"))
    facts = _facts(of.select("part"), files.join(of, "image_id", "left").select("part", "empty"), _long_enough(lines).join(of, "image_id", "left").select("part", "cls_id"))
    by = facts.groupingSets([["part", "cls_id"], ["cls_id"]], "part", "cls_id").agg(*(F.sum(c).alias(c) for c in AMOUNTS), F.grouping("part").alias("whole"))
    of = by.where("whole = 1 or part is not null").groupBy("part", "whole")
    out = of.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AMOUNTS[:3]), *_class_figures(classes, unknown, low))
    return _shares(out.drop("whole")).withColumnRenamed("part", group)


def _long_enough(lines: DataFrame) -> DataFrame:
    """image_id, cls_id: -1 for what is no number, null for short lines; those go with their count, as a filter here would parse lines twice."""
    return lines.select("image_id", F.when(F.col("n_tokens") >= 5, F.coalesce(F.col("cls_id").cast("long"), F.lit(-1))).alias("cls_id"))


AMOUNTS = ("n_images", "n_label_files", "n_empty", "n")


def _facts(images: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """part, cls_id (null but for lines) and the AMOUNTS, counted for each of the three on its own: a few rows for each part and class."""
    one = F.count(F.lit(1))
    counted = [
        images.groupBy("part").agg(one.alias("n_images")),
        files.groupBy("part").agg(one.alias("n_label_files"), F.count_if("empty").alias("n_empty")),
        lines.groupBy("part", "cls_id").agg(one.alias("n")).where("cls_id is not null"),
    ]
    full = [d.select("part", *(F.col(c) if c in d.columns else F.lit(None).cast("long").alias(c) for c in ("cls_id", *AMOUNTS))) for d in counted]
    return full[0].unionByName(full[1]).unionByName(full[2])


def _class_figures(classes: int, unknown: int, low: int) -> list[Column]:
    """Aggregates of counts n by class."""
    valid = F.col("cls_id").between(0, classes - 1)
    total = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name)
    levels = [(classes - F.count_if(valid)).alias("n_zero"), F.count_if(valid & (F.col("n") < low)).alias("n_low")]
    return [total(valid, "n_instances"), total(~valid, "n_invalid"), total(F.col("cls_id") == unknown, "n_unknown"), *levels]


def _shares(df: DataFrame) -> DataFrame:
    df = df.withColumns({"avg_per_file": F.col("n_instances") / F.greatest("n_label_files", F.lit(1)), "unknown_pct": percent(F.col("n_unknown"), F.col("n_instances"))})
    return df.withColumn("unknown_warning", F.col("unknown_pct") > 10)


def class_levels(counts: DataFrame, low: int = 10) -> DataFrame:
    """level of zero-filled class counts: zero, low or ok."""
    return counts.withColumn("level", F.when(F.col("n") == 0, "zero").when(F.col("n") < low, "low").otherwise("ok"))


def top(counts: DataFrame, by: str, key: str, k: int) -> DataFrame:
    return counts.orderBy(F.col(by).desc(), key).limit(k)


def bottom(counts: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k least above 0, shown from the greatest down, ties by key as in top()."""
    return counts.where(F.col(by) > 0).orderBy(by, F.col(key).desc()).limit(k).orderBy(F.col(by).desc(), key)


def with_bars(counts: DataFrame, per: int, most: int | None = None, least: int = 0) -> DataFrame:
    """A bar of one block for each `per`, between least and most blocks."""
    return counts.withColumn("bar", bar(F.col("n"), 1 / per, most, least))


def first(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows in an order."""
    return rows.orderBy(*order).limit(k)


def detections_by_image(detections: DataFrame, image: str = "image_id", place: str = "place") -> DataFrame:
    """image, n, found: an image's detections (name, conf, bar, tier) in the model's order. A detector caps them, so they fit a row."""
    item = F.struct(F.col(place).alias("place"), "name", "conf", bar(F.col("conf")).alias("bar"), tier(F.col("conf")).alias("tier"))
    return detections.groupBy(image).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("found"))


def worst_best(scores: DataFrame, by: str, key: str, worst: int = 20, best: int = 10) -> DataFrame:
    """The lowest and the highest rows, tagged."""
    a = scores.orderBy(by, key).limit(worst).withColumn("side", F.lit("worst"))
    return a.unionByName(scores.orderBy(F.col(by).desc(), key).limit(best).withColumn("side", F.lit("best")))
