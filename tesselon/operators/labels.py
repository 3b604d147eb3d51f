"""Label lines, boxes and class ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselon.functions.expressions import bar, natural_key

CLASSES = 150


def parse_lines(lines: DataFrame, rule: str = "exact5") -> DataFrame:
    """Adds tokens, n_tokens, cls_id, xc, yc, bw, bh; keeps lines with exactly five, at least five, or any tokens.

    A token that is not a number gives null instead of an error.
    """
    keep = {"exact5": F.col("n_tokens") == 5, "min5": F.col("n_tokens") >= 5, "nonempty": F.col("n_tokens") > 0}[rule]
    df = _tokenised(lines).where(keep)
    token = lambda i: F.get("tokens", F.lit(i))
    return df.withColumns({"cls_id": token(0).try_cast("int")} | {n: token(i + 1).try_cast("double") for i, n in enumerate(("xc", "yc", "bw", "bh"))})


def _clean() -> Column:
    """The line with plain blanks only, none at its ends; no regular expression."""
    return F.trim(F.translate("line", "\t\r\f\x0b", "    "))


def _tokenised(lines: DataFrame) -> DataFrame:
    df = lines.withColumn("tokens", F.array_remove(F.split(_clean(), " "), ""))
    return df.withColumn("n_tokens", F.size("tokens"))


def line_classes(lines: DataFrame) -> DataFrame:
    """lines with n_tokens and cls_id only, none left out; cls_id needs no cutting up."""
    return lines.withColumns({"n_tokens": F.size(F.array_remove(F.split(_clean(), " "), "")), "cls_id": F.substring_index(_clean(), " ", 1).try_cast("int")}).drop("line")


def named(boxes: DataFrame, names: DataFrame, beyond: str = "OUT OF RANGE") -> DataFrame:
    """boxes with class_name of their cls_id; ids that names (cls_id, class_name; a dimension) lacks get a fixed text."""
    return boxes.join(names.select("cls_id", "class_name"), "cls_id", "left").withColumn("class_name", F.coalesce("class_name", F.lit(beyond)))


def ids_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the cls_id of their class_name, null for names that are not in the dimension."""
    return rows.join(names.select("class_name", "cls_id"), "class_name", "left")


def boxes_of_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every image with its boxes; one without a label file or box has one row with null box columns."""
    return images.join(boxes, "image_id", "left")


def same_folder(folders: DataFrame, only: str) -> DataFrame:
    """Folders of one name, whatever its case; none is an error."""
    found = folders.where(F.lower("class_name") == only.lower())
    if found.isEmpty():
        raise ValueError(f"no folder is named {only}")
    return found


def availability(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """class_name, n, bar for each wanted class (a dimension), 0 where it has no file; no file at all is an error."""
    n = files.join(wanted.select("class_name"), "class_name", "left_semi").groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    out = wanted.select("class_name").distinct().join(n, "class_name", "left").select("class_name", F.coalesce("n", F.lit(0)).alias("n"))
    if out.where("n > 0").isEmpty():
        raise ValueError("no file of the wanted classes")
    return out.withColumn("bar", bar(F.col("n"), 1, 20))


def repair_ids(boxes: DataFrame, gap: int = 127) -> DataFrame:
    """Ids from gap on move up by one."""
    return boxes.withColumn("cls_id", F.when(F.col("cls_id") >= gap, F.col("cls_id") + 1).otherwise(F.col("cls_id")))


def invalid_ids(boxes: DataFrame, classes: int = CLASSES) -> DataFrame:
    return boxes.where((F.col("cls_id") < 0) | (F.col("cls_id") >= classes))


def histogram(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n"))


def class_dimension(df: DataFrame, classes: int = CLASSES) -> DataFrame:
    return df.sparkSession.range(classes).select(F.col("id").alias("cls_id"))


def zero_filled(boxes: DataFrame, classes: int = CLASSES) -> DataFrame:
    """A row for every class of the dimension, 0 where no box has it."""
    return class_dimension(boxes, classes).join(histogram(boxes), "cls_id", "left").select("cls_id", F.coalesce("n", F.lit(0)).alias("n"))


def class_map(names: DataFrame, first: str = "aa1", last: str = "aa15") -> DataFrame:
    """class_name, class_id: natural order, two names pinned to the ends. Names are a small dimension, ordered in one task.

    Names that differ only in case are all kept; they tie in the natural order and go by code point.
    """
    pin = F.when(F.lower("class_name") == first, 0).when(F.lower("class_name") == last, 2).otherwise(1)
    order = W.orderBy(pin, natural_key(F.col("class_name")), "class_name")
    return names.select("class_name").distinct().withColumn("class_id", F.row_number().over(order) - 1)


def prefix_class(files: DataFrame, classes: DataFrame) -> DataFrame:
    """class of a file: the first class (by position) that its stem equals or begins with before an underscore.

    The stem's prefixes at underscores are exploded, so the match is an equality join.
    """
    parts = F.split("stem", "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    pairs = files.select("stem", F.explode(ends).alias("class_name")).join(classes, "class_name")
    return pairs.groupBy("stem").agg(F.min_by("class_name", "position").alias("class_name"))


def suspicious(w: Column, h: Column) -> Column:
    return (w * h > 0.85) | (w * h < 0.04)


def suspicious_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with a suspicious box or with no box."""
    flags = boxes.groupBy("image_id").agg(F.bool_or(suspicious(F.col("bw"), F.col("bh"))).alias("bad"), F.count(F.lit(1)).alias("n_boxes"))
    df = images.join(flags, "image_id", "left")
    return df.where(F.coalesce("bad", F.lit(True))).select("image_id", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))
