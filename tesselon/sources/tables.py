"""Readers: the standard tables as datasets of images, boxes, files and scores, and files on disk."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators import kernels
from tesselon.sources import folders

#: File suffixes of images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, cls_id, xc, yc, bw, bh: one row per box, a bag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 155).alias("cls_id"), (F.col("l_quantity") / 51).alias("xc"),
        ((F.col("l_suppkey") % 97) / 97).alias("yc"), (F.col("l_discount") * 10).alias("bw"), (F.col("l_tax") * 12.5).alias("bh"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("image_id"), (80 + key * 7919 % 1200).alias("width"), (80 + key * 104729 % 1200).alias("height"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class, stem: one file per document, a class per language and source."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", "source").alias("class"))
    return df.withColumn("stem", F.concat_ws("_", "class", F.col("doc_id").cast("string")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, name, conf in 0..1."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), (F.col("event_id") * 37 % 101 / 100.0).alias("conf"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor, cls, score: each vector is an anchor with a score per position."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("anchor"), F.posexplode("embedding").alias("cls", "score"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, line_no, line: boxes as text, some lines with a token less or more than five."""
    b = table(spark, sf_dir, "lineitem")
    tokens = [F.col("l_partkey") % 155, F.col("l_quantity").cast("int"), F.col("l_suppkey") % 97, F.col("l_linenumber")]
    tokens = [t.cast("string") for t in tokens] + [F.when(F.col("l_linenumber") != 7, "9"), F.when(F.col("l_linenumber") == 6, "8")]
    return b.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line_no"), F.concat_ws(" ", *tokens).alias("line"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, empty: a label file for each image with lines, and an empty one for two thirds of the others."""
    some = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("some", F.lit(True))
    both = images(spark, sf_dir).select("image_id").join(some, "image_id", "left").withColumn("empty", F.col("some").isNull())
    return both.where("not empty or image_id % 3 <> 0").select("image_id", "empty")


def class_names(spark: SparkSession, classes: int = 150) -> DataFrame:
    """cls_id, class_name: a name for each id."""
    return spark.range(classes).select(F.col("id").alias("cls_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("class_name"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, pos, value: each vector as a gray image of 8 x 8, values 0 to 255."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return p.select("vec_id", "pos", F.pmod(F.round(F.col("v").cast("double") * 1000).cast("long"), F.lit(256)).alias("value"))


def gray_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, width, height, px: the same with an image's values as an array."""
    value = F.transform("embedding", lambda v: F.pmod(F.round(v.cast("double") * 1000).cast("long"), F.lit(256)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), value.alias("px"))


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, width, height, channels, data: the same as rows of an image table."""
    value = F.transform("embedding", lambda v: F.pmod(F.round(v.cast("double") * 1000).cast("long"), F.lit(256)))
    data = F.unhex(F.array_join(F.transform(value, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), data.alias("data"))


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recursive: bool = True, globs: tuple[str, ...] = ("*",)) -> DataFrame:
    """path, dir, stem, suffix, length of the files of path, or below it, with one of the suffixes, whatever their case.

    Executors list, folder by folder, empty files included. Paths that several globs match are there once.
    """
    df = _listing(spark, path, recursive=recursive, globs=json.dumps(globs))
    df = df.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*?)(\\.[^./]*)?$", 1).alias("stem"), F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).alias("suffix"), "length")
    return df.where(F.col("suffix").isin(*suffixes)).orderBy("path")


def _listing(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(folders.Listing)
    return spark.read.format("tesselon_listing").options(**options).load(path)


def class_folders(files: DataFrame) -> DataFrame:
    """class_name of each folder that holds a file, once; folders without files are not seen."""
    return files.select(F.regexp_extract("dir", "([^/]*)$", 1).alias("class_name")).distinct()


def layout_of(files: DataFrame) -> DataFrame:
    """One row: whether a listing has images in a split (images/<split>/), in a folder for each class, or flat."""
    inside = F.bool_or(F.col("path").rlike("/images/"))
    folders = F.count_distinct("dir")
    return files.agg(F.when(inside, "split").when(folders > 1, "classes").otherwise("flat").alias("layout"))


def label_listing(files: DataFrame) -> DataFrame:
    """stem, empty of label files, from a listing."""
    return files.select("stem", (F.col("length") == 0).alias("empty"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, data (BGR rows); unreadable files have null sizes."""
    i = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    ok = F.col("image.height") > 0
    return i.select(F.col("image.origin").alias("path"), *(F.when(ok, F.col(f"image.{c}")).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))))


def colour_images(images: DataFrame) -> DataFrame:
    """read_images() with three channels in every row: gray repeated, transparency dropped."""
    return kernels.over_images(images, lambda img, _: img, "image")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, bytes_read from the headers of PNG, JPEG, BMP and GIF files; no size where they tell none. Some tens of bytes of a file are read."""
    return _listing(spark, path, sizes=True).select("path", "width", "height", "bytes_read")


def read_manifest(text: str) -> dict:
    """A dataset manifest of plain keys and a list of names, in YAML block or flow form or as JSON."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    value = lambda x: int(x) if re.fullmatch(r"-?\d+", x) else x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x
    out: dict = {}
    last = None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if body.startswith("- "):
            out.setdefault(last, [])
            out[last] = out[last] or []
            out[last].append(value(body[2:].strip()))
            continue
        key, _, rest = body.partition(":")
        rest = rest.strip()
        if line[:1].isspace() and re.fullmatch(r"\d+", key):  # names as a map from id
            out[last] = out[last] or []
            out[last].append(value(rest))
        elif rest.startswith("["):
            out[key] = [value(x.strip()) for x in rest[1:-1].split(",") if x.strip()]
        else:
            out[last := key] = value(rest) if rest else None
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, line_no, line of text label files."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("_metadata.file_path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return df.where("trim(line) <> ''").select(F.col("file_path").alias("path"), F.regexp_extract("file_path", "([^/]*?)\\.[^./]*$", 1).alias("stem"), "line_no", "line")
