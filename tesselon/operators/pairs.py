"""Pairs of files, splits, unions and rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.expressions import seeded
from tesselon.operators.ranges import numbered


def pair(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equality join by stem or id: inner, left, left_anti (no label) or left_semi."""
    return left.join(right, key, how)


def ranked(df: DataFrame, group: str | None, order: Column, name: str = "rank") -> DataFrame:
    """df with the rank (from 1) of each row in its group by an order without ties; a group may hold all rows (see ranges)."""
    return numbered(df, [group] if group else [], order, name)


def positional(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Pairs by rank within a group; what is left over on the left has null on the right."""
    return ranked(left, group, F.col(left_order)).join(ranked(right, group, F.col(right_order)), [group, "rank"], "left")


def stratified_split(files: DataFrame, group: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """split: per group the first max(1, floor(n * share)) in a seeded order are val, the rest train."""
    n = files.groupBy(group).agg(F.count(F.lit(1)).alias("split_n"))
    rows = ranked(files, group, F.concat_ws(":", seeded(seed, F.col(key)), F.col(key).cast("string")), "split_rank").join(n, group)
    first = F.col("split_rank") <= F.greatest(F.lit(1), F.floor(F.col("split_n") * share))
    return rows.withColumn("split", F.when(first, "val").otherwise("train")).drop("split_rank", "split_n")


def resplit(split: DataFrame, key: str, n: int = 76, seed: int = 7) -> DataFrame:
    """Moves n train rows, first in a seeded order, to val. Their keys are n at most, so they are broadcast."""
    moved = split.where("split = 'train'").orderBy(seeded(seed, F.col(key)), key).limit(n).select(key, F.lit(True).alias("moved"))
    return split.join(F.broadcast(moved), key, "left").withColumn("split", F.when(F.col("moved"), "val").otherwise(F.col("split"))).drop("moved")


def union_last_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union by name; of rows with equal key the one of the later source stays."""
    both = sources[0].withColumn("source_no", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        both = both.unionByName(s.withColumn("source_no", F.lit(i)))
    others = [c for c in both.columns if c not in (key, "source_no")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*others), "source_no").alias("b"), F.max("source_no").alias("source_no"))
    return best.select(key, *(f"b.{c}" for c in others), "source_no")


def rename_plan(files: DataFrame, group: str, order: str, template: str, start: int = 0, *extra: Column) -> DataFrame:
    """src, dst: numbered within each group; the template takes the group, extra values and the number."""
    i = F.col("rank") - 1 + start
    return ranked(files, group, F.col(order)).select(F.col(order).alias("src"), F.format_string(template, F.col(group), *extra, i).alias("dst"))


def sample(files: DataFrame, key: str, n: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """n rows without replacement, first in a seeded order; all where there are fewer, which is an error if exact."""
    out = files.orderBy(seeded(seed, F.col(key)), key).limit(n)
    if exact and out.count() < n:
        raise ValueError(f"fewer than {n} rows to sample")
    return out


def drawn(files: DataFrame, key: str, slots: DataFrame, seed: int = 42) -> DataFrame:
    """slots with one of the files each, at random with replacement: a seeded number gives the file's rank in key order."""
    n = files.count()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in slots.columns)))
    at = slots.withColumn("rank", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % max(n, 1) + 1)
    return at.join(ranked(files.select(key), None, F.col(key)), "rank").drop("rank")


def moved_with_labels(moved: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: moved files, those with a label, those without."""
    both = moved.select(key).join(labels.select(key).distinct().withColumn("has_label", F.lit(True)), key, "left")
    return both.agg(F.count(F.lit(1)).alias("n_moved"), F.count("has_label").alias("n_with_label"), F.count_if(F.col("has_label").isNull()).alias("n_missing"))


def numbered_on(copies: DataFrame, existing: DataFrame, group: str, order: str) -> DataFrame:
    """copies with number: counting in each group goes on after the files that exist."""
    n = existing.groupBy(group).agg(F.count(F.lit(1)).alias("n_before"))
    return ranked(copies, group, F.col(order)).join(n, group, "left").withColumn("number", F.col("rank") + F.coalesce("n_before", F.lit(0))).drop("rank", "n_before")


def in_class_order(files: DataFrame, classes: DataFrame, group: str, key: str) -> DataFrame:
    """Bag union of each class's files in the order of the classes (group, position): place gives the order."""
    both = files.join(classes.select(group, "position"), group)
    return ranked(both, None, F.format_string("%010d%020d", "position", key), "place").drop("position")


def distinct_paths(*listings: DataFrame) -> DataFrame:
    """Paths that any of the listings has, each once."""
    out = listings[0].select("path")
    for other in listings[1:]:
        out = out.union(other.select("path"))
    return out.distinct()


def on_list(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key an allow-list (a dimension) holds; list entries without a row drop out."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def split_counts(files: DataFrame, labelled: DataFrame, group: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Per class: pairs, train, val, files without a label; a class without pairs is skipped."""
    of = files.join(labelled.select(key).distinct(), key, "left_semi")
    split = stratified_split(of, group, key, share, seed).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    every = files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"))
    out = every.join(split, group, "left").na.fill(0)
    return out.withColumns({"no_label": F.col("n_files") - F.col("n"), "skipped": F.col("n") == 0})
