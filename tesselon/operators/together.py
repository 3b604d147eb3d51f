"""Boxes of one image (or image and class) taken together in numpy, many images at a time.

Rows are grouped by key into lists of at most FEW; groups of more rows are named in the result (`crowd`), for an exact way by grid. Where the rows
come from a join by image, grouping them shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a side of a group up to which they are taken together.
FEW = 100
#: Pairs of boxes looked at in one go.
BLOCK = 500_000


def lists(df: DataFrame, keys: list[str], name: str, columns: list[Column], unique: bool = False) -> DataFrame:
    """keys, <name>: a sorted list of structs of the columns (without repeats if unique), <name>_crowd: whether there are too many, so that the list is empty."""
    rows = df.select(*keys, F.struct(*columns).alias("row"), (F.count(F.lit(1)).over(W.partitionBy(*keys)) > FEW).alias("crowd"))
    collect = F.collect_set if unique else F.collect_list
    return rows.groupBy(*keys).agg(F.sort_array(collect(F.when(~F.col("crowd"), F.col("row")))).alias(name), F.max("crowd").alias(f"{name}_crowd"))


def flat(column: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """Structs of all lists one after another, and how many each has."""
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    """Fields as doubles; null is NaN, so that it overlaps and equals nothing."""
    return [rows.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def known(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Whether none of the leading key columns is null."""
    return np.all([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[:keys]], axis=0)


def pairs(na: np.ndarray, nb: np.ndarray, use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a row of a and one of b of the same group, for the groups in use, some groups at a time."""
    n = np.where(use, na * nb, 0)
    first_a, first_b, ends = np.cumsum(na) - na, np.cumsum(nb) - nb, np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + BLOCK, "right")))
        some = n[at:to]
        group = np.repeat(np.arange(at, to), some)
        k = np.arange(len(group)) - np.repeat(np.cumsum(some) - some, some)
        if len(group):
            yield first_a[group] + k // nb[group], first_b[group] + k % nb[group]
        at = to


def overlap(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs i, j of boxes (x1, y1, x2, y2) those that share an area, and that area."""
    wide = np.minimum(a[2][i], b[2][j]) - np.maximum(a[0][i], b[0][j])
    high = np.minimum(a[3][i], b[3][j]) - np.maximum(a[1][i], b[1][j])
    real = (wide > 0) & (high > 0)
    return i[real], j[real], (wide * high)[real]


def share(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Shared area by the area of both together."""
    area = lambda c, k: (c[2][k] - c[0][k]) * (c[3][k] - c[1][k])
    return both / (area(a, i) + area(b, j) - both)


def one_to_one(i: np.ndarray, j: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which pairs are taken if the best (ties by i, then j) is taken again and again and all that share a box with it go."""
    taken, left = np.zeros(len(i), bool), np.lexsort((j, i, -iou))
    best_i, best_j = (np.zeros(int(x.max(initial=-1)) + 1, np.int64) for x in (i, j))
    gone_i, gone_j = (np.zeros(len(x), bool) for x in (best_i, best_j))
    while len(left):
        place, a, b = np.arange(len(left)), i[left], j[left]
        best_i[a[::-1]], best_j[b[::-1]] = place[::-1], place[::-1]  # the first of each box is written last
        now = (best_i[a] == place) & (best_j[b] == place)
        taken[left[now]], gone_i[a[now]], gone_j[b[now]] = True, True, True
        left = left[~gone_i[a] & ~gone_j[b]]
    return taken


def hidden(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of n boxes go, if i comes before j in each pair and a box goes that overlaps one which stays."""
    gone = np.zeros(n, bool)
    while len(i):
        waits = np.zeros(n, bool)
        waits[j] = True
        out = np.zeros(n, bool)
        out[j[~waits[i]]] = True
        gone |= out
        keep = ~out[i] & ~out[j]
        i, j = i[keep], j[keep]
    return gone


def linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by links i, j."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def optional(column: pa.Array, at: np.ndarray) -> pa.Array:
    """Values of a column at places; null where the place is below zero."""
    return column.take(pa.array(at, mask=at < 0))
