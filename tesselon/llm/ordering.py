"""Sorted order of suffixes over many machines.

Rows stand for suffixes (or other sequences) by 64-bit words: leading tokens first, then digests
of what follows. Splitters sampled by Spark's range partitioner deal the rows out by these words
and, among equal ones, by where they start, so that copies of one text spread over buckets too.
Each bucket is sorted by multikey quicksort, word by word, and equal neighbours are compared.
Runs that go on in the next bucket show in the rows at the edges, three a bucket at most: once all
buckets are written, these are aggregated by key, which tells what each is part of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, partitions


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words: a sort by the first, then of each group of ties by the next."""
    order = np.argsort(words[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    for before, word in zip(words, words[1:], strict=False):
        here = before[order]
        group += np.concatenate([[0], np.cumsum(here[1:] != here[:-1])]) if len(order) else 0
        group = np.concatenate([[0], np.cumsum(np.diff(group) != 0)]) if len(order) else group
        same = np.zeros(len(order), bool)
        tied = group[1:] == group[:-1]
        same[1:] |= tied
        same[:-1] |= tied
        at = np.flatnonzero(same)
        if not len(at):
            break
        order[at] = order[at][np.lexsort((word[order[at]], group[at]))]
    return order


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    got = list(batches)
    return {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in got]) if got else np.zeros(0, np.int64) for n in names}


def runs(rows: DataFrame, wide: list[str], narrow: list[str], start: list[str], tables: Tables) -> DataFrame:
    """Rows whose `wide` words occur again, with `equal` (whether `wide + narrow` do too), `later` and `ask`.

    All columns are long and without nulls; rows is a written table. start names a place in the
    corpus; `later` is true but for the first start of a run of equal `wide + narrow` words.
    `ask` is true for one row at least of each run of equal `wide + narrow` words if there may be
    another such run of equal `wide` words. Rows that are unique in `wide` are left out.
    """
    spark = rows.sparkSession
    keys = [*wide, *narrow, *start]
    n_wide, n_key = len(wide), len(wide) + len(narrow)
    n = partitions(spark, rows.count())

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = _whole(batches, keys)
        columns = [data[k] for k in keys]
        if not len(columns[0]):
            return
        order = multikey_order(columns)
        columns = [c[order] for c in columns]
        rows_n = len(order)

        def breaks(until: int) -> np.ndarray:
            new = np.ones(rows_n, bool)
            if rows_n > 1:
                new[1:] = False
                for c in columns[:until]:
                    new[1:] |= c[1:] != c[:-1]
            return new

        def repeated(new: np.ndarray) -> np.ndarray:
            alone = new.copy()
            alone[:-1] &= new[1:]
            return ~alone

        new = breaks(n_key)
        first = np.maximum.accumulate(np.where(new, np.arange(rows_n), 0))
        later = np.zeros(rows_n, bool)
        for c in columns[n_key:]:
            later |= c != c[first]
        wider = breaks(n_wide)
        again, equal = repeated(wider), repeated(new)
        run = np.cumsum(wider) - 1
        mixed = np.bincount(run, weights=new) > 1
        mixed[[0, -1]] = True  # these may go on in other buckets
        ask = mixed[run] & (new | ~equal)
        edge = np.zeros(rows_n, np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        last = np.flatnonzero(first == first[-1])
        edge[last[0]] |= 4  # the first start of the bucket's last run
        keep = np.flatnonzero(again | (edge > 0))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c[keep]) for c in columns), pa.array(again[keep]), pa.array(equal[keep]), pa.array(later[keep]), pa.array(ask[keep]), pa.array(edge[keep])],
            names=[*keys, "again", "equal", "later", "ask", "edge"],
        )

    kinds = ", ".join(f"{k} long" for k in keys)
    out = f"{kinds}, again boolean, equal boolean, later boolean, ask boolean, edge int"
    done = tables.write(rows.select(*keys).repartitionByRange(n, *keys).mapInArrow(bucket, out))
    tables.drop(rows)
    inner = done.where("edge = 0").select(*keys, "equal", "later", "ask")
    return inner.union(_edges(done.where("edge > 0"), keys, n_wide, n_key).select(*inner.columns))


def _edges(edges: DataFrame, keys: list[str], n_wide: int, n_key: int) -> DataFrame:
    """The rows at the buckets' edges that occur again, seen over all buckets.

    A run that lies in several buckets has an edge row in each, and the first row of its last run is
    an edge row of every bucket: so the run's first start is the least among its edge rows.
    """
    place = F.struct(*keys[n_key:])
    wide = edges.groupBy(*(F.col(k).alias(f"w_{k}") for k in keys[:n_wide])).agg((F.count(F.lit(1)) > 1).alias("w_again"))
    key = edges.groupBy(*(F.col(k).alias(f"k_{k}") for k in keys[:n_key])).agg((F.count(F.lit(1)) > 1).alias("k_equal"), F.min(place).alias("k_first"))
    found = edges.join(wide, [F.col(k) == F.col(f"w_{k}") for k in keys[:n_wide]]).join(key, [F.col(k) == F.col(f"k_{k}") for k in keys[:n_key]])
    found = found.where("again or w_again")
    return found.select(*keys, (F.col("equal") | F.col("k_equal")).alias("equal"), (F.col("later") | (place > F.col("k_first"))).alias("later"), F.lit(True).alias("ask"))
