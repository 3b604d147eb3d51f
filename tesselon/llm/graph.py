"""Connected components by contraction, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's edges as a forest of stars round the smallest node: fewer edges, same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory: a forest so far, then another
            yield out()
    yield out()


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node, component (its smallest node) for every node of edges (two long columns).

    Each round every node points at its smallest neighbour if that is smaller, pointers are
    doubled once, and the edges are contracted along them; nodes only ever meet in joins and
    minima, so no component is gathered anywhere. No edges: no rows. Loops and repeats are
    ignored, nulls dropped.
    """
    a, b = edges.columns
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    left = tables.write(left.mapInArrow(_forest, "a long, b long").distinct())
    steps = []
    while not left.isEmpty():
        ends = left.union(left.select("b", "a"))
        to = ends.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        to = tables.write(to)
        twice = to.alias("x").join(to.alias("y"), F.col("x.m") == F.col("y.n")).select("x.n", F.col("y.m").alias("m"))
        twice = tables.write(twice)
        moved = left.join(twice, left.a == twice.n).select(F.col("m").alias("a"), "b")
        moved = moved.join(twice, moved.b == twice.n).select("a", F.col("m").alias("b")).where("a <> b")
        after = tables.write(moved.mapInArrow(_forest, "a long, b long").distinct())
        tables.drop(to)
        tables.drop(left)
        left = after
        steps.append(twice)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[0].select(F.col("n").alias("node"), F.col("m").alias("component"))
    for step in steps[1:]:
        labels = labels.join(step, labels.component == step.n, "left").select("node", F.coalesce("m", "component").alias("component"))
    return labels
