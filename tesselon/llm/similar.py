"""Near copies by exact Jaccard similarity of word shingles.

Texts with equal shingle sets are one node. Candidates come from two sides. Each set has a SimHash, and
fingerprints at 2 or fewer differing bits are found by the range join on segment counts of `simhash`.
Two sets at a similarity of 0.8 may differ in up to about 12 bits, and within that distance of segment counts
lie 8 % of all pairs of random fingerprints, so for those the radius is not widened: candidates are
also sets that share one of `BANDS` digests of `ROWS` minimum hashes each, which two sets at a
similarity of 0.8 miss with a chance of 2 in 100,000. Nodes that share a digest link to its smallest
node, and what hangs together over either kind of link is a cluster. Clusters are cut into
blocks of bounded text; each pair of blocks is a tile, where all pairs are compared exactly.
A tile gives a star forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, sized_join, text_key
from .graph import connected_components
from .simhash import fingerprint_links, keep_least, majority

BANDS, ROWS = 36, 6
#: Shingles of a block, on average.
BLOCK = 200_000

_rng = np.random.default_rng(11)
_BY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted different XXH64 of the word shingles; fewer words than `size` are one shingle, none give none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(7)), np.uint64, len(parts)))


def bands(found: np.ndarray) -> np.ndarray:
    """A digest of each band's minimum hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        mixed = found[None, i : i + 1024] * _BY[:, None] + _PLUS[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(0)]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = [bands(s) if len(s) > 1 else [] for s in sets]  # a single shingle is alike or not
            fp = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            columns = [*batch.columns[1:], pa.array(node), pa.array(n), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "node", "n", "fp", "bands"])

    return run


def alike(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set the places of the right sets at a Jaccard similarity of percent or more."""
    each = np.fromiter(map(len, right), np.int64, len(right))
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), each)[order]
    for i, s in enumerate(left):
        a, b = np.searchsorted(values, s), np.searchsorted(values, s, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(right))
        yield i, np.flatnonzero(100 * both >= percent * (len(s) + each - both))


def _tile(size: int, percent: int):
    """Links within one tile as stars round the smallest node."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        right = right if (rows["first"] != rows["second"]).any() else left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        ids, ends = left["node"].tolist(), right["node"].tolist()
        parent = {x: x for x in [*ids, *ends]}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = [shingles(t, size) for t in left["text"]]
        for i, found in alike(sets, sets if right is left else [shingles(t, size) for t in right["text"]], percent):
            for j in found:
                a, b = find(ids[i]), find(ends[j])
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}).astype("int64")

    return run


def _by_fingerprint(nodes: DataFrame, tables: Tables) -> DataFrame:
    """node, hub: links that connect the nodes whose fingerprints differ in 2 or fewer bits."""
    nodes = nodes.where("n > 1").select("node", "fp")
    fps = tables.write(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("other")))
    same = nodes.join(fps.where("hub <> other"), "fp").where("node <> hub").select("node", "hub")
    near = fingerprint_links(fps.select("fp"))
    ends = [fps.select(F.col("fp").alias(c), F.col("hub").alias(name)) for c, name in (("a", "node"), ("b", "hub"))]
    return same.union(near.join(ends[0], "a").join(ends[1], "b").select("node", "hub"))


def _links(docs: DataFrame, nodes: DataFrame, tables: Tables, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """a, b: links that connect exactly the nodes whose sets are alike."""
    keyed = tables.write(nodes.select("node", F.explode("bands").alias("at")))
    hubs = keyed.groupBy("at").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other").select("at", "hub")
    stars = keyed.join(hubs, "at").where("node <> hub").select("node", "hub")
    clusters = tables.write(connected_components(stars.union(_by_fingerprint(nodes, tables)), tables))
    tables.drop(keyed)
    clusters = tables.write(clusters.union(clusters.select("component", "component")).distinct().join(nodes.drop("bands", "fp"), "node"))
    blocks = clusters.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    clusters = clusters.join(blocks, "component").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("k"))
    wanted = clusters.select("component", "node", "block", "blocks", F.col("low.id").alias("low_id"), F.col("low.k").alias("low_k"))
    texts = sized_join(own, wanted, [("id", "low_id"), ("k", "low_k")], docs.count()).dropDuplicates(["node"])
    placed = tables.write(texts.select("component", "node", "block", "blocks", "text"))
    placed = placed.select("component", "node", "block", "text", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    tiles = placed.select("component", "node", "text", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    return tables.write(tiles.groupBy("component", "first", "second").applyInPandas(_tile(size, percent), "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, k (hash of the text), component_id (the smallest id reachable over near copies).

    Texts without words are alike. Null ids and repeated rows count as in simhash.near_duplicates.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).alias("id"), text_key(text_col).alias("k"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = tables.write(rows.mapInArrow(_nodes(size), f"id {kind}, k long, node long, n long, fp long, bands array<long>"))
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "k")).alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = tables.write(nodes)
    parts = connected_components(_links(docs, nodes, tables, id_col, text_col, size, percent), tables).withColumnRenamed("node", "part")
    whole = tables.write(nodes.join(parts, nodes.node == parts.part, "left").select("node", "least", F.coalesce("component", "node").alias("c")))
    low = whole.groupBy("c").agg(F.min("least").alias("component_id"))
    return rows.select("id", "k", "node").join(whole.join(low, "c").select("node", "component_id"), "node")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that carry the smallest id of their near copies, all columns kept."""
    return keep_least(docs, near_copies(docs, id_col, text_col, size, percent), id_col, text_col)
