"""SimHash near-duplicates.

Fingerprints are embedded as the vector of bit counts of their 16 four-bit segments. One
differing bit moves one count by one, so the Manhattan distance of two vectors is at most the
Hamming distance of the fingerprints. Vectors within distance 2 share a grid point at distance
1 or less from both: a range join on the unit grid is an equality join on such points. Grid
points that only one fingerprint reaches are dropped. What is left is verified exactly, again
without pairs: two fingerprints differ in at most 2 bits exactly if some 64-bit value differs
from each in at most one bit, so every fingerprint at a crowded grid point meets the others at
those values and links to the smallest one there. Work is linear in the distinct fingerprints
(33 points and at most 65 values each), whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, fresh, sized_join, text_key
from .graph import connected_components

SEGMENTS = 16


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a text: majority bits of the XXH64 of its word shingles, 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z changes
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - shingle + 1].tolist()
        parts = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    return run


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, packed in the same four bits each."""
    out = F.bit_count(fp.bitwiseAND(F.lit(15))).cast("long")
    for s in range(1, SEGMENTS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 4 * s).bitwiseAND(F.lit(15))).cast("long"), 4 * s))
    return out


def _grid(fps: DataFrame) -> DataFrame:
    """fp, cell, move: the grid points within 1 of a fingerprint's vector; move is 0 or +-(segment + 1)."""
    v = F.col("v")
    points = [F.struct(v.alias("cell"), F.lit(0).alias("move"))]
    for s in range(SEGMENTS):
        count = F.shiftrightunsigned(v, 4 * s).bitwiseAND(F.lit(15))
        one = F.lit(1 << (4 * s)).cast("long")
        points += [F.when(count < 4, F.struct((v + one).alias("cell"), F.lit(s + 1).alias("move"))), F.when(count > 0, F.struct((v - one).alias("cell"), F.lit(-s - 1).alias("move")))]
    return fps.withColumn("v", segment_counts(F.col("fp"))).select("fp", F.explode(F.array(*points)).alias("p")).where("p is not null").select("fp", "p.cell", "p.move")


def _meeting_values(members: DataFrame) -> DataFrame:
    """fp, at: values at Hamming distance 0 or 1 of fp whose vector is the member's grid point."""
    fp, move = F.col("fp"), F.col("move")
    at = [F.when(move == 0, fp)]
    for j in range(4):
        bit = F.expr(f"shiftleft(1L, 4 * (abs(move) - 1) + {j})")
        is_set = fp.bitwiseAND(bit) != 0
        at.append(F.when((move > 0) & ~is_set | (move < 0) & is_set, fp.bitwiseXOR(bit)))
    return members.select("fp", F.explode(F.array(*at)).alias("at")).where("at is not null")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints at 2 or fewer differing bits (fps: distinct fp).

    Grid points are dealt and sorted once: whether one is crowded shows in the neighbouring rows.
    """
    near = W.partitionBy("cell").orderBy("fp")
    grid = _grid(fps).select("fp", "cell", "move", F.lag("fp").over(near).alias("x"), F.lead("fp").over(near).alias("y"))
    members = _meeting_values(grid.where("x is not null or y is not null"))
    hubs = members.groupBy("at").agg(F.min("fp").alias("hub"), F.max("fp").alias("y")).where("hub <> y").select("at", "hub")
    links = members.join(hubs, "at").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).alias("id"), text_key(text_col).alias("k"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = tables.write(rows.mapInArrow(_fingerprints(shingle), f"id {kind}, k long, fp long"))
    fps = tables.write(rows.groupBy("fp").agg(F.min("id").alias("low")))
    parts = connected_components(fingerprint_links(fps.select("fp")), tables)
    whole = tables.write(fps.join(parts, fps.fp == parts.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c")))
    least = whole.groupBy("c").agg(F.min("low").alias("component_id"))
    return rows.join(whole.join(least, "c").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: id, fp (long), component_id (the smallest id reachable over links).

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat an id each
    give a row. A null id takes part in links but is a component's id only if all its ids are
    null. An empty table gives an empty result. Other columns are ignored.
    """
    return _components(docs, id_col, text_col, shingle).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs that carry the smallest id of their near-duplicates, all columns kept.

    Of rows with equal id and text one stays; rows that share an id but not their text are told apart.
    """
    return keep_least(docs, _components(docs, id_col, text_col, shingle), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id in found (id, k, component_id) is its component's; of rows with equal id and text one."""
    (key,) = fresh(docs, "tess_key")
    found = found.where("id <=> component_id").groupBy("id", "k").count()
    kept = found.select(F.col("id").alias("keep_id"), F.col("k").alias("keep_key"), "count")
    own = docs.withColumn(key, text_key(text_col))
    columns = [own[f"`{c}`"] for c in docs.columns]
    out = sized_join(own, kept, [(id_col, "keep_id"), (key, "keep_key")], docs.count())
    if not found.where("count > 1").isEmpty():
        return out.dropDuplicates([id_col, key]).select(*columns)
    return out.select(*columns)
