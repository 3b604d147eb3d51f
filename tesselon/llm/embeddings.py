"""Near-duplicate vectors by int8 tile products.

Unit vectors are quantised to int8 with a scale each; the length of what quantisation loses is
kept. For x = x^ + dx and y = y^ + dy the cosine differs from x^.y^ by |dx||y^| + |x^||dy| +
|dx||dy| at most, so pairs whose product plus this bound stays below the threshold are settled
by whole-number arithmetic (held in float32, exact below 2**24), and those whose product less the bound
reaches it are links. Only the others are recomputed in double precision. Equal vectors are one row. Pivots
from a bounded sample deal the vectors into cells; two cells are compared only if the angle between their pivots does not
exceed their radii and the threshold's angle together, which loses no pair. Cells are cut into
blocks, and each pair of blocks is a tile, a task's unit of work, to which int8 values are sent.
A tile gives link counts and a star forest, never pairs, and the vectors of its undecided pairs: these meet
again, in full precision, in a second round of the tiles that have any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .graph import connected_components

#: Vectors in the sample that pivots come from, number of pivots, vectors in a block.
SAMPLE, PIVOTS, BLOCK = 2000, 32, 2048


def _units(columns: list) -> np.ndarray:
    x = np.array(columns, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(units: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice: deterministic, and spread over clusters."""
    chosen = [0]
    best = units @ units[0]
    while len(chosen) < min(n, len(units)):
        at = int(best.argmin())
        if best[at] > 0.999:
            break
        chosen.append(at)
        best = np.maximum(best, units @ units[at])
    return units[chosen]


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the quantised vector, length of what is lost."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((units - near) ** 2).sum(axis=1))


def compare(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of quantised rows are links for sure, and which are undecided."""
    (qa, sa, na, la), (qb, sb, nb, lb) = a, b
    exact = np.float32 if qa.shape[1] <= 1000 else np.float64  # sums of int8 products stay below 2**24
    product = (qa.astype(exact) @ qb.astype(exact).T) * sa[:, None].astype(exact) * sb[None, :].astype(exact)
    slack = 1e-5  # float32 rounding of the scaled product and of the bound
    bound = (la[:, None] * (nb + lb)[None, :] + na[:, None] * lb[None, :]).astype(exact) + exact(slack)
    sure = product - bound >= threshold
    return sure, (product + bound >= threshold) & ~sure


def settled(a: np.ndarray, b: np.ndarray, open_: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the undecided pairs of unit vectors have a cosine of threshold or more in double precision."""
    out = np.zeros_like(open_)
    i, j = np.nonzero(open_)
    for k in range(0, len(i), 1 << 18):
        p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of threshold or more."""
    sure, open_ = compare(quantise(a), quantise(b), threshold)
    return sure | settled(a, b, open_, threshold)


def _stars(m: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, wa: np.ndarray, wb: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector with links in a tile: its id, the others' weight, its star's centre."""
    i, j = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    m, big = m[np.ix_(i, j)], np.iinfo(np.int64).max
    ca, cb = ids_a[i], ids_b[j]
    while len(i):  # smallest label of all that hang together in this tile
        na = np.minimum(ca, np.array([cb[r].min(initial=big) for r in m]))
        nb = np.minimum(cb, np.array([na[c].min(initial=big) for c in m.T]))
        if (na == ca).all() and (nb == cb).all():
            break
        ca, cb = na, nb
    if own:
        return ids_a[i], m @ wb[j], ca
    return np.concatenate([ids_a[i], ids_b[j]]), np.concatenate([m @ wb[j], m.T @ wa[i]]), np.concatenate([ca, cb])


def _sides(t: pa.Table, form) -> tuple[list, list, bool]:
    """The columns of a tile's two sides (rep, weight, then what form makes of them), and whether they are the same."""
    side = t.column("side").to_numpy()
    left, right = (t.filter(pa.array(side == k)) for k in (0, 1))
    own = t.num_rows > 0 and t.column("first")[0] == t.column("second")[0]
    both = [[x.column("rep").to_numpy(), x.column("weight").to_numpy(), form(x)] for x in (left, left if own else right)]
    return *both, own


_LINKS = "rep long, links long, centre long, first struct<dim:int,cell:int,block:int>, second struct<dim:int,cell:int,block:int>, side int"


def _answer(t: pa.Table, found: tuple, open_reps: list[np.ndarray]) -> pa.Table:
    """Rows of links, then rows of vectors in undecided pairs (without centre) by side."""
    n, rest = len(found[0]), sum(map(len, open_reps))
    kind = t.schema.field("first").type
    some = lambda c: pa.concat_arrays([pa.nulls(n, kind), pa.array([t.column(c)[0].as_py()] * rest, kind)])
    longs = lambda x: pa.concat_arrays([pa.array(np.asarray(x, np.int64)), pa.nulls(rest, pa.int64())])
    reps = np.concatenate([found[0], *open_reps]).astype(np.int64)
    sides = np.concatenate([np.zeros(n, np.int32), *(np.full(len(r), k, np.int32) for k, r in enumerate(open_reps))])
    return pa.table([pa.array(reps), longs(found[1]), longs(found[2]), some("first"), some("second"), pa.array(sides)], names=["rep", "links", "centre", "first", "second", "side"])


def _quantised(t: pa.Table) -> tuple:
    q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.int8)
    return q, *(t.column(c).to_numpy() for c in ("scale", "near", "lost"))


def _tile(threshold: float):
    """Sure links of a tile, and the vectors of its undecided pairs."""

    def run(t: pa.Table) -> pa.Table:
        (ids_a, wa, a), (ids_b, wb, b), own = _sides(t, _quantised)
        if not len(ids_a) or not len(ids_b):
            return _answer(t, ([], [], []), [])
        sure, open_ = compare(a, b, threshold)
        if own:
            np.fill_diagonal(sure, False)
            np.fill_diagonal(open_, False)
        open_reps = [ids_a[open_.any(axis=1)]] + ([] if own else [ids_b[open_.any(axis=0)]])
        return _answer(t, _stars(sure, ids_a, ids_b, wa, wb, own), open_reps)

    return run


def _again(threshold: float):
    """Links among a tile's undecided pairs, by cosines in double precision."""

    def run(t: pa.Table) -> pa.Table:
        (ids_a, wa, a), (ids_b, wb, b), own = _sides(t, lambda x: _units(x.column("v").to_pylist()))
        _, open_ = compare(quantise(a), quantise(b), threshold)
        if own:
            np.fill_diagonal(open_, False)
        return _answer(t, _stars(settled(a, b, open_, threshold), ids_a, ids_b, wa, wb, own), [])

    return run


def _prepare(pivots: dict[int, np.ndarray]):
    """Per vector: digest, length, cell, angle to the cell's pivot, and the quantised unit vector."""
    names = ["id", "v", "h1", "h2", "dim", "cell", "angle", "q", "scale", "near", "lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)], np.int64)
            for dim in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == dim))
                x = some.column(1).flatten().to_numpy().reshape(-1, dim)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in x), "<i8").reshape(-1, 2)
                units = _units(x)
                cell, angle = np.zeros(len(x), np.int32), np.full(len(x), math.pi)
                if dim in pivots:
                    cos = units @ pivots[dim].T
                    cell, angle = cos.argmax(axis=1).astype(np.int32), np.arccos(np.clip(cos.max(axis=1), -1, 1))
                q, *rest = quantise(units)
                columns = [*some.columns, *(pa.array(digests[:, k].copy()) for k in (0, 1)), pa.array(np.full(len(x), dim, np.int32)), pa.array(cell), pa.array(angle), pa.array([r.tobytes() for r in q], pa.binary()), *map(pa.array, rest)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept (it is its component's smallest id).

    Vectors that are null, empty or zero, or hold null or non-finite parts, link with nothing, as do
    vectors of different lengths with each other. Rows with equal vectors link, also under the same id.
    A null id takes part but is a component's id only if it has no other. No rows: empty result.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce(F.expr("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("fit", fit)
    good = rows.where("fit").select("id", "v")
    part = min(1.0, SAMPLE / max(1, good.count()))  # a share of the different vectors by hash: SAMPLE are expected at most
    sample = good.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < math.ceil(part * (1 << 30))).select("v").distinct().orderBy(F.xxhash64("v")).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {n: _pivots(_units(vs), PIVOTS) for n, vs in by_length.items()}
    kind = rows.schema["id"].dataType.simpleString()
    ready = tables.write(good.mapInArrow(_prepare(pivots), f"id {kind}, v array<double>, h1 long, h2 long, dim int, cell int, angle double, q binary, scale double, near double, lost double"))
    once = ("cell", "angle", "q", "scale", "near", "lost")  # the same in all rows of a class
    classes = ready.groupBy("h1", "h2", "dim").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in once))
    classes = tables.write(classes.withColumn("rep", F.monotonically_increasing_id()))
    sizes = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in classes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    blocks = {c: -(-n // BLOCK) for c, (n, _) in sizes.items()}
    reach = math.acos(threshold) + 1e-6
    near: list[tuple] = []
    for (dim, c), (_, r) in sizes.items():
        for (size, e), (_, s) in sizes.items():
            if dim == size:
                apart = math.acos(max(-1.0, min(1.0, float(pivots[dim][c] @ pivots[dim][e])))) if dim in pivots else 0.0
                if apart <= r + s + reach:
                    near.append((dim, c, blocks[dim, c], e, blocks[dim, e]))
    # every vector goes to the tiles of its block with each block of the cells in reach: PIVOTS ** 2 rows a length at most
    table = spark.createDataFrame(near or [(-1, 0, 1, 0, 1)], "dim int, cell int, own int, other int, others int")
    dealt = classes.select("rep", "weight", "dim", "cell", "q", "scale", "near", "lost").join(F.broadcast(table), ["dim", "cell"]).withColumn("block", F.expr("pmod(xxhash64(rep), own)").cast("int"))
    dealt = dealt.withColumn("other_block", F.explode(F.expr("sequence(0, others - 1)")))
    mine, its = F.struct("dim", "cell", "block"), F.struct("dim", F.col("other").alias("cell"), F.col("other_block").alias("block"))
    tiles = dealt.select("rep", "weight", "q", "scale", "near", "lost", F.least(mine, its).alias("first"), F.greatest(mine, its).alias("second"), F.when(mine <= its, 0).otherwise(1).alias("side"))
    found = tables.write(tiles.groupBy("first", "second").applyInArrow(_tile(threshold), _LINKS))
    open_ = found.where("centre is null").select("rep", "first", "second", "side")
    exact = classes.select("rep", "weight", "h1", "h2").join(open_.select("rep").distinct(), "rep")
    exact = ready.select("h1", "h2", "v").join(exact, ["h1", "h2"]).groupBy("rep", "weight").agg(F.first("v").alias("v"))
    second = tables.write(open_.join(exact, "rep").groupBy("first", "second").applyInArrow(_again(threshold), _LINKS))
    links = found.where("centre is not null").union(second).select("rep", "links", "centre")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select("rep", "centre").distinct(), tables)
    whole = classes.select("h1", "h2", "dim", "rep", "low", "weight").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    whole = tables.write(whole.select("h1", "h2", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")))
    least = whole.groupBy("c").agg(F.min("low").alias("component_id"))
    to = whole.join(least, "c").select("h1", "h2", "n_links", "component_id")
    linked_ = ready.select("id", "h1", "h2").join(to, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
