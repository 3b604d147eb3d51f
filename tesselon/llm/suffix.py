"""Removal of long repeated passages by a sparse suffix order.

A string of 400 bytes that starts twice is found through suffixes at content-defined places: of
the 201 grams of 100 bytes within the first 300 bytes of a window, the one with the smallest hash is its
anchor, so equal windows have equal anchors at equal offsets. Anchors stand about every 100
bytes. Their suffixes are put in global order (see ordering.py) by leading bytes, then a digest
of the gram, then a digest of the extent, all bytes of the windows that have this anchor.

- An anchor whose gram occurs once: none of its windows is repeated.
- Extent repeated too: all of its windows are.
- Gram repeated, extent not (the end of a passage): its windows are cut into blocks of 16 and
  ordered by the bytes common to a block's windows, then by all bytes of the block; blocks left
  undecided give way to their single windows, ordered by 128-bit digest. One of each kind of
  equal extents and blocks stays in, for the others to be compared with.

Every test is equality of neighbours in order, so copies never meet in pairs or in one task.
Digests of at least 128 bits stand for the bytes they are made of. Past the 8 leading bytes the order is
that of digests, not of the text: equal suffixes still stand together, which is all that is asked.

Passages of 300 bytes (about 50 words) are too short for the removal, but two texts that share one share an anchor in it,
with the 100 bytes before its gram or those after: a second order, of repeated grams with either, tells which texts
share such a passage with another (`shares_passage`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, sized_join, text_key
from .linededup import id_number
from .ordering import runs

BLOCK = 16
#: Bytes of a document looked at in one go.
PIECE = 1 << 22
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


class Anchors:
    """Places of a text's anchors and the windows that each stands for."""

    def __init__(self, length: int, gram: int):
        """length: bytes of the windows, all of whose grams are looked at."""
        self.length, self.gram, self.grams = length, gram, length - gram + 1
        self.up, self.down = _powers(1 << 16)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of the gram at each place that has one, from prefix sums modulo 2**64."""
        n = len(data)
        while len(self.up) < n + 1:
            self.up, self.down = _powers(2 * len(self.up))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64)])
            h = (sums[self.gram :] - sums[: n - self.gram + 1]) * self.down[: n - self.gram + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xA0761D6478BD642F)
        return h

    def find(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(anchor, first window, last window), in order; together the windows are all of the text's."""
        windows = len(text) - self.length + 1
        for start in range(0, windows, PIECE):
            stop = min(start + PIECE, windows)
            data = np.frombuffer(text, np.uint8, stop - start + self.length - 1, start)
            h = self._hashes(data)
            h = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
            width = 1
            while width < self.grams:
                step = min(width, self.grams - width)
                h = np.minimum(h[:-step], h[step:])
                width += step
            at = (h & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([first[1:] - 1, [len(at) - 1]])
            yield from zip((at[first] + start).tolist(), (first + start).tolist(), (last + start).tolist(), strict=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rows(columns: list[list[int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=names)


def _suffixes(length: int, gram: int, passage: int):
    """A row for each anchor; span holds the offset and the number less one of its windows of `length` bytes, or is -1 without any."""
    names = ["lead", "gram", "extent", "doc", "key", "at", "span", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(passage, gram)
        hash64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for text, doc, key in zip(*batch.columns, strict=True):
                text, doc, key = text.as_py().encode("utf-8"), doc.as_py(), key.as_py()
                most = len(text) - length
                for at, lo, hi in anchors.find(text):
                    hi = min(hi, most)
                    span = (at - lo) << 20 | (hi - lo) if hi >= lo else -1
                    extent = hash64(text[lo : hi + length], seed=span) if hi >= lo else 0
                    end = at + 2 * gram
                    sides = hash64(text[at - gram : at]) if at >= gram else 0, hash64(text[end - gram : end]) if end <= len(text) else 0
                    for column, value in zip(out, (int.from_bytes(text[at : at + 8], "big", signed=False) - (1 << 63), _signed(hash64(text[at : at + gram])), _signed(extent), doc, key, at, span, *map(_signed, sides)), strict=True):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield _rows(out, names)
                    out = [[] for _ in names]
            yield _rows(out, names)

    return run, ", ".join(f"{n} long" for n in names)


def _blocks(length: int):
    """Blocks of the windows of undecided extents: common bytes, then all bytes."""
    names = ["core1", "core2", "full1", "full2", "doc", "key", "first", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for data, doc, key, lo, offset, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(offset % BLOCK - BLOCK, n, BLOCK):  # aligned with the anchor; extents may end within a block
                    a, b = max(i, 0), min(i + BLOCK, n)
                    if a >= b:
                        continue
                    seed = (offset - i + BLOCK) << 16
                    core = xxhash.xxh3_128_intdigest(data[i + BLOCK - 1 : i + length], seed=seed)
                    full = xxhash.xxh3_128_intdigest(data[a : b - 1 + length], seed=seed | (a - i) << 8 | (b - i))
                    for column, value in zip(out, (_signed(core >> 64), _signed(core & (1 << 64) - 1), _signed(full >> 64), _signed(full & (1 << 64) - 1), doc, key, lo + a, b - a), strict=True):
                        column.append(value)
            yield _rows(out, names)

    return run, ", ".join(f"{n} long" for n in names)


def _single(length: int):
    names = ["h1", "h2", "doc", "key", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for data, doc, key, lo, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for first, size in ((s["first"], s["size"]) for s in starts):
                    for i in range(first - lo, first - lo + size):
                        h = xxhash.xxh3_128_intdigest(data[i : i + length])
                        for column, value in zip(out, (_signed(h >> 64), _signed(h & (1 << 64) - 1), doc, key, lo + i), strict=True):
                            column.append(value)
            yield _rows(out, names)

    return run, ", ".join(f"{n} long" for n in names)


def repeated_spans(docs: DataFrame, doc: str, key: str, text: str, length: int, gram: int, passage: int, tables: Tables) -> DataFrame:
    """d, k, spans: per text the groups (first, size) of consecutive windows of `length` bytes that start more than once, and shares_passage."""
    run, kinds = _suffixes(length, gram, passage)
    rows = docs.select(text, doc, key).where(F.octet_length(text) >= passage).mapInArrow(run, kinds)
    found = tables.write(runs(tables.write(rows), ["lead", "gram"], ["extent"], ["doc", "key", "at", "span", "before", "after"], tables))
    lo, n = F.expr("at - shiftright(span, 20)"), F.expr("(span & 1048575L) + 1")
    some = found.where("span >= 0")
    sure = some.where("equal").select("doc", "key", lo.alias("first"), n.alias("size"))
    asks = some.where("ask").groupBy(F.col("doc").alias("d"), F.col("key").alias("k")).agg(F.collect_set(F.struct(lo.alias("lo"), F.expr("shiftright(span, 20)").alias("offset"), n.alias("n"))).alias("asks"))
    own = docs.select(text, doc, key)
    cut = sized_join(own, asks, [(doc, "d"), (key, "k")], docs.count()).select(F.encode(text, "UTF-8").alias("t"), "d", "k", F.explode("asks").alias("a"))
    cut = tables.write(cut.select(F.expr(f"substring(t, int(a.lo + 1), int(a.n + {length - 1}))").alias("data"), "d", "k", "a.lo", "a.offset", "a.n"))
    run, kinds = _blocks(length)
    blocks = tables.write(runs(tables.write(cut.mapInArrow(run, kinds)), ["core1", "core2"], ["full1", "full2"], ["doc", "key", "first", "size"], tables))
    sure = sure.union(blocks.where("equal").select("doc", "key", "first", "size"))
    open_ = blocks.where("ask").select("doc", "key", "first", "size")
    span = cut.select("d", "k", "lo", "n")
    open_ = open_.join(span, (open_.doc == span.d) & (open_.key == span.k)).where("first >= lo and first < lo + n").groupBy("d", "k", "lo").agg(F.collect_set(F.struct("first", "size")).alias("starts"))
    run, kinds = _single(length)
    ones = cut.join(open_, ["d", "k", "lo"]).select("data", "d", "k", "lo", "starts").mapInArrow(run, kinds)
    ones = runs(tables.write(ones), ["h1", "h2"], [], ["doc", "key", "first"], tables)
    nothing = F.lit(None).cast("long")
    sides = F.explode(F.array(*(F.when(F.col(c) != 0, F.xxhash64(F.lit(c), F.col(c))) for c in ("before", "after"))))
    sides = found.select("gram", sides.alias("side"), "doc", "key").where("side is not null").distinct()
    texts = runs(tables.write(sides), ["gram", "side"], [], ["doc", "key"], tables)
    texts = texts.select("doc", "key").distinct().select("doc", "key", nothing.alias("first"), nothing.alias("size"))
    out = sure.union(ones.select("doc", "key", "first", F.lit(1).cast("long"))).union(texts).select(F.col("doc").alias("d"), F.col("key").alias("k"), "first", "size")
    spans = tables.write(out.groupBy("d", "k").agg(F.collect_set(F.expr("if(first is null, null, struct(first, size))")).alias("spans"), F.bool_or(F.col("first").isNull()).alias("shares")))
    tables.drop(found, cut, blocks)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100, passage: int = 300) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, shares_passage, kept (binary).

    Removes every byte covered by a string of `length` bytes that also starts elsewhere, in the
    same document or in another, all occurrences alike. shares_passage: the text holds a string of
    2 * gram bytes round an anchor that another text or document holds; true wherever two share
    `passage` bytes, if that is 3 * gram or more (and no more than `length`). Null texts count as empty, and texts
    shorter than `length` keep all. Ids may be of any type. Rows equal in id and text lie elsewhere to each other.
    """
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), id_number(docs, id_col).alias("doc"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(own, "doc", "key", "text", length, gram, min(passage, length), tables)
    joined = sized_join(own, spans, [("doc", "d"), ("key", "k")], docs.count(), "left")
    joined = joined.select("text", "id", F.col("spans.first").alias("firsts"), F.col("spans.size").alias("sizes"), F.coalesce("shares", F.lit(False)).alias("shares_passage"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, _, firsts, sizes, _ in zip(*batch.columns, strict=True):
                data = text.as_py().encode("utf-8")
                firsts = np.array(firsts.as_py() or [], np.int64)
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, firsts, 1)
                np.add.at(edges, firsts + np.array(sizes.as_py() or [], np.int64) + length - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(out, (len(data), len(data) - len(kept), starts, kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.int64()) for c in out[:3]), batch.column(4), pa.array(out[3], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "shares_passage", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, shares_passage boolean, kept binary").withColumnRenamed("id", id_col)
