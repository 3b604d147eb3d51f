"""Removal of repeated lines by overlapping windows of three.

A window is three consecutive lines of a document, not all blank. All windows are put in global
order by their 128-bit digest, then by document and line. The first start of each run of equal
windows stays; every line that a later start covers is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Tables, fresh, sized_join, text_key
from .ordering import runs

WINDOW = 3
NO_ID = -(1 << 63)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h1", "h2", "doc", "key", "line"]
    for batch in batches:
        digests, doc, key, at = [], [], [], []
        for text, d, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.encode("utf-8").split(b"\n")
            blank = [not x.split() for x in lines]
            for i in range(len(lines) - WINDOW + 1):
                if not all(blank[i : i + WINDOW]):
                    digests.append(xxhash.xxh3_128_digest(b"\n".join(lines[i : i + WINDOW])))
                    doc.append(d)
                    key.append(k)
                    at.append(i)
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *(pa.array(x, pa.int64()) for x in (doc, key, at))], names=names)


def _without(lines: bytes, starts: list[int]) -> tuple[bytes, int, int]:
    """The text without the lines that windows at these starts cover, the number of lines and of those removed."""
    parts = lines.split(b"\n")
    gone = {i + j for i in starts for j in range(WINDOW)}
    return b"\n".join([x for i, x in enumerate(parts) if i not in gone]), len(parts), len(gone)


def id_number(docs: DataFrame, id_col: str) -> Column:
    """A whole number for each id, the least one for null: integers as they are, any other type by its hash."""
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    return F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(NO_ID))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, text replaced by what is kept, then n_lines, n_removed and kept_sha256.

    Lines end at \\n. A null text stays null and counts as one blank line, as an empty one does. All-blank windows are left alone. Texts of
    fewer than three lines stay as they are. Documents are ordered by id (null first; ids that are not
    integers by their hash), then by a hash of the text. Rows equal in id and text are one document: each keeps what it keeps.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    doc, key, starts, n_lines, n_removed, sha = fresh(docs, "tess_doc", "tess_key", "tess_starts", "n_lines", "n_removed", "kept_sha256")
    own = docs.withColumns({doc: id_number(docs, id_col), key: text_key(text_col)})
    rows = own.select(F.coalesce(text_col, F.lit("")), doc, key).mapInArrow(_windows, "h1 long, h2 long, doc long, key long, line long")
    found = runs(tables.write(rows), ["h1"], ["h2"], ["doc", "key", "line"], tables).where("later")
    by_doc = found.groupBy(F.col("doc").alias("d"), F.col("key").alias("k")).agg(F.sort_array(F.collect_set("line")).alias(starts))
    joined = sized_join(own, by_doc, [(doc, "d"), (key, "k")], docs.count(), "left").select(*(own[f"`{c}`"] for c in docs.columns), starts)
    schema = joined.drop(starts).schema.add(n_lines, "long").add(n_removed, "long").add(sha, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, counts, removed, digests = [], [], [], []
            for text, where in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text, where = text.as_py(), where.as_py()
                kept, n, m = _without(text.encode("utf-8"), where or []) if text is not None else (b"", 1, 0)
                texts.append(None if text is None else kept.decode("utf-8"))
                counts.append(n)
                removed.append(m)
                digests.append(hashlib.sha256(kept).hexdigest())
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
