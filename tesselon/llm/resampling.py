"""Importance resampling towards a target distribution of hashed word n-grams.

Two passes over the texts. The first counts, bucket by bucket, the runs of one and two words of the
corpus and of the target texts: 10,000 sums each, whatever the input. The second looks each text's
buckets up in the array of gains and keeps a whole-numbered weight. Scores (weight plus seeded Gumbel
noise) are whole numbers, too, so the exact histogram of scores has a row per different score, some tens of
thousands at any size: weights lie between the least and the greatest gain and the noise between
-3,135 and 22,874. Summed from the top, it gives each score's first rank and the score at which the draw
is cut off; rows are then numbered by id within a score, and no task sorts more than one score's rows.

Buckets are computed over arrays: all words of a piece of text advance their CRC byte by byte
together, and a pair's CRC goes on from its first word's.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Tables

BUCKETS = 10_000
#: Bytes of text that one round of array operations takes.
PIECE = 1 << 20
#: Longer words are hashed one by one.
LONG = 48

#: Fixed value: the polynomial of CRC-32, lowest bit first.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after the words at start, size in data; words are given from the longest to the shortest."""
    out = state.copy()
    sizes = np.searchsorted(-size, -np.arange(1, min(int(size[0]) if len(size) else 0, LONG) + 1), "right")  # words of a length of k or more
    for k, n in enumerate(sizes):
        out[:n] = _CRC[(out[:n] ^ data[start[:n] + k]) & 255] ^ (out[:n] >> 8)
    for i in range(int(np.searchsorted(-size, -LONG, "left"))):
        rest = data[start[i] + LONG : start[i] + size[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all one- and two-word runs of some texts, the number of the text each is of, and words per text."""
    joined = b" ".join(texts).lower()  # of bytes: A-Z only
    data = np.frombuffer(joined, np.uint8)
    word = np.concatenate([[False], _WORD[data], [False]])
    change = np.flatnonzero(word[1:] != word[:-1])
    start, end = change[::2], change[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, "right")
    size = end - start
    order = np.argsort(-size, kind="stable")
    one = np.empty(len(start), np.uint32)
    one[order] = _advance(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start[order], size[order])
    pair = np.flatnonzero(doc[1:] == doc[:-1]) + 1  # words with one before them in their text
    pair = pair[np.argsort(-size[pair], kind="stable")]
    before = one[pair - 1]
    before = _CRC[(before ^ 32) & 255] ^ (before >> 8)
    two = _advance(before, data, start[pair], size[pair])
    bucket = (np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % BUCKETS
    return bucket, np.concatenate([doc, doc[pair]]), np.bincount(doc, minlength=len(texts))


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts (null: empty) in runs of about PIECE bytes, with the number of the first one."""
    at, size, out = 0, 0, []
    for i, x in enumerate(column):
        text = x.as_buffer().to_pybytes() if x.is_valid else b""
        if out and size + len(text) > PIECE:
            yield at, out
            at, size, out = i, 0, []
        out.append(text)
        size += len(text)
    if out:
        yield at, out


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, n: features of all texts. A task adds its texts up first and hands on one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, piece in _pieces(batch.column(0)):
                total += np.bincount(features(piece)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """What each bucket adds to a text's weight: the smoothed log ratio of target and corpus in thousandths, rounded down."""
    own, other = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * own / ((s + 1.0) * other))) for s, t in zip(corpus, target, strict=True)]


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight: the mean gain of a text's features, rounded down; 0 without any. One row per row."""
    rows = docs.select(F.col(text_col).cast("string").alias("x"), F.col(id_col).alias("id"))
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in _pieces(batch.column(0)):
                bucket, doc, words = features(piece)
                total = np.bincount(doc, table[bucket], len(piece)).astype(np.int64)  # exact in doubles
                n = np.where(words > 0, 2 * words - 1, 0)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(piece)), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 digest of seed and id (a null id: of the seed and a colon)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank: rank 1, 2, ... for the drawn, null for the others. One row per row.

    Of the texts with `least` words or more, `percent` in a hundred (rounded down) of the highest score are drawn, ties by the
    smaller id (null first). Rows equal in id and text count each on its own and take neighbouring ranks in any order. Null and empty texts have no
    features and weight 0. Without target texts all gains come from the corpus alone; without documents there are no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    found = []
    for texts in (docs, target):
        n = [0] * BUCKETS
        for r in bucket_counts(texts, text_col).collect():  # BUCKETS rows at most
            n[r["bucket"]] = r["n"]
        found.append(n)
    rows = weights(docs, gains(*found), id_col, text_col)
    rows = tables.write(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    may = F.col("n_words") >= least
    levels = rows.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # different whole scores: see above
    drawn = sum(r["n"] for r in levels) * percent // 100
    first, taken = [], 0
    for score, n in sorted(((r["score"], r["n"]) for r in levels), reverse=True):
        if taken >= drawn:
            break
        first.append((score, taken))
        taken += n
    if not first:
        return rows.withColumn("rank", F.lit(None).cast("long")).withColumnRenamed("id", id_col)
    cutoff = first[-1][0]
    before = F.broadcast(spark.createDataFrame(first, "level long, taken long"))
    top = rows.where(may & (F.col("score") >= cutoff)).join(before, F.col("score") == F.col("level"))
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("id").asc_nulls_first())) + F.col("taken")
    top = top.withColumn("rank", F.when(place <= drawn, place.cast("long"))).drop("level", "taken")
    rest = rows.where(~may | (F.col("score") < cutoff)).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).withColumnRenamed("id", id_col)
