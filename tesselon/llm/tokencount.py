"""Token counts of whole texts by a tokenizer library, huge texts in overlapping chunks.

A huge text is cut into chunks that overlap. Each is encoded with offsets, and two neighbours
are spliced where both have a token boundary that no context can move: between a character
that is not white space and one that is. No pre-token of a byte-level tokenizer goes across
such a place, merges stay within pre-tokens, and special strings hold no white space, so left
of it the first encoding and right of it the second agree with the encoding of the whole text.
If the overlap holds no such place, the chunk is encoded again with twice the overlap, in the
end up to the whole text.

The same places let small texts share work: between them lie units whose counts add up, so
each unit is encoded by the library once per worker and then looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = re.compile(r"\s*\S+|\s+")
#: White space in Python, but not to the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
#: White space that is so in Python and to the tokenizer, after what is not in Python.
STABLE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")
MEMO = 1_000_000


class Counter:
    """Counts tokens with the library's own encoder."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 512):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}

    def ends(self, text: str) -> list[int]:
        """Where each token ends, in characters."""
        return [b for _, b in self.library.encode(text, add_special_tokens=False).offsets]

    def units(self, units: list[str]) -> list[int]:
        """Tokens of each unit. Those that start with white space and end without are encoded in one go."""
        joined = [i for i, u in enumerate(units) if u[0].isspace() and not u[-1].isspace()]
        alone = sorted(set(range(len(units))).difference(joined))
        out = [0] * len(units)
        for i, e in zip(alone, self.library.encode_batch_fast([units[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = len(e)
        for k in range(0, len(joined), 2000):
            part = joined[k : k + 2000]
            starts = np.array([b for b, _ in self.library.encode("".join([units[i] for i in part]), add_special_tokens=False).offsets])
            ends = np.cumsum([len(units[i]) for i in part])
            for i, n in zip(part, np.diff(np.searchsorted(starts, ends), prepend=0).tolist(), strict=True):
                out[i] = n
        return out

    def small(self, text: str) -> int:
        units = UNITS.findall(text)
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, units))
        except KeyError:
            pass
        new = [u for u in dict.fromkeys(units) if u not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(dict.fromkeys(units))
        memo.update(zip(new, self.units(new), strict=True))
        return sum(map(memo.__getitem__, units))

    def huge(self, text: str) -> int:
        """Chunks with offsets, spliced at stable boundaries that both sides have."""
        total, start, n = 0, 0, len(text)
        while start < n:
            stop, overlap = min(start + self.chunk, n), self.overlap
            ends = self.ends(text[start:stop])
            while stop < n:
                low = max(start + 1, stop - overlap)
                right = {low + e for e in self.ends(text[low : min(low + 2 * overlap, n)])}
                here = {start + e for e in ends}
                splice = [m.start() for m in STABLE.finditer(text, low + 1, stop) if m.start() in here and m.start() in right]
                if splice:
                    break
                overlap *= 2
                if overlap > stop - start:  # nothing stable in the whole chunk: a longer one
                    stop = min(stop + overlap, n)
                    ends = self.ends(text[start:stop])
            if stop == n:
                return total + len(ends)
            at = splice[-1]
            total += sum(start + e <= at for e in ends)
            start = at
        return total

    def count(self, text: str) -> int:
        if len(text) > self.chunk:
            return self.huge(text)
        if ODD.search(text):
            return len(self.library.encode(text, add_special_tokens=False))
        return self.small(text)


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One per Python worker, kept between tasks."""
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens (long), over_limit. Null texts count as empty; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, chunk, overlap)
        for batch in batches:
            n = [c.count(x.as_py() or "") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(text_col).alias("x"), F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
