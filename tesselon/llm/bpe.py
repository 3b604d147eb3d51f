"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours, encoded
together, give just these two tokens. So the last token of every prefix is fixed by the last
tokens of shorter prefixes, and reading a byte needs only (a) the last token before the pending
bytes and (b) the pending bytes: that pair is a state of the transducer. A byte moves it to the
next state and emits the tokens on which all prefixes that can still be extended agree. Pending bytes are
bounded by the lookahead the vocabulary needs, so a piece of any length streams through. States and moves are made when first met, up to a bound; a short
tail that leaves the known states is finished by the same recurrence without making more.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Above any rank.
NONE = 1 << 40
#: Bounds of the memos of moves and of units.
MOVES, MEMO = 200_000, 1_000_000
#: Letters of these alone are one match after a blank.
PLAIN = re.compile(r" [a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
#: A white-space run and the run after it: no match of the splitting pattern goes from other characters to white space.
UNITS = re.compile(r"\s*\S+|\s+")
#: Characters that Python, but not the pattern, takes as white space.
ODD = re.compile("[\x1c-\x1f]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes of one piece in, token ids out, as by merging the pair of lowest rank again and again."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MOVES):
        self.ranks, self.memo = ranks, memo
        #: Every beginning of a token, with the token's rank or -1.
        self.starts = dict.fromkeys((t[:i] for t in ranks for i in range(1, len(t) + 1)), -1) | ranks
        self.token = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in self.token}
        self.fit: dict[int, bool] = {}
        self.made_of: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        # a state: rank of the last token before the pending bytes (-1: none) and these bytes
        self.keys: list[tuple[int, bytes]] = [(-1, b"")]
        self.ids = {(-1, b""): 0}
        # for each state the last token of every pending prefix, and where a token may still have begun
        self.nodes: list[tuple[list[int], list[int]]] = [([-1], [0])]
        self.made = 0

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token; None for a byte, and for a token that merging never makes."""
        if token not in self.made_of:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
                if rank == NONE:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.made_of[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.made_of[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both tokens ends in just these two; memoised."""
        key = before << 32 | token
        got = self.fit.get(key)
        if got is None:
            if len(self.fit) >= 2 * self.memo:
                self.fit.clear()
            got = self.fit[key] = self.seam(self.token.get(before, b""), self.token[token])
        return got

    def seam(self, before: bytes, token: bytes) -> bool:
        """Whether no merge ever goes across the seam.

        Merges are undone from the last one back, looking only at the parts beside the seam. A part
        that is undone was made at its rank, so the pair that then meets at the seam must not have
        merged earlier; of merges of equal rank the left one comes first.
        """
        if (len(token) > 1 and not self.halves(token)) or (len(before) > 1 and not self.halves(before)):
            return False
        left, right, until = before, token, NONE
        while left:
            if self.ranks.get(left + right, NONE) < until:
                return False
            if len(left) > 1 and (len(right) == 1 or self.ranks[left] > self.ranks[right]):
                until = self.ranks[left]
                left = self.halves(left)[1]
            elif len(right) > 1:
                until = self.ranks[right] + 1
                right = self.halves(right)[0]
            else:
                break
        return True

    def read(self, before: int, pending: bytes, last: list[int], live: list[int], n: int) -> list[int]:
        """Adds to last the last token of the first n pending bytes; gives where a token may still have begun."""
        starts, fit, left, found = self.starts, self.fit, [], None
        for j in live:  # the longest first; one start at most fits
            rank = starts.get(pending[j:n])
            if rank is not None:
                left.append(j)
                if rank >= 0 and found is None:
                    seam = last[j] if j else before
                    ok = fit.get(seam << 32 | rank)
                    if ok or (ok is None and self.fits(seam, rank)):
                        found = rank
        if found is None:
            raise ValueError("the vocabulary lacks a byte")
        last.append(found)
        left.append(n)
        return left

    def move(self, state: int, byte: int) -> tuple[int, bytes]:
        """The state after a byte and the ids emitted on the way (unsigned 32-bit, little-endian)."""
        before, pending = self.keys[state]
        pending += bytes((byte,))
        last, live = self.nodes[state]
        last, size, at = list(last), self.size, len(pending)
        left = self.read(before, pending, last, live, at)
        for j in left:  # the deepest boundary on the way back from every start that can still grow
            while at != j:
                if at > j:
                    at -= size[last[at]]
                else:
                    j -= size[last[j]]
        key = (last[at] if at else before, pending[at:])
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            self.nodes.append((last[at:], [j - at for j in left if j >= at]))
        self.made += 1
        got = self.moves[state][byte] = (to, self.emitted(last, at))
        return got

    def emitted(self, last: list[int], at: int) -> bytes:
        """Ids of the tokens that lead to a boundary."""
        out = []
        while at:
            out.append(self.packed[last[at]])
            at -= self.size[last[at]]
        return b"".join(out[::-1])

    def rest(self, state: int, tail: bytes) -> bytes:
        """Ids from a state over a short tail to the end, by the same recurrence but without making states."""
        before, pending = self.keys[state]
        last, live = self.nodes[state]
        last, whole = list(last), pending + tail
        for n in range(len(pending) + 1, len(whole) + 1):
            live = self.read(before, whole, last, live, n)
        return self.emitted(last, len(whole))

    def encode(self, piece: bytes) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return self.packed[rank]
        out, state, moves = [], 0, self.moves
        for i, byte in enumerate(piece):
            got = moves[state].get(byte)
            if got is None:
                if self.made >= self.memo:
                    if len(piece) - i <= 64:  # the states met first stay; what leaves them ends without new ones
                        out.append(self.rest(state, piece[i:]))
                        return b"".join(out)
                    if self.made >= 4 * self.memo:
                        self.__init__(self.ranks, self.memo)
                        return self.encode(piece)
                got = self.move(state, byte)
            state = got[0]
            if got[1]:
                out.append(got[1])
        out.append(self.rest(state, b""))
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8: bytes in as they come, text out as soon as characters are whole.

    The state is the bytes of a character that has begun but not ended. Bytes that can start or
    continue no character give U+FFFD.
    """

    def __init__(self):
        self.tail = b""

    def feed(self, data: bytes, end: bool = False) -> str:
        data = self.tail + data
        cut = len(data)
        if not end:
            for back in range(1, min(3, cut) + 1):
                lead = data[cut - back]
                if lead >= 0xC0:  # starts a character of 2, 3 or 4 bytes
                    if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        cut -= back
                    break
                if lead < 0x80:
                    break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Tokenizer:
    """Splits texts by a pattern, encodes each match with the transducer, and decodes ids."""

    def __init__(self, path: str, pattern: str, moves: int = MOVES, memo: int = MEMO):
        self.memo = memo
        self.ranks = read_ranks(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.machine = Transducer(self.ranks, moves)
        self.units: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        got = self.units.get(text)
        if got is None:
            got = b"".join([self.machine.encode(p.encode("utf-8")) for p in ([text] if PLAIN(text) else self.split(text))])
            if len(text) <= 64:
                if len(self.units) >= self.memo:
                    self.units.clear()
                self.units[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if ODD.search(text):
            return b"".join([self.machine.encode(p.encode("utf-8")) for p in self.split(text)])
        memo, out = self.units.get, []
        for u in UNITS.findall(text):
            out.append(memo(u) or self.unit(u))
        return b"".join(out)

    def decode(self, ids: bytes, chunk: int = 4096) -> Iterator[str]:
        """Text of the ids, piece by piece."""
        stream, token = Utf8Stream(), self.tokens.__getitem__
        numbers = np.frombuffer(ids, "<u4").tolist()
        for i in range(0, len(numbers), chunk):
            yield stream.feed(b"".join(map(token, numbers[i : i + chunk])))
        yield stream.feed(b"", end=True)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str, moves: int = MOVES, memo: int = MEMO) -> Tokenizer:
    """One per Python worker, kept between tasks."""
    return Tokenizer(path, pattern, moves, memo)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int): the tokens of every whole text; null and empty texts have none. One row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(t.encode(x.as_py() or ""), "<i4") for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return _narrow(docs, id_col, text_col, run, "ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: decoded ids; null ids give an empty text, bytes that are not UTF-8 give U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            texts = ["".join(t.decode(np.array(x.as_py() or [], "<u4").tobytes())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["id", "text"])

    return _narrow(encoded, id_col, ids_col, run, "text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", moves: int = MOVES, memo: int = MEMO, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids): encoding and decoding in one pass, without a shuffle.

    moves and memo bound what a worker keeps of the transducer and of encoded units; they trade
    memory (about 1 KB a move, 0.3 KB a unit) for time and never change results. Null texts count as empty. Each row gives a row, repeats included; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern, moves, memo)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                coded = [t.encode(x.as_py() or "") for x in part.column(0)]
                digests = [hashlib.sha256(x).hexdigest() for x in coded]
                columns = [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(digests, pa.string()), pa.array([back(t, x) for x in coded], pa.string())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 1 + len(columns)])

    def back(t: Tokenizer, ids: bytes) -> str:
        digest = hashlib.sha256()
        for part in t.decode(ids):
            digest.update(part.encode("utf-8"))
        return digest.hexdigest()

    return _narrow(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def _narrow(df: DataFrame, id_col: str, col: str, run, columns: str) -> DataFrame:
    rows = df.select(F.col(col).alias("x"), F.col(id_col).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
