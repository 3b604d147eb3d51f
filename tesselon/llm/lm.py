"""Scores of whole texts by a small causal attention model over subword ids, and a word baseline.

One pass over the corpus turns texts into subword ids, written to the shared folder, and counts the
words of the training texts (each task counts, then one aggregation by word). Word counts give
the subwords' counts and so the `KINDS` kinds the model tells apart: the most frequent subwords, and
two kinds for all others, spread by their counts. A second pass counts which kind follows which.

The model predicts a kind in two steps, its class and its place there. Logits are those of the
counted successors of the preceding kind (smoothed towards the frequencies of kinds), which are
fixed, plus a learned correction: one masked attention head over a window, a bounded layer and an
output matrix, trained in numpy by Adam. As the head is as wide as the embedding, queries and keys
are one matrix (`look`), values and their way out another (`mix`). Training goes in rounds: in each, tasks take their share
of a fresh part of the training texts from the same start, and weights are averaged, summed by
index before anything reaches the driver. The rounds together take all training texts, each once.

Scoring cuts each text's subwords into windows of `WINDOW` that overlap by `OVERLAP`: the
overlap is context only, so each token is scored once. The baseline needs the count of every word
of every text: the most frequent words (`TOP` at most) go to the workers, the rest meet
their counts in a join by word.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, text_key

WIDTH, WINDOW, OVERLAP = 32, 32, 8
#: Kinds are CLASSES classes of as many members each; the first OPENERS classes are of subwords that open a word.
BITS, OPENERS = 5, 10
CLASSES = MEMBERS = 1 << BITS
KINDS = CLASSES * MEMBERS
TOP = 200_000
#: As many rounds as shares: each training text is learned from in exactly one round. Adam's rate of each.
RATES = (0.02, 0.01, 0.004)
ROUNDS = len(RATES)
#: Windows in a training batch; batches whose changes to the embedding are made in one go.
BATCH, HOLD = 32, 4
#: Windows scored at once.
BLOCK = 128
#: Weight of the kinds' own frequencies in the successors' distributions, in counts.
SMOOTH = 20.0
#: Words whose subwords a worker keeps.
MEMO = 500_000
#: Texts split into words at once: each different word among them is looked up once.
TEXTS = 2048
#: Frequent words of more subwords than this are looked up by their bytes, not by a sum.
LONG = 64

f4 = np.float32
BEFORE = np.tril(np.ones((WINDOW, WINDOW), f4))
#: Attention logits and output weights are held within these: the softmax needs no maximum, and no sum vanishes.
LIMIT, MOST = 30.0, 2.0
#: Exponentials are taken as powers of two, which numpy raises twice as fast.
BITS_OF_E = math.log2(math.e)


# --- the model ---------------------------------------------------------------------------------


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(f4)
    each = 0.3 / math.sqrt(WIDTH)
    return {"embed": draw(0.3, KINDS, WIDTH), "place": draw(0.1, WINDOW, WIDTH), **{k: draw(each, WIDTH, WIDTH) for k in ("look", "mix")}, "out": draw(each / 5, WIDTH, CLASSES + MEMBERS)}


class Successors:
    """Probabilities of the next class, and of its members, by the preceding kind, one below the other in `both`."""

    def __init__(self, pairs: np.ndarray, single: np.ndarray):
        p = (single + 0.5) / (single + 0.5).sum()
        joint = (pairs.reshape(KINDS, KINDS) + SMOOTH * p) / (pairs.reshape(KINDS, KINDS).sum(1, keepdims=True) + SMOOTH)
        joint = joint.reshape(KINDS, CLASSES, MEMBERS)
        classes = joint.sum(2)
        joint /= classes[:, :, None]
        self.both = np.concatenate([classes, joint.reshape(-1, MEMBERS)]).astype(f4)
        self.classes, self.members = self.both[:KINDS], self.both[KINDS:]


class Room:
    """Arrays by name, which one step after another writes over."""

    def __init__(self, kind=f4):
        self.kind, self.held = np.dtype(kind), {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        found = self.held.get(name)
        if found is None or found.shape != shape:
            found = self.held[name] = np.empty(shape, self.kind)
        return found


def hidden(w: dict[str, np.ndarray], x: np.ndarray, room: Room | None = None, skip: int = 0) -> tuple:
    """States of windows x (n, WINDOW), one a row: each place sees itself and what is before it. The first `skip` places are only seen.

    Products go window by window: many small ones with a matrix that lies in order are faster than one tall one.
    """
    room = room or Room(w["embed"].dtype)
    shape = (len(x), WINDOW - skip, WIDTH)
    e = w["embed"].take(x, axis=0, out=room("e", len(x), WINDOW, WIDTH), mode="clip")
    e += w["place"]
    s = np.matmul(e[:, skip:], w["look"] * BITS_OF_E, out=room("s", *shape))
    across = room("across", len(x), WIDTH, WINDOW)
    across[...] = e.transpose(0, 2, 1)
    a = np.matmul(s, across, out=room("a", *shape[:2], WINDOW))
    most = LIMIT * BITS_OF_E
    if a.max(initial=0) > most or a.min(initial=0) < -most:
        np.clip(a, -most, most, out=a)
    np.exp2(a, out=a)
    a *= BEFORE[skip:]
    a /= row_sums(a, room("sums", *a.shape))
    c = np.matmul(a, e, out=room("c", *shape))
    h = np.matmul(c, w["mix"], out=room("h", *shape))
    h += e[:, skip:]
    slope = np.abs(h, out=room("slope", *shape))
    slope += 1
    np.divide(1, slope, out=slope)
    h *= slope
    return h.reshape(-1, WIDTH), c, a, s, across, e, slope


def row_sums(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums over the last axis, in each place of out's: whole arrays divide faster than an array by a column."""
    return np.matmul(x, np.ones((x.shape[-1], out.shape[-1]), x.dtype), out=out)


@lru_cache(maxsize=8)
def _starts(shape: tuple) -> np.ndarray:
    return np.arange(0, math.prod(shape) * MEMBERS, MEMBERS).reshape(shape)


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For y's class and for its member, side by side: rows of counted probabilities after x, and where they are in a flat array of logits."""
    rows, at = np.empty((2, *x.shape, 2), np.intp)
    c = y >> BITS
    rows[..., 0] = x
    np.add((x << BITS) + KINDS, c, out=rows[..., 1])
    at[..., 0] = c
    np.bitwise_and(y, MEMBERS - 1, out=at[..., 1])
    at += _starts(at.shape)
    return rows, at


def log_probability(w: dict[str, np.ndarray], known: Successors, h: np.ndarray, x: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural log of the probability of kinds y after kinds x in states h, which have a row for each."""
    room = room or Room(h.dtype)
    rows, at = _places(x, y)
    z = np.matmul(h, w["out"] * BITS_OF_E, out=room("z", *h.shape[:-1], CLASSES + MEMBERS))
    own = z.reshape(-1).take(at) / BITS_OF_E
    np.exp2(z, out=z)
    p = known.both.take(rows, axis=0)
    counted = p.reshape(-1).take(at) / np.vecdot(p, z.reshape(p.shape))
    return own[..., 0] + own[..., 1] + np.log(counted[..., 0] * counted[..., 1])


def gradients(w: dict[str, np.ndarray], known: Successors, x: np.ndarray, y: np.ndarray, use: np.ndarray, room: Room | None = None, by_place: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient of the mean negative log probability over the used places; that of the embedding by place, one a row."""
    room = room or Room(w["embed"].dtype)
    h, c, a, s, across, e, slope = hidden(w, x, room)
    shape, kind = e.shape, e.dtype
    scale = kind.type(1 / max(1, np.count_nonzero(use)))
    rows, at = _places(x, y)
    z = np.matmul(h.reshape(shape), w["out"] * BITS_OF_E, out=room("z", *shape[:2], CLASSES + MEMBERS))
    np.exp2(z, out=z)
    halves = z.reshape(len(x), 2 * WINDOW, MEMBERS)
    p = known.both.take(rows, axis=0).reshape(halves.shape)
    halves *= p
    halves /= row_sums(halves, p if p.dtype == kind else np.empty(p.shape, kind))
    z.reshape(-1)[at.ravel()] -= 1
    z.reshape(len(h), -1)[np.flatnonzero(~use)] = 0
    g = {"out": _product(h, z)}
    g["out"] *= scale
    dh = np.empty(shape, kind) if by_place is None else by_place.reshape(shape)
    np.matmul(z, w["out"].T.copy(), out=dh)
    more = h.reshape(shape)  # nothing reads states from here on
    slope *= slope
    slope *= scale
    dh *= slope
    g["mix"] = _product(c, dh)
    dc = np.matmul(dh, w["mix"].T.copy(), out=room("dc", *shape))
    da = np.matmul(dc, across, out=room("da", *a.shape))
    c *= dc
    da -= row_sums(c, room("sums", *a.shape))
    da *= a
    ds = np.matmul(da, e, out=slope)
    g["look"] = _product(e, ds)
    dh += np.matmul(a.transpose(0, 2, 1), dc, out=more)
    s /= BITS_OF_E
    dh += np.matmul(da.transpose(0, 2, 1), s, out=more)
    dh += np.matmul(ds, w["look"].T.copy(), out=more)
    g["place"] = (np.ones(len(x), kind) @ dh.reshape(len(x), -1)).reshape(WINDOW, WIDTH)
    return g, dh.reshape(-1, WIDTH)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b over all rows of a and b, in many small products."""
    a, b = a.reshape(-1, a.shape[-1]), b.reshape(-1, b.shape[-1])
    whole = len(a) // 64 * 64
    out = (a[:whole].reshape(-1, 64, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, 64, b.shape[1])).sum(0)
    return out + a[whole:].T @ b[whole:] if whole < len(a) else out


def by_kind(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows of d summed by kind; two columns at a time, as one complex number."""
    order = np.argsort(x.astype(np.int16, copy=False), kind="stable")
    there = x.take(order)
    first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
    out = np.zeros((KINDS, d.shape[1]), d.dtype)
    pairs = d.take(order, axis=0).view(np.result_type(d.dtype, np.complex64))
    out[there.take(first)] = np.add.reduceat(pairs, first).view(d.dtype)
    return out


class Learner:
    """Weights under Adam; changes to the embedding wait for HOLD batches. The other weights lie in one array and move together."""

    def __init__(self, w: dict[str, np.ndarray], known: Successors, rate: float):
        self.w, self.known, self.rate, self.room = w, known, rate, Room(w["embed"].dtype)
        self.rest = sorted(k for k in w if k != "embed")
        flat, at = np.concatenate([w[k].ravel() for k in self.rest]), 0
        for k in self.rest:
            w[k] = flat[at : at + w[k].size].reshape(w[k].shape)
            at += w[k].size
        self.moved = {"embed": w["embed"], "rest": flat}
        self.steps = dict.fromkeys(self.moved, 0)
        self.m = {k: np.zeros_like(v) for k, v in self.moved.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.moved.items()}
        self.x, self.by_place = np.zeros(0, np.int16), np.zeros((0, WIDTH), w["embed"].dtype)
        self.held = self.rows = 0

    def _move(self, k: str, d: np.ndarray) -> None:
        self.steps[k] += 1
        t, m, s, r = self.steps[k], self.m[k], self.s[k], self.room(k, *d.shape)
        m += np.multiply(f4(0.1), np.subtract(d, m, out=r), out=r)
        d *= d
        s += np.multiply(f4(0.01), np.subtract(d, s, out=r), out=r)
        np.sqrt(np.multiply(s, f4(1 / (1 - 0.99**t)), out=r), out=r)
        r += f4(1e-8)
        np.divide(m, r, out=r)
        r *= f4(self.rate / (1 - 0.9**t))
        self.moved[k] -= r

    def step(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> None:
        rows = slice(self.rows, self.rows + x.size)
        if rows.stop > len(self.x):
            self.x, self.by_place = (np.concatenate([v[: self.rows], np.empty((HOLD * x.size, *v.shape[1:]), v.dtype)]) for v in (self.x, self.by_place))
        g, _ = gradients(self.w, self.known, x, y, use, self.room, self.by_place[rows])
        self._move("rest", np.concatenate([g[k].ravel() for k in self.rest]))
        np.clip(self.w["out"], -MOST, MOST, out=self.w["out"])
        self.x[rows] = x.ravel()
        self.held, self.rows = self.held + 1, rows.stop
        if self.held >= HOLD:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self._move("embed", by_kind(self.x[: self.rows], self.by_place[: self.rows]))
            self.held = self.rows = 0


class Windows:
    """Overlapping windows over many texts' kinds, one after another; each target is used once.

    Only where each window starts is held; inputs and targets are made a block at a time.
    """

    def __init__(self, kinds: np.ndarray, lengths: np.ndarray, first: int, overlap: int):
        ends = np.cumsum(lengths)
        begins = ends - lengths
        n = np.maximum(1, -(-(lengths - overlap) // (WINDOW - overlap)))
        self.owner = np.repeat(np.arange(len(lengths)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.start, self.end, self.opens = begins[self.owner] + place * (WINDOW - overlap), ends[self.owner], place == 0
        self.y, self.overlap = kinds.astype(np.intp), overlap
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[begins] = first

    def __len__(self) -> int:
        return len(self.start)

    def block(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and use."""
        along = np.arange(WINDOW)
        at, end = self.start[which][:, None] + along, self.end[which][:, None]
        use = at < end
        if self.overlap:
            use &= (along >= self.overlap) | self.opens[which][:, None]
        np.minimum(at, end - 1, out=at)
        return self.x.take(at), self.y.take(at), use


# --- subwords -----------------------------------------------------------------------------------


class Subwords:
    """Subword ids of words, each word encoded as it stands after a blank. Ids fit 16 bits."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2  # the last id ends a text
        self.end = self.size - 1
        self.library = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.opens[i] = token[:1] == b" "
        self.opens[self.end] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.begins = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 4096):
            part = [w.decode("utf-8", "replace") for w in words[i : i + 4096]]
            whole = " ".join(part)
            if len(whole.split()) == len(part):
                got = np.array(self.library.encode_ordinary(" " + whole), np.int64)
                first = np.flatnonzero(self.opens[got])
            else:  # a word that holds other white space
                each = [self.library.encode_ordinary(" " + x) for x in part]
                got = np.array([t for e in each for t in e], np.int64)
                first = np.cumsum([0, *map(len, each)])[:-1]
            ids.append(got)
            sizes.append(np.diff(np.append(first, len(got))))
        return np.concatenate(ids), np.concatenate(sizes)

    def places(self, words: list[bytes] | pa.BinaryArray) -> np.ndarray:
        """Places in the memo of words; new words go into it."""
        coded = (words if isinstance(words, pa.BinaryArray) else pa.array(words, pa.binary())).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = self.index
        found = list(map(index.get, different))
        if None in found:
            new = [w for w, i in zip(different, found, strict=True) if i is None]
            ids, sizes = self.of(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            at = iter(range(len(index) - len(new), len(index)))
            found = [next(at) if i is None else i for i in found]
        return np.array(found, np.int64)[coded.indices.to_numpy()]

    def spelled(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places of the memo, one after another, and how many each has."""
        n = self.begins[places + 1] - self.begins[places]
        return self.ids[np.repeat(self.begins[places] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str) -> Subwords:
    """One per Python worker, kept between tasks."""
    return Subwords(path, pattern)


def split_words(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts one after another, A-Z lower-cased and cut at ASCII white space, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, n = lists.flatten().cast(pa.binary()), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is False:  # white space at either end of a text cuts off an empty word
        n = np.bincount(np.repeat(np.arange(len(n)), n), full.to_numpy(zero_copy_only=False), len(n)).astype(np.int64)
        words = words.filter(full)
    return words, n


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The same for a list."""
    words, n = split_words(pa.array(texts, pa.string()))
    return words.to_pylist(), n


class Kinds:
    """Which kind each subword id is, and the log share of each id in its kind."""

    def __init__(self, counts: np.ndarray, opens: np.ndarray):
        ranked = np.argsort(-counts, kind="stable")
        self.of = np.empty(len(counts), np.int32)
        for side, low, high in ((opens, 0, OPENERS * MEMBERS), (~opens, OPENERS * MEMBERS, KINDS)):
            mine = ranked[side[ranked]]
            self.of[mine] = np.minimum(low + np.arange(len(mine)), high - 1)  # the last kind is all others
        weight = counts + 1.0
        self.single = np.bincount(self.of, counts, KINDS)
        self.share = np.log(weight / np.bincount(self.of, weight, KINDS)[self.of])


def _flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a binary column one after another, and how many each has."""
    column = pa.concat_arrays([column.cast(pa.binary())])
    edges = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint16, (edges[-1] - edges[0]) // 2, edges[0]) if data and edges[-1] > edges[0] else np.zeros(0, np.uint16)
    return ids, np.diff(edges).astype(np.int64) // 2


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    edges = np.concatenate([[0], np.cumsum(2 * sizes)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, np.uint16))])


# --- over the corpus -----------------------------------------------------------------------------

#: Values of `part` beyond the rounds: texts held out, counts of words.
HELD_OUT, COUNTS = -1, -2


def held_out(id_col: str) -> Column:
    """Texts that nothing is learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def part_of(id_col: str, text_col: str) -> Column:
    """The round that learns from a text."""
    return F.when(held_out(id_col), HELD_OUT).otherwise(F.pmod(F.xxhash64(text_key(text_col), F.lit("train")), F.lit(ROUNDS))).cast("int")


def _encode(path: str, pattern: str):
    """Texts as ids with the end; and the words of training texts as ids, with counts."""
    names = ["id", "key", "part", "ids", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path, pattern)
        seen, kind = np.zeros(0, np.int64), None

        def counted() -> pa.RecordBatch:
            at = np.flatnonzero(seen)
            none = pa.nulls(len(at), kind), pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(at), COUNTS, np.int32)), _binary(*coder.spelled(at)), pa.array(seen[at])], names=names)

        for batch in batches:
            kind = batch.column(1).type
            for i in range(0, batch.num_rows, TEXTS):
                some = batch.slice(i, TEXTS)
                words, n = split_words(some.column(0))
                places = coder.places(words)
                learned = np.repeat(some.column(3).to_numpy() >= 0, n)
                more = np.bincount(places[learned], minlength=len(coder.index))
                more[: len(seen)] += seen
                seen = more
                ids, sizes = coder.spelled(places)
                each = np.bincount(np.repeat(np.arange(len(n)), n), sizes, len(n)).astype(np.int64)
                whole = np.insert(ids, np.cumsum(each), coder.end)
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), some.column(3), _binary(whole, each + 1), pa.nulls(len(n), pa.int64())], names=names)
                if len(coder.index) > MEMO:
                    yield counted()
                    coder.forget()
                    seen = np.zeros(0, np.int64)
        if len(seen):
            yield counted()

    return run


def _count_subwords(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            ids, n = _flat(batch.column(0))
            total += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), n), size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["i", "n"])

    return run


def _texts(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some texts at a time: their rows, their ids and how many each has. The ids are the first column."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            some = batch.slice(i, most)
            yield some, *_flat(some.column(0))


def _count_pairs(kinds: Kinds, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS * KINDS, np.int64)
        for _, ids, n in _texts(batches, 4096):
            y = kinds.of[ids].astype(np.int64)
            x = np.concatenate([[0], y[:-1]])
            x[np.cumsum(n) - n] = kinds.of[end]
            total += np.bincount(x * KINDS + y, minlength=KINDS * KINDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    return run


def _train(kinds: Kinds, known: Successors, end: int, weights: dict[str, np.ndarray], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = {k: v.copy() for k, v in weights.items()}
        learner, seen = Learner(w, known, rate), 0
        for _, ids, n in _texts(batches):
            windows = Windows(kinds.of[ids], n, kinds.of[end], 0)
            order = np.random.default_rng(len(windows)).permutation(len(windows))
            for i in range(0, len(order), BATCH):
                learner.step(*windows.block(order[i : i + BATCH]))
            seen += len(ids)
        learner.settle()
        if seen:
            flat = np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.float64))], names=["i", "x", "n"])

    return run


def _sums(rows: DataFrame, size: int) -> np.ndarray:
    """Counts n by index i, summed before they reach the driver."""
    got = rows.groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[got["i"].to_numpy(np.int64)] = got["n"]
    return out


def fit(streams: DataFrame, counts: DataFrame, ends: int, coder: Subwords) -> tuple[Kinds, Successors, dict[str, np.ndarray]]:
    """The model, from word counts and from the training texts' ids (part, ids)."""
    single = _sums(counts.select("ids", "n").mapInArrow(_count_subwords(coder.size), "i long, n long"), coder.size)
    single[coder.end] = ends
    kinds = Kinds(single, coder.opens)
    pairs = streams.where("part >= 0").select("ids").mapInArrow(_count_pairs(kinds, coder.end), "i long, n long")
    known = Successors(_sums(pairs, KINDS * KINDS), kinds.single)
    weights = start_weights()
    for r, rate in enumerate(RATES):
        rows = streams.where(f"part = {r}").select("ids").mapInArrow(_train(kinds, known, coder.end, weights, rate), "i long, x double, n double")
        found = rows.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("i").toPandas()["x"].to_numpy(f4)
        at = 0
        for k in sorted(weights) if len(found) else ():
            weights[k] = found[at : at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size
    return kinds, known, weights


def score_ids(kinds: Kinds, known: Successors, w: dict[str, np.ndarray], ids: np.ndarray, n: np.ndarray, first: int) -> np.ndarray:
    """log10 probability of each text, given as its number of ids; windows of many texts go through the model together.

    Places that are context only are seen, but have no states of their own.
    """
    windows = Windows(kinds.of[ids], n, first, OVERLAP)
    out = np.bincount(np.repeat(np.arange(len(n)), n), kinds.share[ids], len(n))
    room = Room(w["embed"].dtype)
    for opens, skip in ((True, 0), (False, OVERLAP)):
        mine = np.flatnonzero(windows.opens == opens)
        for i in range(0, len(mine), BLOCK):
            x, y, use = windows.block(mine[i : i + BLOCK])
            h = hidden(w, x, room, skip)[0].reshape(len(x), -1, WIDTH)
            p = log_probability(w, known, h, x[:, skip:], y[:, skip:], room)
            p[~use[:, skip:]] = 0
            out += np.bincount(windows.owner[mine[i : i + BLOCK]], p.sum(1), len(n))
    return out / math.log(10)


class Frequent:
    """Values of frequent words, found by 64-bit sums of random numbers of each subword and place.

    A word that is not among n of them takes the value of one with a chance of n in 2^64.
    """

    def __init__(self, values: dict[bytes, float], size: int):
        rng = np.random.default_rng(3)
        self.by_id, self.by_place = (rng.integers(1, 1 << 64, n, dtype=np.uint64) for n in (size, LONG))
        self.by_place |= np.uint64(1)
        self.long = {w: x for w, x in values.items() if len(w) > 2 * LONG}
        short = [w for w in values if len(w) <= 2 * LONG]
        n = np.fromiter(map(len, short), np.int64, len(short)) // 2
        keys = self._keys(np.frombuffer(b"".join(short), np.uint16), np.cumsum(n) - n, n)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([values[w] for w in short], float)[order]

    def _keys(self, ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = np.minimum(np.arange(len(ids)) - np.repeat(starts, n), LONG - 1)
        return np.add.reduceat(self.by_id.take(ids) * self.by_place.take(place), starts)

    def of(self, ids: np.ndarray, starts: np.ndarray, absent: float) -> np.ndarray:
        """Values of the words that start at these places, the first of them at 0."""
        n = np.diff(np.append(starts, len(ids)))
        out = np.full(len(starts), absent)
        if len(self.keys):
            keys = self._keys(ids, starts, n)
            different, which = np.unique(keys, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, different), len(self.keys) - 1)
            out = np.where(self.keys.take(at) == different, self.values.take(at), absent)[which]
        for i in np.flatnonzero(n > LONG):
            out[i] = self.long.get(ids[starts[i] : starts[i] + n[i]].tobytes(), absent)
        return out


def _score(kinds: Kinds, known: Successors, weights: dict[str, np.ndarray], end: int, opens: np.ndarray, frequent_words: Frequent):
    """Per text: token count, the model's score, the baseline over frequent words, and the rare words left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, ids, n in _texts(batches):
            starts = np.flatnonzero(opens[ids])
            log = frequent_words.of(ids, starts, 1.0)  # logs of probabilities are below 0
            last = ids[starts] == end
            owner = np.repeat(np.arange(len(n)), n)[starts]
            frequent = (log <= 0) & ~last
            rare = np.flatnonzero((log > 0) & ~last)
            sizes = np.bincount(owner[rare], minlength=len(n))
            words = _binary(*_words_at(ids, starts, rare))
            rares = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), words)
            by_text = lambda use, weight=None: np.bincount(owner[use], None if weight is None else weight[use], len(n))
            columns = [by_text(slice(None)).astype(np.int64), by_text(frequent).astype(np.int64), by_text(frequent, log), score_ids(kinds, known, weights, ids, n, kinds.of[end])]
            yield pa.RecordBatch.from_arrays([*some.columns[1:], *map(pa.array, columns), rares], names=[*some.schema.names[1:], "n_tokens", "known", "base", "score", "rare"])

    return run


def _words_at(ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some of the words that start at these places, one after another, and how many each has."""
    sizes = np.diff(np.append(starts, len(ids)))[which]
    return ids[np.repeat(starts[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of counts above a threshold on n that `most` rows at most exceed, found from a histogram of a few hundred steps."""
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        left -= r["rows"]
        if left < 0:
            break
        least = r["n"]
    return counts.where(F.lit(False)) if least is None else counts.where(F.col("n") >= least)


def score_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null and empty texts are one end token. Rows equal in id and text each count in training and
    each get the same row. Without training texts every word is unknown. No rows: empty result.
    """
    tables = Tables(docs.sparkSession)
    coder = subwords(path, pattern)
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("key"), part_of(id_col, text_col).alias("part"))
    kind = rows.schema["id"].dataType.simpleString()
    streams = tables.write(rows.mapInArrow(_encode(path, pattern), f"id {kind}, key long, part int, ids binary, n long"), "part")
    counts = tables.write(streams.where(f"part = {COUNTS}").groupBy("ids").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = streams.where("part >= 0").count()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    kinds, known, weights = fit(streams, counts, ends, coder)
    top = Frequent({bytes(r["ids"]): math.log10((r["n"] + 1) / (total + distinct + 1)) for r in most_frequent(counts, TOP).collect()}, coder.size)
    texts = streams.where(f"part >= {HELD_OUT}").select("ids", "id", "key", (F.col("part") == HELD_OUT).alias("held_out"))
    scored = tables.write(texts.mapInArrow(_score(kinds, known, weights, coder.end, coder.opens, top), f"id {kind}, key long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>"))
    rare = scored.select("key", F.explode("rare").alias("ids")).join(counts, "ids", "left").groupBy("key").agg(F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(total + distinct + 1))).alias("rest"))
    out = scored.drop("rare").join(rare, "key", "left")
    end = math.log10((ends + 1) / (total + distinct + 1))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0)) + end).alias("base_score"), "score"
    )
