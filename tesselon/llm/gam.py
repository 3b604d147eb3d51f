"""Quality classifier: a generalised additive model with pairwise interactions.

A text's statistics are binned; each statistic, and each of a few pairs of them, has a lookup table
over its bins. A score is the logistic function of the sum of the looked-up values. Tables are learned by cyclic boosting: in
each round every statistic in turn gets a tree of up to four leaves over its own bins, fitted to
what the sum so far leaves unexplained, and a small share of it is added to its table. Pairs
are ranked by what their best cross of two cuts would explain after that, and boosted likewise, each
tree cutting one statistic and then both halves by the other.

The model is fitted on the driver from a sample of labelled rows with a fixed bound (SAMPLE), as arrays of
statistics. Texts are read and scored by tasks, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that the model is fitted on.
SAMPLE = 20_000
#: Bins of a statistic on its own and in a pair, pairs, rounds at most for each.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS = 64, 16, 8, 400, 200
RATE, LEAST, RIDGE = 0.05, 8.0, 1.0

STATISTICS = (
    "log_words", "log_bytes", "word_length", "long_words", "distinct", "top_word", "same_next", "odd_words", "bare_words", "capital_words", "sentence_ends",
    "letters", "digits", "upper", "space", "symbols", "stops", "high", "brackets", "log_lines", "line_words", "same_lines", "compressed", "char_entropy",
)
_SYMBOL, _STOP, _BRACKET = b"#$%&*|<>@~^=+_\\/{}", b".,;:!?", b"()[]\"'"
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; an empty one has none of anything."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda part: int(bytes_[[*part]].sum()) / n
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    odd = sum(c for w, c in counts.items() if _ODD.search(w))
    bare = sum(c for w, c in counts.items() if not any(map(str.isalpha, w)))
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    ends = sum(c for w, c in counts.items() if w[-1] in ".!?")
    long = sum(c for w, c in counts.items() if len(w) > 12)
    length = sum(len(w) * c for w, c in counts.items())
    lines = [x for x in text.split("\n") if x.strip()]
    shares = bytes_[bytes_ > 0] / n
    return [
        math.log1p(len(words)), math.log1p(len(data)), length / m, long / m, len(counts) / m, max(counts.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m, odd / m, bare / m, capital / m, ends / m,
        of([*range(65, 91), *range(97, 123)]), of(range(48, 58)), of(range(65, 91)), of(b" \t\n\r"), of(_SYMBOL), of(_STOP), of(range(128, 256)), of(_BRACKET),
        math.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), len(zlib.compress(data, 1)) / n, float(-(shares * np.log2(shares)).sum()),
    ]


@dataclass
class Model:
    """edges: of each statistic's bins; tables: a value for each bin; pairs: (i, j, edges, edges, values of the grid)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of statistics: bins are looked up and added."""
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Limits between bins of about equal numbers of rows, midway between values."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    cut = np.unique(np.quantile(x, np.arange(1, bins) / bins))
    at = np.minimum(np.searchsorted(values, cut, "right"), len(values) - 1)
    return np.unique((values[at - 1] + values[at]) / 2)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """Where to cut a row of bins in two, and what that explains; 0 if neither side may be so small."""
    if len(g) < 2:
        return 0, 0.0
    left, weight, rows = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(left, weight) + _gain(g.sum() - left, h.sum() - weight) - _gain(g.sum(), h.sum())
    gain[(rows < LEAST) | (n.sum() - rows < LEAST)] = 0
    at = int(gain.argmax())
    return (at + 1, float(gain[at])) if gain[at] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A step for each bin: a tree of depth two over the order of the bins."""
    out = np.zeros(len(g))
    first, _ = _cut(g, h, n)
    for a, b in ((0, first), (first, len(g))) if first else ((0, len(g)),):
        second, _ = _cut(g[a:b], h[a:b], n[a:b])
        for c, d in ((a, a + second), (a + second, b)) if second else ((a, b),):
            out[c:d] = g[c:d].sum() / (h[c:d].sum() + RIDGE)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As _tree() over a grid: one axis is cut, then both halves along the other; the axis that explains more goes first."""
    best = None
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        first, gain = _cut(a.sum(1), b.sum(1), c.sum(1))
        out = np.zeros(a.shape)
        for p, q in ((0, first), (first, len(a))) if first else ((0, len(a)),):
            u, v, w = (x[p:q].sum(0) for x in (a, b, c))
            second, more = _cut(u, v, w)
            gain += more
            for r, s in ((0, second), (second, len(u))) if second else ((0, len(u)),):
                out[p:q, r:s] = u[r:s].sum() / (v[r:s].sum() + RIDGE)
        if best is None or gain > best[0]:
            best = gain, out.T if turn else out
    return best[1]


def _boost(y: np.ndarray, z: np.ndarray, held: np.ndarray, cells: list[np.ndarray], shapes: list[tuple[int, ...]], rounds: int, tree) -> list[np.ndarray]:
    """Tables after the round with the least loss on the held rows; z, the sum so far, is moved on to it.

    cells: for each table the cell of each row. Only the other rows teach.
    """
    tables = [np.zeros(s) for s in shapes]
    own = ~held
    taught = [(c[own], np.bincount(c[own], minlength=math.prod(s)).reshape(s).astype(float)) for c, s in zip(cells, shapes, strict=True)]
    loss = lambda: float(np.logaddexp(0, np.where(y[held] > 0, -z[held], z[held])).mean()) if held.any() else 0.0
    best, since, kept = loss(), 0, [t.copy() for t in tables]
    start = z.copy()
    for _ in range(rounds):
        for k, ((cell, n), shape) in enumerate(zip(taught, shapes, strict=True)):
            p = 1 / (1 + np.exp(-z[own]))
            size = math.prod(shape)
            g = np.bincount(cell, y[own] - p, size).reshape(shape)
            h = np.bincount(cell, p * (1 - p), size).reshape(shape)
            step = RATE * np.clip(tree(g, h, n), -4, 4)
            tables[k] += step
            z += step.ravel()[cells[k]]
        now = loss()
        if now < best - 1e-6:
            best, since, kept = now, 0, [t.copy() for t in tables]
        elif held.any() and (since := since + 1) >= 30:
            break
    if not held.any():
        kept = tables
    z[:] = start
    for t, c in zip(kept, cells, strict=True):
        z += t.ravel()[c]
    return kept


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows of statistics and labels (0, 1). Every eighth row only tells when to stop.

    Without rows the score is 0.5; with one label only, what its rows make likely. The order of rows matters as far as it picks those held back.
    """
    n = len(y)
    base = math.log((y.sum() + 1) / (n - y.sum() + 1))
    if n < 16 or y.min() == y.max():
        return Model(base, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    held = np.arange(n) % 8 == 7 if n >= 400 else np.zeros(n, bool)
    rounds, pair_rounds = (ROUNDS, PAIR_ROUNDS) if held.any() else (40, 20)  # few rows: nothing is held back, so few rounds
    y = y.astype(float)
    edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    z = np.full(n, base)
    tables = _boost(y, z, held, cells, [(len(e) + 1,) for e in edges], rounds, _tree)
    p = 1 / (1 + np.exp(-z))
    g, h = np.where(held, 0, y - p), np.where(held, 0, p * (1 - p))
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    ranked = sorted(((-_cross(small[i], small[j], len(coarse[i]) + 1, len(coarse[j]) + 1, g, h), i, j) for i, j in combinations(range(x.shape[1]), 2)))
    chosen = [(i, j) for gain, i, j in ranked[:PAIRS] if gain < 0]
    grids = _boost(y, z, held, [small[i] * (len(coarse[j]) + 1) + small[j] for i, j in chosen], [(len(coarse[i]) + 1, len(coarse[j]) + 1) for i, j in chosen], pair_rounds, _grid_tree)
    return Model(base, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, grids, strict=True)])


def _cross(a: np.ndarray, b: np.ndarray, na: int, nb: int, g: np.ndarray, h: np.ndarray) -> float:
    """What the best cross of two cuts would explain: four quarters, each with its own step."""
    if na < 2 or nb < 2:
        return 0.0
    u, v = (np.bincount(a * nb + b, w, na * nb).reshape(na, nb).cumsum(0).cumsum(1) for w in (g, h))
    low = lambda s: s[:-1, :-1]  # noqa: E731  below both cuts
    first, second = (lambda s: s[:-1, -1:] - low(s)), (lambda s: s[-1:, :-1] - low(s))
    rest = lambda s: s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low(s)
    quarters = sum(_gain(part(u), part(v)) for part in (low, first, second, rest))
    return float(quarters.max() - _gain(u[-1, -1], v[-1, -1]))


def held_out(id_: Column, parts: int = 5) -> Column:
    """Whether the CRC-32 of the id as text (a null id: of nothing) is a multiple of parts: such rows teach nothing."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % parts == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the `sample` labelled texts of lowest hashed id that are not held out, in that order.

    An id with several labels counts as 1 if any is; null ids and labels are passed over. The chosen ids are `sample` at most, so they are
    broadcast and no text is shuffled; what is collected is a row of statistics for each. Where rows share an id, each of
    them is taken, but none beyond the bound.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col) == 1).cast("int").alias("label")).withColumn("order", F.xxhash64("label_id", F.lit("sample")))
    n = known.count()
    if n > 4 * sample:  # most rows need not be sorted to find the lowest
        known = known.where(F.pmod("order", F.lit(n)) < 2 * sample).withColumn("order", F.pmod("order", F.lit(n)))
    chosen = known.orderBy("order", "label_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("x")).join(F.broadcast(chosen), F.col("own_id") == F.col("label_id"))
    rows = _over(rows.select("x", "order", "own_id", "label"), lambda x: pa.array(x.tolist(), pa.list_(pa.float64())), "stats array<double>")
    got = rows.orderBy("order", "own_id", "stats").limit(sample).collect()
    return np.array([r["stats"] for r in got]).reshape(len(got), len(STATISTICS)), np.array([r["label"] for r in got], int)


def _over(rows: DataFrame, value, column: str) -> DataFrame:
    """rows without their first column, a text (null: empty), then what value() makes of the texts' statistics."""
    schema = rows.drop("x").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = np.array([statistics(t.as_py() or "") for t in part.column(0)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], value(x)], names=[*schema.names, column.split()[0]])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), column]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score, predicted: the chance that a text's label is 1, and whether it reaches the threshold.

    One row per row, repeats included; null texts count as empty and are scored like any other. Nothing but the text is an input. Without labelled
    rows every score is 0.5; without documents there are no rows.
    """
    model = fit(*training_rows(docs, labels, sample, id_col, text_col, label_col))
    own = "own_id"
    rows = docs.select(F.col(text_col).cast("string").alias("x"), F.col(id_col).alias(own))
    scored = _over(rows, lambda x: pa.array(model.scores(x), pa.float64()), "score double")
    return scored.select(F.col(own).alias(id_col), held_out(F.col(own)).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted"))
