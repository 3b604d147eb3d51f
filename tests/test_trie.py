"""Sequences corrected along a prefix tree, against weighted edit distances."""

import itertools
import random

import pytest

from tesselon.operators import trie

SEQ, COST = "seq array<string>", "seen string, meant string, cost long"


def distance(a, b, mistakes, missing, extra, other):
    row = [j * missing for j in range(len(b) + 1)]
    for x in a:
        now = [row[0] + extra]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + extra, now[j - 1] + missing, row[j - 1] + (0 if x == y else mistakes.get((x, y), other))))
        row = now
    return row[-1]


def brute(seen, lexicon, mistakes, most, missing=1000, extra=1000, other=1000):
    n = {}
    for w in lexicon:
        n[tuple(w)] = n.get(tuple(w), 0) + 1
    out = {}
    for s in {tuple(s) for s in seen if s}:
        best = min(((distance(s, w, mistakes, missing, extra, other), -k, w) for w, k in n.items() if w), default=(most + 1,))
        out[s] = (best[2], best[0]) if best[0] <= most else (None, None)
    return out


def run(spark, seen, lexicon, mistakes, most=1500, **costs):
    words = trie.prefix_table(spark.createDataFrame([(w,) for w in lexicon], SEQ))
    found = trie.corrected(spark.createDataFrame([(s,) for s in seen], SEQ), words, spark.createDataFrame([(*k, v) for k, v in mistakes.items()], COST), most, **costs)
    return {tuple(r.seq): (r.fixed and tuple(r.fixed), r.cost) for r in found.collect()}


def test_missing_superfluous_and_mistaken_codes(spark):
    lexicon = [["A1", "B2", "C3"], ["A1", "C3"], ["D4", "B2"], ["D4", "B3"]]
    seen = [["A1", "B2", "C3"], ["B2", "C3"], ["A1", "B2"], ["A1", "X", "B2", "C3"], ["D4", "B9"], ["Q", "Q", "Q"], [], None]
    got = run(spark, seen, lexicon, {("B9", "B3"): 200})
    assert got == {("A1", "B2", "C3"): (("A1", "B2", "C3"), 0), ("B2", "C3"): (("A1", "B2", "C3"), 1000), ("A1", "B2"): (("A1", "B2", "C3"), 1000), ("A1", "X", "B2", "C3"): (("A1", "B2", "C3"), 1000), ("D4", "B9"): (("D4", "B3"), 200), ("Q", "Q", "Q"): (None, None)}


@pytest.mark.parametrize("costs", [{}, {"missing": 400, "extra": 700, "other": 900}])
def test_against_edit_distances(spark, costs):
    r = random.Random(4)
    word = lambda: [r.choice("abcde") for _ in range(r.randint(1, 5))]
    lexicon, seen = [word() for _ in range(40)], [word() for _ in range(60)]
    mistakes = {(a, b): r.randint(1, 12) * 100 for a, b in itertools.permutations("abcde", 2) if r.random() < 0.4}
    assert run(spark, seen, lexicon, mistakes, 1600, **costs) == brute(seen, lexicon, mistakes, 1600, **costs)


def test_frequent_sequences_win_ties(spark):
    got = run(spark, [["a", "x"]], [["a", "c"], ["a", "b"], ["a", "c"], ["a", "a"]], {})
    assert got == {("a", "x"): (("a", "c"), 1000)}
    assert run(spark, [["a", "x"]], [["a", "c"], ["a", "b"]], {}) == {("a", "x"): (("a", "b"), 1000)}


def test_empty_tables(spark):
    assert run(spark, [], [["a"]], {}) == {} and run(spark, [["a"]], [], {}) == {("a",): (None, None)}
    with pytest.raises(ValueError):
        run(spark, [["a"]], [["a"]], {}, missing=0)


def test_prefixes(spark):
    rows = trie.prefix_table(spark.createDataFrame([(["a", "b"],), (["a"],), (["a", None, "b"],), (None,), ([],)], SEQ)).collect()
    assert sorted((r.parent, r.code, r.depth, r.n) for r in rows) == [("", "a", 1, 1), ("\x1fa", "b", 2, 2)]
