"""Renames whose destinations are other rows' sources."""

import random

import pytest
from pyspark.sql import functions as F

from tesselon.operators import renames
from tesselon.sources import sinks

PLAN = "src string, dst string"


def played(moves):
    """Names after the passes, each move onto a free name."""
    held = {}
    for n in (1, 2, 3):
        now = [(m.src, m.dst) for m in moves if m["pass"] == n]
        assert not {a for a, _ in now} & {b for _, b in now}  # the order within a pass does not matter
        for a, b in now:
            there = held.pop(a, a)
            held[b] = there
    return held


@pytest.mark.parametrize("rows", [[], [("a", "a")], [("a", "b")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "c"), ("c", "d")], [(f"n{i:05}", f"n{i + 1:05}") for i in range(700)]])
def test_shifts_swaps_and_cycles(spark, rows):
    moves = renames.passes(renames.move_order(spark.createDataFrame(rows, PLAN))).collect()
    held = played(moves)
    assert held == {b: a for a, b in rows if a != b}


def test_random_plans(spark):
    r = random.Random(5)
    for n in (7, 60, 400):
        names = [f"x/{i}" for i in range(n)]
        to = r.sample([*names, *(f"y/{i}" for i in range(n // 8))], n)
        rows = list(zip(names, to, strict=True))
        order = renames.move_order(spark.createDataFrame(rows, PLAN)).collect()
        assert sorted((o.src, o.dst) for o in order) == sorted(rows)
        leads = dict(rows)
        for o in order:
            at, k, seen = o.dst, 0, {o.src}
            while at in leads and at not in seen:
                seen.add(at)
                at, k = leads[at], k + 1
            cycle = at == o.src
            assert o.kind == ("same" if o.src == o.dst else "cycle" if cycle else "chain" if k or o.src in to else "free")
            assert o.kind != "chain" or o.place == k
        assert played(renames.passes(renames.move_order(spark.createDataFrame(rows, PLAN))).collect()) == {b: a for a, b in rows if a != b}


def test_refused_plans(spark):
    plan = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e"), ("f", "e"), (None, "q"), ("g", None), ("h", "i")], PLAN)
    assert sorted((r.src or "", r.dst or "", r.why) for r in renames.refused(plan).collect()) == [("", "q", "no name"), ("a", "b", "src twice"), ("a", "c", "src twice"), ("d", "e", "dst twice"), ("f", "e", "dst twice"), ("g", "", "no name")]


def test_files_move(spark, tmp_path):
    for x in "abcdefghi":
        (tmp_path / x).write_text(x)
    at = lambda pairs: spark.createDataFrame([(str(tmp_path / a), str(tmp_path / b)) for a, b in pairs], PLAN)
    pairs = [("a", "b"), ("b", "c"), ("c", "sub/z"), ("d", "e"), ("e", "d"), ("f", "g"), ("g", "h"), ("h", "f")]
    with pytest.raises(FileExistsError):
        sinks.apply_plan(at(pairs))  # copies would lose originals
    with pytest.raises(FileExistsError):
        sinks.apply_plan(at([("a", "b"), ("b", "i")]), move=True)  # i is not moved away
    sinks.apply_plan(at(pairs), move=True)
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {b: a for a, b in pairs} | {"i": "i"}


def test_parked_names_lie_beside_their_destination(spark):
    order = spark.createDataFrame([("p/a", "q/b", "cycle", 1, True)], "src string, dst string, kind string, place long, aside boolean")
    first = renames.passes(order).where("pass = 1").first()
    assert first.dst.startswith("q/.moving-") and renames.passes(order, F.lit("tmp")).where("pass = 3").first().src == "tmp"
