"""Entries of long documents against those of documents in one row."""

import random

import pytest

from tesselon.operators import lexicon, longtext

KIND = "doc int, pos int, line string"


def shown(df):
    return sorted((r.doc, r.n, r.translit, r.translation, r.codes, r.raw) for r in df.collect())


@pytest.mark.parametrize("ranges", [None, 7])
def test_equals_entries_of_a_row(spark, ranges):
    r = random.Random(6)
    pieces = ["[", "]", "{", "}", "[a]", "b c", "{D1}", "[x] y {Z1 A2}", "  ", "12", "plain words", "] {", "[n [m] k {Q}", "é {U}", "Dictionary of Middle Egyptian"]
    rows = [(d, 3 * i, "".join(r.choice(pieces) for _ in range(r.randint(1, 4)))) for d in range(5) for i in range(r.choice([1, 60, 200]))]
    rows += [(9, 1, None), (9, 2, "[a"), (9, 3, "{b}"), (9, 4, "c] d"), (9, 6, "more {"), (9, 7, "E1}")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    want = shown(lexicon.entries(df))
    assert shown(longtext.entries(df, ranges=ranges)) == want and len(want) > 60
    assert any(x[0] == 9 and x[2] == "a {b} c" and x[5] == "[a {b} c] d more { E1}" for x in want)


def test_one_long_document(spark):
    rows = 60_000
    df = spark.range(rows, numPartitions=6).selectExpr("1 as doc", "cast(id as int) as pos", "case id % 3 when 0 then concat('[w', id, '] a') when 1 then 'b more (no) brackets' else concat('c {D', id, '}') end as line")
    got = longtext.entries(df, ranges=16)
    assert got.count() == rows // 3 and got.where("n <> (cast(substring(translit, 2) as int)) / 3 or codes <> concat('D', 3 * n + 2) or translation <> 'a c'").isEmpty()


def test_nothing(spark):
    assert longtext.entries(spark.createDataFrame([], KIND)).count() == 0
    assert longtext.entries(spark.createDataFrame([(1, 1, "[] {A}"), (1, 2, "[a] {}"), (1, 3, "{x} [y]")], KIND)).count() == 0
