"""Literal cases of the dataset operators."""

import pytest
from pyspark.sql import functions as F

from tesselon.functions.expressions import natural_key
from tesselon.operators import geometry, labels, lexicon, pairs, scores
from tesselon.sources import sinks


def test_line_rules(spark):
    df = spark.createDataFrame([(1, "3 .5 .5 .2 .2"), (2, "3 .5 .5 .2"), (3, "3 .5 .5 .2 .2 .9"), (4, "  "), (5, "x .5 .5 .2 .2")], "k int, line string")
    keep = lambda rule: [r.k for r in labels.parse_lines(df, rule).orderBy("k").collect()]
    assert keep("exact5") == [1, 5] and keep("min5") == [1, 3, 5] and keep("nonempty") == [1, 2, 3, 5]
    assert labels.parse_lines(df, "exact5").where("k = 5").first().cls_id is None


def test_repair_and_invalid(spark):
    df = spark.createDataFrame([(i,) for i in (0, 126, 127, 148, 150, -1)], "cls_id long")
    assert [r.cls_id for r in labels.repair_ids(df).collect()] == [0, 126, 128, 149, 151, -1]
    assert {r.cls_id for r in labels.invalid_ids(df).collect()} == {150, -1}


def test_natural_order_and_class_map(spark):
    df = spark.createDataFrame([(x,) for x in ("1a", "a1", "10a", "2a", "a", "Aa15", "Aa1")], "class_name string")
    assert [r[0] for r in df.where("class_name not like 'Aa%'").orderBy(natural_key(F.col("class_name"))).collect()] == ["1a", "2a", "10a", "a", "a1"]
    order = [r.class_name for r in labels.class_map(df).orderBy("class_id").collect()]
    assert order[0] == "Aa1" and order[-1] == "Aa15"


def test_suspicious(spark):
    df = spark.createDataFrame([(0.95, 0.95), (0.92, 0.92), (0.2, 0.2), (0.19, 0.2), (0.5, 0.5)], "w double, h double")
    assert [r[0] for r in df.select(labels.suspicious(F.col("w"), F.col("h"))).collect()] == [True, False, False, True, False]


def test_pixel_corners(spark):
    df = spark.createDataFrame([(0.05, 0.5, 0.2, 0.4, 100, 200), (1.4, 0.5, 0.2, 0.2, 100, 100)], "xc double, yc double, bw double, bh double, width int, height int")
    got = [(r.x1, r.y1, r.x2, r.y2) for r in geometry.pixel_boxes(df).collect()]
    assert got == [(0, 60, 15, 140), (129, 40, 100, 60)]


def test_letterboxes(spark):
    df = spark.createDataFrame([(1, 100, 50), (2, 1000, 333), (3, 3, 700), (4, 1000, 1), (5, 256, 1)], "image_id int, width int, height int")
    a = {r.image_id: r for r in geometry.letterbox_margin(df).collect()}
    assert (a[1].new_w, a[1].new_h, a[1].off_x, a[1].off_y, a[1].method) == (212, 106, 6, 59, "lanczos")
    assert (a[2].new_h, a[2].off_y, a[2].method) == (70, 77, "area") and a[3].status == "reject"
    b = {r.image_id: r for r in geometry.letterbox_fit(df).collect()}
    assert (b[1].new_h, b[1].off_y) == (320, 160) and (b[4].new_h, b[5].new_h) == (1, 2)


def test_tiles_and_segments(spark):
    box = spark.createDataFrame([(0.5, 0.5, 0.4, 0.2)], "xc double, yc double, bw double, bh double")
    r = geometry.tile_remap(box, F.lit(10)).first()
    assert (r.nx, r.ny, r.nw, r.nh) == (0.3125, 0.1875, 0.05, 0.025)
    with pytest.raises(ValueError):
        geometry.tile_remap(box, F.lit(0), grid=6)
    df = spark.createDataFrame([(1, 1003, 1000), (2, 500, 300), (3, 90, 20)], "image_id int, width long, height long")
    assert {r.image_id: r["count"] for r in geometry.strip_segments(df).groupBy("image_id").count().collect()} == {1: 60}


def test_split_counts(spark):
    for n, val in ((1, 1), (4, 1), (5, 1), (10, 2), (15, 3), (36, 7)):
        df = spark.range(n).withColumn("g", F.lit("a"))
        assert pairs.stratified_split(df, "g", "id").where("split = 'val'").count() == val


def test_lexicon(spark):
    lines = ["[ra] mouth {D21}", "[mw] a long", "middle piece", "meaning {N35 A1a}", "[xx] odd {Zz9 A1}", "[no] braces only", "12", "Dictionary of Middle Egyptian"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, pos int, line string")
    known = spark.createDataFrame([(x,) for x in ("A1", "Aa1", "D21", "N35", "G17")], "code string")
    got = {r.translit: r for r in lexicon.routed(lexicon.entries(df), known).collect()}
    assert set(got) == {"ra", "mw", "xx"} and got["mw"].translation == "a long meaning"
    assert (got["ra"].gardiner_seq_orig, got["mw"].gardiner_seq, got["mw"].gardiner_seq_orig) == ("", "N35 A1", "N35 A1a")
    assert not got["xx"].clean and got["xx"].unknown_codes == "Zz9"


def test_normalised_confusion(spark):
    df = spark.createDataFrame([(0, 0, 8), (0, 1, 2), (2, 0, 1), (2, 1, 1), (2, 2, 2)], "row_label long, col_label long, n long")
    got = {(r.row_label, r.col_label): r.share for r in scores.normalised(df, 3).collect()}
    assert [got[0, i] for i in range(3)] == [0.8, 0.2, 0] and [got[1, i] for i in range(3)] == [0, 0, 0] and [got[2, i] for i in range(3)] == [0.25, 0.25, 0.5]


def test_nms(spark):
    rows = [(1, 0, 0.9, 0, 0, 10, 10), (1, 0, 0.8, 1, 1, 11, 11), (1, 0, 0.7, 20, 20, 30, 30), (1, 1, 0.6, 0, 0, 10, 10), (1, 0, 0.1, 50, 50, 60, 60)]
    df = spark.createDataFrame(rows, "image_id int, cls_id int, conf double, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r.conf for r in scores.nms(df).collect()) == [0.6, 0.7, 0.9]


def test_correction(spark):
    seqs = spark.createDataFrame([(["A1", "B2"],), (["A1", "C3"],)], "seq array<string>")
    cost = spark.createDataFrame([("X9", "B2", 0.2), ("X9", "C3", 0.7)], "seen string, meant string, p double")
    got = lexicon.correct(spark.createDataFrame([(["A1", "X9"],)], "seq array<string>"), seqs, cost).collect()
    assert got[0].fixed == ["A1", "C3"]


def test_collisions_and_png(spark):
    plan = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "src string, dst string")
    there = spark.createDataFrame([("y",)], "dst string")
    assert {r.src for r in sinks.collisions(plan, there).collect()} == {"a", "b", "c"}
    assert sinks.png(1, 1, b"\x01\x02\x03").startswith(b"\x89PNG")


def test_ranks_of_many_rows_are_spread(spark):
    """Ranks over all of some MB, by Spark's estimate, come from more than one task, and are the same."""
    from pyspark.sql import functions as F

    from tesselon.operators import pairs

    got = pairs.ranked(spark.range(300_000), None, -F.col("id")).withColumn("part", F.spark_partition_id())
    assert got.where("rank + id <> 300000").isEmpty() and got.select("part").distinct().count() > 1
