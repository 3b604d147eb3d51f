"""Listings, readers, plans and writers on files, and ranks over many ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesselon.operators import audit, labels, lexicon, pairs, ranges, scores
from tesselon.sources import sinks, tables
from tesselon.streaming.labels import histogram_stream


@pytest.fixture
def tree(tmp_path):
    for name, data in {"images/train/a_1.JPG": b"x", "images/val/b_2.png": b"yy", "labels/train/a_1.txt": b"3 .5 .5 .2 .2\n4 .1 .1 .1 .1\n", "labels/val/b_2.txt": b"", "labels/val/c_3.txt": b"5 .5 .5 .2 .2 .9\n", "x/notes.md": b"n", "empty.png": b""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def test_listing(spark, tree):
    got = [(r.stem, r.suffix, r.length) for r in tables.list_files(spark, str(tree)).collect()]
    assert sorted(got) == [("a_1", "jpg", 1), ("b_2", "png", 2), ("empty", "png", 0)]
    many = tables.list_files(spark, str(tree), globs=("*.png", "b*"))
    assert sorted(r.stem for r in many.collect()) == ["b_2", "empty"]
    files = tables.list_files(spark, str(tree))
    assert sorted(r.class_name for r in tables.class_folders(files.where("length > 0")).collect()) == ["train", "val"]
    assert tables.layout_of(files).first().layout == "split"
    assert tables.layout_of(files.where("stem = 'empty'")).first().layout == "flat"
    flags = {r.stem: r.empty for r in tables.label_listing(tables.list_files(spark, str(tree / "labels"), ("txt",))).collect()}
    assert flags == {"a_1": False, "b_2": True, "c_3": False}


def test_labels_from_files_to_audit(spark, tree):
    lines = tables.read_labels(spark, str(tree / "labels")).withColumnRenamed("stem", "image_id")
    files = tables.label_listing(tables.list_files(spark, str(tree / "labels"), ("txt",))).withColumnRenamed("stem", "image_id")
    images = spark.createDataFrame([("a_1",), ("b_2",), ("z",)], "image_id string")
    r = audit.health(images, files, labels.line_classes(lines), classes=10, unknown=5, low=2).first()
    assert (r.n_images, r.n_label_files, r.n_empty, r.n_instances, r.n_invalid, r.n_zero, r.n_low, r.avg_per_file) == (3, 3, 1, 3, 0, 7, 3, 1.0)
    assert r.unknown_warning


def test_streamed_histogram(spark, tree):
    q = histogram_stream(spark, str(tree / "labels" / "*")).writeStream.outputMode("complete").format("memory").queryName("classes").start()
    q.processAllAvailable()
    q.stop()
    assert {r.cls_id: r.n for r in spark.table("classes").collect()} == {3: 1, 4: 1, 5: 1}


def test_label_files_keep_the_order_of_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 9, 0.5, 0.5, 0.1, 0.1), ("a", 0, 12, 0.25, 0.5, 0.1, 0.1)], "image_id string, line_no int, cls_id int, xc double, yc double, bw double, bh double")
    texts = sinks.label_files(df).withColumn("name", F.concat("image_id", F.lit(".txt")))
    assert sinks.write_files(texts, str(tmp_path)) == 1
    assert (tmp_path / "a.txt").read_text() == "12 0.250000 0.500000 0.100000 0.100000\n9 0.500000 0.500000 0.100000 0.100000\n"


def test_plans(spark, tree):
    plan = spark.createDataFrame([(str(tree / "x/notes.md"), str(tree / "y/notes_0.md"))], "src string, dst string")
    sinks.apply_plan(plan)
    assert (tree / "y/notes_0.md").read_bytes() == b"n" and (tree / "x/notes.md").exists()
    with pytest.raises(FileExistsError):
        sinks.apply_plan(plan)
    with pytest.raises(FileExistsError):
        sinks.apply_plan(spark.createDataFrame([("a", "q"), ("b", "q")], "src string, dst string"))
    sinks.apply_plan(spark.createDataFrame([(str(tree / "x/notes.md"), str(tree / "moved.md"))], "src string, dst string"), move=True)
    assert (tree / "moved.md").exists() and not (tree / "x/notes.md").exists()
    files = tables.list_files(spark, str(tree))
    doomed = sinks.delete_plan(files, F.col("length") > 1)
    sinks.write_delete_list(doomed, str(tree / "doomed"))
    assert sorted(r.value.rsplit("/", 1)[-1] for r in spark.read.text(str(tree / "doomed")).collect()) == ["a_1.JPG", "empty.png"]


def test_class_lists_and_manifests(spark):
    classes = spark.createDataFrame([("b c", 1), ("a", 0), ("true", 2)], "class_name string, class_id int")
    assert sinks.class_lines(classes) == "a\nb c\ntrue\n" and list(json.loads(sinks.class_map_json(classes)).items()) == [("a", 0), ("b c", 1), ("true", 2)]
    assert tables.read_manifest(sinks.manifest(classes, "/d"))["nc"] == 3
    block = tables.read_manifest(sinks.manifest_yaml("/d", ["a", "b c", "true"]))
    assert block == {"path": "/d", "train": "images/train", "val": "images/val", "nc": 3, "names": ["a", "b c", "true"]}
    assert tables.read_manifest("nc: 2\nnames: [x, 'y']\n")["names"] == ["x", "y"] and tables.read_manifest("names:\n  0: p\n  1: q\nnc: 2")["names"] == ["p", "q"]


def test_matrix_exports(spark, tmp_path):
    import io

    import numpy as np

    cells = spark.createDataFrame([(0, 0, 2), (1, 0, 3), (1, 1, 4)], "row_label int, col_label int, n int")
    assert np.load(io.BytesIO(sinks.matrix_npy(cells, 3, "n"))).tolist() == [[2, 0, 0], [3, 4, 0], [0, 0, 0]]
    sinks.matrix_csv(cells, [0, 1, 2], "n", str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == [("0", "2", "0", "0"), ("1", "3", "4", "0")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.matrix_csv(cells, [0, 1, 2], "n", str(tmp_path / "m"))
    assert json.loads(sinks.scores_json(spark.createDataFrame([("x", 0.12345678)], "k string, v double"), "k", "v")) == {"x": 0.123457}


def test_csv_pair(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, '[a "b", c] x {A1}'), (1, 1, "[d] y {Zz1}")], "doc int, pos int, line string")
    found = lexicon.routed(lexicon.entries(lines), spark.createDataFrame([("A1",)], "code string"))
    clean = found.where("clean").select("translit", "translation", "gardiner_seq", "gardiner_seq_orig")
    bad = found.where("not clean").select("translit", "translation", "gardiner_seq", "gardiner_seq_orig", "unknown_codes", F.col("raw").alias("raw_line"))
    sinks.write_csv_pair(clean, bad, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out/clean"), header=True, escape='"')
    assert back.columns == clean.columns and back.first().translit == 'a "b", c' and spark.read.csv(str(tmp_path / "out/quarantine"), header=True).first().unknown_codes == "Zz1"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_csv_pair(clean, bad, str(tmp_path / "out"))


def test_corrections_need_the_confusion_table(spark):
    seqs = spark.createDataFrame([(["A1", "B2"],), (["A1", "C3"],), (["D4"],)], "seq array<string>")
    cost = spark.createDataFrame([("X9", "B2", 0.2), ("X9", "C3", 0.7), ("E5", "D4", 0.1)], "seen string, meant string, p double")
    asked = spark.createDataFrame([(["A1", "X9"],), (["A1", "B2"],), (["E5"],), (["F6"],), ([],)], "seq array<string>")
    assert {tuple(r.seq): r.fixed for r in lexicon.correct(asked, seqs, cost).collect()} == {("A1", "X9"): ["A1", "C3"], ("E5",): ["D4"]}


def test_report_and_totals(spark):
    lines = ["[ra] mouth {D21}", "[mw] a long", "middle piece", "meaning {N35 A1a}", "[xx] odd {Zz9 A1}", "[no] braces only", "A - Alpha, be/ta", "a – lower", "12", "[e] none {}", "[n] in {A[1]}"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, pos int, line string")
    kinds = [r.kind for r in lexicon.classify_lines(df).orderBy("pos").collect()]
    assert kinds[6:9] == ["header", "noise", "number"]
    known = spark.createDataFrame([(x,) for x in ("A1", "Aa1", "D21", "N35", "G17")], "code string")
    found = lexicon.routed(lexicon.entries(df), known)
    r = lexicon.totals(df, found).first()
    assert (r.n_lines, r.dropped, r.candidates, r.clean, r.quarantined, r.normalised, r.unknown_codes) == (11, 2, 3, 2, 1, 1, 1)
    text = lexicon.report(lexicon.totals(df, found), spark.createDataFrame([("Zz9", 1)], "code string, n int"), lexicon.first_lines(df, "noise", 15))
    assert "candidates      : 3" in text and "Zz9" in text and "middle piece" in text


def test_names_and_lists(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "cls_id int, class_name string")
    rows = spark.createDataFrame([(0,), (7,)], "cls_id int")
    assert {r.cls_id: r.class_name for r in labels.named(rows, names).collect()} == {0: "a", 7: "OUT OF RANGE"}
    assert labels.same_folder(names, "B").count() == 1
    with pytest.raises(ValueError):
        labels.same_folder(names, "zz")
    with pytest.raises(ValueError):
        labels.availability(names, names.limit(0))
    with pytest.raises(ValueError):
        pairs.sample(spark.range(5), "id", 6, exact=True)
    assert pairs.sample(spark.range(5), "id", 6).count() == 5


def test_ranks_over_many_ranges(spark):
    rows = [(i, f"g{i % 3 if i % 2 else 0}" if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string")
    want = {}
    for k, g in rows:
        want[g, k] = 1 + sum(a < k and b == g for a, b in rows)
    assert {(r.g, r.k): r["rank"] for r in pairs.ranked(df, "g", F.col("k")).collect()} == want
    many = ranges.numbered(df, ["g"], F.col("k"), ranges=37)
    assert {(r.g, r.k): r["rank"] for r in many.collect()} == want and "k" in many.columns and len(many.columns) == 3
    assert sorted(r["rank"] for r in pairs.ranked(df, None, F.format_string("%05d", "k")).collect()) == list(range(1, 501))


def brute_nms(rows, iou):
    out = []
    for key in {r[:2] for r in rows}:
        kept = []
        for b in sorted((r for r in rows if r[:2] == key and r[2] >= 0.25), key=lambda r: (-r[2], *r[3:])):
            def share(k, b=b):
                w, h = min(b[5], k[5]) - max(b[3], k[3]), min(b[6], k[6]) - max(b[4], k[4])
                both = max(w, 0) * max(h, 0)
                return both / max((b[5] - b[3]) * (b[6] - b[4]) + (k[5] - k[3]) * (k[6] - k[4]) - both, 1e-12)
            if all(share(k) <= iou for k in kept):
                kept.append(b)
        out += kept
    return sorted(out)


def test_suppression_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(12):
        for _ in range(r.randint(1, 40)):
            x, y = r.randint(0, 60), r.randint(0, 60)
            rows.append((i, r.randint(0, 1), r.randint(0, 20) / 20, x, y, x + r.randint(0, 30), y + r.randint(0, 30)))
    df = spark.createDataFrame(rows, "image_id int, cls_id int, conf double, x1 int, y1 int, x2 int, y2 int")
    assert sorted(tuple(x) for x in scores.nms(df).collect()) == brute_nms(rows, 0.30)
