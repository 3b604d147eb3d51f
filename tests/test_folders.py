"""Listings, header reads and folders written as a whole."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tesselon.sources import folders, headers, sinks, tables


def jpeg_head(w, h, blocks):
    """A JPEG file's beginning with further blocks of some lengths before its frame."""
    out = b"\xff\xd8"
    for n in blocks:
        out += b"\xff\xe1" + struct.pack(">H", n + 2) + bytes(n)
    return out + b"\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, h, w) + bytes(40)


def test_ten_thousand_files(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"c{i:03}" / "x").mkdir(parents=True)
        for j in range(100):
            (tmp_path / f"c{i:03}" / ("x" if j % 2 else "") / f"{j}.{'TXT' if j % 5 == 0 else 'png'}").write_bytes(b"" if j % 3 == 0 else b"abc")
    all_ = tables._listing(spark, str(tmp_path))
    assert all_.count() == 10_000 and all_.rdd.getNumPartitions() > 64
    txt = tables.list_files(spark, str(tmp_path), ("txt",))
    assert txt.count() == 2000 and txt.where("length = 0").count() == 700 and {r.suffix for r in txt.select("suffix").distinct().collect()} == {"txt"}
    assert tables.list_files(spark, str(tmp_path / "c005"), recursive=False).count() == 40
    assert tables.list_files(spark, str(tmp_path), globs=("1.*", "1?.png")).count() == 100 + 8 * 100
    with pytest.raises(Exception, match="nowhere"):
        tables.list_files(spark, str(tmp_path / "nowhere")).count()


def test_driver_looks_for_folders_only(tmp_path):
    for i in range(5):
        (tmp_path / f"a{i}" / "b").mkdir(parents=True)
        (tmp_path / f"a{i}" / "f").write_bytes(b"1")
    reader = folders.ListingReader(str(tmp_path), True, False, ["*"])
    parts = reader.partitions()
    assert [p.below for p in parts].count(False) == len(parts) and len(parts) == 11  # all folders, none has more below
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5
    deep = tmp_path
    for _ in range(6):
        deep = deep / "d"
    deep.mkdir(parents=True)
    (deep / "f").write_bytes(b"")
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6


def test_headers_need_few_bytes(spark, tmp_path):
    big = bytes(200_000)
    cases = {
        "a.png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 300, 200) + big, (300, 200)),
        "b.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 30, -20) + big, (30, 20)),
        "c.gif": (b"GIF89a" + struct.pack("<HH", 7, 9) + big, (7, 9)),
        "d.jpg": (jpeg_head(640, 480, []) + big, (640, 480)),
        "e.jpg": (jpeg_head(640, 480, [60_000, 3, 65_000, 0]) + big, (640, 480)),
        "f.jpg": (b"\xff\xd8\xff\xe1\xff\xff" + big, None),
        "g.txt": (b"no image", None),
        "h.png": (b"", None),
        "i.jpg": (b"\xff\xd8\xff", None),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in tables.image_sizes(spark, str(tmp_path)).collect()}
    assert {k: (r.width, r.height) if r.width else None for k, r in got.items()} == {k: v for k, (_, v) in cases.items()}
    assert max(r.bytes_read for r in got.values()) <= headers.FIRST + 9 * 5 and got["e.jpg"].bytes_read > headers.FIRST


def test_folder_is_written_as_a_whole(spark, tmp_path):
    rows = [(f"k{i % 3}/f{i}.txt", f"text {i}") for i in range(40)] + [("empty.txt", "")]
    df = spark.createDataFrame(rows, "name string, content string").repartition(5)
    sinks.write_folder(df, str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == dict(rows)
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_folder(df, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        sinks.write_folder(df.union(df), str(tmp_path / "twice"))
    sinks.write_folder(df.limit(0), str(tmp_path / "none"))
    assert sorted(os.listdir(tmp_path)) == ["none", "out"]


def test_failed_task_leaves_nothing(spark, tmp_path):
    broken = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") < 35, F.lit("x")).alias("content"))
    with pytest.raises(Exception):  # noqa: B017  a null content cannot be written
        sinks.write_folder(broken, str(tmp_path / "out"))
    outside = spark.createDataFrame([("../away", "x")], "name string, content string")
    with pytest.raises(Exception, match="outside"):
        sinks.write_folder(outside, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_copies_by_plan(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\0\1")
    sinks.write_folder(spark.createDataFrame([(str(tmp_path / "a"), "n/b")], "src string, name string"), str(tmp_path / "out"))
    assert (tmp_path / "out/n/b").read_bytes() == b"\0\1" and (tmp_path / "a").exists()
