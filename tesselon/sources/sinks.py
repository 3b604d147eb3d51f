"""Writers. Plans are DataFrames; applying one is a separate step, so a dry run is simply the plan."""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.operators import kernels
from tesselon.operators.renames import move_order, passes, refused
from tesselon.operators.scores import as_matrix
from tesselon.sources import folders, jpeg
from tesselon.sources.scratch import fixed


def label_files(boxes: DataFrame, image_col: str = "image_id", order: str = "line_no") -> DataFrame:
    """image, content: one label text per image, its boxes by the order column, six decimals a value."""
    six = [F.col(c).cast("double").cast("decimal(18,6)").cast("string") for c in ("xc", "yc", "bw", "bh")]
    line = F.concat(F.concat_ws(" ", F.col("cls_id").cast("string"), *six), F.lit("\n"))
    lines = boxes.groupBy(image_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))
    return lines.select(image_col, F.array_join(F.col("lines.line"), "").alias("content"))


def write_files(files: DataFrame, root: str, name: str = "name", content: str = "content") -> int:
    """One file per row (name, content as text or bytes) below root, a folder that all executors have mounted; the number written.

    Each is written beside its place and moved there, so a task that runs twice does no harm.
    """

    def write(rows) -> None:
        for r in rows:
            path = Path(root) / r[name]
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
            data = r[content]
            part.write_bytes(data.encode("utf-8") if isinstance(data, str) else bytes(data))
            os.replace(part, path)

    files.select(name, content).foreachPartition(write)
    return files.count()


def write_folder(files: DataFrame, root: str) -> None:
    """One file per row (name, and content as text or bytes, or src to copy) in a new folder that all executors have mounted: all of them or none.

    Null or repeated names, and a folder that exists, are errors before anything is written; a task that fails for good leaves nothing behind.
    """
    twice = files.groupBy("name").count().where("name is null or count > 1").first()
    if twice is not None:
        raise FileExistsError(f"planned twice or without a name: {twice['name']}")
    files.sparkSession.dataSource.register(folders.NewFolder)
    files.select("name", "src" if "src" in files.columns else "content").write.format("tesselon_new_folder").mode("append").save(root)


def apply_plan(plan: DataFrame, move: bool = False) -> None:
    """Copies or moves src to dst, files that all executors have mounted. A plan that would overwrite is an error before anything happens.

    A move's destination may be another row's source (shifts, swaps, cycles): such rows are moved in three passes, some of
    them by way of a temporary name. A copy's may not: the original would be lost. A task that runs twice does no harm.
    """
    wrong = refused(plan).first()
    if wrong is not None:
        raise FileExistsError(f"{wrong['why']}: {wrong['src']} to {wrong['dst']}")
    of = plan.select("src", "dst")
    others = of if not move else of.join(of.select(F.col("src").alias("leaves")), F.col("dst") == F.col("leaves"), "left_anti")

    def there(batches):
        for rows in batches:
            for dst in rows.column(0).to_pylist():
                if os.path.exists(dst):
                    yield pa.RecordBatch.from_arrays([pa.array([dst])], names=["dst"])

    taken = others.select("dst").mapInArrow(there, "dst string").first()
    if taken is not None:
        raise FileExistsError(taken["dst"])

    def act(rows) -> None:
        for r in rows:
            Path(r["dst"]).parent.mkdir(parents=True, exist_ok=True)
            if os.path.exists(r["src"]):  # else a lost task has moved it already
                (shutil.move if move else shutil.copy2)(r["src"], r["dst"])

    if not move:
        of.foreachPartition(act)
        return
    moves = fixed(passes(move_order(of)))  # before anything moves
    for n in (1, 2, 3):
        moves.where(F.col("pass") == n).select("src", "dst").foreachPartition(act)


def class_lines(classes: DataFrame) -> str:
    """classes.txt: one name a line in the order of ids. A dimension, so it is collected."""
    return "".join(f"{r['class_name']}\n" for r in classes.orderBy("class_id").collect())


def class_map_json(classes: DataFrame) -> str:
    """Name to id as JSON, in the order of ids."""
    return json.dumps({r["class_name"]: r["class_id"] for r in classes.orderBy("class_id").collect()}, ensure_ascii=False, indent=2)


def delete_plan(files: DataFrame, keep: Column, path: str = "path") -> DataFrame:
    """Paths of the files that a predicate does not keep (null counts as not kept)."""
    return files.where(~F.coalesce(keep, F.lit(False))).select(path)


def write_delete_list(plan: DataFrame, path: str) -> None:
    """The paths of a delete plan as text, one a line, in order."""
    plan.orderBy(plan.columns[0]).select(F.col(plan.columns[0]).alias("value")).write.mode("errorifexists").text(path)


def matrix_csv(cells: DataFrame, labels: list[int], value: str, path: str) -> None:
    """A confusion matrix in wide form as CSV with a header."""
    as_matrix(cells, labels, value).orderBy("row_label").coalesce(1).write.mode("errorifexists").csv(path, header=True)


def matrix_npy(cells: DataFrame, labels: int, value: str) -> bytes:
    """A matrix of labels x labels as the bytes of an .npy file; cells that are missing are 0. A dimension squared, so it is collected."""
    out = np.zeros((labels, labels))
    for r in cells.select("row_label", "col_label", value).collect():
        out[r["row_label"], r["col_label"]] = r[value]
    held = io.BytesIO()
    np.save(held, out)
    return held.getvalue()


def scores_json(scores: DataFrame, key: str, value: str) -> str:
    """A dimension's scores as JSON, six decimals."""
    return json.dumps({r[key]: round(r[value], 6) for r in scores.orderBy(key).collect()}, ensure_ascii=False)


def encoded(images: DataFrame, form: str = "jpg", quality: int = 93, key: str = "path") -> DataFrame:
    """name, content: each readable image of (key, width, height, channels, data) as a JPEG or PNG file, named by its stem."""

    def run(img, _):
        return (jpeg.encode(img, quality) if form == "jpg" else png(img.shape[1], img.shape[0], img.tobytes()),)

    files = kernels.over_images(images, run, "content binary", key=key)
    stem = F.regexp_extract(F.col(key).cast("string"), "([^/]*?)(\\.[^./]*)?$", 1)
    return files.select(F.concat(stem, F.lit(f".{form}")).alias("name"), "content")


def previews(images: DataFrame, boxes: DataFrame, key: str = "path") -> DataFrame:
    """name, content: a PNG of each image with its boxes (x1, y1, x2, y2, suspicious) drawn on it."""
    marks = boxes.groupBy(key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "suspicious")).alias("boxes"))
    rows = images.select(key, "width", "height", "channels", "data").join(marks, key, "left")

    def run(batches):
        for batch in batches:
            names, data = [], []
            for k, w, h, c, d, found in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if d is not None and w and h:
                    img = kernels.draw(kernels.decoded(w, h, c, d), [tuple(b.values()) for b in found or []])
                    names.append(re.sub(r"\.[^./]*$", "", str(k).rsplit("/", 1)[-1]) + "_bbox.png")
                    data.append(png(img.shape[1], img.shape[0], img.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


def manifest(classes: DataFrame, root: str) -> str:
    """Dataset manifest as JSON (which YAML readers take too); nc equals the number of names. A dimension, so it is collected."""
    names = [r["class_name"] for r in classes.orderBy("class_id").collect()]
    return json.dumps({"path": root, "train": "images/train", "val": "images/val", "nc": len(names), "names": names}, ensure_ascii=False)


def collisions(plan: DataFrame, existing: DataFrame, name: str = "dst") -> DataFrame:
    """Rows of a plan whose destination exists already or occurs twice in the plan; must be empty before writing."""
    twice = plan.groupBy(name).count().where("count > 1").select(name)
    return plan.join(existing.select(name).union(twice).distinct(), name, "left_semi")


def write_csv_pair(clean: DataFrame, quarantine: DataFrame, path: str) -> None:
    """Clean and quarantined rows as CSV with headers; an existing destination is an error."""
    clean.write.mode("errorifexists").csv(f"{path}/clean", header=True, escape='"')
    quarantine.write.mode("errorifexists").csv(f"{path}/quarantine", header=True, escape='"')


def png(width: int, height: int, bgr: bytes) -> bytes:
    """An 8-bit RGB PNG of BGR rows."""
    pixels = np.frombuffer(bgr, np.uint8).reshape(height, width, 3)[:, :, ::-1].reshape(height, -1)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def manifest_yaml(path: str, names: list[str]) -> str:
    """The manifest in block form; names are quoted where they need it."""
    quoted = [n if re.fullmatch(r"[A-Za-z_][\w.-]*", n) and n.lower() not in ("true", "false", "null", "yes", "no", "on", "off") else json.dumps(n, ensure_ascii=False) for n in names]
    return "\n".join([f"path: {json.dumps(path)}", "train: images/train", "val: images/val", f"nc: {len(names)}", "names:", *(f"- {n}" for n in quoted)]) + "\n"
