"""Folders as data sources: listings and image headers read by executors, and folders written as a whole.

Paths are those that pyarrow's file systems open on driver and executors alike (for local ones, a folder that all
have mounted).
"""

from __future__ import annotations

import fnmatch
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tesselon.sources.headers import size_of

#: Folders that the driver looks for, so that there are as many tasks; it stops after DEEP levels.
WANTED, DEEP = 64, 3
#: Rows of a batch.
ROWS = 2048


@dataclass
class Folder(InputPartition):
    path: str
    below: bool


class Listing(DataSource):
    """path, length (and width, height with sizes=true) of every file of a folder, empty ones included; recursive=true goes below, globs is a JSON list of
    patterns for names, one of which has to fit.

    The driver only looks for sub-folders, until there are WANTED of them; each is a task that lists what is in it or below it. width and height
    come from the first bytes of a file, and more only where an image's header lies behind other blocks; null for what is no image.
    """

    @classmethod
    def name(cls) -> str:
        return "tesselon_listing"

    def schema(self) -> str:
        return "path string, length long" + (", width int, height int, bytes_read long" if self.options.get("sizes", "false") == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        of = self.options.get
        return ListingReader(self.options["path"], of("recursive", "true") == "true", of("sizes", "false") == "true", json.loads(of("globs", '["*"]')))


class ListingReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, sizes: bool, globs: list[str]):
        self.path, self.recursive, self.sizes, self.globs = path, recursive, sizes, globs

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), os.path.abspath(self.path))

    def partitions(self) -> list[Folder]:
        store, root = self._store()
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        alone, front = [], [root]
        for _ in range(DEEP if self.recursive else 0):
            if len(front) >= WANTED or not front:
                break
            alone += front
            front = [x for f in front for x, size in entries(store, f) if size is None]
        return [Folder(f, False) for f in alone] + [Folder(f, self.recursive) for f in front]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        names = ["path", "length", "width", "height", "bytes_read"][: 5 if self.sizes else 2]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
        rows: list[tuple] = []
        for path, length in self._files(store, partition):
            row = (path, length)
            if self.sizes:
                with store.open_input_file(path) as f:
                    size, read = size_of(f.read_at, length)
                row += (*(size or (None, None)), read)
            rows.append(row)
            if len(rows) == ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def _files(self, store: fs.FileSystem, folder: Folder) -> Iterator[tuple[str, int]]:
        todo = [folder.path]
        while todo:
            for path, length in entries(store, todo.pop()):
                if length is None:
                    if folder.below:
                        todo.append(path)
                elif any(fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], g) for g in self.globs):
                    yield path, length


def entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Path and length of what is in a folder, no length for folders; one by one where the file system is local. Links to folders are not followed."""
    if not isinstance(store, fs.LocalFileSystem):
        yield from ((x.path, None if x.type == fs.FileType.Directory else x.size) for x in store.get_file_info(fs.FileSelector(folder)))
        return
    with os.scandir(folder) as found:
        for x in found:
            if x.is_dir(follow_symlinks=False):
                yield x.path, None
            elif x.is_file():
                yield x.path, x.stat().st_size


@dataclass
class Written(WriterCommitMessage):
    files: int


class NewFolder(DataSource):
    """Writes rows (name, and content or src to copy) as the files of a folder that does not exist yet, all of them or none.

    Tasks write into a folder beside the place; a name is moved into it only when its file is whole, so a task that runs again writes the
    same files again. The driver's commit is a single rename. Names must be unique.
    """

    @classmethod
    def name(cls) -> str:
        return "tesselon_new_folder"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = os.path.abspath(self.options["path"])
        if overwrite or os.path.exists(path):
            raise FileExistsError(path)
        return NewFolderWriter(path, "src" in schema.fieldNames())


class NewFolderWriter(DataSourceWriter):
    def __init__(self, path: str, copies: bool):
        self.path, self.copies = path, copies
        self.staged = f"{path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        n = 0
        for r in iterator:
            to = os.path.normpath(os.path.join(self.staged, r["name"]))
            if not to.startswith(self.staged + os.sep):
                raise ValueError(f"outside the folder: {r['name']}")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}"
            if self.copies:
                shutil.copy2(r["src"], part)
            else:
                data = r["content"]
                with open(part, "wb") as f:
                    f.write(data.encode("utf-8") if isinstance(data, str) else bytes(data))
            os.replace(part, to)
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.staged, exist_ok=True)  # no rows
        if os.path.exists(self.path):
            self.abort(messages)
            raise FileExistsError(self.path)
        os.rename(self.staged, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)
