"""Helpers shared by the operators: the shared folder, written tables, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACE = "[ \\t-\\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master (tests) may go without: it gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesselon-"))
            held = sc._jsc.sc().getCheckpointDir()
        found = held.get()
    return found


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Tables:
    """Tables written to the shared folder. They cut lineage and survive lost executors.

    An operator drops those that its result does not read; what the result reads goes with forget(),
    called by whoever has written the result elsewhere.
    """

    _left: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tesselon-{uuid.uuid4().hex}"
        self.n = 0
        self._left.append(self.root)

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """The written rows, in a folder for each value of the columns `by` (the last ones of the result)."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tesselon_path = path
        return out

    def drop(self, *written: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        for df in written:
            _remove(self.spark, df._tesselon_path)

    @classmethod
    def mark(cls) -> int:
        """For forget()."""
        return len(cls._left)

    @classmethod
    def forget(cls, spark: SparkSession, since: int = 0) -> None:
        """Remove the tables of this driver's operators, or of those called since a mark. Results not written elsewhere are lost."""
        while len(cls._left) > since:
            _remove(spark, cls._left.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share an id: rows with equal id and text are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sized_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], rows: int, how: str = "inner") -> DataFrame:
    """Null-safe join of wide rows with a narrow row for some of them, both unique but for repeated rows.

    rows is the number of rows on the left: there are so many partitions that the narrow side of one
    fits in memory at any size, so the wide side need not be sorted.
    """
    spark = left.sparkSession
    n = partitions(spark, rows, 50_000)
    names = fresh(left, *(f"left_{i}" for i in range(len(pairs)))), fresh(right, *(f"right_{i}" for i in range(len(pairs))))
    sides = []
    for df, own, at in zip((left, right), names, (0, 1), strict=True):
        df = df.withColumns({k: F.coalesce(F.col(f"`{p[at]}`").cast("string"), F.lit("\0")) for k, p in zip(own, pairs, strict=True)})
        sides.append(df.repartition(n, *own))
    on = [sides[0][a] == sides[1][b] for a, b in zip(*names, strict=True)]
    return sides[0].join(sides[1].hint("shuffle_hash"), on, how).drop(*names[0], *names[1])


def partitions(spark: SparkSession, rows: int, per: int = 500_000) -> int:
    """Shuffle partitions for rows of some tens of bytes, so that one fits in memory at any size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
