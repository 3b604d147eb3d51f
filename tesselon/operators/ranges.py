"""Running values over an order of any size: rows in ranges of the order, and what the ranges before hold.

Rows are dealt into ranges once and fixed (RangePartitioner picks the limits from a sample, so a second
reading could deal otherwise). Within a range each row's place comes from its position, without a window; a
group that spans ranges is put together from one small row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesselon.sources.scratch import fixed

#: Bytes, by Spark's own estimate, up to which one task may number all rows. Files are estimated by their compressed columns: some 1 to 3 bytes a key, of which a task holds 60.
SMALL = 1 << 20
#: Bits of a row's id that monotonically_increasing_id() gives to the place in its partition.
PLACE = 33


def dealt(df: DataFrame, *order: Column, ranges: int | None = None) -> DataFrame:
    """df, fixed, with range_no and range_at: its range of the order and its place in it. The order should have no ties: those are placed anyhow."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"range_key_{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True)))
    rows = rows.repartitionByRange(n, *names).sortWithinPartitions(*names).withColumn("range_id", F.monotonically_increasing_id())
    return fixed(rows.drop(*names)).withColumns({"range_no": F.shiftright("range_id", PLACE), "range_at": F.col("range_id").bitwiseAND(F.lit((1 << PLACE) - 1))}).drop("range_id")


def numbered(df: DataFrame, group: list[str], order: Column, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with the rank (from 1) of each row in its group (null is a group) by the order. Two rows of a group that tie come in any order.

    Rows that are few for certain are numbered by a window; a group of any other size by as many tasks as there are ranges.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if ranges is None and int(str(size)) <= SMALL:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(order)).cast("long"))
    rows = dealt(df, *(F.col(c) for c in group), order, ranges=ranges)
    keys = [*group, "range_no"]
    sizes = rows.groupBy(*(F.col(c).alias(f"of_{i}") for i, c in enumerate(keys))).agg(F.count(F.lit(1)).alias("of_n"), F.min("range_at").alias("of_first"))
    own = W.partitionBy(*(f"of_{i}" for i in range(len(group)))).orderBy(f"of_{len(group)}") if group else W.orderBy("of_0")
    before = F.coalesce(F.sum("of_n").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range of a group
    sizes = sizes.withColumn("of_before", before - F.col("of_first") + 1).drop("of_n", "of_first")
    found = rows.join(sizes, [F.col(c).eqNullSafe(F.col(f"of_{i}")) for i, c in enumerate(keys)])
    return found.withColumn(name, F.col("range_at") + F.col("of_before")).drop("range_no", "range_at", "of_before", *(f"of_{i}" for i in range(len(keys))))
