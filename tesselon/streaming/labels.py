"""Optional extension: a running class histogram over label files as they arrive. The reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselon.operators.labels import histogram, parse_lines


def histogram_stream(spark: SparkSession, path: str) -> DataFrame:
    """Counts by class of all label lines that have arrived (complete output mode)."""
    lines = spark.readStream.format("text").load(path).withColumnRenamed("value", "line")
    return histogram(parse_lines(lines, "min5"))
