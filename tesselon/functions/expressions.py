"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sort key: runs of other characters and of ASCII digits, digits by value, case ignored."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([^0-9]*)([0-9]*)"), F.lit(0))
    piece = lambda p: F.struct(F.regexp_extract(p, "^([^0-9]*)", 1).alias("text"), F.regexp_extract(p, "([0-9]*)$", 1).try_cast("bigint").alias("number"))
    return F.transform(F.filter(parts, lambda p: p != ""), piece)


def tier(conf: Column) -> Column:
    """sure, doubtful or poor at 0.80 and 0.50."""
    return F.when(conf >= 0.80, "sure").when(conf >= 0.50, "doubtful").otherwise("poor")


def bar(value: Column, scale: float = 20, most: int | None = None, least: int = 0) -> Column:
    """A text bar of value * scale full blocks, truncated, within least and most."""
    n = F.greatest(F.floor(value * scale), F.lit(least))
    return F.repeat(F.lit("█"), (n if most is None else F.least(n, F.lit(most))).cast("int"))


def rescaled(conf: Column, factor: float = 1.5) -> list[Column]:
    """conf times a factor, to six decimals half to even, and whether that changes it."""
    value = F.bround(conf * factor, 6)
    return [value.alias("rescaled"), (value != conf).alias("changed")]


def grouped(n: Column) -> Column:
    """A whole number with separators between thousands."""
    return F.format_number(n, 0)


def overwritten(config: Column, **values: object) -> Column:
    """A map of settings with some replaced: new ones win."""
    new = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, str(v))))
    return F.map_concat(F.map_filter(config, lambda k, _: ~k.isin(*values)), new)


def percent(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)) * 100


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def batch_for_device(name: Column) -> Column:
    """Training batch by the device's name."""
    return F.when(name.contains("A100"), 128).when(name.contains("L4"), 32).when(name.contains("T4"), 16).otherwise(8)


def seeded(seed: int, *keys: Column) -> Column:
    """A fixed random order: the MD5 digest of seed and keys, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
