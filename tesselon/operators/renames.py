"""Order of renames whose destinations are other rows' sources: shifts, swaps and longer cycles.

Sources and destinations are each unique, so a plan falls into chains (ending at a free name) and
cycles. Pointer doubling finds every row's place: each round a row's pointer skips as many rows
again, in one join by name, so a chain of n rows takes log2(n) rounds. Places then give three passes,
whatever the length of a chain: every second row of it steps aside to a temporary name, the others move
straight to the names so freed, and those aside follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.sources.scratch import fixed


def refused(plan: DataFrame) -> DataFrame:
    """Rows of a plan that cannot be carried out, with why: a name is missing, or a source or destination is there twice."""
    found = plan.where("src is null or dst is null").withColumn("why", F.lit("no name"))
    for c in ("src", "dst"):
        twice = plan.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
        found = found.unionByName(plan.join(twice, c, "left_semi").select(*plan.columns).withColumn("why", F.lit(f"{c} twice")))
    return found


def _doubled(rows: DataFrame) -> DataFrame:
    """rows (src, at, steps, low) whose pointers `at` have been followed to the end of their chain, where they are null.

    On cycles pointers never end; there `low` becomes the least name of the cycle. A round's pointers span 2^r
    rows, and every chain that has rows on its way loses some each round: if none was lost, all that are left lie on cycles. Where
    a cycle is no shorter than the span, the rows that know its least name are as many as the span; so it is
    done once all such groups are smaller.
    """
    span, before = 1, -1
    while True:
        n, most = rows.where("at is not null").groupBy("low").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
        if n == 0 or (n == before and most < span):
            return rows
        before = n
        far = rows.select(F.col("src").alias("far"), F.col("at").alias("far_at"), F.col("steps").alias("far_steps"), F.col("low").alias("far_low"))
        moved = rows.join(far, F.col("at") == F.col("far"), "left")
        rows = fixed(moved.select("src", F.col("far_at").alias("at"), (F.col("steps") + F.coalesce("far_steps", F.lit(0))).alias("steps"), F.least("low", "far_low").alias("low")))
        span *= 2


def move_order(plan: DataFrame) -> DataFrame:
    """src, dst, kind, place, aside for a plan of unique, non-null sources and destinations (see refused()).

    kind: same (nothing to do), free (no other row has to do with its names), chain or cycle. place: rows between it and the end of its chain, whose
    destination is free; a cycle ends with the row that moves to its least name. aside: whether it has to wait under
    a temporary name: rows of odd place, and the least name of a cycle, whose length may be odd.
    """
    moves = plan.where("src <> dst").select("src", "dst")
    here = moves.select(F.col("src").alias("taken"))
    linked = moves.join(here, F.col("dst") == F.col("taken"), "left").withColumn("at", F.col("taken")).drop("taken")
    follows = linked.where("at is not null").select(F.col("at").alias("follower"))
    linked = fixed(linked.join(follows, F.col("src") == F.col("follower"), "left").withColumn("followed", F.col("follower").isNotNull()).drop("follower"))
    tied = "at is not null or followed"
    start = linked.where(tied).select("src", "at", F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("src").alias("low"))
    first = _doubled(start)
    chains = first.where("at is null").select("src", F.lit("chain").alias("kind"), F.col("steps").alias("place"), F.lit(False).alias("least"))
    rings = first.where("at is not null").select(F.col("src").alias("own"), "low").join(linked.select("src", "at"), F.col("own") == F.col("src"))
    cut = rings.select("src", F.nullif("at", "low").alias("at"), F.when(F.col("at") == F.col("low"), 0).otherwise(1).cast("long").alias("steps"), "low", (F.col("src") == F.col("low")).alias("least"))
    cut = fixed(cut)
    second = _doubled(cut.drop("least")).select("src", "steps")
    cycles = second.join(cut.select(F.col("src").alias("ring"), "least"), F.col("src") == F.col("ring")).select("src", F.lit("cycle").alias("kind"), F.col("steps").alias("place"), "least")
    places = chains.unionByName(cycles)
    tied_rows = linked.where(tied).select("src", "dst").join(places, "src").select("src", "dst", "kind", "place", (F.col("least") | (F.col("place") % 2 == 1)).alias("aside"))
    plain = lambda rows, kind: rows.select("src", "dst", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("aside"))
    return tied_rows.unionByName(plain(linked.where(f"not ({tied})"), "free")).unionByName(plain(plan.where("src = dst"), "same"))


def passes(ordered: DataFrame, parked: Column | None = None) -> DataFrame:
    """pass, src, dst: the moves to make, from move_order(); within a pass their order does not matter.

    parked: the temporary name of a row, by default in its destination's folder, by the digest of its source.
    """
    parked = F.concat(F.regexp_extract("dst", "^(.*/)?", 0), F.lit(".moving-"), F.md5("src")) if parked is None else parked
    move = lambda n, a, b: F.struct(F.lit(n).alias("pass"), a.alias("src"), b.alias("dst"))
    away = F.array(move(1, F.col("src"), parked), move(3, parked, F.col("dst")))
    return ordered.where("kind <> 'same'").select(F.inline(F.when(F.col("aside"), away).otherwise(F.array(move(2, F.col("src"), F.col("dst"))))))
