"""Correction of detected code sequences against the prefix tree of a lexicon.

Both the sequences and the lexicon become prefix tables, and an alignment walks the two trees together: a state is a
pair of prefixes with the least cost of turning one into the other. States are taken level by level of the sequences'
tree, each level in a few joins, so sequences that begin alike are aligned once, and the first level is a single
state however many sequences there are. A code may be missing, superfluous or mistaken; states beyond the allowed
cost are dropped, so the frontier keeps to the neighbourhood of what was seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.sources.scratch import fixed

#: Between the codes of a prefix; codes do not contain it.
BETWEEN = "\x1f"


def key_of(seq: Column) -> Column:
    """The node of a sequence; that of the empty one, the root, is empty."""
    return F.array_join(F.transform(seq, lambda c: F.concat(F.lit(BETWEEN), c)), "")


def prefix_table(sequences: DataFrame, seq: str = "seq", n: str | None = None) -> DataFrame:
    """node, parent, code, depth, n: a row for each prefix of one code or more.

    n: how often the prefix is a whole sequence, by the column of that name or by rows; 0 where it is none. Null codes are left out, null sequences passed over.
    """
    codes = F.filter(F.col(seq), lambda c: c.isNotNull())
    rows = sequences.where(F.col(seq).isNotNull()).select(codes.alias("codes"), (F.lit(1) if n is None else F.col(n)).cast("long").alias("n"))
    rows = rows.groupBy("codes").agg(F.sum("n").alias("n"))
    one = lambda i: F.struct(key_of(F.slice("codes", F.lit(1), i)).alias("node"), key_of(F.slice("codes", F.lit(1), i - 1)).alias("parent"), F.element_at("codes", i).alias("code"), i.alias("depth"), F.when(i == F.size("codes"), F.col("n")).otherwise(0).alias("n"))
    places = F.when(F.size("codes") > 0, F.sequence(F.lit(1), F.size("codes")))
    return rows.select(F.inline(F.transform(places, one))).groupBy("node", "parent", "code", "depth").agg(F.sum("n").alias("n"))


def corrected(seen: DataFrame, lexicon: DataFrame, mistakes: DataFrame, most: int = 1500, missing: int = 1000, extra: int = 1000, other: int = 1000, seq: str = "seq") -> DataFrame:
    """seq, fixed, cost: each different non-empty sequence with the lexicon's nearest; null if none is within `most`.

    lexicon: as prefix_table() gives it. mistakes: seen, meant, cost, for codes that are taken for one another more (or less)
    easily than any `other`. missing: the cost of a code that was not seen, extra: of one that is not there. Costs are whole and positive, so
    that sums are exact. Ties go to the more frequent sequence, then to the first by its codes.
    """
    if min(missing, extra, other) <= 0:
        raise ValueError("costs are positive")
    tree = fixed(prefix_table(seen, seq)).select(F.col("node").alias("to"), F.col("parent").alias("own"), F.col("code").alias("seen"), "depth", F.col("n").alias("whole"))
    words = fixed(lexicon.select("node", "parent", "code", "n"))
    edges = words.select(F.col("parent").alias("at"), F.col("node").alias("next"), F.col("code").alias("meant"))
    costs = mistakes.groupBy("seen", "meant").agg(F.min("cost").cast("long").alias("mistake"))
    least = min(other, costs.agg(F.coalesce(F.min("mistake"), F.lit(other))).first()[0])
    levels = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]

    def best(states: DataFrame) -> DataFrame:
        return states.where(F.col("cost") <= most).groupBy("own", "at").agg(F.min("cost").alias("cost"))

    def with_missing(states: DataFrame) -> DataFrame:
        """The states, and those with further codes of the lexicon that were not seen, as far as the cost goes."""
        found, front = states, states
        for _ in range(most // missing):
            front = front.where(F.col("cost") + missing <= most).join(edges, "at").select("own", F.col("next").alias("at"), (F.col("cost") + missing).alias("cost"))
            found = found.unionByName(front)
        return best(found)

    spark = seen.sparkSession
    states = fixed(with_missing(spark.createDataFrame([("", "", 0)], "own string, at string, cost long")))
    ends = []
    for depth in range(1, levels + 1):
        step = states.join(tree.where(F.col("depth") == depth).select("own", "to", "seen"), "own")
        surplus = step.select(F.col("to").alias("own"), "at", (F.col("cost") + extra).alias("cost"))
        same = step.join(edges.withColumnRenamed("meant", "seen"), ["at", "seen"]).select(F.col("to").alias("own"), F.col("next").alias("at"), "cost")
        wrong = step.where(F.col("cost") + least <= most).join(edges, "at").where("seen <> meant").join(costs, ["seen", "meant"], "left")
        wrong = wrong.select(F.col("to").alias("own"), F.col("next").alias("at"), (F.col("cost") + F.coalesce("mistake", F.lit(other))).alias("cost"))
        states = fixed(with_missing(best(surplus.unionByName(same).unionByName(wrong))))
        ends.append(states)
    found = tree.where("whole > 0").select(F.col("to").alias("own"))
    if ends:
        every = ends[0]
        for e in ends[1:]:
            every = every.unionByName(e)
        full = words.where("n > 0").select(F.col("node").alias("at"), "n")
        order = F.struct("cost", (-F.col("n")).alias("o"), "at")
        chosen = every.join(found, "own", "left_semi").join(full, "at").groupBy("own").agg(F.min(order).alias("b"))
        found = found.join(chosen, "own", "left")
    else:
        found = found.withColumn("b", F.lit(None).cast("struct<cost:long,o:long,at:string>"))
    codes = lambda c: F.filter(F.split(c, BETWEEN), lambda x: x != "")
    return found.select(codes(F.col("own")).alias("seq"), F.when(F.col("b").isNotNull(), codes(F.col("b.at"))).alias("fixed"), F.col("b.cost").alias("cost"))
