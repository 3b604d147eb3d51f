"""Audit of how document filters interact, over every order of applying them.

Orders form a trie; what is left of the documents after a prefix depends on the set of its filters
alone, not on their order. So the trie is walked depth first with one survivor DataFrame for each
unordered prefix: n filters give n! orders, but 2^n survivor states and n * 2^(n - 1) edges. A state
is what its filter leaves of the state above, persisted while its subtree is walked and dropped
afterwards. Each edge's removals are counted on the rows that are really there; a lost executor's
part of a state comes again from the written verdicts.

Verdicts do not depend on the order, so each filter reads the texts once. States then hold a
document's part, labels and verdicts, no text.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, Tables, fresh

#: When a document fails, over n_words, n_distinct, n_upper, n_chars, has_symbol and is_copy.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
#: More filters than this have more orders than a report can be read for.
MOST = 6


def verdicts(docs: DataFrame, labels: DataFrame, tables: Tables, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, good, toxic, fails (one bit for each filter, the first the lowest): one row per document, repeats included, written.

    A null text is empty, a null part the empty string. is_copy: a smaller id has the same text; a null id is neither
    smaller nor greater than any. Labels are by id; where an id has several, 1 in any of them counts; a null id has none.
    Both joins leave the documents' side to be split where one text or id has very many rows (adaptive skew
    joins), and their other side has one row a key, aggregated before it is shuffled.
    """
    id_, key, first, mine = fresh(docs, "tess_id", "tess_key", "tess_first", "tess_part")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    rows = docs.select(
        F.col(id_col).alias(id_), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias(mine), F.unhex(F.sha2(text, 256)).alias(key),
        F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("n_upper"),
        F.length(text).alias("n_chars"), text.rlike("[#$%&*|]").alias("has_symbol"),
    )
    rows = tables.write(rows)
    twice = rows.groupBy(key).agg(F.min(id_).alias(first), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("text_key"), first)
    twice = tables.write(twice)  # so that the join shuffles both sides on its own, and a text's many rows can be split
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = rows.join(twice, F.col(key) == F.col("text_key"), "left").withColumn("is_copy", F.coalesce(F.col(id_) > F.col(first), F.lit(False)))
    of = of.join(marks, F.col(id_) == F.col("label_id"), "left")
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(filters.values())]
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    out = tables.write(of.select(F.col(mine).alias("part"), flag("good"), flag("toxic"), sum(bits[1:], bits[0]).alias("fails")))
    tables.drop(rows, twice)
    return out


def _fails(i: int) -> Column:
    return F.col("fails").bitwiseAND(F.lit(1 << i)) != 0


def edges(rows: DataFrame, n: int, tables: Tables) -> DataFrame:
    """part, done (set of the filters applied, as bits), filter (its number), n, removed, good_lost, toxic_lost.

    rows as verdicts() gives them. A part of which a state has nothing left has no row there. Rows are counted part by part with
    partial sums, so a part may hold any share of them; counts are written, as parts may be many.
    """
    found: list[DataFrame] = []
    seen: set[int] = set()

    def visit(done: int, here: DataFrame) -> None:
        seen.add(done)
        left = [i for i in range(n) if not done >> i & 1]
        if not left:
            return  # no edge leaves the state of all filters
        here = here.persist(StorageLevel.MEMORY_AND_DISK)
        counts = []
        for i in left:
            counts += [F.count_if(_fails(i)).alias(f"r{i}"), F.count_if(_fails(i) & F.col("good")).alias(f"g{i}"), F.count_if(_fails(i) & F.col("toxic")).alias(f"t{i}")]
        by = here.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *counts)
        each = F.array(*(F.struct(F.lit(i).alias("filter"), F.col(f"r{i}").alias("removed"), F.col(f"g{i}").alias("good_lost"), F.col(f"t{i}").alias("toxic_lost")) for i in left))
        found.append(tables.write(by.select("part", F.lit(done).alias("done"), "n", F.inline(each))))
        for i in left:
            if done | 1 << i not in seen:
                visit(done | 1 << i, here.where(~_fails(i)))
        here.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema(found[0].schema).parquet(*(f._tesselon_path for f in found))


def report(counts: DataFrame, names: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from edges().

    Each part has a row for each step of each order, zeros included. redundant: documents that fail the step's filter, but were
    removed before. unique_fails: those that fail this filter only. shapley: what the filter removes, summed over all orders.
    """
    spark, n = counts.sparkSession, len(names)
    every = [(done, i) for done in range(1 << n) for i in range(n) if not done >> i & 1]
    blank = F.array(*(F.struct(F.lit(d).alias("done"), F.lit(0).cast("long").alias("n"), F.lit(i).alias("filter")) for d, i in every))
    amounts = ["removed", "good_lost", "toxic_lost"]
    zeros = counts.where("done = 0 and filter = 0").select("part", F.inline(blank)).withColumns({c: F.lit(0).cast("long") for c in amounts})
    full = counts.unionByName(zeros).groupBy("part", "filter", "done").agg(*(F.sum(c).alias(c) for c in ("n", *amounts)))
    size = F.bit_count("done")
    orders_with = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)  # orders that apply the filter to this state
    alone = F.expr(f"done = {(1 << n) - 1} - shiftleft(1, filter)")
    of = W.partitionBy("part", "filter")  # 2^(n - 1) rows
    full = full.withColumns({
        "fail": F.sum(F.when(F.col("done") == 0, F.col("removed"))).over(of),
        "unique_fails": F.sum(F.when(alone, F.col("removed"))).over(of),
        "shapley": F.sum(F.col("removed") * orders_with).over(of),
    })
    steps = [("".join(names[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, done int, filter int")  # n! * n rows, n at most MOST
    rows = full.join(F.broadcast(orders), ["done", "filter"])
    return rows.select("part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("fail") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter removes at each step of each order, part by part (see report()); no documents: no rows.

    filters: a letter each, MOST at most, with the SQL condition under which a document fails (null: it passes).
    """
    if not 0 < len(filters) <= MOST or any(len(x) != 1 for x in filters):
        raise ValueError(f"filters are 1 to {MOST}, each named by a letter")
    tables = Tables(docs.sparkSession)
    rows = verdicts(docs, labels, tables, filters, id_col, text_col, part_col)
    counts = edges(rows, len(filters), tables)
    tables.drop(rows)
    return report(counts, list(filters))
