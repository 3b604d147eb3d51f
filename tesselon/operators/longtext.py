"""Dictionary entries of documents of any length: no row and no task holds a document.

An entry is `[...] ... {...}`. Its first part has no square bracket and the rest no bracket but its braces, so in the
order of all brackets it is an opening square bracket, braces or none, the closing one, and then the two braces
at once. So brackets are numbered, all of them and the square ones apart, over ranges of the lines; a closing square bracket finds
its entry's other three by their numbers, in equality joins; and lines are put together only from an entry's first to its last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators.lexicon import ENTRY, classify_lines
from tesselon.operators.ranges import numbered
from tesselon.sources.scratch import fixed


def entries(lines: DataFrame, doc: str = "doc", pos: str = "pos", ranges: int | None = None) -> DataFrame:
    """doc, n, translit, translation, codes, raw, as lexicon.entries() gives them, for documents of which one may hold all lines.

    Places within a document should be unique. Null lines are left out.
    """
    text = classify_lines(lines).where("kind = 'text'").select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.trim("line").alias("line"))
    text = fixed(numbered(text, ["doc"], F.col("pos"), "row", ranges))
    chars = F.transform(F.split("line", ""), lambda c, i: F.struct(c.alias("kind"), (i + 1).alias("at")))
    marks = text.select("doc", "row", F.inline(F.filter(chars, lambda x: x["kind"].isin("[", "]", "{", "}"))))
    marks = fixed(numbered(marks, ["doc"], F.struct("row", "at"), "mark", ranges))
    square = fixed(numbered(marks.where("kind in ('[', ']')"), ["doc"], F.col("mark"), "square", ranges))
    closing = square.where("kind = ']'").select("doc", "mark", F.col("square"))
    opening = square.where("kind = '['").select("doc", F.col("row").alias("first"), F.col("at").alias("begins"), (F.col("square") + 1).alias("square"))
    brace = lambda kind, k, *more: marks.where(F.col("kind") == kind).select("doc", (F.col("mark") - k).alias("mark"), *more)
    found = closing.join(opening, ["doc", "square"]).join(brace("{", 1), ["doc", "mark"]).join(brace("}", 2, F.col("row").alias("last"), F.col("at").alias("ends")), ["doc", "mark"])
    rows = found.select("doc", "mark", "first", "begins", "last", "ends", F.explode(F.sequence("first", "last")).alias("row")).join(text.select("doc", "row", "line"), ["doc", "row"])
    start = F.when(F.col("row") == F.col("first"), F.col("begins")).otherwise(1)
    end = F.when(F.col("row") == F.col("last"), F.col("ends")).otherwise(F.length("line"))
    pieces = rows.select("doc", "mark", F.struct("row", F.substring("line", start, end - start + 1).alias("piece")).alias("p"))
    whole = pieces.groupBy("doc", "mark").agg(F.array_join(F.array_sort(F.collect_list("p"))["piece"], " ").alias("raw")).where(F.col("raw").rlike(ENTRY))  # an empty part is none
    out = numbered(fixed(whole), ["doc"], F.col("mark"), "n", ranges).withColumn("n", F.col("n") - 1)
    part = lambda i, name: F.trim(F.regexp_extract("raw", ENTRY, i)).alias(name)
    return out.select(F.col("doc").alias(doc), "n", part(1, "translit"), part(2, "translation"), part(3, "codes"), "raw")
