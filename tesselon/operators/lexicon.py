"""Dictionary text to entries, with code normalisation and a quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Page headers, page numbers, entries, variant codes.
HEADER = "(?U)^(?:Dictionary of Middle Egyptian|[A-Z]\\s*[–\\-]\\s*[A-Z][\\w ,\\-/]+)\\s*$"
NUMBER = "(?U)^\\d{1,4}\\s*$"
ENTRY = "(?U)\\[([^\\[\\]]+)\\]\\s*([^{}\\[\\]]*?)\\s*\\{([^{}\\[\\]]+)\\}"
VARIANT = "^([A-Z][a-z]?[0-9]+)[A-Za-z]$"


def classify_lines(lines: DataFrame) -> DataFrame:
    """kind of a line: empty, header, number, noise (no bracket or brace) or text."""
    t = F.trim("line")
    return lines.withColumn("kind", F.when(t == "", "empty").when(t.rlike(HEADER), "header").when(t.rlike(NUMBER), "number").when(~t.rlike("[\\[\\]{}]"), "noise").otherwise("text"))


def entries(lines: DataFrame, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """doc, n, translit, translation, codes, raw: entries over a document's text lines joined in order.

    Joining needs the lines of one document together, so cost is bounded by the largest document.
    """
    text = classify_lines(lines).where("kind = 'text'").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(pos, F.trim("line").alias("line")))).alias("l"))
    text = text.select(doc, F.array_join(F.col("l.line"), " ").alias("t"))
    part = lambda i: F.regexp_extract_all("t", F.lit(ENTRY), F.lit(i))
    rows = text.select(doc, F.posexplode(F.arrays_zip(part(0).alias("raw"), part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("n", "e"))
    return rows.select(doc, "n", F.trim("e.a").alias("translit"), F.trim("e.b").alias("translation"), F.trim("e.c").alias("codes"), F.col("e.raw").alias("raw"))


def routed(found: DataFrame, known: DataFrame, doc: str = "doc") -> DataFrame:
    """entries with gardiner_seq, gardiner_seq_orig, unknown_codes, n_normalised and whether clean.

    A code that is not known loses one variant letter if the rest is known. known is a dimension of
    codes; each code is looked up by equality, once as written and once without the letter.
    """
    tokens = found.select("*", F.posexplode_outer(F.filter(F.split("codes", "\\s+"), lambda t: t != "")).alias("k", "code"))
    tokens = tokens.withColumn("base", F.nullif(F.regexp_extract("code", VARIANT, 1), F.lit("")))
    one, two = known.select(F.col("code").alias("code"), F.lit(True).alias("as_is")), known.select(F.col("code").alias("base"), F.lit(True).alias("as_base"))
    tokens = tokens.join(one, "code", "left").join(two, "base", "left")
    fixed = F.coalesce(~F.coalesce("as_is", F.lit(False)) & F.col("as_base"), F.lit(False))
    tokens = tokens.withColumns({"fixed": fixed, "unknown": F.col("code").isNotNull() & ~F.coalesce("as_is", F.lit(False)) & ~fixed})
    item = F.struct("k", F.when(F.col("fixed"), F.col("base")).otherwise(F.col("code")).alias("seq"), F.col("code").alias("orig"), "unknown")
    rows = tokens.groupBy(doc, "n", "translit", "translation", "codes", "raw").agg(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), item))).alias("l"), F.count_if("fixed").alias("n_normalised"))
    join = lambda a: F.array_join(a, " ")
    rows = rows.withColumns({"gardiner_seq": join(F.col("l.seq")), "orig": join(F.col("l.orig")), "unknown_codes": join(F.transform(F.filter("l", lambda x: x["unknown"]), lambda x: x["orig"]))})
    rows = rows.withColumn("clean", F.col("unknown_codes") == "")
    return rows.withColumn("gardiner_seq_orig", F.when(F.col("clean") & (F.col("n_normalised") == 0), "").otherwise(F.col("orig"))).drop("l", "orig")


def totals(lines: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_lines, joined_chars, dropped, candidates, clean, quarantined, normalised, unknown_codes.

    lines as in classify_lines; found as routed() gives it. Lines are counted as they come; texts of
    several documents are joined each on their own.
    """
    is_text = F.col("kind") == "text"
    by = classify_lines(lines).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "noise").alias("noise"), F.sum(F.when(is_text, F.length(F.trim("line")) + 1)).alias("chars"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    a = by.agg(total("n", "n_lines"), total("noise", "dropped"), total(F.col("chars") - 1, "joined_chars"))  # a space between lines
    rows = found.select("clean", "n_normalised", F.posexplode_outer(F.when(~F.col("clean"), F.split("unknown_codes", " "))).alias("k", "code"))
    one = F.coalesce("k", F.lit(0)) == 0  # the first row of each entry
    c = rows.agg(F.count_if(one).alias("candidates"), F.count_if(one & F.col("clean")).alias("clean"), F.count_if(one & ~F.col("clean")).alias("quarantined"), total(F.when(one, F.col("n_normalised")), "normalised"), F.countDistinct("code").alias("unknown_codes"))
    return a.crossJoin(c)  # a row each


def first_lines(lines: DataFrame, kind: str, n: int) -> DataFrame:
    """The first n lines of a kind by document and place."""
    return classify_lines(lines).where(F.col("kind") == kind).orderBy("doc", "pos").limit(n)


def report(total: DataFrame, codes: DataFrame, dropped: DataFrame) -> str:
    """A text report: totals, the most frequent unknown codes, the first dropped lines. All three are a few rows."""
    row = total.first()
    out = [f"{name.replace('_', ' '):<16}: {value:,}" for name, value in row.asDict().items()]
    out += ["", "Unknown codes:", *(f"  {r['code']:<10} {r['n']:6d}" for r in codes.collect())]
    return "\n".join([*out, "", "Dropped lines:", *(f"  {r['line']}" for r in dropped.collect())]) + "\n"


def correct(codes: DataFrame, sequences: DataFrame, cost: DataFrame) -> DataFrame:
    """seq, fixed: a sequence that is not in the lexicon becomes the likeliest one that differs in one code.

    codes: seq (array of codes); sequences: lexicon (array); cost: seen, meant, p (a confusion table).
    Each sequence with one place left out is a key, so candidates meet by equality.
    """
    holes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.struct(i.alias("at"), F.concat(F.slice(c, F.lit(1), i - 1), F.array(F.lit("")), F.slice(c, i + 1, F.size(c))).alias("key"), F.element_at(c, i).alias("code"))))
    ask = codes.where(F.size("seq") > 0).join(sequences.select(F.col("seq")), "seq", "left_anti").distinct()
    a = ask.select("seq", holes(F.col("seq")).alias("h")).select("seq", "h.key", F.col("h.code").alias("seen"))
    b = sequences.where(F.size("seq") > 0).select(F.col("seq").alias("fixed"), holes(F.col("seq")).alias("h")).select("fixed", "h.key", F.col("h.code").alias("meant"))
    scored = a.join(b, "key").join(cost, ["seen", "meant"])
    return scored.groupBy("seq").agg(F.max_by("fixed", F.struct(F.col("p"), F.col("fixed"))).alias("fixed"))
