"""Quality rules: counts per text, then multivariate outliers by minimum covariance determinant.

Everything is DataFrame expressions. Four transformed statistics per text (mean word length,
symbol share, share of repeated lines, share of repeated words) are held as whole 1/1024ths, so
sums are exact and do not depend on the order of rows. Per language and source, three starts (mean and
covariance; medians and MAD; the half nearest the medians) are each improved by concentration steps: squared Mahalanobis
distances are binned, the bins that hold the nearest 75 % of the texts give the next mean and
covariance. The start whose covariance has the smaller determinant wins. Every estimate also counts PRIOR
texts that are spread as the nearest texts of all groups together: it rules the estimate of a group of a few texts and
vanishes in that of a large one, by one formula at every size. Texts beyond the distance that `tail` of
normal texts would exceed are rejected.

Rows meet only in sums by group and bin and in counts by group and value, both summed before the shuffle, so
a group that holds most rows costs no more than others. Medians are taken over the counts by value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Tables, text_key

#: Smallest standard deviation of each statistic: within a few of these nothing is an outlier.
FLOORS = {"x_length": 0.15, "x_symbols": 0.5, "x_lines": 0.25, "x_repeats": 0.25}
SCALE = 1024
DIMS = list(FLOORS)
PAIRS = [(a, b) for a in range(len(DIMS)) for b in range(a, len(DIMS))]
SHARE = 0.75
#: Texts of all groups that each group's estimate counts besides its own.
PRIOR = 50.0
#: Values of a statistic that medians tell apart: 1024ths taken together.
COARSE = 8
#: Rows of a table of groups up to which it is broadcast.
FEW = 100_000


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    text = f"coalesce(`{text_col}`, '')"
    df = docs.withColumn("t_words", F.expr(f"array_remove(split({text}, '{SPACE}+'), '')")).withColumn("t_lines", F.expr(f"filter(split({text}, '\\n'), l -> l rlike '[^ \\\\t-\\\\r]')"))
    df = df.withColumns(
        {
            "n_words": F.size("t_words").cast("long"),
            "word_chars": F.expr("cast(length(array_join(t_words, '')) as long)"),
            "n_symbols": F.expr(f"cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as long)"),
            "n_lines": F.size("t_lines").cast("long"),
            "n_dup_lines": F.expr("cast(size(t_lines) - size(array_distinct(t_lines)) as long)"),
            "t_grams": F.expr("case when size(t_words) < 6 then array() else transform(sequence(1, size(t_words) - 4), i -> xxhash64(slice(t_words, i, 5))) end"),
        }
    )
    # places of the windows found twice or more, in order; each adds the words up to the next place, five at most
    places = """sort_array(transform(filter(transform(array(sort_array(transform(t_grams, (g, i) -> struct(g, i)))),
        s -> transform(s, (x, k) -> if(get(s, k - 1).g = x.g or get(s, k + 1).g = x.g, x.i, null)))[0], p -> p is not null), p -> p))"""
    covered = f"transform(array({places}), p -> aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0, (a, b) -> a + b))[0]"
    df = df.withColumn("n_repeat_words", F.expr(f"cast(case when size(array_distinct(t_grams)) = size(t_grams) then 0 else {covered} end as long)"))
    df = df.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return df.drop("t_words", "t_lines", "t_grams")


def _transformed(df: DataFrame) -> DataFrame:
    """The statistics of texts with words, as whole numbers of 1/1024; null without."""
    some = F.col("n_words") > 0
    x = {
        "x_length": F.expr("ln(word_chars / n_words)"),
        "x_symbols": F.expr("ln(1 + 1000 * n_symbols / word_chars)"),
        "x_lines": F.expr("ln(1 + 10 * n_dup_lines / n_lines)"),
        "x_repeats": F.expr("ln(1 + 10 * n_repeat_words / n_words)"),
    }
    return df.withColumns({k: F.when(some, F.round(v * SCALE).cast("long")) for k, v in x.items()})


def _chi_square(x: float, dims: int) -> float:
    """Distribution function for an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))


def quantile(tail: float) -> float:
    """The squared distance that a share `tail` of normal points exceeds."""
    low, high = 0.0, 400.0
    over = lambda x: math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(len(DIMS) // 2))
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) > tail else (low, mid)
    return low


def _consistency() -> float:
    """Factor by which the covariance of the nearest SHARE of normal points is too small."""
    return SHARE / _chi_square(quantile(1 - SHARE), len(DIMS) + 2)


def _estimate(sums: DataFrame, widen: float) -> DataFrame:
    """Mean m0.. and lower Cholesky factor c00.. of the covariance from n, s0.., s00..."""
    d = len(DIMS)
    df = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in range(d)})
    cov: dict[tuple[int, int], Column] = {}
    for i, j in PAIRS:
        floor = FLOORS[DIMS[i]] ** 2 if i == j else 0.0
        # the floor is added rather than a lower limit: the matrix stays positive definite
        cov[i, j] = (F.col(f"s{i}{j}") / F.col("n") / SCALE**2 - F.col(f"m{i}") * F.col(f"m{j}")) * widen + F.lit(floor)
    df = df.withColumns({f"v{i}{j}": c for (i, j), c in cov.items()})
    for j in range(d):
        rest = sum((F.col(f"c{j}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"c{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - rest, F.lit(FLOORS[DIMS[j]] ** 2 / 4))))
        df = df.withColumns({f"c{i}{j}": (F.col(f"v{j}{i}") - sum((F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"c{j}{j}") for i in range(j + 1, d)})
    keep = [f"m{i}" for i in range(d)] + [f"c{i}{j}" for j in range(d) for i in range(j, d)]
    logdet = sum((F.ln(f"c{i}{i}") for i in range(d)), F.lit(0.0))
    return df.select("g_lang", "g_source", "start", *keep, logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(len(DIMS)):
        y.append((F.col(DIMS[i]) / SCALE - F.col(f"m{i}") - sum((F.col(f"c{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"c{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _sums(prefix: list[Column]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.sum(DIMS[i]).alias(f"s{i}") for i in range(len(DIMS))]
    return prefix + out + [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i, j in PAIRS]


def _few(groups: DataFrame, tables: Tables) -> DataFrame:
    """A written table of groups, to be broadcast if it is small."""
    groups = tables.write(groups)
    return F.broadcast(groups) if groups.count() <= FEW else groups


GROUP = ["g_lang", "g_source"]


def _medians(counts: DataFrame) -> DataFrame:
    """value: the lower median of each group's statistic, from counts n by value."""
    by = [*GROUP, "dim"]
    ranked = counts.withColumns({"up_to": F.sum("n").over(W.partitionBy(*by).orderBy("value")), "total": F.sum("n").over(W.partitionBy(*by))})
    return ranked.where("2 * up_to >= total").groupBy(*by).agg(F.min("value").alias("value"))


def _robust_start(stats: DataFrame, tables: Tables) -> DataFrame:
    """Medians and, as a diagonal covariance, deviations from them."""
    by = [*GROUP, "dim"]
    values = stats.select(*GROUP, F.posexplode(F.array(*(F.floor(F.col(x) / COARSE) for x in DIMS))).alias("dim", "value"))
    counts = tables.write(values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")))
    middle = tables.write(_medians(counts).withColumnRenamed("value", "q"))
    away = counts.join(middle, by).groupBy(*by, F.abs(F.col("value") - F.col("q")).alias("value")).agg(F.sum("n").alias("n"))
    both = middle.join(_medians(away).withColumnRenamed("value", "away"), by)
    at = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    d = range(len(DIMS))
    rows = both.groupBy(*GROUP).agg(*((at("q", i) + 0.5).alias(f"q{i}") for i in d), *(at("away", i).alias(f"d{i}") for i in d))
    out = {f"m{i}": F.col(f"q{i}") * COARSE / SCALE for i in d}
    out |= {f"c{i}{j}": F.greatest(F.col(f"d{i}") * 1.4826 * COARSE / SCALE, F.lit(FLOORS[DIMS[i]])) if i == j else F.lit(0.0) for j in d for i in range(j, len(DIMS))}
    return rows.withColumns(out | {"logdet": F.lit(0.0)})


def _with_prior(sums: DataFrame, names: list[str]) -> DataFrame:
    """Sums of each group and start, with PRIOR texts spread as those of all groups."""
    everyone = sums.groupBy(F.col("start").alias("e_start")).agg(*(F.sum(c).alias(f"e_{c}") for c in names))
    both = sums.join(F.broadcast(everyone), F.col("start") == F.col("e_start"))  # a row for each start
    return both.select(*GROUP, "start", *((F.col(c) + F.col(f"e_{c}") * (PRIOR / F.col("e_n"))).alias(c) for c in names))


def minimum_covariance(stats: DataFrame, tables: Tables, steps: int = 8) -> DataFrame:
    """g_lang, g_source, mean and Cholesky factor for each group of stats (g_lang, g_source, x_...).

    Steps end when no determinant changes by more than a millionth, or after `steps`.
    """
    names = ["n", *(f"s{i}" for i in range(len(DIMS))), *(f"s{i}{j}" for i, j in PAIRS)]
    plain = _estimate(_with_prior(stats.groupBy(*GROUP).agg(*_sums([])).withColumn("start", F.lit(0)), names), 1.0)
    robust = _robust_start(stats, tables)
    now = plain
    for start in (1, 2):
        now = now.unionByName(robust.withColumn("start", F.lit(start)).select(*plain.columns))
    now = _few(now, tables)
    for step in range(steps):
        share = F.when((F.col("start") == 2) & F.lit(not step), 0.5).otherwise(SHARE)
        near = stats.join(now, GROUP).withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * 16).cast("int"))
        own = W.partitionBy(*GROUP, "start")
        bins = near.groupBy(*GROUP, "start", "bin").agg(*_sums([])).withColumns({"up_to": F.sum("n").over(own.orderBy("bin")), "total": F.sum("n").over(own)})
        inner = bins.where(F.col("up_to") - F.col("n") < share * F.col("total")).groupBy(*GROUP, "start").agg(*(F.sum(c).alias(c) for c in names))
        before, now = now, _few(_estimate(_with_prior(inner, names), _consistency()), tables)
        old = before.select(*(F.col(c).alias(f"b_{c}") for c in (*GROUP, "start", "logdet")))
        moved = now.join(old, [F.col(c) == F.col(f"b_{c}") for c in (*GROUP, "start")]).agg(F.max(F.abs(F.col("logdet") - F.col("b_logdet"))).alias("m")).first()["m"]
        if step and (moved or 0.0) < 1e-6:
            break
    best = now.groupBy(*GROUP).agg(F.expr("min_by(start, struct(logdet, start))").alias("start"))
    return now.join(best, [*GROUP, "start"]).drop("start", "logdet")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = 4e-9) -> DataFrame:
    """One row per row of docs: id, text hash, counts, base_failed, distance, kept.

    tail: the share of normal texts that would be rejected. The statistics have longer tails than a
    normal distribution, so it is small; the floors on variances make it smaller still. Null and empty
    texts have zero counts and fail the base rules. A null language or source is a
    group of its own. Rows that repeat each count. Without rows the result is empty.
    """
    return _judged(docs, F.col(id_col).alias("id"), text_col, lang_col, source_col, tail).withColumnRenamed("id", id_col)


def _judged(docs: DataFrame, carried: Column, text_col: str, lang_col: str = "lang", source_col: str = "source", tail: float = 4e-9) -> DataFrame:
    """id (the carried column, which may hold whole rows) with the counts and the verdict. Rows meet only a table of groups."""
    tables = Tables(docs.sparkSession)
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(carried.alias("id"), text_key(text_col).alias("key"), group(lang_col).alias("r_lang"), group(source_col).alias("r_source"), F.col(text_col).cast("string").alias("text"))
    rows = tables.write(_transformed(base_statistics(rows)).drop("text"))
    stats = rows.where("not base_failed").select(F.col("r_lang").alias("g_lang"), F.col("r_source").alias("g_source"), *DIMS)
    found = _few(minimum_covariance(stats, tables), tables)
    joined = rows.join(found, (F.col("r_lang") == F.col("g_lang")) & (F.col("r_source") == F.col("g_source")), "left")
    return joined.withColumn("distance", _distance()).select(
        "id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(tail))).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are. Texts are not shuffled."""
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return _judged(docs, rows, text_col, **options).where("kept").select("id.*")
