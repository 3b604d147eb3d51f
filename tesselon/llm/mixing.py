"""Mixing to target weights by soft membership.

A naive Bayes classifier over the presence of words, fitted on a bounded sample of the labelled
rows, gives each document's posterior over domains. Rates r >= 0 (optionally bounded above) are
then fitted so that the expected tokens of each domain, the sum of rate * tokens * posterior,
match the targets with the least squares of the misses: projected gradient from rate 1, in the metric
that weighs documents by their tokens, so that a document's gradient depends on its posterior alone
and projection is clipping; rates that are free to move may be scaled by their second moments. Posteriors are held in
whole thousandths that add up to 1, so a step is two small sums
over the different posteriors, and a document's rate replays the steps. Only
DataFrame functions touch rows; the driver holds a few numbers per domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Tables, fresh, sized_join

DOMAINS = ("good", "poor", "toxic")
#: Bounds of the fitted classifier: labelled rows used, words used.
SAMPLE, FEATURES = 4000, 2048
GRID = 1000


def label_domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """toxic rows are `toxic`; others `good` or `poor` by quality."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").otherwise("poor")


def _words(text: str) -> Column:
    return F.expr(f"array_distinct(array_remove(split(translate(lower(coalesce({text}, '')), '.,', ''), '{SPACE}+'), ''))")


def fit_classifier(docs: DataFrame, labels: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> tuple[DataFrame, list[float]]:
    """Words with a log weight per domain for being there rather than not (w0, w1, ...), and the log weights of a text without any.

    Uses the `sample` labelled rows of lowest hashed id; keeps the `features` words, seen in 4 of
    them or more, that tell the domains apart best. Without labelled rows: no words, equal priors.
    """
    chosen = labels.select(F.col(id_col).alias("l_id"), "quality", "toxic").where("l_id is not null").groupBy("l_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id").limit(sample).select("l_id", label_domain().alias("domain"))
    own = docs.select(F.col(id_col).alias("d_id"), _words(f"`{text_col}`").alias("words"))
    texts = tables.write(own.join(chosen, F.col("d_id") == F.col("l_id")).select("domain", "words"))
    sizes = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    counts = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(DOMAINS)]
    words = texts.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"), *counts).where("c >= 4")
    share = [sizes.get(d, 0) / max(total, 1) for d in DOMAINS]
    surprise = [(F.col(f"c{i}") - F.col("c") * s) / F.sqrt(F.col("c") * s + 1.0) for i, s in enumerate(share)]
    rate = [(F.col(f"c{i}") + 0.5) / (sizes.get(d, 0) + 1.0) for i, d in enumerate(DOMAINS)]
    mean = (F.col("c") + 0.5) / (total + 1.0)
    sure = [F.abs(z) >= 4 for z in surprise]  # a weight counts only where the word's count in the domain is no accident
    bounded = lambda x: F.least(F.greatest(x, F.lit(-3.0)), F.lit(3.0))
    there = [F.when(ok, bounded(F.ln(r / mean))).otherwise(0.0) for ok, r in zip(sure, rate, strict=True)]
    missing = [F.when(ok, bounded(F.ln((1.0 - r) / (1.0 - mean)))).otherwise(0.0) for ok, r in zip(sure, rate, strict=True)]
    words = words.withColumns({f"w{i}": t - m for i, (t, m) in enumerate(zip(there, missing, strict=True))} | {f"a{i}": m for i, m in enumerate(missing)} | {"tells": F.greatest(*map(F.abs, surprise))})
    model = tables.write(words.where("tells >= 4").orderBy(F.col("tells").desc(), "word").limit(features))
    away = model.agg(*(F.coalesce(F.sum(f"a{i}"), F.lit(0.0)).alias(f"a{i}") for i in range(len(DOMAINS)))).first()
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(DOMAINS))) + away[f"a{i}"] for i, d in enumerate(DOMAINS)]
    return model.select("word", *(f"w{i}" for i in range(len(DOMAINS)))), prior


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float], tables: Tables, id_col: str = "doc_id", text_col: str = "text", temper: float = 1.0) -> DataFrame:
    """id, key (text hash), copies, n_words, p0, p1, ... (whole thousandths, summing to 1000).

    Rows equal in id and text are one row with their number as copies. The model has FEATURES words at most, so it is broadcast.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), F.expr(f"size(array_remove(split(coalesce(`{text_col}`, ''), '{SPACE}+'), ''))").cast("long").alias("n_words"), _words(f"`{text_col}`").alias("words"))
    # no word is empty: the empty one counts the copies
    hits = rows.select("id", "key", "n_words", F.explode(F.array_append("words", F.lit(""))).alias("word")).join(F.broadcast(model), "word", "left")
    scores = [F.sum(f"w{i}").alias(f"z{i}") for i in range(len(DOMAINS))]
    z = hits.groupBy("id", "key", "n_words").agg(F.count_if(F.col("word") == "").alias("copies"), *scores)
    raw = [F.exp(F.least(F.greatest((F.coalesce(f"z{i}", F.lit(0.0)) / F.col("copies") + F.lit(p)) * temper, F.lit(-60.0)), F.lit(60.0))) for i, p in enumerate(prior)]
    z = z.withColumns({f"e{i}": e for i, e in enumerate(raw)})
    whole = sum((F.col(f"e{i}") for i in range(1, len(DOMAINS))), F.col("e0"))
    left = F.lit(GRID).cast("long")
    for i in range(len(DOMAINS) - 1):
        z = z.withColumn(f"p{i}", F.least(left, F.round(F.col(f"e{i}") / whole * GRID).cast("long")))
        left = left - F.col(f"p{i}")
    z = z.withColumn(f"p{len(DOMAINS) - 1}", left)
    return tables.write(z.select("id", "key", "copies", "n_words", *(f"p{i}" for i in range(len(DOMAINS)))))


def _along(v: list[str]) -> str:
    """A document's posterior times a weight per domain, in SQL: plans are built in one call."""
    return "(" + " + ".join(f"{e} * p{i}" for i, e in enumerate(v)) + f") / {GRID}"


def _numbers(v: list[float]) -> list[str]:
    return [f"({float(x)!r}D)" for x in v]


def _held(rate: str, slope: str, most: float | None) -> str:
    """Whether a rate is at its bound and the gradient (slope) points outwards."""
    low = f"({rate} <= 0 and {slope} >= 0)"
    return low if most is None else f"({low} or ({rate} >= {float(most)!r}D and {slope} <= 0))"


def _step(rate: str, move: str, slope: str, most: float | None) -> str:
    """The rate after a projected step."""
    moved = f"greatest(0D, {rate} - {move})"
    if most is not None:
        moved = f"least({float(most)!r}D, {moved})"
    return f"if({_held(rate, slope, most)}, {rate}, {moved})"


def replay(steps: list[list[float]], most: float | None) -> Column:
    """A document's rate after all steps, each a move and a gradient as weights per domain, one after the other."""
    n = len(DOMAINS)
    held = ", ".join(f"array({', '.join(_numbers(s))})" for s in steps) if steps else ""
    at = lambda first: _along([f"s[{first + i}]" for i in range(n)])
    start = 1.0 if most is None else min(1.0, float(most))
    return F.expr(f"aggregate(cast(array({held}) as array<array<double>>), {start!r}D, (rate, s) -> {_step('rate', at(0), at(n), most)})")


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a few linear equations, the matrix symmetric and positive definite."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    for i in range(n):
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
    for i in reversed(range(n)):
        rows[i][n] = (rows[i][n] - sum(rows[i][k] * rows[k][n] for k in range(i + 1, n))) / rows[i][i]
    return [r[n] for r in rows]


def fit_rates(members: DataFrame, targets: dict[str, float], tables: Tables, most: float | None = None, rounds: int = 40, tolerance: float = 1e-5) -> list[list[float]]:
    """Projected gradient steps after which the squared misses of the targets (shares of all tokens) are least.

    Each round tries the plain gradient, at several lengths, and the gradient scaled by the inverse second moments of the posteriors over
    the rates that are free to move, and takes what leaves least; the plain step of length 1 always gains.
    Ends when every domain is within `tolerance` of its target, when the projected gradient is
    shorter than ten times that (no allowed change of rates gains), when nothing gains any more, or after `rounds` rounds of two
    sums each: targets that are far out of reach are then missed by a little more than they must be.
    """
    d = range(len(DOMAINS))
    cells = tables.write(members.where("n_words > 0").groupBy(*(f"p{i}" for i in d)).agg(F.sum(F.col("n_words") * F.col("copies")).cast("double").alias("w")))
    total = cells.agg(F.sum("w").alias("all_w")).first()["all_w"] or 0.0
    if not total:
        return []
    loss = lambda m: sum(v * v for v in m)

    def misses(steps: list[list[float]], miss: list[float], moves: list[list[float]]) -> list[list[float]]:
        """What is missed after the steps and each of the moves."""
        slope = _along(_numbers(miss))
        after = [f"{_step('rate', _along(_numbers(m)), slope, most)} as r{j}" for j, m in enumerate(moves)] or ["rate as r0"]
        df = cells.withColumn("rate", replay(steps, most)).selectExpr("*", *after)
        got = df.selectExpr(*(f"sum(w * p{i} * r{j}) as r{j}_{i}" for j in range(len(after)) for i in d)).first()
        return [[got[f"r{j}_{i}"] / GRID / total - targets[n] for i, n in enumerate(DOMAINS)] for j in range(len(after))]

    steps: list[list[float]] = []
    miss = misses(steps, [], [])[0]
    for _ in range(rounds):
        if max(map(abs, miss)) < tolerance:
            break
        slope = _along(_numbers(miss))
        df = cells.withColumn("rate", replay(steps, most)).selectExpr("*", f"{_step('rate', slope, slope, most)} as moved", f"if({_held('rate', slope, most)}, 0D, w) as free")
        got = df.selectExpr("sum(w * pow(rate - moved, 2)) as pull", *(f"sum(free * p{i} * p{j}) as m_{i}{j}" for i in d for j in d)).first()
        if math.sqrt(got["pull"] / total) < 10 * tolerance:
            break
        moment = [[got[f"m_{i}{j}"] / GRID**2 / total + (1e-7 if i == j else 0.0) for j in d] for i in d]
        scaled = _solve(moment, miss)
        moves = [[a * v for v in scaled] for a in (1.0, 0.5, 0.2, 0.05)] + [[a * v for v in miss] for a in (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0)]
        then = misses(steps, miss, moves)
        best = min(range(len(moves)), key=lambda j: loss(then[j]))
        if loss(then[best]) >= loss(miss) * (1 - 1e-9):
            break
        steps.append([*moves[best], *miss])
        miss = then[best]
    tables.drop(cells)
    return steps


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, relative: dict[str, float] | None = None, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different id and text of docs: id, key (text hash), copies, n_words, posteriors, rate.

    targets: share of all tokens wanted for each domain; relative: the same as a multiple of the
    domain's expected share now. Null and empty texts have no words: the prior is their
    posterior and they weigh nothing. No documents: no rows.
    """
    tables = Tables(docs.sparkSession)
    model, prior = fit_classifier(docs, labels, tables, id_col, text_col)
    members = posteriors(docs, model, prior, tables, id_col, text_col)
    if targets is None:
        tokens = F.col("n_words") * F.col("copies")
        sums = members.agg(F.sum(tokens).alias("w"), *(F.sum(tokens * F.col(f"p{i}") / GRID).alias(d) for i, d in enumerate(DOMAINS))).first()
        targets = {d: (relative or {}).get(d, 1.0) * (sums[d] or 0.0) / (sums["w"] or 1) for d in DOMAINS}
    steps = fit_rates(members, targets, tables, most)
    shown = [(F.col(f"p{i}") / GRID).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return members.select(F.col("id").alias(id_col), "key", "copies", "n_words", *shown, replay(steps, most).alias("rate"))


def draw(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row repeated floor(rate + u) times, u a fixed uniform number from its id: the expected count is the rate."""
    key, copies = fresh(docs, "tess_key", "tess_copies")
    u = F.pmod(F.xxhash64(F.coalesce(F.col("r_id").cast("string"), F.lit("")), "r_key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rates.select(F.col(id_col).alias("r_id"), F.col("key").alias("r_key"), "rate").select("r_id", "r_key", F.floor(F.col("rate") + u).cast("int").alias(copies)).where(F.col(copies) > 0)
    own = docs.withColumn(key, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    joined = sized_join(own, some, [(id_col, "r_id"), (key, "r_key")], docs.count())
    columns = [own[f"`{c}`"] for c in docs.columns]
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(f"`{c}`" for c in docs.columns))
