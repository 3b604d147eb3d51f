"""The filter audit, the additive quality model and resampling against brute force, held-out labels and odd inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.llm import gam, interactions, linededup, queries, resampling, suffix

KINDS = "doc_id long, text string, lang string, source string, n int, done int, part string, fails int, x string, rank long"
D = "/root/testdata/sf0.001"


def odd_rows():
    long = " ".join(f"w{i % 400}" for i in range(9000))
    texts = [
        "same text here", "same text here", "Same text here", None, "", "  \t\n ", long, long, "A B C " * 90, "x # y " * 120, "pipe | and $", "é中🙂 " * 260,
        " ".join(f"n{i}" for i in range(210)), "UPPER " + " ".join(f"n{i}" for i in range(230)), "a\x00b \x0b\x0c\r\n c", "z" * 6000, "one two three " * 7,
    ]
    rows = [(i, t, "en", "s" if i % 3 else None if i % 2 else "", i, i, "p", 3, "x", i) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "same text here", None, "s", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (40, long, "en", "t", 1, 1, "", 1, "", 1)]


LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 0), (6, 1, 0), (7, 0, 1), (7, 1, 0), (9, 1, None), (12, 1, 0), (40, None, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("source", F.lit("clash"))


def test_ids_that_are_no_numbers(spark):
    """Removal of lines and of repeated strings with text ids: as with numbers, but for the order of documents."""
    block, lines = " ".join(f"w{i * i}" for i in range(200)), "a b\nc d\ne f\ng"
    rows = [("x-1", f"one {block}"), ("y/2", f"{block} two"), (None, "short"), ("", lines), ("q", lines), ("z", None)]
    named = spark.createDataFrame(rows, "doc_id string, text string")
    numbered = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    a, b = ({r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(x).collect()} for x in (named, numbered))
    assert a == {k: b[i] for i, (k, _) in enumerate(rows)} and a["x-1"][1] > 400
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(named).collect()}
    assert sorted((got[""], got["q"])) == [0, 4] and {got[k] for k in ("x-1", "y/2", None, "z")} == {0}


# --- filter audit --------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """Every order applied to the documents one filter after the other."""
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)

    def failing(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > smallest[t])
        return "".join(f for f, bad in zip("ABCDE", tests, strict=True) if bad)

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, parts = {}, {r[3] or "" for r in rows}
    for part in parts:
        mine = [(r[0], failing(r[0], r[1])) for r in rows if (r[3] or "") == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                fail = sum(f in x[1] for x in mine)
                out[part, order, k + 1] = [len(left), len(gone), fail - len(gone), sum(x[1] == f for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return out


def test_audit_of_all_orders(docs, none, labels):
    got = interactions.audit_filters(docs, labels)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    rows = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert rows == brute_audit(odd_rows(), LABELS)
    assert interactions.audit_filters(none, labels).count() == 0
    assert interactions.audit_filters(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_states_are_shared_between_orders(docs, labels, monkeypatch):
    from tesselon.llm.common import Tables

    tables = Tables(docs.sparkSession)
    rows = interactions.verdicts(docs, labels, tables)
    made = []
    write = Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, *by: made.append(1) or write(self, df, *by))
    counts = interactions.edges(rows, 5, tables)
    assert len(made) == 31 and counts.select("done", "filter").distinct().count() <= 80  # states with an edge below them, edges
    assert docs.sparkSession._jsparkSession.sharedState().cacheManager().isEmpty()  # nothing stays persisted


def test_audit_of_other_filters(docs, labels):
    got = interactions.audit_filters(docs, labels, {"S": "n_chars < 20", "L": "n_chars > 5000", "N": "cast(null as boolean)"})
    by = {(r.part, r.filter_order, r.step): r for r in got.collect()}
    assert len(by) == 3 * 6 * 3 and all(by["s", o, o.index("N") + 1].removed == 0 for o in ("SLN", "NLS"))
    assert all(r.redundant == 0 for r in by.values())  # none is short and long
    with pytest.raises(ValueError):
        interactions.audit_filters(docs, labels, {})


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_filter_audit"])
    columns = sorted(want.columns)
    got = queries.op11_filter_audit(spark, D)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall())


# --- additive model ------------------------------------------------------------------------------


def area(y, s):
    """Area under the curve of true against false positives."""
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = np.flatnonzero(s[order] == v)
        rank[order[at]] = at.mean() + 1
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_model_tells_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op12_quality_model(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    score = {r.doc_id: r.score for r in got if r.held_out}
    pairs = [(r.quality, score[r.doc_id]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id in score]
    y, s = map(np.array, zip(*pairs, strict=True))
    assert len(y) > 50 and area(y, s) > 0.97 and ((s >= 0.3) == y).mean() > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in gam.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b
    other = docs.withColumns({"lang": F.lit("q"), "source": F.lit("q"), "n_chars": F.lit(0), "score": F.lit(2)})
    assert a == {r.doc_id: r.score for r in gam.classify(other, labels).collect()}


def test_model_of_odd_rows(spark, docs, none, labels):
    got = gam.classify(docs, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {True}
    by_text = {}
    for r, _ in zip(got, odd_rows(), strict=True):
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_text[0]) == 1 and by_text[3] == by_text[4]  # repeated rows; null as empty
    assert gam.classify(none, labels).count() == 0
    assert {r.score for r in gam.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded_and_stable(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    x, y = gam.training_rows(docs, labels, sample=20)
    again = gam.training_rows(docs.repartition(7), labels.repartition(3), sample=20)
    assert len(y) == 20 and (x == again[0]).all() and (y == again[1]).all()
    assert len(gam.training_rows(docs, labels, sample=1000)[1]) == labels.where(~gam.held_out(F.col("doc_id"))).count()
    assert len(gam.training_rows(docs.union(docs), labels, sample=30)[1]) == 30


def test_pairs_learn_what_single_statistics_cannot():
    r = np.random.default_rng(1)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = gam.fit(x, y)
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1) and len(model.pairs) <= gam.PAIRS
    fresh = r.random((1000, 4))
    assert (((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) == (model.scores(fresh) > 0.5)).mean() > 0.95


def test_score_is_a_sum_of_table_values():
    r = np.random.default_rng(2)
    x = r.random((800, 3))
    model = gam.fit(x, (x[:, 0] + 0.2 * r.random(800) > 0.6).astype(int))
    for row in x[:20]:
        z = model.base
        for k in range(3):
            z += model.tables[k][sum(e <= row[k] for e in model.edges[k])]
        for i, j, a, b, table in model.pairs:
            z += table[sum(e <= row[i] for e in a), sum(e <= row[j] for e in b)]
        assert math.isclose(model.scores(row[None])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-12)


def test_cuts_against_every_cut():
    r = np.random.default_rng(3)
    for _ in range(30):
        g, h, n = r.normal(size=9), r.random(9) + 0.1, r.integers(1, 9, 9).astype(float)
        best = max(((gam._gain(g[:k].sum(), h[:k].sum()) + gam._gain(g[k:].sum(), h[k:].sum()) - gam._gain(g.sum(), h.sum()), k) for k in range(1, 9) if min(n[:k].sum(), n[k:].sum()) >= gam.LEAST), default=(0, 0))
        at, gain = gam._cut(g, h, n)
        assert at == (best[1] if best[0] > 1e-9 else 0) and math.isclose(gain, max(best[0], 0), abs_tol=1e-9)
        step = gam._tree(g, h, n)
        assert len(set(step.round(12))) <= 4
    a, b = r.integers(0, 5, 300), r.integers(0, 4, 300)
    g, h = r.normal(size=300), r.random(300)
    quarters = [[((a < i) == p) & ((b < j) == q) for p in (0, 1) for q in (0, 1)] for i in range(1, 5) for j in range(1, 4)]
    want = max(sum(gam._gain(g[m].sum(), h[m].sum()) for m in ms) for ms in quarters) - gam._gain(g.sum(), h.sum())
    assert math.isclose(gam._cross(a, b, 5, 4, g, h), want, rel_tol=1e-9)


# --- resampling ----------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]


def brute_resample(rows, target):
    """id, text -> n_features, weight, score; and the drawn (score, id) in order."""
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(buckets_of(x))
    for x in target:
        t.update(buckets_of(x))
    own, other = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * own / ((s[b] + 1) * other))) for b in range(10000)]
    out, may = [], []
    for i, x in rows:
        b = buckets_of(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in b) // len(b) if b else 0
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(b), w, score))
        if len(words_of(x)) >= 20:
            may.append((-score, i is not None, i or 0))
    return out, sorted(may)[: 25 * len(may) // 100]


ORDER = lambda x: tuple((y is not None, y or 0) for y in x)


@pytest.mark.parametrize("target", [["same text here", "n1 n2 n3 UPPER n4", None, ""], []])
def test_resampling(spark, docs, none, target):
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, bench).collect()
    want, drawn = brute_resample([(r[0], r[1]) for r in odd_rows()], target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=ORDER) == sorted(want, key=ORDER)
    assert [(-r.score, r.doc_id is not None, r.doc_id or 0) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    assert resampling.resample(none, bench).count() == 0


def test_draw_within_equal_scores(spark):
    """A text in thousands of copies: scores tie, and the draw ends inside a tie."""
    rows = [(i % 3000, "alpha beta gamma " * 8) for i in range(9000)] + [(i, "short") for i in range(5000, 5100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = resampling.resample(docs, spark.createDataFrame([("gamma delta",)], "text string")).collect()
    want, drawn = brute_resample(rows, ["gamma delta"])
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert len(ranked) == len(drawn) == 25 * 9000 // 100 and [(-r.score, True, r.doc_id) for r in ranked] == drawn
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and all(r["rank"] is None for r in got if r.doc_id >= 5000)


def test_resampling_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    want, drawn = brute_resample(docs, [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
    rank = {i: k + 1 for k, (_, _, i) in enumerate(drawn)}
    got = queries.op13_resample(spark, D).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == sorted((*w, rank.get(w[0], 0)) for w in want)


def test_buckets_of_words_of_all_lengths():
    texts = ["", "!", "A", "é中🙂 Abc1 x\x7fy", " ".join("q" * n for n in (1, 47, 48, 49, 50, 200, 5000)), "one  two\nthree", "Z" * 70_000]
    bucket, doc, n = resampling.features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i].tolist()) == sorted(buckets_of(t)) and n[i] == len(words_of(t))
