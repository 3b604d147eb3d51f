"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, gam, interactions, license, linededup, lm, mixing, quality, resampling, simhash, suffix, tokencount

#: Share of all tokens wanted for each domain.
TARGETS = {"good": 0.85, "poor": 0.05, "toxic": 0.10}


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each context, unless the package's folder is on their path anyway."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_tesselon", False):
        return
    name = Path(tempfile.mkdtemp(prefix="tesselon-")) / "tesselon.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "tesselon").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    spark.sparkContext._tesselon = True


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for documents so that expected tokens per domain match TARGETS."""
    rates = mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), targets=TARGETS)
    return rates.drop("key")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_quality, op4_bpe, op5_lm, op6_suffix, op7_embeddings, op8_tokens, op9_licenses, op10_lines, op11_filter_audit, op12_quality_model, op13_resample, pipeline)}

_NOTICES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license.TEMPLATES.items())

ORACLE_SQL = {
    "op7_embeddings": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
        ), u as (
            select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v
        ), links as (
            select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
            where list_dot_product(a.e, b.e) >= 0.95
        ), reach as (
            select vec_id as n, vec_id as m from u union select reach.n, links.b from reach join links on reach.m = links.a
        ), parts as (
            select n, min(m) as component_id from reach group by n
        ), counts as (
            select a, count(*) as n_links from links group by a
        )
        select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
        from u join parts on n = vec_id left join counts on a = vec_id
    """,
    "op9_licenses": f"""
        with t(license, body) as (values {_NOTICES}),
        w as (select license, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from t),
        g as (select license, list_distinct(case when len(w) <= 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
        d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) <= 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as x from d),
        k as (select license, len(g)::bigint as n_shingles, unnest(g) as x from g),
        f as (select doc_id, license, n_shingles, count(*) as n_shared from s join k using (x) group by all)
        select doc_id, license, n_shared, n_shingles, n_shared / n_shingles as containment from f where n_shared / n_shingles >= 0.8
    """,
    "op10_lines": """
        with l as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
        ), w as (
            select doc_id, i, line, lead(line, 1) over p as second, lead(line, 2) over p as third from l window p as (partition by doc_id order by i)
        ), ranked as (
            select doc_id, i, row_number() over (partition by line, second, third order by doc_id, i) as r
            from w where third is not null and regexp_matches(line || second || third, '[^ \\t-\\r]')
        ), gone as (
            select distinct doc_id, i + unnest([0, 1, 2]) as i from ranked where r > 1
        ), kept as (
            select doc_id, count(*) as n_lines, count(gone.i) as n_removed, string_agg(line, chr(10) order by i) filter (gone.i is null) as kept
            from l left join gone using (doc_id, i) group by doc_id
        )
        select doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) as kept_sha256 from kept
    """,
    "op11_filter_audit": """
        with recursive d as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
        ), w as (
            select *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') as words, min(doc_id) over (partition by text) as first_id from d
        ), m as (
            select doc_id, part, concat(case when len(words) < 200 then 'A' end, case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' end,
                case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) then 'C' end,
                case when regexp_matches(text, '[#$%&*|]') then 'D' end, case when doc_id > first_id then 'E' end) as fails from w
        ), l as (
            select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
        ), g as (
            select part, fails, count(*) as c, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by all
        ), p as (
            select '' as o union all select o || x from p, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where strpos(o, x) = 0
        ), s as (
            select o as filter_order, (range + 1)::int as step, o[range + 1:range + 1] as f, o[1:range] as before from p, range(5) where length(o) = 5
        ), e as (
            select part, filter_order, step, f,
                regexp_matches(fails, '[' || before || ' ]') as gone, strpos(fails, f) > 0 as hit, fails = f as only_this, c, good, toxic from g, s
        ), r as (
            select part, filter_order, step, f, coalesce(sum(c) filter (not gone and not hit), 0)::bigint as kept, coalesce(sum(c) filter (not gone and hit), 0)::bigint as removed,
                coalesce(sum(c) filter (gone and hit), 0)::bigint as redundant, coalesce(sum(c) filter (only_this), 0)::bigint as unique_fails,
                coalesce(sum(good) filter (not gone and hit), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not gone and hit), 0)::bigint as toxic_lost from e group by all
        )
        select * exclude (f), (sum(removed) over (partition by part, f))::bigint as shapley from r
    """,
}
