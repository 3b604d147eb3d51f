"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of documents. Between stages the rows are written as Parquet in the
shared folder and read again, so a lost executor never costs more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import bpe, linededup, mixing, quality, similar
from tesselon.llm.common import Tables
from tesselon.llm.queries import ship

#: Expected tokens of each domain as a multiple of what there is: toxic and poor texts are thinned.
RELATIVE = {"good": 1.0, "poor": 0.5, "toxic": 0.05}

#: What an encoding worker keeps: less than on its own, as the executors' heaps have grown in the stages before.
MOVES, MEMO = 30_000, 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut out; a document of which nothing is left goes."""
    ship(spark)
    cut = linededup.dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more, candidates by SimHash and minimum hashes) stays."""
    ship(spark)
    return similar.keep_one_of_each(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at their rates, none more than once."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.draw(docs, mixing.mixing_rates(docs, labels, relative=RELATIVE, most=1.0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and the digests of ids and decoded text."""
    import public_tokenizers

    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, moves=MOVES, memo=MEMO, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mix), ("encoding", encode)]

#: SQL cannot express the fitted stages and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        mark = Tables.mark()
        docs = tables.write(stage(spark, docs, sf_dir))
        Tables.forget(spark, mark)  # what the stage wrote on its way
    return docs
