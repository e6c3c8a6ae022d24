"""Corpus preparation from raw documents to token counts, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, compression, decontam, jaccard, linededup, queries
from barloom.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep.

    A null or empty text fails the base rules.  Equal rows share their verdict.  Columns beyond
    those of documents end here; no documents give no rows, in this stage and in the others.
    """
    queries.small_batches(spark)
    return compression.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars is the new length.

    A null text becomes an empty one.  Rows that share a doc_id count as one document; rows without
    a doc_id keep all lines.
    """
    queries.small_batches(spark)
    cut = linededup.drop_repeated_lines(docs, ("lang", "source"))
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones.

    Texts without words are similar to nothing and stay.  Of rows that share a doc_id one stays,
    that with the smallest text, lang, source and n_chars.  Rows without a doc_id all stay.
    """
    queries.small_batches(spark)
    groups = jaccard.near_duplicates(docs)
    copies = groups.filter("component_id < doc_id").select("doc_id")
    own = docs.filter("doc_id is not null").join(copies, "doc_id", "left_anti")
    one = own.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return one.select(*COLUMNS).union(docs.filter("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; texts without words, and rows without a doc_id, stay."""
    queries.small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts; a null text has no tokens."""
    queries.small_batches(spark)
    return bpe.round_trip(docs, queries.WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

#: SQL can't express the compression bands and the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again for the next."""
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
