"""One query for each corpus operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, compression, decontam, jaccard, langid, linededup, nbsvm, packing, phrases, repair, suffix, token_counts, tokenfile



def vocabulary(name: str) -> str:
    """A public vocabulary file: in the folder TOKENIZERS_DIR, if it is set, or the installed one."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


WORD_BPE, BYTE_BPE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
#: Bytes of one Arrow batch in sessions that run these queries.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so a session gets smaller Arrow batches than Spark's 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), WORD_BPE)


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(documents(spark, sf_dir))


def op6_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_round_trip(documents(spark, sf_dir), BYTE_BPE)


def op9_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


def op4_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_divide_skip_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_report(documents(spark, sf_dir))


def op2_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(documents(spark, sf_dir), BYTE_BPE)


def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_role_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair.repair_report(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_dot_product_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, end_id=1, with_ids=False)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op5_compression_bands": op5_compression_bands,
    "op6_arrow_token_files": op6_arrow_token_files,
    "op9_bloom_line_dedup": op9_bloom_line_dedup,
    "op4_nbsvm_quality": op4_nbsvm_quality,
    "op10_bitmask_language": op10_bitmask_language,
    "op8_divide_skip_jaccard": op8_divide_skip_jaccard,
    "op7_suffix_levels": op7_suffix_levels,
    "op2_section_token_counts": op2_section_token_counts,
    "op3_minhash_containment": op3_minhash_containment,
    "op11_role_grammar_repair": op11_role_grammar_repair,
    "op12_dot_product_packing": op12_dot_product_packing,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op9_bloom_line_dedup": linededup.ORACLE,
    "op8_divide_skip_jaccard": jaccard.ORACLE,
    "op7_suffix_levels": suffix.ORACLE,
    "op3_minhash_containment": decontam.ORACLE,
    "op11_role_grammar_repair": repair.ORACLE,
    "op13_phrase_collocations": phrases.ORACLE,
}
