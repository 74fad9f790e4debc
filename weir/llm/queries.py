"""The corpus operators as queries over whole tables, in the digest form of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import exact_dedup, oracles
from weir.llm.common import table
from weir.llm.decontamination import decontaminate
from weir.llm.jaccard_join import jaccard_join
from weir.llm.licences import scan_licences
from weir.llm.pseudonyms import pseudonymise
from weir.llm.quality import score_quality
from weir.llm.sentencepiece_bpe import encode_documents
from weir.llm.substring_dedup import substring_dedup
from weir.llm.suffix_dedup import suffix_dedup
from weir.llm.toxicity import score_toxicity

#: Key of the registered query; a real run passes its own secret.
PSEUDONYM_KEY = "example-key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_known", F.concat_ws(",", "licences").alias("licences"), F.size("matches").cast("long").alias("n_matches"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_ranking, op2_pii_pseudonyms, op3_toxicity_kernel, op4_benchmark_decontamination, op5_jaccard_join,
        op6_substring_dedup, op7_sentencepiece, op8_exact_dedup, op9_licence_scan, op10_suffix_array_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": oracles.DECONTAMINATION,
        "op5_jaccard_join": oracles.JACCARD,
        "op6_substring_dedup": oracles.SUBSTRINGS,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op10_suffix_array_dedup": oracles.SUFFIXES,
    }
