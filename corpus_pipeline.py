"""The corpus pipeline: toxicity, exact dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. Stages that filter return
the columns of documents as they are. Null texts count as empty in every stage, and one of them stays. Rows that repeat
both id and text are one document after exact dedup; rows of one id with other texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import fresh_prefix, stored, table
from weir.llm.decontamination import decontaminate
from weir.llm.exact_dedup import without_copies
from weir.llm.jaccard_join import without_near_copies
from weir.llm.queries import tokenizer_path
from weir.llm.sentencepiece_bpe import encode_documents
from weir.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    p = fresh_prefix(docs.columns)
    return score_toxicity(docs, table(spark, sf_dir, "labels"), carry=docs.columns, prefix=p).filter(F.col(f"{p}predicted") == 0).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest id."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 join: the smallest id."""
    return without_near_copies(docs, width=5, threshold=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word of a benchmark window: a long text that holds a test item whole goes too."""
    p = fresh_prefix(docs.columns)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), with_spans=False, carry=docs.columns, prefix=p, share=(0, 1))
    return found.filter(~F.col(f"{p}contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of every document left."""
    return encode_documents(docs, tokenizer_path(), ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokens),
]

#: A learned stage and an exact merge encoding are not SQL; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
