"""Cleaning of a training corpus: five stages, each on all that the one before it kept.

Quality classifier, near-duplicates, benchmark decontamination, secrets, tokens.  A stage gets the session, the documents and the
folder of the tables; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import bpe, decontaminate, near, quality, secrets, simhash
from tablewarden.llm.common import cut_lineage, parquet
from tablewarden.llm.queries import public_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # the trained stages are no SQL; the tests compare with brute force


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is below one half go.  The model is fitted on the labelled ones among the documents."""
    model = quality.train(docs, parquet(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if one with a smaller id is a near copy: Jaccard similarity of at least 0.8 between their sets of five-word
    shingles, by an exact search.  Of each group of ``op1`` (fingerprints of three-word shingles that differ in at most three bits) the
    document with the smallest id stays.  Both look at all documents of the stage."""
    first = simhash.first_of_groups(docs, distance=3, width=3)
    return near.keep_first(docs, threshold=0.8, width=5, stay=first).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, parquet(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs, secrets.train(docs)).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of the ids and of the text they decode to."""
    path = public_path("word_bpe_49k.json")
    return bpe.digests(bpe.encode(docs, path, with_text=True))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored before the next one reads it."""
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
