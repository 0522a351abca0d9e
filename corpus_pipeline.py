"""A corpus pipeline of five stages, each an operator of keyloom.llm on all that the stage before kept.

Near-duplicates are judged on shingles of five words at a similarity of 0.8. Defined
results: every row is judged by itself, whatever its doc_id; rows without text go
where they are judged poor, else they stay as rows without pieces; rows repeated with
their id and text count once after near-dedup; a null doc_id stays if no row with one
stands for it; an empty table gives no rows; columns beyond those of documents are
kept up to the last stage, which returns doc_id, n_pieces and ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, minhash, quality, secrets, sp_dropout
from keyloom.llm.common import forget, small_batches, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal classifier rejects."""
    small_batches(spark)
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near-duplicates (5-word shingles, similarity 0.8)."""
    return minhash.deduplicated(docs, percent=80, words=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that shares a window of 8 words with any benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), limit=1)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; every document stays."""
    return secrets.redacted(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids, by merge-dropout."""
    return sp_dropout.segmented(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: The classifier and the forest are fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; each result is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            forget(before)
        before = docs
    return docs
