"""Documents to token files in five stages, each on what the one before kept.

Toxic documents go; of near copies (five-word shingles, similarity 0.8) one document stays; documents with benchmark items go;
sources are mixed to their target weights, documents repeated as the mix takes them; the rest is written to token files.
Every stage but the last returns the columns of ``documents``. The last gives the digest of the files it has written and read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, jaccard, mixing, tokenfile, toxicity
from ledgerloom.llm.shared import seen_by_workers, stored
from ledgerloom.session import prepare

WIDTH, PERCENT = 5, 80

# Learned scores, set joins and entropy coding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return seen_by_workers(prepare(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    seen_by_workers(prepare(spark))
    return jaccard.one_of_each(docs, WIDTH, PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix of sources takes it."""
    prepare(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 read from the token files."""
    import public_tokenizers

    seen_by_workers(prepare(spark))
    return tokenfile.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("jaccard_join", distinct), ("decontamination", decontaminated), ("mixing", mixed),
          ("token_files", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
