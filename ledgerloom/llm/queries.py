"""The operators of this subpackage as registered queries, over their whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (alignment, decontaminate, jaccard, languages, linededup, lmscore, mixing, sharding, tokenfile,
                            topk, toxicity, urlfilter, whitening)
from ledgerloom.llm.shared import seen_by_workers
from ledgerloom.session import prepare

_PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(plan):
        _PLANS[name] = lambda spark, sf_dir: plan(seen_by_workers(prepare(spark)), sf_dir)
        if sql:
            _SQL[name] = sql
        return plan
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_lm_scores")
def _op1(spark, sf_dir):
    return lmscore.score_documents(_table(spark, sf_dir, "documents"))


@_query("op2_benchmark_leaks")
def _op2(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op3_line_dedup", linededup.SQL)
def _op3(spark, sf_dir):
    return linededup.without_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@_query("op4_url_filter")
def _op4(spark, sf_dir):
    rules = spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


@_query("op5_sharding")
def _op5(spark, sf_dir):
    return sharding.assign(_table(spark, sf_dir, "documents"))


@_query("op6_top_k", topk.SQL)
def _op6(spark, sf_dir):
    vectors = topk.whole_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@_query("op7_jaccard_join")
def _op7(spark, sf_dir):
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


@_query("op8_toxicity")
def _op8(spark, sf_dir):
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op9_token_files")
def _op9(spark, sf_dir):
    import public_tokenizers
    return tokenfile.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op10_mixing")
def _op10(spark, sf_dir):
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixing.copies(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


@_query("op11_languages")
def _op11(spark, sf_dir):
    return languages.predict_documents(_table(spark, sf_dir, "documents"))


@_query("op12_whitening")
def _op12(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query("op13_alignment")
def _op13(spark, sf_dir):
    import public_tokenizers
    return alignment.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
