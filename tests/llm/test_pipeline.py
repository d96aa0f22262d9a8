"""The pipeline, its stages, and the registered queries of the subpackage."""

import __spark_entry__ as contract
import corpus_pipeline
import pytest

from compare import difference, duck
from ledgerloom.llm import queries
from ledgerloom.llm.shared import stored

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # too few labels to learn from in the smallest


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    if name in queries.oracle_sql():
        assert difference(df, duck(SF), queries.oracle_sql()[name]) is None
    else:
        assert df.count() > 0 or name == "op2_benchmark_leaks"


def test_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(contract.queries())


def test_stages_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    ids, names = {r.doc_id for r in docs.collect()}, docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, LARGER), name)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == names and now <= ids
        ids = now
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER)
    assert last.count() == sizes[-1] and {r.doc_id for r in last.collect()} == ids


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
