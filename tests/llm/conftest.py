import pytest

from ledgerloom.llm.shared import seen_by_workers


@pytest.fixture(autouse=True)
def workers(spark):
    seen_by_workers(spark)


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows, with extra columns whose names clash with those operators add."""
    def build(rows, schema):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, schema).repartition(3)
        for name in ("score", "size", "shard", "group", "key", "n", "words", "window", "host", "rule"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df
    return build
