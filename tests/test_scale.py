"""The bucket-wise helpers give what the plain window gives, also with one very hot key."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom import scale
from ledgerloom.operators import ingest


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).selectExpr(
        "id AS n", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS key", "id * 37 % 101 AS v",
        "CASE WHEN id % 4 <> 0 THEN id % 7 END AS maybe").cache()


def test_running_sum_and_ordinal(rows):
    w = Window.partitionBy("key").orderBy("n")
    got = scale.running_sum(rows, ["key"], F.expr("n div 100"), [F.col("n")], F.col("v"), "s")
    got = scale.ordinal(got, ["key"], F.expr("n div 64"), [F.col("n")], "o")
    got = scale.ordinal_from_end(got, ["key"], F.expr("n div 64"), [F.col("n")], "e")
    want = rows.withColumns({"ws": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "wo": F.row_number().over(w),
                             "we": F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n")))})
    assert got.join(want.select("n", "ws", "wo", "we"), "n").filter("s <> ws OR o <> wo OR e <> we").count() == 0
    assert got.count() == 4000


def test_previous_value(rows):
    got = scale.previous_value(rows, ["key"], F.expr("n div 100"), [F.col("n")], F.col("maybe"), "p")
    want = rows.withColumn("w", F.lag("maybe").over(Window.partitionBy("key").orderBy("n")))
    assert got.join(want.select("n", "w"), "n").filter("NOT (p <=> w)").count() == 0


def test_first_per_key_is_limited_before_the_shuffle(rows):
    plan = scale.first_per_key(rows, ["key"], [F.col("n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_null_keys_are_spread(spark):
    df = spark.range(100).withColumn("k", F.lit(None).cast("string"))
    assert df.select(scale.spread_nulls(F.col("k"), F.col("id"))).distinct().count() == 100


def test_hot_key_replay(spark):
    """One payout delivered very often is kept once; rows without a UTR are all kept."""
    feed = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'p' ELSE concat('p', id) END AS payout_id", "id AS n")
    none = spark.createDataFrame([], "payout_id string")
    assert ingest.accepted(feed, none, ["payout_id"], [F.col("n")]).count() == 2001
    status = ingest.ingest_status(feed, none, ["payout_id"], [F.col("n")], F.col("n"))
    assert ingest.ingest_summary(status).first().asDict() == {"accepted": 2001, "duplicates": 999, "total": 3000}


def test_documents_are_parsed_once(spark):
    """What extraction results are read for more than once comes from files, not from one more parse of each document."""
    from ledgerloom.plans.registry import queries
    rows = queries()["a15_k10_record_extractions"](spark, "/root/testdata/sf0.001")
    assert "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_page_text_from_lists(spark):
    """Pages of one row need no shuffle of their words; pages in several rows, and those without a key, are put together."""
    from ledgerloom.operators import pages
    word = "array<struct<position int, word string, confidence double>>"
    lists = [(1, [(1, "b", 9.0), (0, "a", 5.0), (2, "x", 0.0)]), (2, [(1, "d", 1.0)]), (2, [(0, "c", 2.0)]), (2, []), (3, [(0, "z", -1.0)]),
             (4, None), (5, []), (None, [(1, "f", 3.0)]), (None, [(0, "e", 4.0)])]
    df = spark.createDataFrame(lists, f"id int, words {word}")
    got = {tuple(r) for r in pages.page_text_from_lists(df, ["id"]).collect()}
    assert got == {(1, "a b", 7.0), (2, "c d", 1.5), (3, "", 0.0), (None, "e f", 3.5)}
    assert got == {tuple(r) for r in pages.page_text_from_words(df.select("id", F.inline("words")), ["id"]).collect()}


def test_feed_is_parsed_once(spark):
    """The status of a feed looks at its rows three times; what it reads then is files of parsed rows."""
    import __spark_entry__ as entry
    status = entry.queries()["a1_a11_feed_file"](spark, "/root/testdata/sf0.001")
    assert "from_json" not in status._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_go_with_the_write(spark):
    """What a step shuffled is off the disks when its files are there, and the caller's setting is as before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p for p in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p and p.endswith(".data")}
    before = shuffles()
    rows = scale.written(spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert (rows.count(), rows.agg(F.sum("n")).first()[0]) == (7_000, 50_000)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key, None) in (None, "false")
