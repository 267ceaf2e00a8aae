"""Landing zones: nothing is broadcast or shuffled with the unfolded columns, and the first of equal names counts."""

from pyspark.sql import functions as F

from ledgerloom.operators import integrate as ig
from ledgerloom.plans import load_queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_fields_need_no_join(spark):
    cols = spark.createDataFrame([("a", "Policy_ID"), ("a", "x"), ("b", None)], "file_id string, column_name string")
    found = ig.missing_fields(cols, {"L": ["policy_id", "premium"], "M": ["policy_id"]})
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "L", "premium"), ("b", "L", "policy_id"), ("b", "L", "premium"), ("b", "M", "policy_id")]


def test_jobs_per_file_shuffle_files_once(spark):
    jobs = load_queries()
    for name in ("detected_file_types", "mapped_columns"):
        assert plan(jobs[name](spark, FOLDER)).count("Exchange") == 1, name


def test_files_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(ig, "FILES_PER_TASK", 10)
    rows = spark.range(500).select(F.col("id").cast("string").alias("file_id"))
    assert ig.by_file(rows).rdd.getNumPartitions() == 50
