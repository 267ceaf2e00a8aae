"""Readers and writers on small files, and streams against their batch twins."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import canonical as cn
from ledgerloom.sources import readers as rd
from ledgerloom.sources import sinks as sk
from ledgerloom.streaming import events as ev

D = "/root/testdata/sf0.001"


def test_csv_keeps_bad_rows(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("policy_id,face_amount\n1,100.5\n2,oops\n3,300\n")
    schema = T.StructType([T.StructField("policy_id", T.LongType()), T.StructField("face_amount", T.DoubleType())])
    good, bad = rd.split_corrupt(rd.read_csv(spark, str(f), schema).cache())
    assert [r.policy_id for r in good.orderBy("policy_id").collect()] == [1, 3]
    assert bad.first()[0] == "2,oops"


@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_delimiter_is_found(spark, tmp_path, sep):
    f = tmp_path / "x.txt"
    f.write_text("\n".join(sep.join(r) for r in (["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"])))
    assert [r.delimiter for r in rd.find_delimiters(spark, str(f)).collect()] == [sep]
    assert rd.read_any_delimited(spark, str(f)).columns == ["a", "b", "c"]


def test_json_array_is_flattened(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text(json.dumps([{"policy_id": 1, "insured": {"age": 40, "home": {"state": "CA"}}}, {"policy_id": 2, "insured": {"age": 50, "home": {"state": "NY"}}}]))
    df = rd.read_json(spark, str(f))
    assert set(df.columns) == {"policy_id", "insured_age", "insured_home_state"}
    assert df.count() == 2


def test_fixed_width(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("ID   AGE FACE\nP001  35 100000\nP002  42 250000\n")
    got = rd.read_fixed_width(spark, str(f), [("id", 1, 4, "string"), ("age", 5, 4, "int"), ("face", 10, 7, "double")], skip=1).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("P001", 35, 100000.0), ("P002", 42, 250000.0)]


def test_row_numbers_follow_the_file_over_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 37)):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name}{i}" for i in range(n)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = rd.number_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5037
    assert all(r.line[1:] == str(r.row_idx) for r in rows)


def test_upsert_replaces_and_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows: spark.createDataFrame(rows, "submission_id string, k int, v int")
    sk.upsert(spark, path, mk([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]), ["submission_id", "k"], [F.desc("v")])
    sk.upsert(spark, path, mk([("a", 2, 9), ("a", 3, 1)]), ["submission_id", "k"], [F.desc("v")])
    got = sorted((r.submission_id, r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1, 1), ("a", 2, 9), ("a", 3, 1), ("b", 1, 1)]
    plan = rd.read_submission(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(submission_id" in plan


def test_upsert_moves_a_key_between_partitions(spark, tmp_path):
    path = str(tmp_path / "moved")
    mk = lambda rows: spark.createDataFrame(rows, "submission_id string, k int, v int")
    sk.upsert(spark, path, mk([("a", 1, 1), ("a", 2, 1), ("b", 3, 1), ("c d", 4, 1)]), ["k"], [F.desc("v")])
    sk.upsert(spark, path, mk([("b", 1, 9), ("a", 4, 9)]), ["k"], [F.desc("v")])
    got = sorted((r.submission_id, r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 2, 1), ("a", 4, 9), ("b", 1, 9), ("b", 3, 1)]


def test_no_folder_is_made_up_on_a_cluster():
    from types import SimpleNamespace

    from ledgerloom.session import shared_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_each_file_keeps_its_own_separator(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("title line\n" + "k;v\n" + "".join(f"{i};{i * 2}\n" for i in range(50)))
    (tmp_path / "x" / "b.txt").write_text("k|v\n1|2\n")
    found = {r.file_path.rsplit("/", 1)[1]: r.delimiter for r in rd.find_delimiters(spark, str(tmp_path / "x")).collect()}
    assert found == {"a.txt": ";", "b.txt": "|"}


def test_scan_reads_only_what_is_used(spark):
    df = cn.claims(spark, D).where("claim_amount > 1000").groupBy("treaty_id").agg(F.sum("claim_amount"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,1000.0)]" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan


def test_policies_without_state_need_no_join(spark):
    plan = cn.policies(spark, D).groupBy("product_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_stream_equals_batch_for_closed_days(spark):
    stream = ev.run_to_table(ev.daily_counts(ev.event_stream(spark, D)), "t-daily")
    batch = ev.daily_counts(cn.event_log(spark, D)).join(stream.select("window_start").distinct(), "window_start", "left_semi")
    key = lambda df: sorted((str(r.window_start), r.event_type, r.events, round(r.value, 6)) for r in df.collect())
    assert key(stream) == key(batch) and stream.count() > 0


def landed(spark, folder, batches):
    """One file per batch of (event_id, seconds, value), the first to come first."""
    for rows in batches:
        df = spark.createDataFrame([(i, None if at is None else at, v) for i, at, v in rows], "event_id long, at double, value double")
        ts = (F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).cast("timestamp_ntz")
        df.select("event_id", ts.alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), "value", F.lit('{"k": 1}').alias("props")).coalesce(1).write.mode("append").parquet(folder)
    return ev.event_stream(spark, folder, files_per_trigger=1, glob="*.parquet")


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    hour = 3600.0
    stream = landed(spark, str(tmp_path / "in"), [
        [(1, 10 * hour, 1.0), (2, 2 * hour, 2.0), (3, 12 * hour + 0.123456, 3.0)],  # nothing is settled yet
        [(4, 10.9 * hour, 4.0), (5, 11.1 * hour, 5.0), (6, None, 6.0), (7, 20 * hour, None)],  # settled: 11 o'clock and 0.123 s
        [(8, 18.9 * hour, 8.0), (9, 19 * hour, 9.0), (4, 10.9 * hour, 4.0)],  # settled: 19 o'clock; a copy of 4
    ])
    path = ev.run_batches(ev.with_lateness(stream), "t-late", ev.split_late)
    rows = spark.read.parquet(path)
    assert sorted((r.event_id, r.batch) for r in rows.where("late = 'true'").collect()) == [(4, 1), (4, 2), (8, 2)]
    assert sorted(r.event_id for r in rows.where("late = 'false'").collect()) == [1, 2, 3, 5, 6, 7, 9]
    assert {(r.batch, r.edge) for r in rows.select("batch", F.unix_millis("watermark").alias("edge")).collect()} == {(0, 0), (1, 11 * 3_600_000 + 123), (2, 19 * 3_600_000)}
    assert rows.where("event_id = 3").select(F.unix_micros("ts").alias("t")).first().t == 12 * 3_600_000_000 + 123_456


def test_history_holds_the_newest(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, float(rng.choice([rng.randrange(500), 77])), float(i)) for i in range(300)] + [(300, None, 0.5)]
    rng.shuffle(rows)
    stream = landed(spark, str(tmp_path / "in"), [rows[:10], rows[10:200], rows[200:]])
    path = ev.run_batches(ev.newest_events(stream, keep=25, buckets=4), "t-history", ev.write_history, mode="update")
    got = [r.event_id for r in ev.merged_history(spark, path, keep=25).collect()]
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]), reverse=True)[:25]
    assert got == [r[0] for r in want]
    assert spark.read.parquet(path).groupBy("batch", "bucket").count().agg(F.max("count")).first()[0] <= 25
    short = ev.run_batches(ev.newest_events(stream, keep=1000, buckets=4), "t-history", ev.write_history, mode="update")
    assert sorted(r.event_id for r in ev.merged_history(spark, short, keep=1000).collect()) == list(range(301))


def test_an_event_is_one_state_row_of_rolling_windows(spark):
    stream = ev.run_to_table(ev.rolling_sessions(ev.event_stream(spark, D)), "t-rolling")
    batch = ev.rolling_sessions(cn.event_log(spark, D)).join(stream.select("window_end").distinct(), "window_end", "left_semi")
    key = lambda df: sorted((str(r.window_end), r.sessions, round(r.average_value, 3), round(r.average_risk, 3), str(r.latest)) for r in df.collect())
    assert key(stream) == key(batch) and stream.count() > 600
    plan = ev.rolling_sessions(cn.event_log(spark, D))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # windows are spread out above the hourly sums
