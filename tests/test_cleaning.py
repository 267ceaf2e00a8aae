"""The whole cleaning on small landed tables: rows, log and scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import clean as cl
from ledgerloom.operators import schemas as sc
from ledgerloom.operators.cleaning import clean_dataset

LANDED = "row_idx long, policy_id long, gender string, face_amount string, premium string, issue_age int, current_age int, issue_date string, note string"
ROWS = [
    (1, 10, " male ", "$1,000.00", "10.004", 40, 45, "2001-02-03", "a"),
    (2, 10, "M", "2000", "20", 40, 45, "2001-02-03", "a"),  # the same policy and date, later in the file
    (3, 11, None, "-3000", "n/a", 50, 40, "03/02/2001", None),
    (4, 12, "X", None, "30", None, 130, "soon", " b"),
    (5, 13, "f", "4000", "1", -1, 60, "2101-05-06", "a"),
]


def cleaned(spark, rows=ROWS, schema=LANDED, **kw):
    return clean_dataset(spark.createDataFrame(rows, schema), ["policy_id", "issue_date"], "row_idx", "2002-01-01", **kw)


def test_rows_log_and_scores(spark):
    out = cleaned(spark)
    rows = {r.row_idx: r for r in out.rows.collect()}
    assert sorted(rows) == [2, 3, 4, 5]
    assert [rows[i].issue_date for i in (2, 3, 4, 5)] == [dt.date(2001, 2, 3), dt.date(2001, 2, 3), dt.date(2001, 2, 3), dt.date(2001, 5, 6)]
    assert [rows[i].face_amount for i in (2, 3, 4, 5)] == [2000.0, 3000.0, 3000.0, 4000.0]  # the median of 2, 3 and 4 thousand
    assert [rows[i].premium for i in (2, 3, 4, 5)] == [20.0, 20.0, 30.0, 1.0]
    assert [rows[i].issue_age for i in (2, 3, 4, 5)] == [40, 50, 29, 0] and [rows[i].current_age for i in (2, 3, 4, 5)] == [45, 50, 120, 60]
    assert rows[3].note == "a" and rows[4].note == "b"
    log = {(r.action, r.column_name): r.cells for r in out.actions.collect()}
    assert log["drop_duplicates", None] == 1
    assert (log["type", "face_amount"], log["type", "premium"], log["type", "issue_date"]) == (4, 4, 4)
    assert (log["unreadable", "premium"], log["unreadable", "issue_date"], log["unreadable", "face_amount"]) == (1, 1, 0)
    assert (log["trim", "gender"], log["trim", "note"], log["repair_date", "issue_date"]) == (1, 1, 1)
    assert (log["normalise_amount", "face_amount"], log["normalise_amount", "premium"]) == (1, 1)
    assert (log["fill_median", "face_amount"], log["fill_median", "premium"], log["fill_mean", "issue_age"], log["fill_mode", "note"], log["fill_forward", "issue_date"]) == (1, 1, 1, 1, 1)
    assert (log["rule", "issue_age"], log["rule", "current_age"]) == (1, 2)
    score = {r.stage: r for r in out.quality.collect()}
    assert score["before"].rows == 5 and score["before"].completeness == pytest.approx(1 - 4 / 40)
    assert score["before"].consistency == pytest.approx((1 - 1 / 5) * (1 - 1 / 5))
    assert (score["after"].rows, score["after"].completeness, score["after"].consistency, score["after"].quality_score) == (4, 1.0, 1.0, pytest.approx(100.0))


def test_no_rows(spark):
    out = cleaned(spark, [])
    assert out.rows.count() == 0 and out.actions.agg({"cells": "sum"}).first()[0] == 0
    assert [r.quality_score for r in out.quality.collect()] == [None, None]


def test_all_missing_and_other_columns(spark):
    """No known column but the keys; nothing to fill a column with leaves it as it is."""
    out = cleaned(spark, [(1, 7, None, None), (2, 7, None, None), (3, None, None, 2.0)], "row_idx long, policy_id long, issue_date string, `rate` double")
    assert sorted((r.row_idx, r.policy_id, r.issue_date, r["rate"]) for r in out.rows.collect()) == [(2, 7, None, 2.0), (3, 7, None, 2.0)]


def test_fill_is_over_the_whole_order(spark):
    """Dates are filled over more rows than one range of the fill, and every count is taken once."""
    rows = [(i * 60_000, i, "M", "1", "1", 1, 1, "2001-02-03" if i == 0 else None, "n") for i in range(40)]
    out = cleaned(spark, rows)
    assert {r.issue_date for r in out.rows.collect()} == {dt.date(2001, 2, 3)}
    log = {(r.action, r.column_name): r.cells for r in out.actions.collect()}
    assert log["fill_forward", "issue_date"] == 39 and log["fill_mode", "gender"] == 0


# --- declared schemas

@pytest.mark.parametrize("actual,declared,level", [
    ("Float", "Float", None), ("Int", "Float", "INFO"), ("Int", "Decimal", "INFO"), ("Float", "Int", "WARNING"), ("Decimal", "Float", "WARNING"), ("String", "Float", "WARNING"),
    ("Date", "String", "WARNING"), ("Int", "String", "WARNING"), ("Boolean", "Int", "WARNING"), ("array<int>", "Float", "WARNING"),
])
def test_types_against_the_lattice(actual, declared, level):
    assert sc.type_level(actual, declared) == level


def test_lattice_has_no_cycle():
    for t in sc.WIDER:
        assert sc.steps_up(t, t) == 0 and sc.steps_up(t, "String") > 0 and sc.steps_up("String", t) is None


def test_findings_of_a_treaty_file(spark):
    rows = [(i, None if i < 21 else 5, "x", None if i < 81 else 1.0, None if i < 80 else 1.0, None if i < 51 else "y", None if i < 20 else "z") for i in range(100)]
    df = spark.createDataFrame(rows, "treaty_id long, premium int, loss_ratio string, cession_rate double, aggregate_limit double, `a.b` string, note string")
    got = {(r.check, r.column_name): (r.level, r.declared, r.actual, r.affected_rows, r.missing_pct) for r in sc.schema_findings(df, "treaty").collect()}
    assert got == {
        ("type", "premium"): ("INFO", "Float", "Int", 0, None), ("type", "loss_ratio"): ("WARNING", "Float", "String", 0, None),
        ("missing", "premium"): ("WARNING", None, None, 21, 21.0), ("missing", "cession_rate"): ("WARNING", None, None, 81, 81.0), ("missing", "a.b"): ("CRITICAL", None, None, 51, 51.0),
    }
    # The same column is judged by the usual bands in a file of another kind.
    other = {(r.check, r.column_name): r.level for r in sc.schema_findings(df, "claims").collect()}
    assert other["missing", "aggregate_limit"] == "CRITICAL" and other["required", "gross_claim_amount"] == "CRITICAL"


def test_findings_of_no_rows(spark):
    df = spark.createDataFrame([], "event_id long, industry_loss date")
    assert [(r.check, r.level, r.actual) for r in sc.schema_findings(df, "catastrophe").collect()] == [("type", "WARNING", "Date")]


def test_generated_code_of_typing_stays_compilable(spark):
    """The JVM never compiles methods of more than 8,000 bytes; the date formats made one."""
    from ledgerloom.plans import quality

    landed = quality._landed(spark, "/root/testdata/sf0.001")
    df = cl.coerce_types(landed, [f.name for f in landed.schema.fields if f.dataType.typeName() == "string"])
    parts = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    assert 0 < max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000


@pytest.mark.parametrize("text,day", [
    (" 2001-2-3 ", (2001, 2, 3)), ("03/02/2001", (2001, 2, 3)), ("12/31/2001", (2001, 12, 31)), ("3-Feb-2001", (2001, 2, 3)), ("03-Feb-75", (1975, 2, 3)), ("20010203", (2001, 2, 3)),
    ("3.2.2001", (2001, 2, 3)), ("12-31-2001", (2001, 12, 31)), ("2001/2/3", (2001, 2, 3)), ("36925.5", (2001, 2, 3)), ("soon", None), (None, None),
])
def test_dates_of_all_formats(spark, text, day):
    got = spark.createDataFrame([(text,)], "issue_date string").select(cl.parse_date(F.col("issue_date")).alias("d")).first().d
    assert got == (day and dt.date(*day))
