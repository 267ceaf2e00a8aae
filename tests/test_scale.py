"""The balanced joins, prefix sums, overlapping chunks and exact quantiles against plain results."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.clean import forward_fill
from ledgerloom.operators import quantiles
from ledgerloom.operators.quantiles import exact_quantiles, narrow
from ledgerloom.operators.skew import hot_keys, own_rows, running_totals, skew_join, with_neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some keys are NULL, some rows are copies."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), (F.col("id") % 97).alias("v")
    )


def test_hot_key_is_found(spark, skewed):
    hot = spark.range(1).select(hot_keys(skewed, ["k"], share=0.1, rows=100).alias("h")).first().h
    want = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint")).alias("x")).first().x
    assert list(hot) == [want] and 2000 <= hot[want] <= 2100


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, skewed, how):
    small = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).unionByName(
        spark.createDataFrame([(7, -1)], "k long, w long")
    )
    got = skew_join(skewed, small, "k", how, rows_per_salt=300, share=0.1, rows=100).toPandas()
    want = skewed.join(small, "k", how).toPandas()
    cols = sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_running_totals(spark):
    df = spark.range(5000).select((F.hash("id") % 1000).cast("double").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(df, "x", {"cum": "n"}, buckets=16).toPandas().sort_values("x")
    assert (got["cum"].values == got["n"].cumsum().values).all()


@pytest.mark.parametrize("chunk", [4, 7, 50, 100000])
def test_chunks_do_not_change_windows(spark, chunk):
    rows = spark.range(137).select((F.col("id") % 2).alias("f"), F.floor(F.col("id") / 2).alias("i"), F.hash("id").alias("v"))
    d, w = with_neighbours(rows, "f", "i", reach=5, chunk=chunk)
    got = own_rows(d.withColumn("s", F.sum("v").over(w.rowsBetween(-5, 5))).withColumn("l", F.lead("v", 4).over(w)), "i", chunk)
    p = Window.partitionBy("f").orderBy("i")
    want = rows.withColumn("s", F.sum("v").over(p.rowsBetween(-5, 5))).withColumn("l", F.lead("v", 4).over(p))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles_of_a_large_group(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"), (F.hash("id") % 5000 / 7.0).alias("x"))
    probs = {"p1": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    got = exact_quantiles(df, ["g"], "x", probs).toPandas().set_index("g")
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for n, p in probs.items():
            assert got.loc[g, n] == pytest.approx(np.quantile(part["x"], p), abs=1e-9)
    whole = exact_quantiles(df, [], "x", probs).first()
    for n, p in probs.items():
        assert whole[n] == pytest.approx(np.quantile(pdf["x"], p), abs=1e-9)


SHAPES = {
    "even": lambda i: F.hash("id").cast("double"),
    "tied": lambda i: F.when(F.col("id") % 4 > 0, F.lit(5.0)).otherwise(F.hash("id") / 1e6),
    "heavy tail": lambda i: F.exp((F.hash("id") % 700).cast("double")) * (1 + F.col("id") / 1e6),
    "one value": lambda i: F.lit(3.25),
    "edges": lambda i: F.when(F.col("id") % 3 == 0, F.lit(float("-inf"))).when(F.col("id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("id") / 7),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_no_task_sorts_more_than_the_budget(spark, shape, monkeypatch):
    """A third of 90,000 rows in one group, a budget of 64 values and 16 pieces: several rounds of narrowing."""
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("g"), SHAPES[shape](None).alias("x"))
    seen, rounds = [], []

    def watched(counted, keys, ps, budget, pieces=16):
        kept = narrow(counted, keys, ps, 64, 16)
        seen.append(kept.groupBy(*keys).count().agg(F.max("count")).first()[0])
        rounds.append(counted.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return kept

    monkeypatch.setattr(quantiles, "narrow", watched)
    probs = {"p1": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    got = exact_quantiles(df, ["g"], "x", probs).toPandas().set_index("g")
    assert max(seen) <= 64 and (shape == "one value" or max(rounds) > 64)
    for g, part in df.toPandas().groupby("g"):
        for n, p in probs.items():
            with np.errstate(invalid="ignore"):
                want = np.quantile(part["x"], p)
            if np.isfinite(want):
                assert got.loc[g, n] == pytest.approx(want, rel=1e-12, abs=1e-9)
        assert got.loc[g, "n_values"] == len(part)


def test_budget_that_pieces_cannot_reach(spark):
    with pytest.raises(ValueError, match="budget"):
        exact_quantiles(spark.range(5), [], "id", {"m": 0.5}, budget=10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.floats(0, 1))
def test_quantile_matches_numpy(spark, xs, p):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert exact_quantiles(df, [], "x", {"q": p}).first().q == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-6)


def test_forward_fill_over_chunk_edges(spark):
    df = spark.range(100).select("id", F.when((F.col("id") % 17 == 3), F.col("id")).alias("v"))
    got = forward_fill(df, "id", "v", chunk=5).orderBy("id").toPandas()["v"]
    want = df.orderBy("id").toPandas()["v"].ffill()
    pd.testing.assert_series_equal(got.astype("float"), want.astype("float"), check_names=False)
