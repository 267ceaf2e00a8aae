"""Hand-computed values and invariants of the insurance operators."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom import canonical as cn
from ledgerloom import refdata
from ledgerloom.operators import capital as cp
from ledgerloom.operators import clean as cl
from ledgerloom.operators import experience as ex
from ledgerloom.operators import integrate as ig
from ledgerloom.operators import ml
from ledgerloom.operators import portfolio as pf
from ledgerloom.operators import quality as ql
from ledgerloom.operators import reserves as rs
from ledgerloom.operators import series as sr
from ledgerloom.operators import treaty as ty

D = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_grid_mortality_interpolates_and_holds_ends(spark):
    g = {(r.age, r.gender, r.smoker_status): r.qx for r in refdata.grid_mortality(spark).collect()}
    assert len(g) == 484
    assert g[(35, "M", "Nonsmoker")] == 0.00102
    assert g[(37, "M", "Nonsmoker")] == pytest.approx(0.00102 + (0.00137 - 0.00102) * 2 / 5)
    assert g[(0, "F", "Smoker")] == 0.00108 and g[(120, "F", "Smoker")] == 0.72335


def test_survival_never_rises_and_life_expectancy_falls(spark):
    keys = ["gender", "smoker_status"]
    g = refdata.grid_mortality(spark)
    s = ex.survival_curve(g, keys).toPandas().sort_values([*keys, "age"])
    assert (s.groupby(keys)["survival"].diff().dropna() <= 1e-12).all()
    e = ex.life_expectancy(g, keys).toPandas().sort_values([*keys, "age"])
    assert (e[e.age < 100].groupby(keys)["life_expectancy"].diff().dropna() < 0).all()


def test_select_rates_lie_below_ultimate(spark):
    t = refdata.select_ultimate_table(spark)
    assert t.count() == 83 * 4 * 26
    ult = t.where("duration = 999").select("age", "sex", "smoking", F.col("qx").alias("u"))
    assert t.where("duration <= 25").join(ult, ["age", "sex", "smoking"]).where("qx > u").count() == 0


def test_life_table_identities(spark):
    t = rs.life_table(spark).toPandas()
    d = 0.035 / 1.035
    # A = 1 - d * annuity-due holds when everyone dies in the last year.
    assert (t["insurance"] - (1 - d * t["annuity_due"])).abs().max() < 1e-9


def test_closed_form_equals_yearly_sum(spark):
    age, face, i = 40, 100000.0, 0.035
    q = 0.01 + (age - 35) * 0.001
    want = sum(face * q * (1 - q) ** t * (1 + i) ** (-t - 0.5) for t in range(25))
    assert one(spark, rs.pv_benefits(F.lit(age), F.lit(face), F.lit(i))) == pytest.approx(want, rel=1e-12)
    want = sum(500 * 0.98**t * 0.95**t * 1.035**-t for t in range(25))
    assert one(spark, rs.pv_premiums(F.lit(age), F.lit(500.0), F.lit(i))) == pytest.approx(want, rel=1e-12)


def test_reserves_are_not_negative(spark):
    r = rs.prospective_reserves(cn.policies(spark, D), rs.life_table(spark))
    assert r.where("net_level_reserve < 0 OR modified_reserve < 0 OR surrender_value < 0").count() == 0
    assert rs.gaap_reserves(cn.policies(spark, D)).where("gaap_reserve < 0").count() == 0


def test_smoker_spellings(spark):
    rows = [("NON-SMOKER", "NON-SMOKER"), ("Nonsmoker", "NON-SMOKER"), ("N", "NON-SMOKER"), ("Smoker", "SMOKER"), ("Y", "SMOKER"), ("?", "UNKNOWN")]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("got", pf.smoking_word(F.col("raw")))
    assert df.where("got <> want").count() == 0


def test_currency_spellings(spark):
    rows = [("US$", "USD"), (" usd ", "USD"), ("U.S.D", "USD"), ("€", "EUR"), ("british pound", "GBP"), ("JP¥", "JPY"), ("CHF", "CHF")]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("got", cl.standard_currency(F.col("raw")))
    assert df.where("got <> want").collect() == []


def test_dates_day_first_and_serial(spark):
    rows = [("2023-01-15", "2023-01-15"), ("15/01/2023", "2023-01-15"), ("01/15/2023", "2023-01-15"), ("15-Jan-2023", "2023-01-15"), ("20230115", "2023-01-15"),
            ("15.01.2023", "2023-01-15"), ("44941", "2023-01-15"), ("2023/01/15", "2023-01-15"), ("03/04/2023", "2023-04-03"),
            ("15-JAN-23", "2023-01-15"), ("1/2/2023", "2023-02-01"), ("15-Jan-85", "1985-01-15")]
    df = spark.createDataFrame(rows, "raw string, want string").withColumn("got", cl.parse_date(F.col("raw")).cast("string"))
    assert df.where("got IS NULL OR got <> want").collect() == []
    assert one(spark, cl.parse_date(F.lit("n/a"))) is None
    assert one(spark, cl.ambiguous_date(F.lit("03/04/2023"))) and not one(spark, cl.ambiguous_date(F.lit("15/04/2023")))


def test_cleaning_twice_changes_nothing(spark):
    once = cl.clean_policies(cn.messy_policies(spark, D), cn.ASOF)
    cols = ["policy_id", "gender", "smoker_status", "policy_status", "product_type", "issue_age", "current_age", "issue_date"]
    a = once.select(*cols)
    b = cl.clean_policies(once, cn.ASOF).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_valid_and_broken_rows_make_the_table(spark):
    m = cl.standardise_categories(cn.messy_policies(spark, D))
    s = ql.validation_summary(m, ql.policy_rules(), ["gender", "face_amount"]).first()
    broken = ql.failed_rules(m, ql.policy_rules(), "error").where(F.size("failed") > 0).count()
    assert s.valid_rows + broken == s.rows


def test_cession(spark):
    t = spark.createDataFrame([(1, "quota_share", 0.0, 0.0, 0.4), (2, "excess_of_loss", 1000.0, 5000.0, 0.0)],
                              "treaty_id long, treaty_type string, retention double, limit_amount double, retention_rate double")
    c = spark.createDataFrame([(1, 10000.0), (1, 1500.0), (2, 900.0), (2, 3000.0), (2, 9000.0)], "treaty_id long, claim_amount double")
    got = sorted((r.treaty_id, r.claim_amount, r.reinsurance_amount) for r in ty.cede_claims(c, t).collect())
    assert got == [(1, 10000.0, 6000.0), (2, 3000.0, 2000.0), (2, 9000.0, 5000.0)]  # 1500·.6 = 900 is not material


def test_action_levels(spark):
    rows = [(2.0, "No Action"), (1.6, "Company Action Level"), (1.0, "Regulatory Action Level"), (0.7, "Authorized Control Level"), (0.1, "Mandatory Control Level")]
    df = spark.createDataFrame(rows, "r double, want string").withColumn("got", cp.action_level(F.col("r")))
    assert df.where("got <> want").count() == 0


def test_unknown_rating_takes_ten_percent(spark):
    h = spark.createDataFrame([("c", "AAA", 1000.0), ("c", "zzz", 100.0)], "company string, rating string, amount double")
    assert cp.asset_charge(h, ["company"]).first().c1 == pytest.approx(3.0 + 10.0)


def test_weighted_recent_both_ways(spark):
    y = spark.createDataFrame([(1, 2020, 0.5), (1, 2021, 0.6), (1, 2022, 0.8)], "cedent_id long, year int, loss_ratio double")
    assert ex.weighted_recent(y).first().weighted_loss_ratio == pytest.approx(0.5 * 0.8 + 0.3 * 0.6 + 0.2 * 0.5)
    assert ex.weighted_recent(y, newest_first=False).first().weighted_loss_ratio == pytest.approx(0.5 * 0.5 + 0.3 * 0.6 + 0.2 * 0.8)


def test_file_types(spark):
    cols = {"t": ["treaty_id", "treaty_name", "treaty_type", "inception_date", "premium", "limit"], "c": ["claim_id", "treaty_id", "loss_date", "claim_amount"], "m": ["date", "gdp_growth", "vix_index"]}
    rows = [(f, i, n, "string") for f, ns in cols.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "file_id string, position int, column_name string, data_type string")
    got = {r.file_id: r.file_type for r in ig.detect_file_types(df).collect()}
    assert got == {"t": "treaty_master", "c": "claims_history", "m": "market_data"}


def test_relationship_kinds(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    r = ig.relationships({"a": (a, ["id"]), "b": (b, ["id"])}, []).first()
    assert (r.common_values, r.relationship) == (2, "one-to-many")


def test_as_of_takes_the_last_state(spark):
    rows = spark.createDataFrame([("2020-01-01",), ("2020-02-15",), ("2021-01-01",), ("2019-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    st = spark.createDataFrame([("2020-01-01", 1.0), ("2020-02-15", 2.0), ("2020-03-01", 3.0)], "d string, v double").select(F.col("d").cast("date").alias("d"), "v")
    got = {str(r.d): r.v for r in sr.as_of_join(rows, st, [], "d", ["v"]).collect()}
    assert got == {"2020-01-01": 1.0, "2020-02-15": 2.0, "2021-01-01": 3.0, "2019-01-01": None}


def test_balanced_share(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100 == 0).cast("int").alias("y"))
    out = ml.balance(df, "y", "id", 0.15)
    n, p = out.count(), out.where("y = 1").count()
    assert p == 200 and abs(p / n - 0.15) < 0.02


def test_auc_agrees_with_the_library(spark):
    from ledgerloom.operators import metrics as mt

    df = spark.range(3000).select((F.hash("id") % 2 == 0).cast("int").alias("y"), (F.abs(F.hash(F.col("id") + 1)) % 50 / 50.0).alias("s"))
    df = df.withColumn("s", F.col("s") + F.col("y") * 0.2)
    assert mt.auc(df, "y", "s").first().auc == pytest.approx(ml.area_under_curve(df.withColumn("y", F.col("y").cast("double")), "y", "s"), abs=1e-6)


def test_monthly_lapse_compounds_to_the_year(spark):
    assert one(spark, rs.cumulative_lapse(F.lit(0.12), 12)) == pytest.approx(0.12)
    assert one(spark, rs.monthly_from_annual(F.lit(0.12))) == pytest.approx(1 - 0.88 ** (1 / 12))


def test_lognormal_tail_uses_the_normal_quantile():
    assert 0.5 * (1 + math.erf(ty.Z_995 / math.sqrt(2))) == pytest.approx(0.995)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_keyed_as_of_join_equals_brute_force(spark, parts):
    """Many cuts, a key with most rows, a key whose states end early, keys without states or rows, NULLs and equal times."""
    import random


    rng = random.Random(parts)
    pick = lambda: rng.choice(["hot"] * 6 + ["early", "late", "none", None])
    rows = [(i, pick(), rng.choice([None, *range(100)])) for i in range(600)] + [(600, "hot", 50), (601, "hot", 50)]
    states = [("hot", 30, 1.0, "a"), ("hot", 30, 2.0, "b"), ("hot", 90, 3.0, "c"), ("early", 2, 4.0, "d"), ("early", 5, None, "e"), ("late", 95, 5.0, "f"), ("other", 1, 6.0, "g"), (None, 1, 7.0, "h"), ("hot", None, 8.0, "i")]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "id int, k string, t int").withColumn("_keep", F.lit("x"))
        got = {r.id: (r.v, r.n) for r in sr.as_of_join(df, spark.createDataFrame(states, "k string, t int, v double, n string"), ["k"], "t", ["v", "n"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    for i, k, t in rows:
        found = [(s[1], s[2] is not None, s[2], s[3]) for s in states if None not in (k, t, s[1]) and s[0] == k and s[1] <= t]
        assert got[i] == (max(found)[2:] if found else (None, None))


def test_keyed_as_of_join_without_rows_or_states(spark):
    rows, states = spark.createDataFrame([("a", 1)], "k string, t int"), spark.createDataFrame([("a", 1, 2.0)], "k string, t int, v double")
    assert sr.as_of_join(rows, states.limit(0), ["k"], "t", ["v"]).collect()[0].v is None
    assert sr.as_of_join(rows.limit(0), states, ["k"], "t", ["v"]).count() == 0


def test_forecasts_beat_the_last_value_and_find_the_pull(spark):
    """Two hundred series that fall back to their mean: every slope is near minus one; a random walk has no skill to speak of."""
    import numpy as np

    rng = np.random.default_rng(5)
    noise = {f"r{i}": rng.normal(3, 1, 120) for i in range(100)} | {f"e{i}": np.exp(rng.normal(0, 0.1, 120)) for i in range(100)}
    series = noise | {"walk": np.cumsum(rng.normal(0, 1, 4000)) + 500, "short": np.ones(12), "flat": np.full(60, 2.0), "gone": -np.ones(80)}
    rows = [(n, "equity" if n[0] in "eg" else "rate", i, float(v)) for n, xs in series.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "series string, kind string, date int, value double")
    got = {r.series: r for r in ml.reverting_forecasts(df).collect()}
    assert np.mean([got[n].skill for n in noise]) > 0.2 and np.mean([got[n].slope for n in noise]) == pytest.approx(-1, abs=0.1)
    assert sum(got[n].skill > 0 for n in noise) > 190
    assert abs(got["walk"].skill) < 0.05 and got["flat"].rmse == 0 and got["flat"].skill is None
    assert "short" not in got and "gone" not in got
    x = noise["r7"]
    gap, move = np.array([x[i] - x[i - 9:i + 1].mean() for i in range(9, 115)]), np.array([x[i + 5] - x[i] for i in range(9, 115)])
    cut = int(len(gap) * 0.8)
    b, a = np.polyfit(gap[:cut], move[:cut], 1)
    e = a + b * gap[cut:] - move[cut:]
    assert (got["r7"].slope, got["r7"].rmse, got["r7"].mae) == pytest.approx((b, np.sqrt((e**2).mean()), np.abs(e).mean()))
    assert (got["r7"].train_rows, got["r7"].test_rows) == (cut, len(gap) - cut)


@pytest.mark.parametrize("strength", [10.0, 50.0, 60.0, 75.0, 100.0])
def test_overlap_by_class_equals_all_pairs_of_files(spark, strength):
    import random
    from collections import Counter

    rng = random.Random(int(strength))
    files = {f"f{i:03d}": {"Policy_ID" if rng.random() < 0.5 else "policy_id", *rng.sample("abcdefgh", rng.randint(0, 5))} for i in range(70)}
    columns = spark.createDataFrame([(f, c) for f, cs in files.items() for c in cs] + [("f000", next(iter(files["f000"])))], "file_id string, column_name string")
    folded = {f: frozenset(c.lower() for c in cs) for f, cs in files.items()}
    label = {s: min(f for f, t in folded.items() if t == s) for s in folded.values()}
    assert {r.file_id: r.class_id for r in ig.class_members(columns).collect()} == {f: label[s] for f, s in folded.items()}
    want, share = Counter(), {}
    for f, a in folded.items():
        for g, b in folded.items():
            if f < g and 100 * len(a & b) >= strength * min(len(a), len(b)):
                k = tuple(sorted((label[a], label[b])))
                want[k] += 1
                share[k] = (len(a & b), len(a & b) / min(len(a), len(b)) * 100)
    got = {(r.class1, r.class2): (r.file_pairs, r.common_columns, r.strength) for r in ig.overlap_by_class(columns, strength).collect()}
    assert got == {k: (n, share[k][0], pytest.approx(share[k][1])) for k, n in want.items()}


def test_a_common_column_does_not_square_the_files(spark):
    """Two thousand files that share one column and nothing else make no candidate pairs."""
    from ledgerloom.operators import integrate

    rows = spark.range(2000).selectExpr("concat('f', id) AS file_id", "explode(array('policy_id', concat('a', id), concat('b', id), concat('c', id))) AS column_name")
    pairs, keep = [], integrate.cut_lineage
    try:
        integrate.cut_lineage = lambda df, label="stage": pairs.append((label, out := keep(df, label))) or out
        assert ig.overlap_by_class(rows).count() == 0
    finally:
        integrate.cut_lineage = keep
    assert dict(pairs)["column-pairs"].count() == 0
