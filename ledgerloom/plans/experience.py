"""Experience studies and portfolio metrics over the policy and claim views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import canonical as cn
from .. import refdata
from ..operators import experience as ex
from ..operators import portfolio as pf
from ..operators.quantiles import exact_quantiles
from ..operators.skew import running_totals, skew_join
from .duck import duck
from .registry import query

# --- mortality tables as SQL --------------------------------------------------

_grid = ", ".join(
    f"({a}, '{g}', '{s}', {q}::DOUBLE)" for (g, s), qs in refdata.GRID_RATES.items() for a, q in zip(refdata.GRID_AGES, qs)
)
GRID = f"""SELECT r.range::INT AS age, lo.gender, lo.smoker_status,
  CASE WHEN r.range <= 20 OR r.range >= 100 THEN lo.rate
       ELSE lo.rate + (hi.rate - lo.rate) * ((r.range - lo.grid_age) / 5.0::DOUBLE) END AS qx
  FROM range(0, 121) r
  JOIN (VALUES {_grid}) lo(grid_age, gender, smoker_status, rate)
    ON lo.grid_age = least(100, greatest(20, (r.range // 5) * 5))
  JOIN (VALUES {_grid}) hi(grid_age, gender, smoker_status, rate)
    ON hi.grid_age = least(100, lo.grid_age + 5) AND hi.gender = lo.gender AND hi.smoker_status = lo.smoker_status"""
_a = "CASE WHEN gender='F' THEN (CASE WHEN smoker_status='Smoker' THEN 0.00015::DOUBLE ELSE 0.0001::DOUBLE END) ELSE (CASE WHEN smoker_status='Smoker' THEN 0.0002::DOUBLE ELSE 0.00015::DOUBLE END) END"
_b = "CASE WHEN gender='F' THEN (CASE WHEN smoker_status='Smoker' THEN 0.095::DOUBLE ELSE 0.085::DOUBLE END) ELSE (CASE WHEN smoker_status='Smoker' THEN 0.10::DOUBLE ELSE 0.09::DOUBLE END) END"
# Ages above the table use the law with no selection factor.
SELECT_QX = f"""least(0.8::DOUBLE, greatest(0.0001::DOUBLE, ({_a}) * exp(({_b}) * (attained_age - 20))))
  * CASE WHEN policy_duration <= 25 AND attained_age <= 100 THEN greatest(0.3::DOUBLE, 1 - 0.8::DOUBLE * exp(-0.2::DOUBLE * policy_duration)) ELSE 1.0::DOUBLE END"""
RATED = f"SELECT *, {SELECT_QX} AS qx FROM policies"
GRIDDED = "SELECT p.*, g.qx FROM policies p JOIN grid g ON g.age = least(attained_age, 120) AND g.gender = p.gender AND g.smoker_status = p.smoker_status"


def _ae(by: str) -> str:
    return f"""SELECT *, least(1.0::DOUBLE, sqrt(actual_deaths / 1082.0::DOUBLE)) AS credibility_factor,
      actual_deaths / expected_deaths AS ae_ratio,
      actual_deaths >= 10 AND (actual_deaths - expected_deaths)**2 / expected_deaths > 3.84 AS significant,
      least(1.0::DOUBLE, sqrt(actual_deaths / 1082.0::DOUBLE)) * actual_deaths / expected_deaths
        + 1 - least(1.0::DOUBLE, sqrt(actual_deaths / 1082.0::DOUBLE)) AS rating_factor
      FROM (SELECT {by} count(*) AS policies, sum(qx) AS expected_deaths, CAST(sum(death_indicator) AS BIGINT) AS actual_deaths,
      sum(face_amount) AS total_face_amount FROM rated GROUP BY ALL)"""


AE_ROUND = dict(r2="total_face_amount", r6="expected_deaths credibility_factor ae_ratio rating_factor")


@query("A5 J10 R1", duck("policies", _ae(""), rated=RATED), **AE_ROUND)
def ae_study_overall(spark, d):
    return ex.actual_to_expected(ex.with_select_qx(cn.policies(spark, d)), [])


@query("A5 A45 J10", duck("policies", _ae("gender, smoker_status,"), rated=RATED), **AE_ROUND)
def ae_study_by_sex_smoker(spark, d):
    return ex.actual_to_expected(ex.with_select_qx(cn.policies(spark, d)), ["gender", "smoker_status"])


@query(
    "A6 J9",
    duck(
        "policies claims",
        """SELECT gender, smoker_status, product_type, count(*) AS policies, sum(duration_years) AS exposure_years,
        CAST(sum(coalesce(n,0)) AS BIGINT) AS actual_claims, sum(coalesce(amt,0)) AS claim_amount, sum(qx * duration_years) AS expected_count,
        sum(face_amount * qx * duration_years) AS expected_amount,
        sum(coalesce(n,0)) / sum(qx * duration_years) AS ae_count, sum(coalesce(amt,0)) / sum(face_amount * qx * duration_years) AS ae_amount,
        sum(coalesce(amt,0)) / sum(coalesce(n,0)) AS claim_severity
        FROM gridded LEFT JOIN c USING (policy_id) GROUP BY ALL""",
        grid=GRID, gridded=GRIDDED,
        c="SELECT policy_id, count(*) AS n, sum(claim_amount) AS amt FROM claims GROUP BY 1",
    ),
    r2="exposure_years claim_amount expected_count expected_amount claim_severity", r4="ae_count ae_amount",
)
def claim_experience_by_segment(spark, d):
    per_policy = cn.claims(spark, d).groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("claim_amount").alias("amt")
    )
    rows = ex.with_grid_qx(cn.policies(spark, d)).join(per_policy, "policy_id", "left")  # one row per policy on both sides
    n, amt, exp_n = F.sum(F.coalesce("n", F.lit(0))), F.sum(F.coalesce("amt", F.lit(0.0))), F.col("qx") * F.col("duration_years")
    out = rows.groupBy("gender", "smoker_status", "product_type").agg(
        F.count(F.lit(1)).alias("policies"),
        F.sum("duration_years").alias("exposure_years"),
        n.alias("actual_claims"),
        amt.alias("claim_amount"),
        F.sum(exp_n).alias("expected_count"),
        F.sum(F.col("face_amount") * exp_n).alias("expected_amount"),
    )
    return out.withColumns(
        {
            "ae_count": F.try_divide("actual_claims", "expected_count"),
            "ae_amount": F.try_divide("claim_amount", "expected_amount"),
            "claim_severity": F.try_divide("claim_amount", "actual_claims"),
        }
    )


@query(
    "J9",
    duck("policies claims", """SELECT cause, count(*) AS claims, sum(claim_amount) AS claim_amount FROM claims
      WHERE policy_id IN (SELECT policy_id FROM policies WHERE product_type = 'Term' AND smoker_status = 'Smoker') GROUP BY 1"""),
    r2="claim_amount",
)
def claims_in_segment(spark, d):
    segment = cn.policies(spark, d).where("product_type = 'Term' AND smoker_status = 'Smoker'").select("policy_id")
    return skew_join(cn.claims(spark, d), segment, "policy_id", "left_semi").groupBy("cause").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").alias("claim_amount")
    )


@query(
    "A7",
    duck("policies", """SELECT gender, smoker_status, count(*) AS policies, avg(issue_age) AS avg_age, avg(qx) AS expected_mortality,
      avg(death_indicator) AS actual_mortality, avg(death_indicator) / avg(qx) AS ae_ratio, sum(face_amount) AS total_face_amount
      FROM gridded GROUP BY ALL HAVING count(*) >= 10""", grid=GRID, gridded=GRIDDED),
    r2="total_face_amount", r6="avg_age expected_mortality actual_mortality ae_ratio",
)
def ae_credible_segments(spark, d):
    rows = ex.with_grid_qx(cn.policies(spark, d)).groupBy("gender", "smoker_status").agg(
        F.count(F.lit(1)).alias("policies"),
        F.avg("issue_age").alias("avg_age"),
        F.avg("qx").alias("expected_mortality"),
        F.avg("death_indicator").alias("actual_mortality"),
        F.sum("face_amount").alias("total_face_amount"),
    )
    return rows.where("policies >= 10").withColumn("ae_ratio", F.try_divide("actual_mortality", "expected_mortality"))


@query(
    "A8",
    duck("policies", """SELECT product_type, CAST(y AS INT) AS policy_year, count(*) AS policies_at_risk, CAST(sum(l) AS BIGINT) AS lapses, sum(l) / count(*) AS lapse_rate FROM (
      SELECT product_type, floor(duration_years) AS y, CAST(policy_status IN ('Lapsed','Surrendered') AS INT) AS l FROM policies
      WHERE floor(duration_years) BETWEEN 1 AND 15
      UNION ALL SELECT product_type, 0, CAST(policy_status IN ('Lapsed','Surrendered') AS INT) FROM policies) GROUP BY ALL"""),
    r6="lapse_rate",
)
def lapse_rate_by_policy_year(spark, d):
    return ex.lapse_rates(cn.policies(spark, d))


@query("A9", duck("policies", "SELECT CAST(year(issue_date) AS INT) AS issue_year, count(*) AS policies, sum(face_amount) AS face_amount FROM policies GROUP BY 1"), r2="face_amount")
def policies_issued_per_year(spark, d):
    return cn.policies(spark, d).groupBy(F.year("issue_date").alias("issue_year")).agg(
        F.count(F.lit(1)).alias("policies"), F.sum("face_amount").alias("face_amount")
    )


_improved = """SELECT *, power(1 + CASE WHEN attained_age <= 120 THEN (CASE WHEN attained_age < 30 THEN -0.02::DOUBLE WHEN attained_age < 65 THEN -0.015::DOUBLE
    WHEN attained_age < 85 THEN -0.01::DOUBLE ELSE -0.005::DOUBLE END) * CASE WHEN gender='F' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
    ELSE -0.01::DOUBLE END, policy_duration) AS f FROM rated"""


@query(
    "J12 R2 R3 R8",
    duck("policies", """SELECT attained_age, gender, avg(f) AS improvement_factor, avg(greatest(0.0001, least(0.5, qx * f * 1.1::DOUBLE))) AS adjusted_qx,
      count(*) AS policies FROM improved GROUP BY ALL""", rated=RATED, improved=_improved),
    r6="improvement_factor adjusted_qx",
)
def improved_mortality_by_age(spark, d):
    rows = ex.with_improvement(ex.with_select_qx(cn.policies(spark, d)), F.col("policy_duration"))
    q = ex.adjusted_qx(F.col("qx"), F.col("improvement_factor"), F.lit(1.1))
    return rows.groupBy("attained_age", "gender").agg(
        F.avg("improvement_factor").alias("improvement_factor"), F.avg(q).alias("adjusted_qx"), F.count(F.lit(1)).alias("policies")
    )


@query(
    "J11",
    duck("policies", """SELECT attained_age, gender, smoker_status, count(*) AS policies, avg(qx) AS qx, sum(qx * face_amount) AS expected_claims
      FROM gridded GROUP BY ALL""", grid=GRID, gridded=GRIDDED),
    r2="expected_claims", r6="qx",
)
def interpolated_mortality_by_age(spark, d):
    return ex.with_grid_qx(cn.policies(spark, d)).groupBy("attained_age", "gender", "smoker_status").agg(
        F.count(F.lit(1)).alias("policies"), F.avg("qx").alias("qx"), F.sum(F.col("qx") * F.col("face_amount")).alias("expected_claims")
    )


_curve = """SELECT *, exp(coalesce(sum(ln(1 - qx)) OVER (PARTITION BY gender, smoker_status ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS survival FROM grid"""


@query(
    "W17",
    duck("policies", """SELECT p.gender, p.smoker_status, p.issue_age, count(*) AS policies, avg(c65.survival / c.survival) AS survival_to_65
      FROM policies p JOIN curve c ON c.age = p.issue_age AND c.gender = p.gender AND c.smoker_status = p.smoker_status
      JOIN curve c65 ON c65.age = 65 AND c65.gender = p.gender AND c65.smoker_status = p.smoker_status
      WHERE p.issue_age < 65 GROUP BY ALL""", grid=GRID, curve=_curve),
    r6="survival_to_65",
)
def survival_to_65(spark, d):
    keys = ["gender", "smoker_status"]
    curve = ex.survival_curve(refdata.grid_mortality(spark), keys)
    at65 = curve.where("age = 65").select(*keys, F.col("survival").alias("s65"))
    odds = curve.join(at65, keys).select(*keys, F.col("age").alias("issue_age"), (F.col("s65") / F.col("survival")).alias("p"))
    return (
        cn.policies(spark, d).where("issue_age < 65")
        .join(F.broadcast(odds), [*keys, "issue_age"])  # 484 rows
        .groupBy(*keys, "issue_age").agg(F.count(F.lit(1)).alias("policies"), F.avg("p").alias("survival_to_65"))
    )


@query(
    "W18",
    duck("policies", """SELECT p.gender, p.smoker_status, p.attained_age, count(*) AS policies, any_value(e.life_expectancy) AS life_expectancy FROM policies p
      JOIN (SELECT a.age, a.gender, a.smoker_status, coalesce(sum(CASE WHEN b.survival * (1 - b.qx) / a.survival > 0.001 THEN b.survival * (1 - b.qx) / a.survival END), 0) AS life_expectancy
            FROM curve a JOIN curve b ON a.gender = b.gender AND a.smoker_status = b.smoker_status AND b.age >= a.age GROUP BY ALL) e
      ON e.age = least(p.attained_age, 120) AND e.gender = p.gender AND e.smoker_status = p.smoker_status GROUP BY ALL""", grid=GRID, curve=_curve),
    r6="life_expectancy",
)
def life_expectancy_of_portfolio(spark, d):
    keys = ["gender", "smoker_status"]
    e = ex.life_expectancy(refdata.grid_mortality(spark), keys).withColumnRenamed("age", "_age")
    rows = cn.policies(spark, d).groupBy(*keys, "attained_age").agg(F.count(F.lit(1)).alias("policies"))
    return rows.withColumn("_age", F.least("attained_age", F.lit(120))).join(F.broadcast(e), [*keys, "_age"]).drop("_age")


# --- portfolio ---------------------------------------------------------------

_dur = ", ".join(
    f"count(*) FILTER (policy_duration > {lo}" + (f" AND policy_duration <= {hi}" if hi else "") + f") AS duration_{n}"
    for lo, hi, n in pf.DURATION_BUCKETS
)


@query(
    "A3 P11",
    duck("policies", f"""SELECT count(*) AS total_policies, sum(face_amount) AS total_exposure, avg(face_amount) AS mean_face,
      stddev_samp(face_amount) AS sd_face, avg(issue_age) AS mean_age, stddev_pop(issue_age) AS sd_age, min(issue_age) AS min_age, max(issue_age) AS max_age,
      count(*) FILTER (gender = 'M') AS male, count(*) FILTER (gender = 'F') AS female,
      count(*) FILTER (smoker_status = 'Smoker') AS smoker, count(*) FILTER (smoker_status = 'Nonsmoker') AS non_smoker, {_dur},
      quantile_cont(face_amount, 0.5) AS median_face, quantile_cont(face_amount, 0.25) AS p25_face, quantile_cont(face_amount, 0.75) AS p75_face,
      quantile_cont(face_amount, 0.9) AS p90_face, quantile_cont(issue_age, 0.5) AS median_age FROM policies"""),
    r2="total_exposure", r4="mean_face sd_face median_face p25_face p75_face p90_face", r6="mean_age sd_age median_age",
)
def portfolio_metrics(spark, d):
    return pf.portfolio_metrics(cn.policies(spark, d))


_summary = """SELECT submission_id, count(*) AS policy_count, sum(face_amount) AS total_inforce, avg(face_amount) AS avg_face_amount,
  avg(issue_age) AS avg_issue_age, avg(CAST(gender='M' AS INT)) AS male_percentage, avg(CAST(smoker_status='Smoker' AS INT)) AS smoker_percentage,
  avg(CAST(policy_status='Inforce' AS INT)) AS inforce_percentage, any_value(ts) AS top_state_concentration, any_value(tp) AS top_product_share
  FROM policies_state
  JOIN (SELECT submission_id, max(n) / sum(n) AS ts FROM (SELECT submission_id, state, count(*) AS n FROM policies_state GROUP BY ALL) GROUP BY 1) USING (submission_id)
  JOIN (SELECT submission_id, max(n) / sum(n) AS tp FROM (SELECT submission_id, product_type, count(*) AS n FROM policies_state GROUP BY ALL) GROUP BY 1) USING (submission_id)
  GROUP BY 1"""
_S6 = "avg_issue_age male_percentage smoker_percentage inforce_percentage top_state_concentration top_product_share"


@query("A4", duck("policies_state", _summary), r2="total_inforce", r4="avg_face_amount", r6=_S6)
def portfolio_summary_by_submission(spark, d):
    return pf.portfolio_summary(cn.policies(spark, d, with_state=True))


@query(
    "G11",
    duck("policies_state", """SELECT *, least(10.0, 5.0 + CASE WHEN g > 0.4 THEN 1.5 WHEN g > 0.25 THEN 0.5 ELSE 0 END + CASE WHEN p > 0.7 THEN 1.0 ELSE 0 END
      + CASE WHEN a > 55 THEN 0.8 WHEN a < 30 THEN 0.5 ELSE 0 END + CASE WHEN s > 0.25 THEN 1.2 ELSE 0 END + CASE WHEN f > 1000000 THEN 0.7 ELSE 0 END)::DOUBLE AS risk_score,
      array_to_string(list_filter([CASE WHEN g > 0.4 THEN 'state_share_over_40' END, CASE WHEN g > 0.25 AND g <= 0.4 THEN 'state_share_over_25' END,
        CASE WHEN p > 0.7 THEN 'product_share_over_70' END, CASE WHEN a > 55 THEN 'age_over_55' END, CASE WHEN a < 30 THEN 'age_under_30' END,
        CASE WHEN s > 0.25 THEN 'smokers_over_25' END, CASE WHEN f > 1000000 THEN 'face_over_1m' END], lambda x: x IS NOT NULL), '; ') AS risk_factors
      FROM (SELECT submission_id, top_state_concentration AS g, top_product_share AS p, avg_issue_age AS a, smoker_percentage AS s, avg_face_amount AS f FROM summary)""", summary=_summary),
    r4="f", r6="g p a s risk_score",
)
def submission_risk_scores(spark, d):
    s = pf.submission_risk_score(pf.portfolio_summary(cn.policies(spark, d, with_state=True)))
    return s.select(
        "submission_id", F.col("top_state_concentration").alias("g"), F.col("top_product_share").alias("p"),
        F.col("avg_issue_age").alias("a"), F.col("smoker_percentage").alias("s"), F.col("avg_face_amount").alias("f"),
        "risk_score", "risk_factors",
    )


@query(
    "A26",
    duck("policies", """SELECT *, n * 3 AS exposure_years, least(1.0, sqrt(n * 3 / 100000.0::DOUBLE)) AS credibility_factor,
      least(1.0, sqrt(n * 3 / 100000.0::DOUBLE)) * 0.8 AS mortality_credibility,
      CASE WHEN sqrt(n * 3 / 100000.0::DOUBLE) > 0.8 THEN 'High' WHEN sqrt(n * 3 / 100000.0::DOUBLE) > 0.5 THEN 'Medium' ELSE 'Low' END AS credibility_grade
      FROM (SELECT product_type, count(*) AS n FROM policies GROUP BY 1)"""),
    r6="credibility_factor mortality_credibility",
)
def exposure_credibility_by_product(spark, d):
    return pf.exposure_credibility(cn.policies(spark, d).groupBy("product_type").agg(F.count(F.lit(1)).alias("n")), "n")


@query(
    "A23",
    duck("policies_state", """SELECT sum(face_amount) FILTER (face_amount >= p90) / sum(face_amount) AS share_p90,
      sum(face_amount) FILTER (face_amount >= p95) / sum(face_amount) AS share_p95, sum(face_amount) FILTER (face_amount >= p99) / sum(face_amount) AS share_p99,
      (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM policies_state GROUP BY state)) AS top_state_share
      FROM policies_state, (SELECT quantile_cont(face_amount, 0.9) AS p90, quantile_cont(face_amount, 0.95) AS p95, quantile_cont(face_amount, 0.99) AS p99 FROM policies_state)"""),
    r6="share_p90 share_p95 share_p99 top_state_share",
)
def exposure_concentration(spark, d):
    return pf.exposure_concentration(cn.policies(spark, d, with_state=True))


@query(
    "A24 T3",
    duck("policies_state", "SELECT state, sum(annual_premium) AS premium, sum(face_amount) AS face_amount, count(*) AS policies FROM policies_state GROUP BY 1 ORDER BY 2 DESC LIMIT 10"),
    r2="premium face_amount",
)
def top_states_by_premium(spark, d):
    by_state = cn.policies(spark, d, with_state=True).groupBy("state").agg(
        F.sum("annual_premium").alias("premium"), F.sum("face_amount").alias("face_amount"), F.count(F.lit(1)).alias("policies")
    )
    return by_state.orderBy(F.desc("premium")).limit(10)


@query(
    "A24 A25",
    duck("policies", """SELECT product_type, sum(annual_premium) AS premium, count(*) AS policies, count(*) / sum(count(*)) OVER () AS row_share,
      CASE WHEN count(*) / sum(count(*)) OVER () > 0.8 THEN 'dominant' WHEN count(*) / sum(count(*)) OVER () > 0.7 THEN 'high' ELSE 'ok' END AS concentration FROM policies GROUP BY 1"""),
    r2="premium", r6="row_share",
)
def premium_by_product(spark, d):
    p = cn.policies(spark, d).groupBy("product_type").agg(F.sum("annual_premium").alias("premium"), F.count(F.lit(1)).alias("policies"))
    total = p.agg(F.sum("policies").alias("n")).scalar()
    s = F.col("row_share")
    return p.withColumn("row_share", F.col("policies") / total).withColumn(
        "concentration", F.when(s > 0.8, "dominant").when(s > 0.7, "high").otherwise("ok")
    )


@query(
    "A45",
    duck("policies", """SELECT coalesce(product_type, 'ALL') AS product_type, coalesce(gender, 'ALL') AS gender, coalesce(smoker_status, 'ALL') AS smoker_status,
      count(*) AS policies, sum(qx) AS expected_deaths, CAST(sum(death_indicator) AS BIGINT) AS actual_deaths, sum(death_indicator) / sum(qx) AS ae_ratio
      FROM rated GROUP BY GROUPING SETS ((product_type, gender, smoker_status), (product_type), (gender, smoker_status), ())""", rated=RATED),
    r6="expected_deaths ae_ratio",
)
def ae_study_subtotals(spark, d):
    rows = ex.with_select_qx(cn.policies(spark, d))
    keys = ["product_type", "gender", "smoker_status"]
    out = rows.groupingSets([keys, ["product_type"], ["gender", "smoker_status"], []], *keys).agg(
        F.count(F.lit(1)).alias("policies"), F.sum("qx").alias("expected_deaths"), F.sum("death_indicator").alias("actual_deaths")
    )
    return out.withColumns({k: F.coalesce(k, F.lit("ALL")) for k in keys}).withColumn(
        "ae_ratio", F.try_divide("actual_deaths", "expected_deaths")
    )


@query(
    "A43 U6",
    "SELECT count(DISTINCT k) AS unique_policies, count(*) AS rows FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem)",
)
def unique_policies_across_datasets(spark, d):
    ids = cn.policies(spark, d).select("policy_id").unionByName(cn.claims(spark, d).select("policy_id"))
    return ids.agg(F.countDistinct("policy_id").alias("unique_policies"), F.count(F.lit(1)).alias("rows"))


_yc = "series IN ('click','view') "


@query(
    "G12 G17",
    duck("policies_state claims", """SELECT r.*, 0.4 * mortality_score + 0.3 * rate_score + 0.2 * concentration_score + 0.1 * operational_score AS overall_score,
      CASE WHEN 0.4 * mortality_score + 0.3 * rate_score + 0.2 * concentration_score + 0.1 * operational_score > 4 THEN 'Quota Share 0.50; Excess of Retention 1000000'
           WHEN 0.4 * mortality_score + 0.3 * rate_score + 0.2 * concentration_score + 0.1 * operational_score > 3 THEN 'Yearly Renewable Term 0.75' ELSE '' END AS structures,
      z * (ae - 1.0) AS mortality_adjustment, ten_year + 0.015 AS discount_rate FROM (
      SELECT mean_age, sd_age, smoker_share, policies, ten_year, two_year, top_state_share,
      greatest(1.0, least(5.0, 2.5 + CASE WHEN mean_age > 65 THEN 1.0 WHEN mean_age < 30 THEN 0.5 ELSE 0 END + CASE WHEN sd_age < 5 THEN 0.8 ELSE 0 END
        + CASE WHEN smoker_share > 0.3 THEN 1.2 WHEN smoker_share > 0.15 THEN 0.6 ELSE 0 END + CASE WHEN policies < 1000 THEN 1.0 WHEN policies < 5000 THEN 0.5 ELSE 0 END))::DOUBLE AS mortality_score,
      greatest(1.0, least(5.0, 2.5 + CASE WHEN ten_year < 0.03 THEN 1.5 WHEN ten_year < 0.04 THEN 0.8 ELSE 0 END + CASE WHEN two_year > ten_year THEN 1.0 ELSE 0 END))::DOUBLE AS rate_score,
      greatest(1.0, least(5.0, 2.5 + CASE WHEN share_p99 > 0.2 THEN 1.5 WHEN share_p95 > 0.4 THEN 1.0 ELSE 0 END + CASE WHEN top_state_share > 0.5 THEN 1.2 WHEN top_state_share > 0.3 THEN 0.6 ELSE 0 END))::DOUBLE AS concentration_score,
      2.5::DOUBLE AS operational_score, z, ae FROM
      (SELECT avg(issue_age) AS mean_age, stddev_pop(issue_age) AS sd_age, avg(CAST(smoker_status='Smoker' AS INT)) AS smoker_share, count(*) AS policies,
        least(1.0, sqrt(sum(death_indicator) / 1082.0::DOUBLE)) AS z, sum(death_indicator) / sum(qx) AS ae FROM rated),
      (SELECT sum(face_amount) FILTER (face_amount >= p95) / sum(face_amount) AS share_p95, sum(face_amount) FILTER (face_amount >= p99) / sum(face_amount) AS share_p99
       FROM policies_state, (SELECT quantile_cont(face_amount, 0.95) AS p95, quantile_cont(face_amount, 0.99) AS p99 FROM policies_state)),
      (SELECT max(n) / sum(n) AS top_state_share FROM (SELECT count(*) AS n FROM policies_state GROUP BY state)),
      (SELECT avg(discount) AS ten_year, avg(tax) AS two_year FROM (SELECT l_discount AS discount, l_tax AS tax FROM lineitem))) r""", rated=RATED),
    r4="mean_age sd_age", r6="smoker_share ten_year two_year top_state_share z ae mortality_score rate_score concentration_score operational_score overall_score mortality_adjustment discount_rate",
)
def portfolio_risk_scores(spark, d):
    p = cn.policies(spark, d, with_state=True)
    deaths = F.sum("death_indicator")
    rated = ex.with_select_qx(cn.policies(spark, d)).agg(
        F.avg("issue_age").alias("mean_age"), F.stddev_pop("issue_age").alias("sd_age"),
        pf.share(F.col("smoker_status") == "Smoker").alias("smoker_share"), F.count(F.lit(1)).alias("policies"),
        ex.credibility(deaths).alias("credibility_factor"), F.try_divide(deaths, F.sum("qx")).alias("ae_ratio"),
    )
    rates = cn.table(spark, d, "lineitem").agg(F.avg("l_discount").alias("ten_year"), F.avg("l_tax").alias("two_year"))
    m = pf.scalars(rated, pf.exposure_concentration(p), rates).withColumns({"rate_volatility": F.lit(0.015), "completeness": F.lit(1.0)})
    s = pf.reinsurance_structure(pf.risk_scores(m))
    return s.select(
        "mean_age", "sd_age", "smoker_share", "policies", "ten_year", "two_year", "top_state_share", "mortality_score", "rate_score",
        "concentration_score", "operational_score", "overall_score", "structures", "mortality_adjustment", "discount_rate",
        F.col("credibility_factor").alias("z"), F.col("ae_ratio").alias("ae"),
    )


# --- cedents -------------------------------------------------------------------

@query(
    "A27 W20",
    duck("cedent_years", """SELECT cedent_id, years, recent_loss_ratio, mean_loss_ratio, loss_ratio_sd, recent_premium, premium_cv, mean_ae,
      CASE WHEN recent_loss_ratio < mean_loss_ratio * 0.95 THEN 'improving' WHEN recent_loss_ratio > mean_loss_ratio * 1.05 THEN 'deteriorating' ELSE 'stable' END AS loss_trend,
      CASE WHEN premium_cv < 0.2 THEN 'stable' WHEN premium_cv < 0.4 THEN 'moderate' ELSE 'volatile' END AS volume_stability,
      CASE WHEN mean_ae < 0.85 THEN 'excellent' WHEN mean_ae < 1 THEN 'good' WHEN mean_ae > 1.2 THEN 'poor' ELSE 'average' END AS underwriting_quality,
      CASE WHEN recent_premium > 100000000 THEN 'large' WHEN recent_premium > 10000000 THEN 'medium' ELSE 'small' END AS size_category, weighted_loss_ratio
      FROM (SELECT cedent_id, count(*) AS years, avg(loss_ratio) FILTER (rn <= 3) AS recent_loss_ratio, avg(loss_ratio) AS mean_loss_ratio,
        stddev_pop(loss_ratio) AS loss_ratio_sd, arg_max(premium_volume, year) AS recent_premium, stddev_pop(premium_volume) / avg(premium_volume) AS premium_cv, avg(ae_ratio) AS mean_ae,
        sum(CASE rn WHEN 1 THEN 0.5::DOUBLE * loss_ratio WHEN 2 THEN 0.3::DOUBLE * loss_ratio WHEN 3 THEN 0.2::DOUBLE * loss_ratio END) AS weighted_loss_ratio
        FROM (SELECT *, row_number() OVER (PARTITION BY cedent_id ORDER BY year DESC) AS rn FROM cedent_years) GROUP BY 1)"""),
    r2="recent_premium", r6="recent_loss_ratio mean_loss_ratio loss_ratio_sd premium_cv mean_ae weighted_loss_ratio",
)
def cedent_experience_bands(spark, d):
    years = cn.cedent_years(spark, d)
    return ex.cedent_experience(years).join(ex.weighted_recent(years), "cedent_id", "left")


@query(
    "A47",
    duck("cedent_years", """SELECT cedent_id, count(*) AS years, avg(loss_ratio) AS mean_lr, quantile_cont(loss_ratio, 0.5) AS median_lr, stddev_samp(loss_ratio) AS sd_lr,
      stddev_samp(loss_ratio) / avg(loss_ratio) AS cv_lr, skewness(loss_ratio) AS skew_lr, kurtosis(loss_ratio) AS kurtosis_lr, min(loss_ratio) AS min_lr, max(loss_ratio) AS max_lr
      FROM cedent_years GROUP BY 1"""),
    r6="mean_lr median_lr sd_lr cv_lr min_lr max_lr", r4="skew_lr kurtosis_lr",
)
def cedent_loss_ratio_distribution(spark, d):
    return ex.cedent_distribution(cn.cedent_years(spark, d))


@query(
    "A47",
    duck("cedent_years", """SELECT cedent_id, CAST(year AS INT) AS year, loss_ratio, m + s AS upper_band, m - s AS lower_band, loss_ratio BETWEEN m - s AND m + s AS inside
      FROM cedent_years JOIN (SELECT cedent_id, avg(loss_ratio) AS m, stddev_samp(loss_ratio) AS s FROM cedent_years GROUP BY 1) USING (cedent_id)"""),
    r6="loss_ratio upper_band lower_band",
)
def cedent_loss_ratio_bands(spark, d):
    years = cn.cedent_years(spark, d)
    m = ex.cedent_distribution(years).select("cedent_id", "mean_lr", "sd_lr")
    up, low = F.col("mean_lr") + F.col("sd_lr"), F.col("mean_lr") - F.col("sd_lr")
    return years.join(m, "cedent_id").select(
        "cedent_id", "year", "loss_ratio", up.alias("upper_band"), low.alias("lower_band"), F.col("loss_ratio").between(low, up).alias("inside")
    )


@query(
    "A48",
    duck("cedent_years", """SELECT cedent_id, count(*) AS years, avg(premium_volume) AS mean_premium, least(1.0, sqrt(count(*) * avg(premium_volume) / 10000000)) AS credibility,
      CASE WHEN least(1.0, sqrt(count(*) * avg(premium_volume) / 10000000)) > 0.8 THEN 'High' WHEN least(1.0, sqrt(count(*) * avg(premium_volume) / 10000000)) > 0.5 THEN 'Medium' ELSE 'Low' END AS significance
      FROM cedent_years GROUP BY 1"""),
    r2="mean_premium", r6="credibility",
)
def cedent_credibility(spark, d):
    return ex.cedent_credibility(cn.cedent_years(spark, d))


@query(
    "A49",
    duck("cedent_years", """SELECT *, CASE WHEN abs(trend_pct) < 5 THEN 'Stable' WHEN trend_pct <= -5 THEN 'Improving' ELSE 'Deteriorating' END AS trend FROM (
      SELECT cedent_id, years, recent_lr, coalesce(e, recent_lr) AS earlier_lr, CASE WHEN coalesce(e, recent_lr) > 0 THEN (recent_lr - coalesce(e, recent_lr)) / coalesce(e, recent_lr) * 100 ELSE 0 END AS trend_pct FROM (
      SELECT cedent_id, count(*) AS years, avg(loss_ratio) FILTER (rn <= 3) AS recent_lr, avg(loss_ratio) FILTER (rn > 3) AS e
      FROM (SELECT *, row_number() OVER (PARTITION BY cedent_id ORDER BY year DESC) AS rn FROM cedent_years) GROUP BY 1 HAVING count(*) >= 3))"""),
    r6="recent_lr earlier_lr trend_pct",
)
def cedent_loss_trend(spark, d):
    return ex.cedent_trend(cn.cedent_years(spark, d))


@query(
    "A50",
    duck("cedent_years", """SELECT *, CASE WHEN sd_lr > 0.15 THEN 'High' WHEN sd_lr > 0.1 THEN 'Moderate' ELSE 'Stable' END AS volatility_band,
      CASE WHEN concentration > 0.4 THEN 'High' WHEN concentration > 0.25 THEN 'Moderate' ELSE 'Diversified' END AS concentration_band FROM (
      SELECT cedent_id, count(*) AS years, avg(ae_ratio) AS mean_ae, stddev_samp(loss_ratio) AS sd_lr,
      CASE WHEN count(*) > 1 THEN (arg_max(premium_volume, year) / arg_min(premium_volume, year) - 1) / count(*) * 100 END AS premium_growth_pct,
      stddev_samp(policy_count) / avg(policy_count) AS policy_cv, any_value(k) AS concentration
      FROM cedent_years JOIN (SELECT cedent_id, max(a) / sum(a) AS k FROM (SELECT cedent_id, business_line, sum(claim_amount) AS a FROM claims JOIN treaties USING (treaty_id) GROUP BY ALL) GROUP BY 1) USING (cedent_id) GROUP BY 1)"""),
    r6="mean_ae sd_lr premium_growth_pct policy_cv concentration",
)
def cedent_underwriting_stability(spark, d):
    by_treaty = cn.claims(spark, d).groupBy("treaty_id").agg(F.sum("claim_amount").alias("a"))
    lines = (
        by_treaty.join(cn.treaties(spark, d).select("treaty_id", "cedent_id", "business_line"), "treaty_id")
        .groupBy("cedent_id", "business_line").agg(F.sum("a").alias("a"))
        .groupBy("cedent_id").agg((F.max("a") / F.sum("a")).alias("concentration"))
    )
    return ex.underwriting_stability(cn.cedent_years(spark, d), lines)


@query(
    "A51",
    duck("cedent_years", """SELECT cedent_id, mean_lr, greatest(0, least(100, (1 - (mean_lr - 0.6) / 0.3::DOUBLE) * 100)) AS position_score, percent_rank() OVER (ORDER BY mean_lr DESC) * 100 AS peer_percentile,
      CASE WHEN (1 - (mean_lr - 0.6) / 0.3::DOUBLE) * 100 >= 75 THEN 'Top quartile' WHEN (1 - (mean_lr - 0.6) / 0.3::DOUBLE) * 100 >= 50 THEN 'Above median' ELSE 'Below median' END AS position
      FROM (SELECT cedent_id, avg(loss_ratio) AS mean_lr FROM cedent_years GROUP BY 1)"""),
    r6="mean_lr position_score peer_percentile",
)
def cedent_market_position(spark, d):
    return ex.market_position(cn.cedent_years(spark, d))
