"""Feature columns over the applicant view, and daily series from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import canonical as cn
from .. import refdata
from ..functions import features as ft
from ..operators import experience as ex
from ..operators import series as sr
from .duck import duck
from .experience import GRID, _curve
from .registry import query

ASOF = cn.ASOF
_int = lambda *cs: ", ".join(f"CAST({c} AS INT)" for c in cs)


@query(
    "F1 D1",
    duck("applicants", """SELECT policy_id, CAST(issue_age * issue_age AS INT) AS age_squared, ln(greatest(issue_age, 1)) AS age_log, CAST(issue_age // 5 * 5 AS INT) AS age_band_5yr, CAST(issue_age // 10 * 10 AS INT) AS age_band_10yr,
      issue_age < 30 AS young_adult, issue_age >= 50 AND issue_age < 65 AS pre_retirement, greatest(0, 65 - issue_age) AS years_to_retirement, issue_age >= 62 AS retirement_eligible, issue_age >= 40 AND issue_age < 60 AS medium_mortality_age,
      CAST(gender = 'M' AS INT) AS gender_male, marital_status = 'Married' AS married, marital_status IN ('Divorced','Widowed') AS previously_married FROM applicants"""),
    r6="age_log",
)
def demographic_features(spark, d):
    return ft.demographic(cn.applicants(spark, d)).select(
        "policy_id", "age_squared", "age_log", "age_band_5yr", "age_band_10yr", "young_adult", "pre_retirement", "years_to_retirement",
        "retirement_eligible", "medium_mortality_age", "gender_male", "married", "previously_married",
    )


_bmi = "weight_pounds / (height_inches * height_inches)::DOUBLE * 703"


@query(
    "F2 D1",
    duck("applicants", f"""SELECT policy_id, CAST(smoker_status = 'Smoker' AS INT) AS is_smoker, b AS bmi, b < 18.5 AS underweight, b >= 18.5 AND b < 25 AS normal_weight, b >= 35 AS severely_obese,
      CASE WHEN b BETWEEN 22 AND 25 THEN 0.9 WHEN b BETWEEN 18.5 AND 22 THEN 1 + (22 - b) * 0.05::DOUBLE WHEN b > 25 AND b <= 30 THEN 1 + (b - 25) * 0.04::DOUBLE WHEN b > 30 THEN 1 + (b - 25) * 0.08::DOUBLE ELSE 1.4 END AS bmi_risk_score,
      CASE health_rating WHEN 'Preferred Plus' THEN 5 WHEN 'Preferred' THEN 4 WHEN 'Standard Plus' THEN 3 WHEN 'Standard' THEN 2 ELSE 1 END AS health_rating_numeric,
      {' + '.join(f'CAST(history_{c} AS INT)' for c in ('diabetes', 'heart_disease', 'hypertension', 'asthma'))} AS total_health_conditions,
      CAST(history_diabetes AS INT) * 3 + CAST(history_heart_disease AS INT) * 4 + CAST(history_hypertension AS INT) * 2 + CAST(history_asthma AS INT) AS health_severity_score FROM (SELECT *, {_bmi} AS b FROM applicants)"""),
    r6="bmi", r4="bmi_risk_score",
)
def health_features(spark, d):
    return ft.health(cn.applicants(spark, d)).select(
        "policy_id", "is_smoker", "bmi", "underweight", "normal_weight", "severely_obese", "bmi_risk_score", "health_rating_numeric", "total_health_conditions", "health_severity_score"
    )


@query(
    "F3 D1",
    duck("applicants", """SELECT policy_id, ln(greatest(annual_income, 1000)) AS income_log, annual_income >= 75000 AND annual_income < 150000 AS high_income,
      CASE WHEN annual_income <= 0 THEN 0 WHEN annual_income < 25000 THEN 20 WHEN annual_income < 50000 THEN 40 WHEN annual_income < 75000 THEN 60 WHEN annual_income < 100000 THEN 75 WHEN annual_income < 150000 THEN 85 WHEN annual_income < 200000 THEN 92 ELSE 95 END::DOUBLE AS income_percentile,
      ln(greatest(face_amount, 1000)) AS face_amount_log, face_amount >= 100000 AND face_amount < 500000 AS medium_coverage, face_amount / greatest(annual_income, 1) AS coverage_multiple, face_amount / annual_income >= 3 AND face_amount / annual_income < 10 AS adequate_coverage_ratio,
      face_amount / annual_income > 20 AS potential_anti_selection, annual_premium / greatest(annual_income, 1) * 100 AS premium_to_income_pct, annual_premium / annual_income > 0.1::DOUBLE AS high_premium_burden, ln(greatest(net_worth, 1000)) AS net_worth_log, net_worth < 0 AS negative_net_worth FROM applicants"""),
    r6="income_log face_amount_log net_worth_log", r4="premium_to_income_pct", r2="coverage_multiple",
)
def financial_features(spark, d):
    return ft.financial(cn.applicants(spark, d)).select(
        "policy_id", "income_log", "high_income", "income_percentile", "face_amount_log", "medium_coverage", "coverage_multiple", "adequate_coverage_ratio",
        "potential_anti_selection", "premium_to_income_pct", "high_premium_burden", "net_worth_log", "negative_net_worth",
    )


@query(
    "F4 D1",
    duck("applicants", """SELECT policy_id, product_type = 'Term' AS simple_product, product_type = 'Variable' AS complex_product, product_type IN ('Whole Life','Universal Life') AS permanent_product, payment_mode = 'Monthly' AS monthly_pay, payment_mode IN ('Quarterly','Semi-Annual') AS semi_frequent_pay,
      premium_frequency > 1 AS frequent_payment, CASE WHEN premium_frequency = 1 THEN 1.0 WHEN premium_frequency <= 4 THEN 1.2 ELSE 1.5 END::DOUBLE AS payment_frequency_risk_factor, medical_exam = 'Yes' AS had_medical_exam, agent_id IS NULL AS direct_sale FROM applicants"""),
)
def policy_features(spark, d):
    return ft.policy(cn.applicants(spark, d)).select(
        "policy_id", "simple_product", "complex_product", "permanent_product", "monthly_pay", "semi_frequent_pay", "frequent_payment", "payment_frequency_risk_factor", "had_medical_exam", "direct_sale"
    )


def _table(spark):
    keys = ["gender", "smoker_status"]
    grid = refdata.grid_mortality(spark)
    return grid.join(ex.life_expectancy(grid, keys), [*keys, "age"]).withColumnRenamed("age", "issue_age")


_le = """SELECT a.age, a.gender, a.smoker_status, any_value(a.qx) AS qx, coalesce(sum(CASE WHEN b.survival * (1 - b.qx) / a.survival > 0.001 THEN b.survival * (1 - b.qx) / a.survival END), 0) AS life_expectancy
  FROM curve a JOIN curve b ON a.gender = b.gender AND a.smoker_status = b.smoker_status AND b.age >= a.age GROUP BY ALL"""


@query(
    "F5 J11 W18",
    duck("applicants", """SELECT policy_id, qx, life_expectancy, qx < 0.005 AS low_mortality_risk, qx >= 0.015 AS high_mortality_risk, life_expectancy > 25 AS long_life_expectancy, face_amount * qx * 0.97 AS approx_net_single_premium, face_amount * qx AS risk_adjusted_coverage
      FROM applicants p JOIN le ON le.age = p.issue_age AND le.gender = p.gender AND le.smoker_status = p.smoker_status""", grid=GRID, curve=_curve, le=_le),
    r6="qx life_expectancy", r2="approx_net_single_premium risk_adjusted_coverage",
)
def actuarial_features(spark, d):
    return ft.actuarial(cn.applicants(spark, d), _table(spark)).select(
        "policy_id", "qx", "life_expectancy", "low_mortality_risk", "high_mortality_risk", "long_life_expectancy", "approx_net_single_premium", "risk_adjusted_coverage"
    )


@query(
    "F6",
    duck("applicants", "SELECT policy_id, state_code IN ('CA','NY','WA') AS high_cost_state, state_code IN ('NY','PA') AS northeast_region, state_code IN ('FL','GA','AL') AS southeast_region, state_code = 'OH' AS midwest_region, state_code IN ('CA','WA','CO') AS west_region, CAST(substr(zip_code, 1, 1) AS INT) AS zip_first_digit, substr(zip_code, 1, 3) AS zip_prefix FROM applicants"),
)
def geographic_features(spark, d):
    return ft.geographic(cn.applicants(spark, d)).select(
        "policy_id", "high_cost_state", "northeast_region", "southeast_region", "midwest_region", "west_region", "zip_first_digit", "zip_prefix"
    )


@query(
    "F7",
    duck("applicants", f"""SELECT policy_id, {', '.join(f'CAST({f}(issue_date) AS INT) AS issue_{n}' for f, n in (('year', 'year'), ('month', 'month'), ('quarter', 'quarter'), ('isodow', 'weekday')))},
      month(issue_date) IN (12, 1, 2) AS winter_issue, month(issue_date) IN (11, 12) AS year_end_issue, CAST(date_diff('day', DATE '2000-01-01', issue_date) AS INT) AS days_since_2000, CAST(date_diff('day', birth_date, issue_date) AS INT) AS age_in_days,
      year(birth_date) BETWEEN 1965 AND 1980 AS gen_x, year(birth_date) BETWEEN 1946 AND 1964 AS boomer FROM applicants"""),
)
def temporal_features(spark, d):
    return ft.temporal(cn.applicants(spark, d)).select(
        "policy_id", "issue_year", "issue_month", "issue_quarter", "issue_weekday", "winter_issue", "year_end_issue", "days_since_2000", "age_in_days", "gen_x", "boomer"
    )


@query(
    "F8",
    duck("applicants", """SELECT policy_id, issue_age * m AS age_male_interaction, issue_age * issue_age * s AS age_squared_smoker_interaction, fl * issue_age AS coverage_age_interaction, il * fl AS income_coverage_interaction, h * issue_age AS health_age_interaction, issue_age * m * s AS age_gender_smoker_interaction
      FROM (SELECT *, CAST(gender = 'M' AS INT) AS m, CAST(smoker_status = 'Smoker' AS INT) AS s, ln(greatest(face_amount, 1000)) AS fl, ln(greatest(annual_income, 1000)) AS il,
        CASE health_rating WHEN 'Preferred Plus' THEN 5 WHEN 'Preferred' THEN 4 WHEN 'Standard Plus' THEN 3 WHEN 'Standard' THEN 2 ELSE 1 END AS h FROM applicants)"""),
    r6="coverage_age_interaction income_coverage_interaction",
)
def interaction_features(spark, d):
    all_groups = ft.interactions(ft.financial(ft.health(ft.demographic(cn.applicants(spark, d)))))
    return all_groups.select(
        "policy_id", "age_male_interaction", "age_squared_smoker_interaction", "coverage_age_interaction", "income_coverage_interaction", "health_age_interaction", "age_gender_smoker_interaction"
    )


@query(
    "F9",
    duck("applicants", """SELECT policy_id, 1 - qx AS survival_probability, life_expectancy, life_expectancy > 20 AS high_longevity_risk, issue_age < 59.5 AS early_retirement, issue_age >= 59.5 AND issue_age < 65 AS normal_retirement, issue_age >= 72 AS rmd_age,
      CASE WHEN issue_age >= 65 THEN greatest(0, 25 - (issue_age - 65)) ELSE 25 END AS expected_retirement_years FROM applicants p JOIN le ON le.age = p.issue_age AND le.gender = p.gender AND le.smoker_status = 'Nonsmoker'""", grid=GRID, curve=_curve, le=_le),
    r6="survival_probability life_expectancy",
)
def longevity_features(spark, d):
    t = _table(spark).where("smoker_status = 'Nonsmoker'").drop("smoker_status")
    return ft.longevity(cn.applicants(spark, d), t).select(
        "policy_id", "survival_probability", "life_expectancy", "high_longevity_risk", "early_retirement", "normal_retirement", "rmd_age", "expected_retirement_years"
    )


@query(
    "F10 D1",
    duck("applicants", f"""SELECT policy_id, ln(greatest(face_amount, 1000)) AS premium_log, face_amount >= 50000 AND face_amount < 250000 AS medium_premium, guaranteed_rate > 0.02 AS high_guaranteed_rate, contains(payout_option, 'Certain') AS period_certain_payout,
      CASE WHEN contains(payout_option, 'Life Only') THEN 1.0 WHEN contains(payout_option, 'Certain') THEN 0.8 ELSE 0.6 END::DOUBLE AS payout_risk_factor, monthly_payment * 12 / face_amount AS annual_payout_rate, monthly_payment > 1000 AS adequate_monthly_income,
      (face_amount - surrender_value) / face_amount AS surrender_charge_rate, CAST(date_diff('day', issue_date, DATE '{ASOF}') AS INT) AS contract_duration_days, date_diff('day', issue_date, DATE '{ASOF}') / 365.25::DOUBLE < 5 AS early_surrender_risk_period FROM applicants"""),
    r6="premium_log annual_payout_rate surrender_charge_rate",
)
def annuity_features(spark, d):
    return ft.investment(cn.applicants(spark, d), ASOF).select(
        "policy_id", "premium_log", "medium_premium", "high_guaranteed_rate", "period_certain_payout", "payout_risk_factor", "annual_payout_rate", "adequate_monthly_income",
        "surrender_charge_rate", "contract_duration_days", "early_surrender_risk_period",
    )


@query(
    "F11 F17",
    duck("applicants", """SELECT policy_id, ln(1 + face_amount) AS log_face_amount, annual_premium / face_amount * 1000 AS premium_per_1000, CAST(policy_duration <= 2 AS INT) AS early_duration, CAST(policy_duration * policy_duration AS INT) AS duration_squared, CAST(attained_age >= 65 AS INT) AS retirement_age,
      CAST(credit_score < 650 AS INT) AS low_credit_score, CAST(payment_history < 0.9 AS INT) AS payment_issues, CAST(product_type = 'Term' AS INT) AS product_term, CAST(product_type = 'Group Life' AS INT) AS product_group_life FROM applicants"""),
    r6="log_face_amount premium_per_1000",
)
def lapse_features(spark, d):
    return ft.lapse(cn.applicants(spark, d), list(cn.PRODUCTS.values())).select(
        "policy_id", "log_face_amount", "premium_per_1000", "early_duration", "duration_squared", "retirement_age", "low_credit_score", "payment_issues", "product_term", "product_group_life"
    )


@query(
    "F12",
    duck("applicants", f"""SELECT policy_id, CAST(attained_age ** 3 AS BIGINT) AS age_cubed, CAST(gender = 'M' AS INT) AS gender_m, CAST({_bmi} >= 30 AS INT) AS bmi_obese, attained_age * CAST(smoker_status = 'Smoker' AS INT) AS age_smoker_interaction, CAST(policy_duration >= 10 AS INT) AS mature_duration,
      CAST(state_code = 'AL' AS INT) AS high_risk_geography, CAST(policy_id % 11 = 0 AS INT) + CAST(policy_id % 13 = 0 AS INT) + CAST(policy_id % 3 = 0 AS INT) AS total_medical_conditions, CAST(policy_id % 11 = 0 AND policy_id % 13 = 0 AND policy_id % 3 = 0 AS INT) AS has_major_condition FROM applicants"""),
)
def mortality_features(spark, d):
    return ft.mortality(ft.health(cn.applicants(spark, d)).drop("age_squared")).select(
        "policy_id", F.col("age_cubed").cast("long").alias("age_cubed"), "gender_m", "bmi_obese", "age_smoker_interaction", "mature_duration", "high_risk_geography", "total_medical_conditions", "has_major_condition"
    )


@query(
    "F14",
    duck("policies", """SELECT policy_id, CAST(round_even(issue_age + duration_years, 0) AS INT) AS attained_age_rounded, CAST(round_even(duration_years + 1, 0) AS INT) AS policy_year,
      CASE WHEN face_amount <= 50000 THEN '<50K' WHEN face_amount <= 100000 THEN '50K-100K' WHEN face_amount <= 250000 THEN '100K-250K' WHEN face_amount <= 500000 THEN '250K-500K' WHEN face_amount <= 1000000 THEN '500K-1M' WHEN face_amount <= 5000000 THEN '1M-5M' ELSE '>5M' END AS face_amount_band,
      CASE WHEN issue_age <= 25 THEN '<25' WHEN issue_age <= 35 THEN '25-35' WHEN issue_age <= 45 THEN '35-45' WHEN issue_age <= 55 THEN '45-55' WHEN issue_age <= 65 THEN '55-65' WHEN issue_age <= 75 THEN '65-75' WHEN issue_age <= 100 THEN '>75' END AS issue_age_band FROM policies"""),
)
def derived_policy_fields(spark, d):
    return ft.derived_policy_fields(cn.policies(spark, d), ASOF).select("policy_id", "attained_age_rounded", "policy_year", "face_amount_band", "issue_age_band")


@query(
    "M14",
    duck("messy", """SELECT row_idx, greatest(0.3, least(0.95, 0.8 - (CAST(issue_age IS NULL AS INT) + CAST(face_amount IS NULL AS INT) + CAST(premium IS NULL AS INT)) * 0.1 - CASE WHEN issue_age < 18 OR issue_age > 85 THEN 0.15 ELSE 0 END))::DOUBLE AS confidence FROM messy"""),
    r6="confidence",
)
def row_confidence(spark, d):
    c = F.col
    m = cn.messy_policies(spark, d)
    return m.select("row_idx", ft.row_confidence([c("issue_age"), c("face_amount"), c("premium")], c("issue_age"), F.lit(1)).alias("confidence"))


# --- series -----------------------------------------------------------------------------------

_w = "WINDOW w AS (PARTITION BY series ORDER BY date)"
_roll = lambda f, c, n: f"CASE WHEN count({c}) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}({c}) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


@query(
    "W9 W10 W11 W14",
    duck("economy", f"""SELECT series, date, value, lag(value, 1) OVER w AS lag_1, lag(value, 5) OVER w AS lag_5, {_roll('avg', 'value', 10)} AS ma_10, {_roll('avg', 'value', 252)} AS ma_252, {_roll('stddev_samp', 'value', 20)} AS sd_20, {_roll('stddev_samp', 'value', 30)} AS sd_30,
      value - lag(value) OVER w AS change_1, value / lag(value) OVER w - 1 AS pct_1, value / lag(value, 20) OVER w - 1 AS pct_20, ln(value) - ln(lag(value) OVER w) AS log_change, lead(value, 5) OVER w AS target FROM economy {_w}"""),
    r6="value lag_1 lag_5 ma_10 ma_252 sd_20 sd_30 change_1 pct_1 pct_20 log_change target", day="date",
)
def rate_features(spark, d):
    return sr.rate_features(cn.economy(spark, d))


_rsi = f"""SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END AS rsi FROM (SELECT *, {_roll('avg', 'g', 14)} AS up, {_roll('avg', 'l', 14)} AS down FROM (
  SELECT *, CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END AS g, CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0) END AS l FROM (SELECT *, value - lag(value) OVER w AS dd FROM economy {_w})))"""


@query(
    "F13 W13 W10",
    duck("economy", f"""SELECT series, date, rsi, return_1, momentum_20, ma_5, ma_20, volatility_20, ma_5 / ma_20 - 1 AS ma_spread, coalesce(volatility_20 > avg(volatility_20) OVER (PARTITION BY series), false) AS high_volatility FROM (SELECT *, {_roll('stddev_samp', 'return_1', 20)} AS volatility_20 FROM (
      SELECT *, value / lag(value) OVER w - 1 AS return_1, value / lag(value, 20) OVER w - 1 AS momentum_20, {_roll('avg', 'value', 5)} AS ma_5, {_roll('avg', 'value', 20)} AS ma_20 FROM r {_w}))""", r=_rsi),
    r6="rsi return_1 momentum_20 ma_5 ma_20 volatility_20 ma_spread", day="date",
)
def equity_features(spark, d):
    return sr.equity_features(cn.economy(spark, d)).drop("value")


@query(
    "W12 A41",
    duck("economy", f"""SELECT series, stddev_samp(lc) * sqrt(12) AS volatility, avg(value) AS mean_rate, count(value) AS n, regr_slope(value - lg, lg) AS slope, greatest(0.01, least(0.5, -regr_slope(value - lg, lg) * 12)) AS mean_reversion FROM (SELECT *, lag(value) OVER w AS lg, ln(value) - ln(lag(value) OVER w) AS lc FROM economy {_w}) GROUP BY 1"""),
    r6="volatility mean_rate slope mean_reversion",
)
def rate_statistics(spark, d):
    e = cn.economy(spark, d)
    return sr.annual_volatility(e).join(sr.mean_reversion(e), "series")


@query(
    "W16",
    duck("claims", """SELECT 'claims' AS series, date, value, value / lag(value, 12) OVER (ORDER BY date) - 1 AS yoy FROM (SELECT date_trunc('month', loss_date) AS date, avg(claim_amount) AS value FROM claims GROUP BY ALL)"""),
    r4="value", r6="yoy", day="date",
)
def claim_inflation(spark, d):
    monthly = cn.claims(spark, d).groupBy(F.trunc("loss_date", "month").alias("date")).agg(F.avg("claim_amount").alias("value"))
    return sr.year_on_year(monthly.select(F.lit("claims").alias("series"), "date", "value"))


@query(
    "W23",
    duck("economy", f"SELECT series, date, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY series) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM economy {_w}"),
    day="date",
)
def chronological_split(spark, d):
    return sr.chronological_split(cn.economy(spark, d)).drop("value")


_wide = "SELECT date, max(value) FILTER (series = 'click') AS y2, max(value) FILTER (series = 'view') AS y5, max(value) FILTER (series = 'purchase') AS y10, max(value) FILTER (series = 'error') AS inflation FROM economy GROUP BY 1"


def _curve_rows(spark, d):
    names = {"click": "y2", "view": "y5", "purchase": "y10", "error": "inflation"}
    return cn.economy(spark, d).groupBy("date").pivot("series", list(names)).agg(F.max("value")).withColumnsRenamed(names)


@query(
    "W24",
    duck("economy", f"SELECT date, y10 - y2 AS slope, 2 * y5 - y2 - y10 AS curvature, y10 - inflation AS real_rate, y2 > y10 AS inverted FROM ({_wide})"),
    r6="slope curvature real_rate", day="date",
)
def yield_curve_measures(spark, d):
    return sr.curve_measures(_curve_rows(spark, d)).select("date", "slope", "curvature", "real_rate", "inverted")


_reg = "SELECT date, (y10 - 28) / 100 AS gdp_growth, y2 / 600 AS unemployment, y5 / 900 AS inflation, (y10 - y2) / 100 AS slope FROM (" + _wide + ")"
_e = "(greatest(0, gdp_growth) * 2 + greatest(0, 0.08::DOUBLE - unemployment) * 3 + greatest(0, 0.03::DOUBLE - abs(inflation - 0.02::DOUBLE)) * 2 + greatest(0, slope)) / 10"
_r = "(greatest(0, -gdp_growth) * 4 + greatest(0, unemployment - 0.05::DOUBLE) * 3 + greatest(0, -slope) * 2) / 8"
_v = "CASE WHEN gdp_growth > 0 AND unemployment > 0.045 THEN (greatest(0, gdp_growth) * 1.5 + greatest(0, 0.06::DOUBLE - unemployment) * 2 + greatest(0, slope) * 1.5) / 6 ELSE 0 END"
_s = "(greatest(0, inflation - 0.04::DOUBLE) * 4 + greatest(0, 0.01::DOUBLE - gdp_growth) * 2) / 6"


@query(
    "F22",
    duck("economy", f"""SELECT date, p_expansion, p_recession, p_recovery, p_stagflation, greatest(p_expansion, p_recession, p_recovery, p_stagflation) AS confidence,
      CASE greatest(p_expansion, p_recession, p_recovery, p_stagflation) WHEN p_expansion THEN 'expansion' WHEN p_recession THEN 'recession' WHEN p_recovery THEN 'recovery' ELSE 'stagflation' END AS regime FROM (
      SELECT date, CASE WHEN t > 0 THEN e / t ELSE 0.6 END AS p_expansion, CASE WHEN t > 0 THEN r / t ELSE 0.15 END AS p_recession, CASE WHEN t > 0 THEN v / t ELSE 0.2 END AS p_recovery, CASE WHEN t > 0 THEN s / t ELSE 0.05 END AS p_stagflation
      FROM (SELECT *, e + r + v + s AS t FROM (SELECT date, least(1, {_e}) AS e, least(1, {_r}) AS r, least(1, {_v}) AS v, least(1, {_s}) AS s FROM reg)))""", reg=_reg),
    r6="p_expansion p_recession p_recovery p_stagflation confidence", day="date",
)
def economic_regimes(spark, d):
    c = F.col
    ind = _curve_rows(spark, d).select(
        "date", ((c("y10") - 28) / 100).alias("gdp_growth"), (c("y2") / 600).alias("unemployment"), (c("y5") / 900).alias("inflation_"), ((c("y10") - c("y2")) / 100).alias("slope")
    ).withColumnRenamed("inflation_", "inflation")
    return ft.regime(ind).select("date", "p_expansion", "p_recession", "p_recovery", "p_stagflation", "confidence", "regime")


@query(
    "A42",
    duck("policies", """SELECT product_type, count(*) AS points, regr_slope(ly, lx) AS elasticity, CASE WHEN regr_slope(ly, lx) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (
      SELECT product_type, ln(greatest(0.001::DOUBLE, x / bx)) AS lx, ln(greatest(0.001::DOUBLE, y / by_)) AS ly FROM (SELECT product_type, year(issue_date) - 1990 AS x, avg(annual_premium) AS y FROM policies GROUP BY ALL)
      JOIN (SELECT product_type, 5.0::DOUBLE AS bx, avg(annual_premium) AS by_ FROM policies GROUP BY 1) USING (product_type)) GROUP BY 1"""),
    r6="elasticity",
)
def premium_elasticity(spark, d):
    p = cn.policies(spark, d)
    pts = p.groupBy("product_type", (F.year("issue_date") - 1990).alias("x")).agg(F.avg("annual_premium").alias("y"))
    base = p.groupBy("product_type").agg(F.lit(5.0).alias("base_x"), F.avg("annual_premium").alias("base_y"))
    return sr.elasticity(pts.join(base, "product_type"), ["product_type"])


_states = "SELECT date_trunc('month', loss_date)::DATE AS loss_date, avg(recovery) AS rate FROM claims GROUP BY 1"


@query(
    "J5",
    duck("claims policies", """SELECT p.policy_id, p.issue_date, s.rate FROM policies p ASOF LEFT JOIN states s ON p.issue_date >= s.loss_date""", states=_states),
    r6="rate", day="issue_date",
)
def economic_state_at_issue(spark, d):
    monthly = cn.claims(spark, d).groupBy(F.trunc("loss_date", "month").alias("issue_date")).agg(F.avg("recovery").alias("rate"))
    p = cn.policies(spark, d).select("policy_id", "issue_date")
    return sr.as_of_join(p, monthly, [], "issue_date", ["rate"])


@query(
    "J5",
    duck("claims treaties cedent_years", """SELECT c.cedent_id, count(*) AS claims, count(s.loss_ratio) AS with_experience, avg(s.loss_ratio) AS known_loss_ratio, min(s.known_on) AS first_known, max(s.known_on) AS last_known
      FROM (SELECT cedent_id, loss_date FROM claims JOIN treaties USING (treaty_id)) c
      ASOF LEFT JOIN (SELECT cedent_id, make_date(year, 12, 31) AS known_on, loss_ratio FROM cedent_years WHERE (cedent_id + year) % 3 > 0) s ON c.cedent_id = s.cedent_id AND c.loss_date >= s.known_on GROUP BY 1"""),
    r6="known_loss_ratio", day="first_known last_known",
)
def cedent_experience_at_loss(spark, d):
    """The cedent's loss ratio that was known on the day of each claim: that of its last year on file."""
    c = cn.claims(spark, d).join(cn.treaties(spark, d).select("treaty_id", "cedent_id"), "treaty_id").select("cedent_id", F.col("loss_date").alias("known_on"))
    filed = cn.cedent_years(spark, d).where((F.col("cedent_id") + F.col("year")) % 3 > 0)
    states = filed.select("cedent_id", F.make_date("year", F.lit(12), F.lit(31)).alias("known_on"), F.make_date("year", F.lit(12), F.lit(31)).alias("as_of"), "loss_ratio")
    known = sr.as_of_join(c, states, ["cedent_id"], "known_on", ["as_of", "loss_ratio"])
    return known.groupBy("cedent_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count("loss_ratio").alias("with_experience"), F.avg("loss_ratio").alias("known_loss_ratio"),
        F.min("as_of").alias("first_known"), F.max("as_of").alias("last_known"))


@query(
    "J4",
    duck("economy treaties", f"""SELECT treaty_id, treaty_type, (SELECT arg_max(y10, date) FROM ({_wide})) AS current_interest_rate, (SELECT arg_max(inflation, date) FROM ({_wide})) AS current_inflation FROM treaties"""),
    r6="current_interest_rate current_inflation",
)
def market_values_on_treaties(spark, d):
    latest = sr.latest_values(_curve_rows(spark, d), "date", ["y10", "inflation"])
    one = latest.select(F.struct("y10", "inflation")).scalar()
    return cn.treaties(spark, d).withColumn("_m", one).select(
        "treaty_id", "treaty_type", F.col("_m.y10").alias("current_interest_rate"), F.col("_m.inflation").alias("current_inflation")
    )
