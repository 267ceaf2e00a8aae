"""Life contingencies, reserves, lapse and commercial premium over the policy view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import canonical as cn
from ..operators import experience as ex
from ..operators import portfolio as pf
from ..operators import reserves as rs
from ..operators.quantiles import exact_quantiles
from .duck import duck
from .experience import GRID, GRIDDED, RATED
from .registry import query

V = "(1/1.035::DOUBLE)"
_W = "PARTITION BY gender, smoker_status ORDER BY age"
LT = f"""SELECT *, big_n / big_d AS annuity_due, big_m / big_d AS insurance FROM (
  SELECT *, sum(big_d) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS big_n,
    sum(lx * qx * power({V}, age + 1)) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS big_m,
    sum(lx) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / lx - 0.5 AS ex FROM (
    SELECT *, lx * qx AS dx, lx * power({V}, age) AS big_d FROM (
      SELECT *, 100000 * exp(coalesce(sum(ln(1 - qx)) FILTER (qx < 1) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lx FROM (
        SELECT age, gender, smoker_status, CASE WHEN age >= 100 THEN 1.0::DOUBLE ELSE least(0.8::DOUBLE, greatest(0.0001::DOUBLE, a * exp(b * (age - 20)))) END AS qx FROM
          (SELECT range::INT AS age FROM range(18, 101)),
          (VALUES ('F','Nonsmoker',0.0001::DOUBLE,0.085::DOUBLE),('F','Smoker',0.00015::DOUBLE,0.095::DOUBLE),('M','Nonsmoker',0.00015::DOUBLE,0.09::DOUBLE),('M','Smoker',0.0002::DOUBLE,0.10::DOUBLE)) v(gender, smoker_status, a, b)))))"""
JOIN_AT = "JOIN lt {a} ON {a}.age = least(100, greatest(18, {age})) AND {a}.gender = p.gender AND {a}.smoker_status = p.smoker_status"


@query(
    "R4 R9",
    duck("policies", f"""SELECT p.issue_age, p.gender, p.smoker_status, count(*) AS policies, any_value(x.lx) AS lx, any_value(x.dx) AS dx, any_value(x.qx) AS qx,
      any_value(x.ex) AS ex, any_value(x.annuity_due) AS annuity_due, any_value(x.insurance) AS insurance
      FROM policies p {JOIN_AT.format(a='x', age='p.issue_age')} GROUP BY ALL""", lt=LT),
    r4="lx dx", r6="qx ex annuity_due insurance",
)
def life_table_of_portfolio(spark, d):
    cells = cn.policies(spark, d).groupBy("issue_age", "gender", "smoker_status").agg(F.count(F.lit(1)).alias("policies"))
    return rs.at_age(cells, rs.life_table(spark), F.col("issue_age"), {c: c for c in ("lx", "dx", "qx", "ex", "annuity_due", "insurance")})


_np = f"""SELECT p.*, face_amount * CASE WHEN product_type = 'Term' THEN (x.big_m - y.big_m) / x.big_d ELSE x.big_m / x.big_d END AS pv_benefits,
  CASE WHEN product_type = 'Term' THEN (x.big_n - y.big_n) / x.big_d ELSE x.big_n / x.big_d END AS pv_annuity
  FROM policies p {JOIN_AT.format(a='x', age='p.issue_age')} {JOIN_AT.format(a='y', age='p.issue_age + 20')}"""


@query(
    "R5",
    duck("policies", """SELECT policy_id, pv_benefits, pv_annuity, pv_benefits / pv_annuity AS net_premium, pv_benefits / pv_annuity / face_amount * 1000 AS premium_per_1000 FROM np""", lt=LT, np=_np),
    r4="pv_benefits net_premium", r6="pv_annuity premium_per_1000",
)
def net_level_premiums(spark, d):
    return rs.net_premiums(cn.policies(spark, d), rs.life_table(spark)).select("policy_id", "pv_benefits", "pv_annuity", "net_premium", "premium_per_1000")


_pr = f"""SELECT p.*, greatest(0, lv) AS net_level_reserve, greatest(0, lv * greatest(0.8, least(1.2, 1 + (5 - (attained_age - issue_age)) * 0.05::DOUBLE))) AS modified_reserve,
  greatest(0, lv * 0.9) AS surrender_value FROM (SELECT p.*, face_amount * y.insurance - face_amount * x.insurance / x.annuity_due * y.annuity_due AS lv
  FROM policies p {JOIN_AT.format(a='x', age='p.issue_age')} {JOIN_AT.format(a='y', age='p.attained_age')}) p"""


@query(
    "R6",
    duck("policies", "SELECT policy_id, net_level_reserve, modified_reserve, surrender_value FROM pr", lt=LT, pr=_pr),
    r4="net_level_reserve modified_reserve surrender_value",
)
def prospective_reserves(spark, d):
    return rs.prospective_reserves(cn.policies(spark, d), rs.life_table(spark)).select(
        "policy_id", "net_level_reserve", "modified_reserve", "surrender_value"
    )


@query(
    "R7",
    duck("policies", """SELECT underwriting_class, smoker_status, count(*) AS policies, avg(q) AS qx, sum(face_amount * q) AS expected_claims FROM (
      SELECT *, least(1.0, qx * CASE WHEN smoker_status = 'Smoker' THEN 2.5 ELSE 1 END * CASE WHEN policy_id % 11 = 0 THEN 1.8 ELSE 1 END * CASE WHEN policy_id % 13 = 0 THEN 2.2 ELSE 1 END
      * CASE underwriting_class WHEN 'Preferred Plus' THEN 0.75 WHEN 'Preferred' THEN 0.85 WHEN 'Substandard' THEN 1.25 ELSE 1.0 END) AS q FROM gridded) GROUP BY ALL""", grid=GRID, gridded=GRIDDED),
    r2="expected_claims", r6="qx",
)
def underwritten_mortality(spark, d):
    k = F.col("policy_id")
    q = rs.underwritten_qx(F.col("qx"), F.col("smoker_status") == "Smoker", k % 11 == 0, k % 13 == 0, F.col("underwriting_class"))
    return ex.with_grid_qx(cn.policies(spark, d)).withColumn("q", q).groupBy("underwriting_class", "smoker_status").agg(
        F.count(F.lit(1)).alias("policies"), F.avg("q").alias("qx"), F.sum(F.col("face_amount") * F.col("q")).alias("expected_claims")
    )


@query(
    "R8",
    duck("policies", """SELECT CAST(range AS INT) AS year_ahead, product_type, sum(qx * power(0.985::DOUBLE, range)) AS expected_deaths, sum(face_amount * qx * power(0.985::DOUBLE, range)) AS expected_claims
      FROM (SELECT product_type, sum(qx) AS qx, sum(face_amount * qx) / sum(qx) AS face_amount FROM rated GROUP BY 1), range(0, 10) GROUP BY ALL""", rated=RATED),
    r2="expected_claims", r6="expected_deaths",
)
def projected_mortality(spark, d):
    base = ex.with_select_qx(cn.policies(spark, d)).groupBy("product_type").agg(
        F.sum("qx").alias("q"), F.sum(F.col("face_amount") * F.col("qx")).alias("c")
    )
    years = base.withColumn("year_ahead", F.explode(F.sequence(F.lit(0), F.lit(9))))
    f = F.pow(F.lit(1 - 0.015), F.col("year_ahead"))
    return years.select("year_ahead", "product_type", (F.col("q") * f).alias("expected_deaths"), (F.col("c") * f).alias("expected_claims"))


# The oracle adds the years one by one; the job uses the closed form.
_gaap = """SELECT *, greatest(0, pv_benefits - pv_premiums - dac_balance) AS gaap_reserve FROM (SELECT p.*, 0.035::DOUBLE AS discount_rate,
  face_amount * bf AS pv_benefits, annual_premium * pfac AS pv_premiums, greatest(0, face_amount * 0.05::DOUBLE - policy_duration * (face_amount * 0.05::DOUBLE / 20)) AS dac_balance,
  year(issue_date) || '_' || product_type AS cohort FROM policies p
  JOIN (SELECT age, sum((0.01::DOUBLE + (age - 35) * 0.001::DOUBLE) * power(1 - (0.01::DOUBLE + (age - 35) * 0.001::DOUBLE), t) * power(1.035::DOUBLE, -t - 0.5)) FILTER (t < greatest(1, 65 - age)) AS bf,
          sum(power(0.98::DOUBLE * 0.95::DOUBLE / 1.035::DOUBLE, t)) FILTER (t < greatest(1, least(65 - age, 30))) AS pfac
        FROM (SELECT range::INT AS age FROM range(0, 121)), (SELECT range::INT AS t FROM range(0, 66)) GROUP BY 1) f ON f.age = p.attained_age)"""


@query(
    "R10 R11 R12 R13",
    duck("policies", "SELECT policy_id, cohort, pv_benefits, pv_premiums, dac_balance, gaap_reserve FROM gaap", gaap=_gaap),
    r6="pv_benefits pv_premiums gaap_reserve dac_balance",
)
def gaap_reserves(spark, d):
    return rs.gaap_reserves(cn.policies(spark, d)).select("policy_id", "cohort", "pv_benefits", "pv_premiums", "dac_balance", "gaap_reserve")


@query(
    "A36 R13",
    duck("policies", """SELECT coalesce(cohort, 'ALL') AS cohort, count(*) AS policies, sum(gaap_reserve) AS total_reserve, avg(gaap_reserve) AS average_reserve, avg(discount_rate) AS mean_discount_rate
      FROM gaap GROUP BY GROUPING SETS ((cohort), ())""", gaap=_gaap),
    r2="total_reserve", r4="average_reserve", r6="mean_discount_rate",
)
def gaap_reserve_totals(spark, d):
    r = rs.gaap_reserves(cn.policies(spark, d))
    return r.rollup("cohort").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("gaap_reserve").alias("total_reserve"),
        F.avg("gaap_reserve").alias("average_reserve"), F.avg("discount_rate").alias("mean_discount_rate"),
    ).withColumn("cohort", F.coalesce("cohort", F.lit("ALL")))


def _funded(spark, d):
    return cn.policies(spark, d).withColumns(
        {"account_value": F.col("annual_premium") * F.col("policy_duration"), "guarantee_reserve": F.col("face_amount") * 0.01}
    )


_stat = """SELECT *, CASE WHEN product_type IN ('Term', 'Whole Life') THEN net_level_reserve * CASE WHEN attained_age - issue_age <= 20 THEN least(1.2::DOUBLE, 1 + (20 - (attained_age - issue_age)) * 0.01::DOUBLE) ELSE 1 END
  WHEN product_type = 'Universal Life' THEN annual_premium * policy_duration + face_amount * 0.01::DOUBLE ELSE net_level_reserve END AS statutory_reserve FROM pr"""


@query(
    "R14",
    duck("policies", """SELECT product_type, CASE WHEN product_type IN ('Term','Whole Life') THEN 'CRVM' ELSE 'Other' END AS reserve_method, count(*) AS policies,
      sum(statutory_reserve) AS total_reserve, avg(statutory_reserve) AS average_reserve FROM stat GROUP BY ALL""", lt=LT, pr=_pr, stat=_stat),
    r2="total_reserve", r4="average_reserve",
)
def statutory_reserves_by_product(spark, d):
    r = rs.statutory_reserves(_funded(spark, d), rs.life_table(spark))
    return r.groupBy("product_type", "reserve_method").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("statutory_reserve").alias("total_reserve"), F.avg("statutory_reserve").alias("average_reserve")
    )


def yield_curve(spark, d):
    """Thirty maturities around the mean rate of the claim table: a supplied curve in table form."""
    level = cn.table(spark, d, "lineitem").agg(F.avg("l_tax").alias("y")).scalar()
    return spark.range(1, 31).select(F.col("id").cast("int").alias("maturity"), (level + F.col("id") * 0.0005).alias("yield"))


@query(
    "R15",
    duck("policies", """SELECT policy_id, i AS discount_rate, sum(face_amount * qx * power(1 - qx, t) * power(1 + i, -t - 0.5)) AS economic_reserve FROM (
      SELECT *, (SELECT avg(l_tax) FROM lineitem) + least(30, greatest(1, 65 - attained_age)) * 0.0005::DOUBLE AS i FROM gridded), (SELECT range::INT AS t FROM range(0, 85))
      WHERE t < greatest(1, 85 - attained_age) GROUP BY ALL""", grid=GRID, gridded=GRIDDED),
    r6="economic_reserve discount_rate",
)
def economic_reserves(spark, d):
    p = ex.with_grid_qx(cn.policies(spark, d))
    return rs.economic_reserves(p, yield_curve(spark, d)).select("policy_id", "discount_rate", "economic_reserve")


@query(
    "R16",
    duck("policies", """SELECT policy_id, greatest(0, face_amount * ff - annual_premium * pf) AS check_reserve FROM policies
      JOIN (SELECT t AS duration, sum(q * power(1/1.045::DOUBLE, t)) OVER (ORDER BY t) AS ff, sum(s * power(1/1.045::DOUBLE, t)) OVER (ORDER BY t) AS pf FROM (
        SELECT t, q, product_(t) AS s FROM (SELECT range::INT AS t, 0.002::DOUBLE * power(1.01::DOUBLE, range) AS q FROM range(1, 21))))
      ON duration = least(20, greatest(1, 65 - attained_age))""".replace("product_(t)", "exp(sum(ln(1 - q)) OVER (ORDER BY t))")),
    r6="check_reserve",
)
def locked_in_check_reserves(spark, d):
    return rs.check_reserves(cn.policies(spark, d)).select("policy_id", "check_reserve")


# --- lapse ----------------------------------------------------------------------------

def _bench(y: str) -> str:
    def steps(p):
        return "CASE " + " ".join(f"WHEN {y} >= {k} THEN {v}" for k, v in sorted(rs.LAPSE_BENCHMARK[p].items(), reverse=True)) + " END"

    return f"CASE product_type WHEN 'Whole Life' THEN {steps('Whole Life')} WHEN 'Universal Life' THEN {steps('Universal Life')} ELSE {steps('Term')} END::DOUBLE"


_ult = "CASE product_type WHEN 'Whole Life' THEN 0.02 WHEN 'Universal Life' THEN 0.03 ELSE 0.04 END::DOUBLE"


@query(
    "R18 F21",
    duck("policies", f"""SELECT product_type, policy_year, p AS lapse_probability, {_ult} AS benchmark, p / {_ult} AS relative_to_benchmark,
      CASE WHEN p >= {_ult} * 2 THEN 'high_risk' WHEN p >= {_ult} * 1.5 THEN 'moderate_risk' WHEN p >= {_ult} * 0.5 THEN 'standard_risk' ELSE 'low_risk' END AS risk_category,
      CASE WHEN p > {_ult} * 1.2 THEN 'Above benchmark' WHEN p > {_ult} * 0.8 THEN 'Near benchmark' ELSE 'Below benchmark' END AS assessment,
      1 - power(1 - p, 1/12.0::DOUBLE) AS monthly_rate, 1 - power(power(1 - p, 1/12.0::DOUBLE), 6) AS six_month FROM (
      SELECT product_type, CAST(floor(duration_years) AS INT) AS policy_year, avg(CAST(policy_status IN ('Lapsed','Surrendered') AS INT)) AS p FROM policies WHERE floor(duration_years) BETWEEN 1 AND 15 GROUP BY ALL)"""),
    r6="lapse_probability benchmark relative_to_benchmark monthly_rate six_month",
)
def lapse_risk_against_benchmark(spark, d):
    rates = ex.lapse_rates(cn.policies(spark, d)).where("policy_year > 0").select(
        "product_type", "policy_year", F.col("lapse_rate").alias("lapse_probability")
    )
    p = F.col("lapse_probability")
    return rs.lapse_risk(rates).withColumns({"monthly_rate": rs.monthly_from_annual(p), "six_month": rs.cumulative_lapse(p, 6)})


def _steps_sql(steps: dict[int, float]) -> str:
    return "CASE " + " ".join(f"WHEN year >= {y} THEN {r}" for y, r in sorted(steps.items(), reverse=True)) + f" ELSE {steps[1]} END"


_bench_by_product = "CASE product_type " + " ".join(f"WHEN '{p}' THEN {_steps_sql(s)}" for p, s in rs.LAPSE_BENCHMARK.items()) + f" ELSE {_steps_sql(rs.LAPSE_BENCHMARK['Term'])} END"


@query(
    "R17",
    duck("policies", f"""SELECT segment, CAST(year AS INT) AS policy_year, CAST(sum(n) AS BIGINT) AS policies, sum(ages) / sum(n) AS issue_age, sum(lapsed) / sum(n) AS observed, sum(ages) / sum(n) + year AS age,
      sum(lapsed) / sum(n) * (CAST(sum(n * CAST({_bench_by_product} AS DECIMAL(6,4))) AS DOUBLE) / sum(n)) / 0.06::DOUBLE AS lapse_rate
      FROM (SELECT segment, product_type, count(*) AS n, sum(issue_age) AS ages, sum(CAST(policy_status IN ('Lapsed','Surrendered') AS INT)) AS lapsed FROM (
        SELECT *, unnest(['product_' || product_type, CASE WHEN issue_age <= 35 THEN 'young' WHEN issue_age <= 55 THEN 'middle_aged' ELSE 'mature' END,
          CASE WHEN face_amount <= (SELECT quantile_cont(face_amount, 0.5) FROM policies) THEN 'small_policies' ELSE 'large_policies' END]) AS segment FROM policies) GROUP BY 1, 2), range(1, 21) y(year) GROUP BY segment, year"""),
    r6="issue_age observed age lapse_rate",
)
def cohort_lapse_curves(spark, d):
    p = cn.policies(spark, d)
    median = exact_quantiles(p, [], "face_amount", {"m": 0.5}).select("m").scalar()
    return rs.lapse_curves(rs.lapse_segments(p, median))


@query(
    "R19",
    duck("policies", """SELECT drivers, count(*) AS policies, sum(annual_premium) AS premium FROM (SELECT annual_premium,
      CASE WHEN policy_duration <= 2 AND round(annual_premium / face_amount * 1000, 6) > 25 THEN 'first_two_years; premium_over_25_per_1000'
           WHEN policy_duration <= 2 THEN 'first_two_years' WHEN round(annual_premium / face_amount * 1000, 6) > 25 THEN 'premium_over_25_per_1000' ELSE 'none' END AS drivers
      FROM policies) GROUP BY 1"""),
    r2="premium",
)
def lapse_drivers(spark, d):
    return rs.lapse_drivers(cn.policies(spark, d)).groupBy(F.array_join("drivers", "; ").alias("drivers")).agg(
        F.count(F.lit(1)).alias("policies"), F.sum("annual_premium").alias("premium")
    )


@query(
    "R20",
    duck("policies", """SELECT product_type, s AS base_sensitivity, s * 1.0 AS rate_up_100bp, s * 0.5 AS rate_down_100bp, n AS policies, l * (1 + s) AS stressed_lapse_rate FROM (
      SELECT product_type, count(*) AS n, avg(CAST(policy_status IN ('Lapsed','Surrendered') AS INT)) AS l,
      CASE product_type WHEN 'Term' THEN 0.05 WHEN 'Whole Life' THEN 0.15 WHEN 'Universal Life' THEN 0.25 WHEN 'Variable' THEN 0.20 ELSE 0.10 END::DOUBLE AS s FROM policies GROUP BY 1)"""),
    r6="base_sensitivity rate_up_100bp rate_down_100bp stressed_lapse_rate",
)
def lapse_interest_sensitivity(spark, d):
    r = ex.lapse_rates(cn.policies(spark, d)).where("policy_year = 0")
    s = rs.lookup(F.col("product_type"), rs.INTEREST_SENSITIVITY, 0.10)
    return r.withColumn("base_sensitivity", s).select(
        "product_type", "base_sensitivity", (s * 1.0).alias("rate_up_100bp"), (s * 0.5).alias("rate_down_100bp"),
        F.col("policies_at_risk").alias("policies"), (F.col("lapse_rate") * (1 + s)).alias("stressed_lapse_rate"),
    )


# --- commercial premium ------------------------------------------------------------------

def _priced(spark, d):
    p = rs.net_premiums(cn.policies(spark, d), rs.life_table(spark))
    k = F.col("policy_id")
    return rs.classify_policies(rs.price_policies(p.withColumns(
        {
            "mortality_factor": F.lit(0.2) + (k % 29) * 0.1,
            "lapse_probability": rs.benchmark_lapse(F.col("product_type"), F.col("policy_duration")) + (k % 5) * 0.02,
            "economic_factor": rs.economic_factor(F.lit(0.01) + (k % 6) * 0.01, (k % 4 - 1) * 0.01, F.lit(0.03) + (k % 7) * 0.01),
        }
    )))


_priced_sql = f"""SELECT *, (commercial_premium - adjusted_premium) / commercial_premium AS profit_margin, commercial_premium / face_amount * 1000 AS rate_per_1000,
  CASE WHEN s >= 6 THEN 'high_risk' WHEN s >= 3 THEN 'moderate_risk' ELSE 'standard_risk' END AS risk_class,
  adjusted_premium <= net_premium * 3 AND commercial_premium <= face_amount * 0.1::DOUBLE AS compliant, ((m - 1) * 2 + l * 10 + abs(e - 1) * 5) / 3 AS overall_risk_score FROM (
  SELECT *, greatest(face_amount * 0.001::DOUBLE, least(face_amount * 0.1::DOUBLE, adjusted_premium * (1 + 0.05::DOUBLE + 0.15::DOUBLE + 0.03::DOUBLE))) AS commercial_premium,
    CASE WHEN m > 2 THEN 3 WHEN m > 1.5 THEN 2 WHEN m > 1.2 THEN 1 ELSE 0 END + CASE WHEN l > 0.15 THEN 2 WHEN l > 0.1 THEN 1 ELSE 0 END
    + CASE WHEN issue_age >= 65 THEN 2 WHEN issue_age >= 55 THEN 1 ELSE 0 END + CASE WHEN face_amount >= 5000000 THEN 2 WHEN face_amount >= 1000000 THEN 1 ELSE 0 END AS s FROM (
    SELECT *, greatest(net_premium * 0.5, least(net_premium * 3::DOUBLE, net_premium * m * greatest(0.7, 1 - (l - 0.05::DOUBLE) * 0.3::DOUBLE) * e)) AS adjusted_premium FROM (
      SELECT *, pv_benefits / pv_annuity AS net_premium, greatest(0.25::DOUBLE, least(5.0::DOUBLE, 0.2::DOUBLE + (policy_id % 29) * 0.1::DOUBLE)) AS m,
        greatest(0.001::DOUBLE, least(0.5::DOUBLE, {_bench('policy_duration')} + (policy_id % 5) * 0.02::DOUBLE)) AS l,
        greatest(0.9, least(1.3::DOUBLE, CASE WHEN 0.01::DOUBLE + (policy_id % 6) * 0.01::DOUBLE > 0.05::DOUBLE THEN 1.1::DOUBLE WHEN 0.01::DOUBLE + (policy_id % 6) * 0.01::DOUBLE < 0.02::DOUBLE THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END
          * CASE WHEN (policy_id % 4 - 1) * 0.01::DOUBLE < 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN 0.03::DOUBLE + (policy_id % 7) * 0.01::DOUBLE > 0.08::DOUBLE THEN 1.10::DOUBLE ELSE 1.0::DOUBLE END)) AS e FROM np)))"""


@query(
    "G13 G14 G16",
    duck("policies", "SELECT policy_id, net_premium, adjusted_premium, commercial_premium, profit_margin, rate_per_1000, risk_class, compliant, overall_risk_score FROM priced", lt=LT, np=_np, priced=_priced_sql),
    r6="net_premium adjusted_premium commercial_premium profit_margin rate_per_1000 overall_risk_score",
)
def commercial_premiums(spark, d):
    return _priced(spark, d).select(
        "policy_id", "net_premium", "adjusted_premium", "commercial_premium", "profit_margin", "rate_per_1000", "risk_class", "compliant", "overall_risk_score"
    )


@query(
    "A33",
    duck("policies", """SELECT *, greatest(share_standard, share_moderate, share_high) AS concentration_risk, 1 - greatest(share_standard, share_moderate, share_high) AS diversification_score,
      CASE WHEN share_high > 0.2 THEN 'high' WHEN share_moderate > 0.4 THEN 'moderate' ELSE 'standard' END AS portfolio_risk,
      CASE WHEN policies > 100 THEN 0.05 WHEN policies > 50 THEN 0.03 ELSE 0 END::DOUBLE AS diversification_benefit FROM (
      SELECT product_type, count(*) AS policies, sum(commercial_premium) AS total_premium, avg(commercial_premium) AS average_premium, stddev_pop(commercial_premium) AS premium_sd,
      avg(profit_margin) AS average_margin, avg(overall_risk_score) AS average_risk_score, count(*) FILTER (risk_class = 'high_risk') AS high_risk_policies, count(*) FILTER (NOT compliant) AS non_compliant_policies,
      avg(CAST(risk_class = 'standard_risk' AS INT)) AS share_standard, avg(CAST(risk_class = 'moderate_risk' AS INT)) AS share_moderate, avg(CAST(risk_class = 'high_risk' AS INT)) AS share_high
      FROM priced GROUP BY 1)""", lt=LT, np=_np, priced=_priced_sql),
    r2="total_premium", r4="average_premium premium_sd", r6="average_margin average_risk_score share_standard share_moderate share_high concentration_risk diversification_score diversification_benefit",
)
def priced_portfolio_rollup(spark, d):
    return rs.priced_portfolio(_priced(spark, d), ["product_type"])


@query(
    "G15",
    duck("policies", """SELECT product_type, count(*) AS policies, sum(gaap_reserve * (1 - l * 0.1)) AS adjusted_gaap, sum(statutory_reserve * (1 - l * 0.1)) AS adjusted_statutory,
      sum(gaap_reserve * 0.9) AS economic_reserve, avg(1 + greatest(0, (m - 1) * 0.5) + greatest(0, (l - 0.05::DOUBLE) * 2)) AS capital_risk_factor
      FROM priced JOIN (SELECT policy_id, gaap_reserve FROM gaap) USING (policy_id) JOIN (SELECT policy_id, statutory_reserve FROM stat) USING (policy_id) GROUP BY 1""",
      lt=LT, np=_np, priced=_priced_sql, pr=_pr, stat=_stat, gaap=_gaap),
    r2="adjusted_gaap adjusted_statutory economic_reserve", r6="capital_risk_factor",
)
def adjusted_reserves_by_product(spark, d):
    k = F.col("policy_id")
    p = rs.statutory_reserves(rs.gaap_reserves(_funded(spark, d)), rs.life_table(spark)).withColumns(
        {
            "mortality_factor": F.greatest(F.lit(0.25), F.lit(0.2) + (k % 29) * 0.1),
            "lapse_probability": rs.benchmark_lapse(F.col("product_type"), F.col("policy_duration")) + (k % 5) * 0.02,
        }
    )
    return rs.adjusted_reserves(p).groupBy("product_type").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("adjusted_gaap").alias("adjusted_gaap"), F.sum("adjusted_statutory").alias("adjusted_statutory"),
        F.sum("economic_reserve").alias("economic_reserve"), F.avg("capital_risk_factor").alias("capital_risk_factor"),
    )
