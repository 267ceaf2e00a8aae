"""Treaty and deal pricing, capital, stress and assumption governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import canonical as cn
from ..operators import capital as cp
from ..operators import experience as ex
from ..operators import portfolio as pf
from ..operators import reserves as rs
from ..operators import treaty as ty
from .duck import duck
from .experience import _summary
from .registry import query

# --- treaties ------------------------------------------------------------------


def _analysis(spark, d):
    years = cn.cedent_years(spark, d)
    by_treaty = cn.claims(spark, d).groupBy("treaty_id").agg(F.sum("claim_amount").alias("a"))
    top = (
        by_treaty.join(cn.treaties(spark, d).select("treaty_id", "cedent_id", "business_line"), "treaty_id")
        .groupBy("cedent_id", "business_line").agg(F.sum("a").alias("a"))
        .groupBy("cedent_id").agg((F.max("a") / F.sum("a")).alias("top_share"))
    )
    return ex.cedent_experience(years).join(ex.weighted_recent(years), "cedent_id", "left").join(top, "cedent_id", "left")


def _priced(spark, d):
    return ty.price_treaties(cn.treaties(spark, d), _analysis(spark, d))


_an = """SELECT *, CASE WHEN recent_loss_ratio < mean_loss_ratio * 0.95 THEN 'improving' WHEN recent_loss_ratio > mean_loss_ratio * 1.05 THEN 'deteriorating' ELSE 'stable' END AS loss_trend,
  CASE WHEN mean_ae < 0.85 THEN 'excellent' WHEN mean_ae < 1 THEN 'good' WHEN mean_ae > 1.2 THEN 'poor' ELSE 'average' END AS uq,
  CASE WHEN recent_premium > 100000000 THEN 'large' WHEN recent_premium > 10000000 THEN 'medium' ELSE 'small' END AS size_category,
  CASE WHEN top_share > 0.4 THEN 'high' WHEN top_share > 0.25 THEN 'medium' ELSE 'low' END AS cr FROM (
  SELECT cedent_id, count(*) AS years, avg(loss_ratio) FILTER (rn <= 3) AS recent_loss_ratio, avg(loss_ratio) AS mean_loss_ratio, stddev_pop(loss_ratio) AS sd, arg_max(premium_volume, year) AS recent_premium, avg(ae_ratio) AS mean_ae,
    sum(CASE rn WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.2::DOUBLE END * loss_ratio) AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY cedent_id ORDER BY year DESC) AS rn FROM cedent_years) GROUP BY 1)
  JOIN (SELECT cedent_id, max(a) / sum(a) AS top_share FROM (SELECT cedent_id, business_line, sum(claim_amount) AS a FROM claims JOIN treaties USING (treaty_id) GROUP BY ALL) GROUP BY 1) USING (cedent_id)"""
_tp = """SELECT *, technical_rate + loading AS gross_rate, technical_rate * exp(2.5758293035489004::DOUBLE * sdx - 0.5 * sdx * sdx) AS var_995 FROM (
  SELECT *, expense_ratio + profit_margin + capital_charge / 100 AS loading FROM (
  SELECT t.treaty_id, t.treaty_type, a.uq, a.cr, a.loss_trend,
    CASE WHEN years >= 3 THEN sd ELSE 0.3 END AS sdx,
    greatest(0.05, least(2.0, CASE WHEN years >= 3 THEN w ELSE CASE WHEN business_line = 'group_life' THEN 0.72 WHEN business_line = 'annuities' THEN 0.45 ELSE 0.68 END END
      * CASE treaty_type WHEN 'quota_share' THEN 1.0 WHEN 'surplus_share' THEN 0.85 WHEN 'excess_of_loss' THEN 0.45 ELSE 0.25 END::DOUBLE)) AS base_loss_ratio,
    base_loss_ratio * CASE uq WHEN 'excellent' THEN 0.9 WHEN 'good' THEN 0.95 WHEN 'poor' THEN 1.2 ELSE 1 END::DOUBLE * CASE cr WHEN 'low' THEN 1.0 WHEN 'medium' THEN 1.05 ELSE 1.15 END::DOUBLE
      * CASE loss_trend WHEN 'deteriorating' THEN 1.1 WHEN 'improving' THEN 0.95 ELSE 1 END::DOUBLE * CASE size_category WHEN 'small' THEN 1.2 WHEN 'medium' THEN 1.05 ELSE 1 END::DOUBLE AS technical_rate,
    CASE treaty_type WHEN 'quota_share' THEN 0.25 WHEN 'surplus_share' THEN 0.2 WHEN 'excess_of_loss' THEN 0.15 ELSE 0.12 END::DOUBLE
      * CASE WHEN recent_premium > 500000000 THEN 0.8 WHEN recent_premium > 100000000 THEN 0.9 WHEN recent_premium < 10000000 THEN 1.3 ELSE 1 END::DOUBLE AS expense_ratio,
    recent_premium / (0.008::DOUBLE * 1.4::DOUBLE) * CASE WHEN business_line = 'group_life' THEN 0.06 WHEN business_line = 'annuities' THEN 0.025 ELSE 0.045 END::DOUBLE
      * CASE treaty_type WHEN 'quota_share' THEN 1.0 WHEN 'surplus_share' THEN 0.8 WHEN 'excess_of_loss' THEN 1.5 ELSE 2.0 END::DOUBLE AS required_capital,
    required_capital * 0.12::DOUBLE / recent_premium * 100 AS capital_charge,
    0.12::DOUBLE * CASE treaty_type WHEN 'quota_share' THEN 1.0 WHEN 'surplus_share' THEN 1.1 WHEN 'excess_of_loss' THEN 1.4 ELSE 1.8 END::DOUBLE * CASE uq WHEN 'excellent' THEN 0.9 WHEN 'good' THEN 0.9 WHEN 'poor' THEN 1.3 ELSE 1 END::DOUBLE AS profit_margin
  FROM treaties t JOIN an a USING (cedent_id)))"""


@query(
    "G1 G2 G3 G4 G5 G6 G7",
    duck("cedent_years", """SELECT treaty_id, treaty_type, base_loss_ratio, technical_rate, expense_ratio, required_capital, capital_charge, profit_margin, loading, gross_rate, var_995,
      var_995 * 1.2 AS expected_shortfall, gross_rate - technical_rate - expense_ratio AS expected_profit, gross_rate - expense_ratio AS break_even_loss_ratio FROM tp""", an=_an, tp=_tp),
    r2="required_capital", r6="base_loss_ratio technical_rate expense_ratio capital_charge profit_margin loading gross_rate var_995 expected_shortfall expected_profit break_even_loss_ratio",
)
def treaty_rates(spark, d):
    return _priced(spark, d).select(
        "treaty_id", "treaty_type", "base_loss_ratio", "technical_rate", "expense_ratio", "required_capital", "capital_charge", "profit_margin",
        "loading", "gross_rate", "var_995", "expected_shortfall", "expected_profit", "break_even_loss_ratio",
    )


@query(
    "G8",
    duck("cedent_years", """SELECT treaty_id, unnest(['loss_ratio_up_10','loss_ratio_down_10','expenses_up_20','volume_up_50','volume_down_25']) AS shock,
      unnest([(technical_rate * 1.1 + loading) / gross_rate - 1, (technical_rate * 0.9 + loading) / gross_rate - 1, (technical_rate + loading * 1.2) / gross_rate - 1, -0.15::DOUBLE, 0.12::DOUBLE]) AS change FROM tp""", an=_an, tp=_tp),
    r6="change",
)
def treaty_rate_sensitivities(spark, d):
    return ty.treaty_sensitivities(_priced(spark, d), ["treaty_id"])


_list = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '; ')"


@query(
    "G9",
    duck("cedent_years", f"""SELECT treaty_id, key_risks, recommendations, CASE WHEN f >= 2 AND n <= 2 THEN 'High' WHEN n >= 4 THEN 'Low' ELSE 'Medium' END AS confidence FROM (
      SELECT treaty_id, CAST(loss_trend = 'stable' AS INT) + CAST(uq IN ('excellent','good') AS INT) AS f,
      CAST(loss_trend <> 'stable' AS INT) + CAST(uq NOT IN ('excellent','good') AS INT) + CAST(cr = 'high' AS INT) + CAST(treaty_type = 'excess_of_loss' AS INT) AS n,
      {_list.format("CASE WHEN loss_trend <> 'stable' THEN 'loss_trend' END, CASE WHEN uq NOT IN ('excellent','good') THEN 'underwriting' END, CASE WHEN cr = 'high' THEN 'concentration' END, CASE WHEN treaty_type = 'excess_of_loss' THEN 'severity' END")} AS key_risks,
      {_list.format("CASE WHEN uq IN ('excellent','good') THEN 'better_terms' END, CASE WHEN cr = 'high' THEN 'limit_territory' END, CASE WHEN treaty_type = 'excess_of_loss' THEN 'catastrophe_reserve' END, CASE WHEN gross_rate > 0.8 THEN 'rate_above_market' END, CASE WHEN gross_rate < 0.3 THEN 'rate_below_losses' END")} AS recommendations
      FROM tp)""", an=_an, tp=_tp),
)
def treaty_recommendations(spark, d):
    a = ty.treaty_advice(_priced(spark, d))
    return a.select("treaty_id", F.array_join("key_risks", "; ").alias("key_risks"), F.array_join("recommendations", "; ").alias("recommendations"), "confidence")


@query(
    "J17",
    duck("claims treaties", """SELECT treaty_id, treaty_type, count(*) AS claims, sum(ceded) AS reinsurance_amount, sum(kept) AS retained_amount FROM (
      SELECT treaty_id, treaty_type, CASE WHEN treaty_type IN ('quota_share','surplus_share') THEN CASE WHEN claim_amount * (1 - retention_rate) > 1000 THEN claim_amount * (1 - retention_rate) END
        WHEN claim_amount > retention THEN least(claim_amount - retention, limit_amount) END AS ceded,
        CASE WHEN treaty_type IN ('quota_share','surplus_share') THEN claim_amount * retention_rate ELSE retention END AS kept
      FROM claims JOIN treaties USING (treaty_id)) WHERE ceded IS NOT NULL GROUP BY ALL"""),
    r2="reinsurance_amount retained_amount",
)
def ceded_claims_by_treaty(spark, d):
    return ty.cede_claims(cn.claims(spark, d), cn.treaties(spark, d)).groupBy("treaty_id", "treaty_type").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("reinsurance_amount").alias("reinsurance_amount"), F.sum("retained_amount").alias("retained_amount")
    )


# --- deals -----------------------------------------------------------------------

def _deals(spark, d):
    """One row per submission: premium, lines, credibility, risk score and its own loss ratio."""
    p = cn.policies(spark, d, with_state=True)
    risk = pf.exposure_credibility(pf.submission_risk_score(pf.portfolio_summary(p)))
    premium = p.groupBy("submission_id").agg(F.sum("annual_premium").alias("annual_premium"))
    per_policy = cn.claims(spark, d).groupBy("policy_id").agg(F.sum("recovery").alias("r"))
    loss = (
        cn.policies(spark, d).select("policy_id", "submission_id", "annual_premium").join(per_policy, "policy_id", "left")
        .groupBy("submission_id").agg((F.sum("r") / F.sum("annual_premium") / 2).alias("cedent_loss_ratio"))
    )
    k = F.substring("submission_id", 5, 2).cast("int")
    first, second = cn.pick(k % 5, cn.LINES), cn.pick((k * 3 + 1) % 5, cn.LINES)
    return risk.join(premium, "submission_id").join(loss, "submission_id").withColumns(
        {"treaty_type": cn.pick(k % 4, cn.TREATY_TYPES), "lines": F.array_distinct(F.array(first, second))}
    )


_L = "['individual_life_term','individual_life_universal','individual_life_whole','group_life','annuities']"


def _avg_line(values: dict[str, float]) -> str:
    case = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END::DOUBLE"
    return f"list_sum(list_transform(lines, lambda x: {case})) / len(lines)"


_deal = f"""SELECT *, expected_loss_ratio + expense_ratio + risk_margin + capital_charge AS gross_rate FROM (
  SELECT *, (lr * z + {_avg_line(ty.DEAL_BENCHMARK)} * (1 - z)) * (1 + (risk - 5) * 0.02::DOUBLE) AS expected_loss_ratio,
    CASE tt WHEN 'quota_share' THEN 0.25 WHEN 'surplus_share' THEN 0.2 WHEN 'excess_of_loss' THEN 0.15 ELSE 0.12 END::DOUBLE * CASE WHEN prem > 500000000 THEN 0.85 WHEN prem > 100000000 THEN 0.92 WHEN prem < 10000000 THEN 1.2 ELSE 1 END::DOUBLE AS expense_ratio,
    CASE tt WHEN 'quota_share' THEN 0.08 WHEN 'surplus_share' THEN 0.1 WHEN 'excess_of_loss' THEN 0.15 ELSE 0.18 END::DOUBLE * (0.8::DOUBLE + risk / 10 * 0.4::DOUBLE) * (1 + (1 - z) * 0.3::DOUBLE) AS risk_margin,
    {_avg_line(ty.CAPITAL_BY_LINE)} * CASE tt WHEN 'quota_share' THEN 1.0 WHEN 'surplus_share' THEN 0.9 WHEN 'excess_of_loss' THEN 1.4 ELSE 1.6 END::DOUBLE * 0.12::DOUBLE AS capital_charge,
    CASE WHEN z > 0.8 THEN 3 WHEN z > 0.6 THEN 2 WHEN z > 0.4 THEN 1 ELSE 0 END + CASE WHEN risk <= 5 THEN 2 WHEN risk <= 7 THEN 1 ELSE 0 END + CASE WHEN len(lines) >= 2 THEN 1 ELSE 0 END AS conf FROM (
  SELECT submission_id, prem, lr, least(1.0::DOUBLE, sqrt(policy_count * 3 / 100000.0::DOUBLE)) * 0.8::DOUBLE AS z,
    least(10.0, 5.0 + CASE WHEN g > 0.4 THEN 1.5 WHEN g > 0.25 THEN 0.5 ELSE 0 END + CASE WHEN pr > 0.7 THEN 1.0 ELSE 0 END + CASE WHEN a > 55 THEN 0.8 WHEN a < 30 THEN 0.5 ELSE 0 END + CASE WHEN s > 0.25 THEN 1.2 ELSE 0 END + CASE WHEN f > 1000000 THEN 0.7 ELSE 0 END)::DOUBLE AS risk,
    (['quota_share','surplus_share','excess_of_loss','stop_loss'])[k % 4 + 1] AS tt, CASE WHEN k % 5 = (k * 3 + 1) % 5 THEN [({_L})[k % 5 + 1]] ELSE [({_L})[k % 5 + 1], ({_L})[(k * 3 + 1) % 5 + 1]] END AS lines
  FROM (SELECT submission_id, policy_count, top_state_concentration AS g, top_product_share AS pr, avg_issue_age AS a, smoker_percentage AS s, avg_face_amount AS f, CAST(substr(submission_id, 5, 2) AS INT) AS k FROM summary)
  JOIN (SELECT submission_id, sum(annual_premium) AS prem, sum(r) / sum(annual_premium) / 2 AS lr FROM policies LEFT JOIN (SELECT policy_id, sum(recovery) AS r FROM claims GROUP BY 1) USING (policy_id) GROUP BY 1) USING (submission_id)))"""


@query(
    "G10",
    duck("policies_state claims", """SELECT submission_id, expected_loss_ratio, expense_ratio, risk_margin, capital_charge, gross_rate, gross_rate * 1000 AS rate_per_1000,
      gross_rate - expense_ratio AS break_even_loss_ratio, gross_rate - expected_loss_ratio - expense_ratio AS profit_margin, CASE WHEN conf >= 5 THEN 'High' WHEN conf >= 3 THEN 'Medium' ELSE 'Low' END AS confidence_level,
      CASE WHEN prem < 25000000 THEN 'auto' WHEN prem <= 100000000 THEN 'standard' WHEN prem <= 500000000 THEN 'chief underwriter' ELSE 'board' END AS approval FROM deal""", summary=_summary, deal=_deal),
    r6="expected_loss_ratio expense_ratio risk_margin capital_charge gross_rate rate_per_1000 break_even_loss_ratio profit_margin",
)
def deal_pricing(spark, d):
    return ty.price_deals(_deals(spark, d)).select(
        "submission_id", "expected_loss_ratio", "expense_ratio", "risk_margin", "capital_charge", "gross_rate", "rate_per_1000",
        "break_even_loss_ratio", "profit_margin", "confidence_level", ty.approval_tier(F.col("annual_premium")).alias("approval"),
    )


@query(
    "G8 S20",
    duck("policies_state claims", """SELECT submission_id, (expected_loss_ratio * 1.1 + expense_ratio + risk_margin + capital_charge) / gross_rate - 1 AS mortality_up_10,
      (expected_loss_ratio * 0.9 + expense_ratio + risk_margin + capital_charge) / gross_rate - 1 AS mortality_down_10, (expected_loss_ratio + expense_ratio * 1.2 + risk_margin + capital_charge) / gross_rate - 1 AS expenses_up_20,
      (expected_loss_ratio + expense_ratio + risk_margin * 1.25 + capital_charge) / gross_rate - 1 AS risk_margin_up_25,
      (expected_loss_ratio * 1.1 + expense_ratio * 1.2 + risk_margin * 1.25 + capital_charge) / gross_rate - 1 AS all_adverse FROM deal""", summary=_summary, deal=_deal),
    r6="mortality_up_10 mortality_down_10 expenses_up_20 risk_margin_up_25 all_adverse",
)
def deal_rate_sensitivities(spark, d):
    return ty.deal_sensitivities(ty.price_deals(_deals(spark, d)), "submission_id")


_adv = """CASE WHEN gross_rate > 1.2 THEN 'rate_over_120' END, CASE WHEN gross_rate > 1.0 AND gross_rate <= 1.2 THEN 'rate_over_100' END,
  CASE WHEN gross_rate < 0.7 THEN 'rate_under_70' END, CASE WHEN expected_loss_ratio > 0.9 THEN 'loss_ratio_over_90' END,
  CASE WHEN expected_loss_ratio < 0.5 THEN 'loss_ratio_under_50' END, CASE WHEN risk_margin > 0.15 THEN 'risk_margin_over_15' END,
  CASE WHEN conf < 3 THEN 'low_confidence' END, CASE WHEN conf < 3 THEN 'more_data' END, CASE WHEN conf >= 5 THEN 'standard_terms' END"""


@query(
    "G9",
    duck("policies_state claims", f"""SELECT submission_id, CASE WHEN r = '' THEN 'no_finding' ELSE r END AS recommendations
      FROM (SELECT submission_id, {_list.format(_adv)} AS r FROM deal)""", summary=_summary, deal=_deal),
)
def deal_recommendations(spark, d):
    return ty.deal_advice(ty.price_deals(_deals(spark, d))).select("submission_id", F.array_join("recommendations", "; ").alias("recommendations"))


@query(
    "G21",
    duck("policies_state claims", f"""SELECT submission_id, prem AS annual_premium, CASE WHEN prem < 25000000 THEN 'auto' WHEN prem <= 100000000 THEN 'standard' WHEN prem <= 500000000 THEN 'chief underwriter' ELSE 'board' END AS approval,
      {_list.format("CASE WHEN g > 0.35 THEN 'state_share' END, CASE WHEN pr > 0.55 THEN 'product_share' END, CASE WHEN lr > 1.15 THEN 'loss_ratio' END, CASE WHEN policy_count < 1000 THEN 'policy_count' END, CASE WHEN z < 0.08 THEN 'credibility' END")} AS breaches
      FROM deal JOIN (SELECT submission_id, policy_count, top_state_concentration AS g, top_product_share AS pr FROM summary) USING (submission_id)""", summary=_summary, deal=_deal),
    r2="annual_premium",
)
def deal_approval_and_limits(spark, d):
    m = _deals(spark, d).withColumnsRenamed(
        {"top_state_concentration": "state_share", "top_product_share": "product_share", "cedent_loss_ratio": "loss_ratio", "mortality_credibility": "credibility"}
    )
    return ty.limit_breaches(m).select(
        "submission_id", "annual_premium", ty.approval_tier(F.col("annual_premium")).alias("approval"), F.array_join("breaches", "; ").alias("breaches")
    )


@query(
    "G22 A40",
    """SELECT scenario, t + a AS risk_free_rate, t + s AS discount_rate, i + b AS inflation_rate, 1 - (t + s - 0.04::DOUBLE) * 2 AS rate_impact, 1 - (i + b - 0.03::DOUBLE) * 1.5 AS inflation_impact,
      v * (1 - (t + s - 0.04::DOUBLE) * 2) * (1 - (i + b - 0.03::DOUBLE) * 1.5) AS portfolio_value, ((1 - (t + s - 0.04::DOUBLE) * 2) * (1 - (i + b - 0.03::DOUBLE) * 1.5) - 1) * 100 AS change_pct
      FROM (SELECT avg(l_discount) AS t, avg(l_tax) AS i FROM lineitem), (SELECT sum(o_totalprice) AS v FROM orders),
      (VALUES ('optimistic', 0.005::DOUBLE, -0.005::DOUBLE, 0.005::DOUBLE), ('base', 0.0::DOUBLE, 0.0::DOUBLE, 0.008::DOUBLE), ('pessimistic', -0.010::DOUBLE, 0.010::DOUBLE, 0.015::DOUBLE)) x(scenario, a, b, s)""",
    r2="portfolio_value", r6="risk_free_rate discount_rate inflation_rate rate_impact inflation_impact change_pct",
)
def economic_scenario_impact(spark, d):
    curve = cn.table(spark, d, "lineitem").agg(F.avg("l_discount").alias("treasury_10y"), F.avg("l_tax").alias("inflation"))
    value = cn.policies(spark, d).agg(F.sum("face_amount").alias("v")).scalar()
    return cp.scenario_impact(ty.rate_scenarios(curve).withColumn("v", value), "v").drop("v")


# --- capital ------------------------------------------------------------------------

_ratings = ["aaa", "aa", "a", "bbb", "bb", "b", "ccc", "stocks", "mortgages", "real_estate", "unrated"]


def _companies(spark, d):
    """Companies are submissions; premiums of their policies stand for the holdings by rating."""
    p = cn.policies(spark, d)
    holdings = p.groupBy("submission_id", cn.pick(F.col("policy_id") % 11, _ratings).alias("rating")).agg(F.sum("annual_premium").alias("amount"))
    c1 = cp.asset_charge(holdings, ["submission_id"])
    k = F.col("k")
    base = p.groupBy("submission_id").agg(F.sum("face_amount").alias("face_amount"), F.sum("annual_premium").alias("annual_premiums"))
    return base.join(c1, "submission_id").withColumn("k", F.substring("submission_id", 5, 2).cast("int")).withColumns(
        {
            "claim_reserves": F.col("annual_premiums") * 0.5, "policy_reserves": F.col("annual_premiums") * 5, "withdrawable_reserves": F.col("annual_premiums") * 2,
            "total_reserves": F.col("annual_premiums") * 6, "asset_duration": (F.lit(5) + k % 7).cast("double"), "liability_duration": F.lit(8.0),
            "operating_expenses": F.col("annual_premiums") * 0.1, "surplus": F.col("face_amount") * (F.lit(0.01) + (k % 10) * 0.008),
        }
    )


_rbc = """SELECT submission_id, prem, face, c1 * 0.85 AS c1_asset_risk, face * 0.015::DOUBLE + prem * 0.5 * 0.125 + prem * 5 * 0.05::DOUBLE AS c2_insurance_risk,
  prem * 2 * 0.1::DOUBLE + CASE WHEN abs(5 + k % 7 - 8) > 2 THEN prem * 6 * 0.05::DOUBLE * (abs(5 + k % 7 - 8) - 2) ELSE 0 END AS c3_interest_risk, prem * 0.025::DOUBLE + prem * 0.1::DOUBLE * 0.01::DOUBLE AS c4_business_risk,
  c1 * 0.85 + sqrt(c2_insurance_risk**2 + c3_interest_risk**2 + c4_business_risk**2) AS total_rbc, face * (0.01::DOUBLE + (k % 10) * 0.008::DOUBLE) / (c1 * 0.85 + sqrt(c2_insurance_risk**2 + c3_interest_risk**2 + c4_business_risk**2)) AS rbc_ratio
  FROM (SELECT submission_id, sum(annual_premium) AS prem, sum(face_amount) AS face, CAST(substr(submission_id, 5, 2) AS INT) AS k,
    sum(annual_premium * ([0.003,0.005,0.01,0.02,0.045,0.1,0.23,0.3,0.05,0.15,0.1]::DOUBLE[])[policy_id % 11 + 1]) AS c1 FROM policies GROUP BY ALL)"""


@query(
    "A37 A38",
    duck("policies", """SELECT submission_id, c1_asset_risk, c2_insurance_risk, c3_interest_risk, c4_business_risk, total_rbc, rbc_ratio,
      CASE WHEN rbc_ratio >= 2 THEN 'No Action' WHEN rbc_ratio >= 1.5 THEN 'Company Action Level' WHEN rbc_ratio >= 1 THEN 'Regulatory Action Level' WHEN rbc_ratio >= 0.7 THEN 'Authorized Control Level' ELSE 'Mandatory Control Level' END AS action_level,
      CASE WHEN rbc_ratio >= 2 THEN 'Adequate' ELSE 'Inadequate' END AS adequacy FROM rbc""", rbc=_rbc),
    r2="c1_asset_risk c2_insurance_risk c3_interest_risk c4_business_risk total_rbc", r6="rbc_ratio",
)
def risk_based_capital(spark, d):
    return cp.risk_based_capital(_companies(spark, d)).select(
        "submission_id", "c1_asset_risk", "c2_insurance_risk", "c3_interest_risk", "c4_business_risk", "total_rbc", "rbc_ratio", "action_level", "adequacy"
    )


def _losses(spark, d):
    """Scenario losses: one per claim event day, as claims less their mean."""
    daily = cn.claims(spark, d).groupBy("loss_date").agg(F.sum("claim_amount").alias("amount"))
    return daily.select((F.col("amount") - daily.agg(F.avg("amount")).scalar()).alias("loss"))


_loss = "SELECT amount - avg(amount) OVER () AS loss FROM (SELECT loss_date, sum(claim_amount) AS amount FROM claims GROUP BY 1)"


@query(
    "A39",
    duck("policies claims", """SELECT *, greatest(0, var_995) AS economic_capital, greatest(0, standalone - greatest(0, var_995)) AS diversification_benefit, greatest(0, standalone - greatest(0, var_995)) / standalone AS capital_efficiency FROM (
      SELECT n_values, var_995, var_99, (SELECT avg(loss) FROM losses WHERE loss >= var_995) AS tail_mean, expected_loss, (SELECT sum(face_amount) FROM policies) * 0.15 AS standalone
      FROM (SELECT count(*) AS n_values, quantile_cont(loss, 0.995) AS var_995, quantile_cont(loss, 0.99) AS var_99, avg(loss) AS expected_loss FROM losses))""", losses=_loss),
    r2="var_995 var_99 tail_mean expected_loss standalone economic_capital diversification_benefit", r6="capital_efficiency",
)
def economic_capital(spark, d):
    exposure = cn.policies(spark, d).agg(F.sum("face_amount").alias("face_amount"))
    return cp.economic_capital(_losses(spark, d), exposure)


@query(
    "G20",
    duck("policies claims", """SELECT *, target_capital - base_capital AS capital_buffer, (target_capital - base_capital) / base_capital AS buffer_share FROM (
      SELECT submission_id, base_capital, e / (base_capital * 2) AS implied_roe, CASE WHEN e / (base_capital * 2) < 0.15::DOUBLE * 0.8::DOUBLE THEN e / 0.15::DOUBLE WHEN e / (base_capital * 2) > 0.15::DOUBLE * 1.5::DOUBLE THEN e / (0.15::DOUBLE * 1.2::DOUBLE) ELSE base_capital * 2 END AS target_capital
      FROM (SELECT submission_id, greatest(total_rbc, (SELECT greatest(0, quantile_cont(loss, 0.995)) FROM losses)) AS base_capital, prem * 0.4 AS e FROM rbc))""", rbc=_rbc, losses=_loss),
    r2="base_capital target_capital capital_buffer", r6="implied_roe buffer_share",
)
def target_capital(spark, d):
    exposure = cn.policies(spark, d).agg(F.sum("face_amount").alias("face_amount"))
    ec = cp.economic_capital(_losses(spark, d), exposure).select("economic_capital").scalar()
    base = cp.risk_based_capital(_companies(spark, d)).withColumns({"economic_capital": ec, "annual_earnings": F.col("annual_premiums") * 0.4})
    return cp.target_capital(base).select("submission_id", "base_capital", "implied_roe", "target_capital", "capital_buffer", "buffer_share")


@query(
    "G23",
    duck("policies", """SELECT product_type, scenario, premium * (1 + m/100.0::DOUBLE) * (1 + r/10000.0::DOUBLE*2) AS stressed_premium, reserve * (1 + m/100.0::DOUBLE) * (1 + l/100.0::DOUBLE*0.3) AS stressed_reserve, capital * (1 + m/100.0::DOUBLE) * sqrt(1 + r/10000.0::DOUBLE*2) AS stressed_capital,
      ((1 + m/100.0::DOUBLE) * (1 + r/10000.0::DOUBLE*2) - 1) * 100 AS premium_change_pct, ((1 + m/100.0::DOUBLE) * (1 + l/100.0::DOUBLE*0.3) - 1) * 100 AS reserve_change_pct, ((1 + m/100.0::DOUBLE) * sqrt(1 + r/10000.0::DOUBLE*2) - 1) * 100 AS capital_change_pct
      FROM (SELECT product_type, sum(annual_premium) AS premium, sum(face_amount) * 0.02::DOUBLE AS reserve, sum(face_amount) * 0.015::DOUBLE AS capital FROM policies GROUP BY 1),
      (VALUES ('Base Case',0,0,0),('Mortality Shock (+25%)',25,0,0),('Mass Lapse (+50%)',0,50,0),('Interest Rate Shock (-200bp)',0,0,-200),('Combined Stress',15,25,-100)) s(scenario, m, l, r)"""),
    r2="stressed_premium stressed_reserve stressed_capital", r6="premium_change_pct reserve_change_pct capital_change_pct",
)
def named_stress_by_product(spark, d):
    base = cn.policies(spark, d).groupBy("product_type").agg(
        F.sum("annual_premium").alias("premium"), (F.sum("face_amount") * 0.02).alias("reserve"), (F.sum("face_amount") * cp.C2_MORTALITY).alias("capital")
    )
    return cp.named_stress(base)


@query(
    "G24",
    duck("policies", """SELECT product_type, variable, CAST(range AS INT) AS shock_pct, v * (1 + range / 100.0::DOUBLE) AS input_value, v * (1 + range * slope / 100) AS output_value, range * slope AS impact_pct
      FROM (SELECT product_type, avg(annual_premium) AS v FROM policies GROUP BY 1), (VALUES ('Mortality Rate', 0.8::DOUBLE), ('Lapse Rate', -0.3::DOUBLE), ('Discount Rate', -1.2::DOUBLE), ('Other', 0.5::DOUBLE)) s(variable, slope), range(-20, 21, 4)"""),
    r4="input_value output_value", r6="impact_pct",
)
def premium_sensitivity_ladder(spark, d):
    return cp.sensitivity_ladder(cn.policies(spark, d).groupBy("product_type").agg(F.avg("annual_premium").alias("v")), "v")


# --- assumptions: order rows stand for override requests ---------------------------------

def _overrides(spark, d):
    o = cn.table(spark, d, "orders")
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        k.alias("override_id"),
        cn.pick(k % 5, list(cp.FLOW_THROUGH)).alias("assumption_type"),
        F.concat(F.lit("set_"), F.col("o_custkey") % 10).alias("set_id"),
        F.concat(cn.pick(k % 5, list(cp.FLOW_THROUGH)), F.lit(".rate_"), k % 7).alias("path"),
        F.lit(1.0).alias("base_value"),
        (F.lit(0.8) + (k % 41) * 0.01).alias("override_value"),
        (F.lit(0.8) + (k % 41) * 0.01).alias("override_factor"),
        day.alias("requested_date"),
        F.date_add(day, 10).alias("approved_date"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"),
        F.when(k % 3 != 0, F.date_add(day, (F.lit(100) + k % 400).cast("int"))).alias("expiry_date"),
    )


_ov = """SELECT o_orderkey AS override_id, (['mortality','economic','lapse','expense','business'])[o_orderkey % 5 + 1] AS assumption_type, 'set_' || (o_custkey % 10) AS set_id,
  (['mortality','economic','lapse','expense','business'])[o_orderkey % 5 + 1] || '.rate_' || (o_orderkey % 7) AS path, 1.0::DOUBLE AS base_value, 0.8::DOUBLE + (o_orderkey % 41) * 0.01::DOUBLE AS override_value,
  CAST(o_orderdate AS DATE) AS requested_date, CAST(o_orderdate AS DATE) + 10 AS approved_date, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(100 + o_orderkey % 400 AS INT) END AS expiry_date FROM orders"""
_ASOF = "2001-06-01"


@query(
    "G18",
    duck("", """SELECT override_id, assumption_type, (override_value - 1) * 100 AS assumption_change_pct, f AS flow_through, (override_value - 1) * 100 * f AS premium_change_pct
      FROM (SELECT *, CASE assumption_type WHEN 'mortality' THEN 0.8 WHEN 'economic' THEN 0.6 WHEN 'lapse' THEN 0.4 WHEN 'expense' THEN 1.0 ELSE 0.3 END::DOUBLE AS f FROM ov)""", ov=_ov),
    r6="assumption_change_pct flow_through premium_change_pct",
)
def override_pricing_impact(spark, d):
    return cp.override_impact(_overrides(spark, d)).select("override_id", "assumption_type", "assumption_change_pct", "flow_through", "premium_change_pct")


@query(
    "P22 A35 W22",
    duck("", f"""SELECT assumption_type, count(*) AS active, count(*) FILTER (approved_date > DATE '{_ASOF}' - 30) AS recent, count(*) FILTER (expiry_date < DATE '{_ASOF}' + 60) AS expiring
      FROM ov WHERE status = 'approved' AND (expiry_date IS NULL OR expiry_date > DATE '{_ASOF}') GROUP BY 1""", ov=_ov),
)
def live_override_summary(spark, d):
    return cp.override_summary(_overrides(spark, d), _ASOF)


@query(
    "W22 A35",
    duck("", f"""SELECT assumption_type, override_id, approved_date, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY assumption_type ORDER BY approved_date DESC, override_id DESC) AS rank
      FROM ov WHERE status = 'approved' AND (expiry_date IS NULL OR expiry_date > DATE '{_ASOF}')) WHERE rank <= 5""", ov=_ov),
    day="approved_date",
)
def recent_overrides(spark, d):
    return cp.recent_overrides(_overrides(spark, d), _ASOF).select("assumption_type", "override_id", "approved_date", "rank")


@query(
    "P23",
    duck("", f"""SELECT override_id, assumption_type, requested_date, status, (override_value / base_value - 1) * 100 AS change_pct FROM ov WHERE requested_date > DATE '{_ASOF}' - 90""", ov=_ov),
    r6="change_pct", day="requested_date",
)
def override_audit_trail(spark, d):
    return cp.override_trail(_overrides(spark, d), _ASOF).select("override_id", "assumption_type", "requested_date", "status", "change_pct")


@query(
    "G19 F20",
    duck("", f"""SELECT set_id, path, CASE WHEN o.value IS NULL THEN b.value ELSE o.value END AS value, o.value IS NOT NULL AS overridden FROM
      (SELECT set_id, path, 1.0::DOUBLE AS value FROM ov GROUP BY ALL) b LEFT JOIN
      (SELECT set_id, path, override_value AS value FROM ov WHERE status = 'approved' AND approved_date <= DATE '{_ASOF}' AND (expiry_date IS NULL OR expiry_date > DATE '{_ASOF}')
       QUALIFY row_number() OVER (PARTITION BY set_id, path ORDER BY approved_date DESC, override_value DESC) = 1) o USING (set_id, path)""", ov=_ov),
    r6="value",
)
def effective_assumptions(spark, d):
    o = _overrides(spark, d)
    base = o.select("set_id", "path", F.col("base_value").alias("value")).distinct()
    ov = o.select("set_id", "path", F.col("override_value").alias("value"), "status", F.col("approved_date").alias("effective_from"), F.col("expiry_date").alias("expires_at"))
    return cp.effective_assumptions(base, ov, _ASOF).select("set_id", "path", "value", "overridden")


@query(
    "F20",
    duck("", """SELECT set_id, max(override_value) FILTER (path = 'mortality.rate_0') AS mortality_rate, count(DISTINCT path) AS paths FROM ov GROUP BY 1""", ov=_ov),
    r6="mortality_rate",
)
def assumption_paths(spark, d):
    o = _overrides(spark, d)
    top = o.groupBy("set_id", "path").agg(F.max("override_value").alias("value"))
    return cp.nested_lookup(top, "set_id").select(
        "set_id", F.try_element_at("settings", F.lit("mortality.rate_0")).alias("mortality_rate"), F.size("settings").cast("long").alias("paths")
    )


@query(
    "P24",
    f"""SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS due_date, date_diff('day', DATE '{_ASOF}', CAST(o_orderdate AS DATE)) AS days_left FROM orders
      WHERE date_diff('day', DATE '{_ASOF}', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 90""",
    day="due_date",
)
def upcoming_due_dates(spark, d):
    day = F.to_date(F.lit(_ASOF))
    left = F.datediff(F.col("due_date"), day)
    due = cn.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("date").alias("due_date"))
    # Bounds on the date itself reach the scan; the day count is only for display.
    return due.where((F.col("due_date") >= day) & (F.col("due_date") <= F.date_add(day, 90))).withColumn("days_left", left.cast("long")).orderBy("due_date", "item_id")
