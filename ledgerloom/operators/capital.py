"""Risk-based and economic capital, stress impacts, assumption governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..refdata import lookup, small_table
from .portfolio import scalars
from .quantiles import exact_quantiles

# Charge per unit of holding.
ASSET_FACTORS = {
    "aaa": 0.003, "aa": 0.005, "a": 0.010, "bbb": 0.020, "bb": 0.045, "b": 0.100, "ccc": 0.230,
    "stocks": 0.30, "mortgages": 0.05, "real_estate": 0.15,
}
UNKNOWN_ASSET = 0.10
C2_MORTALITY, C2_MORBIDITY, C2_LAPSE = 0.015, 0.125, 0.05
C3_WITHDRAWAL, C3_MISMATCH = 0.10, 0.05
C4_GROWTH, C4_OPERATIONAL = 0.025, 0.01
RATING_MULTIPLE = {"AAA": 2.5, "AA": 2.0, "A": 1.5, "BBB": 1.2, "BB": 1.0}


def asset_charge(holdings: DataFrame, by: list[str]) -> DataFrame:
    """Sum of amount times rating factor; an unknown rating takes 10 %."""
    spark = holdings.sparkSession
    factors = small_table(spark, "rating string, factor double", list(ASSET_FACTORS.items()))  # 10 rows
    rated = holdings.withColumn("rating", F.lower("rating")).join(factors, "rating", "left")
    return rated.groupBy(*by).agg(F.sum(F.col("amount") * F.coalesce("factor", F.lit(UNKNOWN_ASSET))).alias("c1"))


def action_level(ratio: Column) -> Column:
    return (
        F.when(ratio >= 2.0, "No Action")
        .when(ratio >= 1.5, "Company Action Level")
        .when(ratio >= 1.0, "Regulatory Action Level")
        .when(ratio >= 0.7, "Authorized Control Level")
        .otherwise("Mandatory Control Level")
    )


def risk_based_capital(company: DataFrame) -> DataFrame:
    """RBC per company from c1, face_amount, claim_reserves, policy_reserves, withdrawable_reserves,
    total_reserves, asset_duration, liability_duration, annual_premiums, operating_expenses, surplus."""
    c = F.col
    gap = F.abs(c("asset_duration") - c("liability_duration"))
    return (
        company.withColumns(
            {
                "c1_asset_risk": c("c1") * 0.85,
                "c2_insurance_risk": c("face_amount") * C2_MORTALITY + c("claim_reserves") * C2_MORBIDITY + c("policy_reserves") * C2_LAPSE,
                "c3_interest_risk": c("withdrawable_reserves") * C3_WITHDRAWAL
                + F.when(gap > 2, c("total_reserves") * C3_MISMATCH * (gap - 2)).otherwise(0.0),
                "c4_business_risk": c("annual_premiums") * C4_GROWTH + c("operating_expenses") * C4_OPERATIONAL,
            }
        )
        .withColumn(
            "total_rbc",
            c("c1_asset_risk")
            + F.sqrt(F.pow("c2_insurance_risk", F.lit(2)) + F.pow("c3_interest_risk", F.lit(2)) + F.pow("c4_business_risk", F.lit(2))),
        )
        .withColumn("rbc_ratio", F.when(c("total_rbc") > 0, c("surplus") / c("total_rbc")).otherwise(5.0))
        .withColumns(
            {
                "action_level": action_level(c("rbc_ratio")),
                "adequacy": F.when(c("rbc_ratio") >= 2.0, "Adequate").otherwise("Inadequate"),
            }
        )
    )


def economic_capital(losses: DataFrame, exposure: DataFrame, level: float = 0.995) -> DataFrame:
    """VaR, tail mean and capital from a supplied scenario-loss table (column ``loss``).

    ``exposure`` is one row with ``face_amount``; standalone capital is 15 % of it.
    """
    q = exact_quantiles(losses, [], "loss", {"var_995": level, "var_99": 0.99})
    cut = q.select("var_995").scalar()
    tail = losses.agg(
        F.avg(F.when(F.col("loss") >= cut, F.col("loss"))).alias("tail_mean"), F.avg("loss").alias("expected_loss")
    )
    alone = exposure.select((F.col("face_amount") * 0.15).alias("standalone"))
    ec = F.greatest(F.lit(0.0), F.col("var_995"))
    return scalars(q, tail, alone).withColumn("economic_capital", ec).withColumn(
        "diversification_benefit", F.greatest(F.lit(0.0), F.col("standalone") - F.col("economic_capital"))
    ).withColumn("capital_efficiency", F.try_divide("diversification_benefit", "standalone"))


def target_capital(base: DataFrame, rating: str = "AA", roe: float = 0.15) -> DataFrame:
    """Larger of RBC and EC times the rating multiple, moved when the implied return is out of band.

    ``base`` has total_rbc, economic_capital and annual_earnings.
    """
    multiple = RATING_MULTIPLE.get(rating, 2.0)
    c = F.col
    first = c("base_capital") * multiple
    implied = F.when(first > 0, c("annual_earnings") / first).otherwise(0.0)
    return (
        base.withColumn("base_capital", F.greatest("total_rbc", "economic_capital"))
        .withColumn("implied_roe", implied)
        .withColumn(
            "target_capital",
            F.when(c("implied_roe") < roe * 0.8, c("annual_earnings") / roe)
            .when(c("implied_roe") > roe * 1.5, c("annual_earnings") / (roe * 1.2))
            .otherwise(first),
        )
        .withColumn("capital_buffer", c("target_capital") - c("base_capital"))
        .withColumn("buffer_share", F.try_divide("capital_buffer", "base_capital"))
    )


def scenario_impact(base: DataFrame, value: str) -> DataFrame:
    """value * (1 - 2(d - .04)) * (1 - 1.5(i - .03)) on rows with discount_rate and inflation_rate."""
    rate = 1 - (F.col("discount_rate") - 0.04) * 2
    infl = 1 - (F.col("inflation_rate") - 0.03) * 1.5
    return base.withColumns({"rate_impact": rate, "inflation_impact": infl}).withColumn(
        "portfolio_value", F.col(value) * F.col("rate_impact") * F.col("inflation_impact")
    ).withColumn("change_pct", (F.col("portfolio_value") - F.col(value)) / F.col(value) * 100)


# Shocks in percent, percent and basis points.
STRESSES = [
    ("Base Case", 0, 0, 0),
    ("Mortality Shock (+25%)", 25, 0, 0),
    ("Mass Lapse (+50%)", 0, 50, 0),
    ("Interest Rate Shock (-200bp)", 0, 0, -200),
    ("Combined Stress", 15, 25, -100),
]


def named_stress(base: DataFrame) -> DataFrame:
    """Premium, reserve and capital under each named stress; ``base`` has those three columns."""
    shock = F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(1 + m / 100).alias("m"), F.lit(1 + lapse / 100 * 0.3).alias("l"),
                 F.lit(1 + r / 10000 * 2).alias("r"))
        for n, m, lapse, r in STRESSES
    ]))
    s = base.withColumn("_s", shock)
    m, lapse, r = F.col("_s.m"), F.col("_s.l"), F.col("_s.r")
    factors = {"premium": m * r, "reserve": m * lapse, "capital": m * F.sqrt(r)}
    return s.select(
        *[c for c in base.columns if c not in factors],
        F.col("_s.scenario").alias("scenario"),
        *[(F.col(k) * f).alias(f"stressed_{k}") for k, f in factors.items()],
        *[((f - 1) * 100).alias(f"{k}_change_pct") for k, f in factors.items()],
    )


# Percent of output change per percent of shock.
LADDER = {"Mortality Rate": 0.8, "Lapse Rate": -0.3, "Discount Rate": -1.2, "Other": 0.5}


def sensitivity_ladder(base: DataFrame, value: str, reach: int = 20) -> DataFrame:
    """Output of a one-way shock grid for each variable; ``base`` is one row per portfolio."""
    variables = F.explode(F.array(*[F.struct(F.lit(k).alias("variable"), F.lit(v).alias("slope")) for k, v in LADDER.items()]))
    grid = F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(max(1, reach // 5))))
    s = base.withColumn("_v", variables).withColumn("shock_pct", grid)
    change = F.col("shock_pct") * F.col("_v.slope")
    return s.select(
        *[c for c in base.columns if c != value],
        F.col("_v.variable").alias("variable"),
        "shock_pct",
        (F.col(value) * (1 + F.col("shock_pct") / 100)).alias("input_value"),
        (F.col(value) * (1 + change / 100)).alias("output_value"),
        change.alias("impact_pct"),
    )


# --- assumptions -----------------------------------------------------------------

# Share of an assumption change that reaches the premium.
FLOW_THROUGH = {"mortality": 0.8, "economic": 0.6, "lapse": 0.4, "expense": 1.0, "business": 0.3}


def override_impact(overrides: DataFrame) -> DataFrame:
    change = (F.col("override_factor") - 1) * 100
    return overrides.withColumn("flow_through", lookup(F.col("assumption_type"), FLOW_THROUGH)).withColumns(
        {"assumption_change_pct": change, "premium_change_pct": change * F.col("flow_through")}
    )


def live_overrides(overrides: DataFrame, asof: str) -> DataFrame:
    """Approved and not expired at ``asof``."""
    day = F.lit(asof).cast("date")
    return overrides.where((F.col("status") == "approved") & (F.col("expiry_date").isNull() | (F.col("expiry_date") > day)))


def override_trail(overrides: DataFrame, asof: str, days_back: int = 90) -> DataFrame:
    day = F.lit(asof).cast("date")
    change = F.when(F.col("base_value") != 0, (F.col("override_value") / F.col("base_value") - 1) * 100)
    return overrides.where(F.col("requested_date") > F.date_sub(day, days_back)).withColumn("change_pct", change)


def override_summary(overrides: DataFrame, asof: str) -> DataFrame:
    """Live overrides by type, with those changed in 30 days and those expiring in 60."""
    day = F.lit(asof).cast("date")
    return live_overrides(overrides, asof).groupBy("assumption_type").agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(F.col("approved_date") > F.date_sub(day, 30)).alias("recent"),
        F.count_if(F.col("expiry_date") < F.date_add(day, 60)).alias("expiring"),
    )


def recent_overrides(overrides: DataFrame, asof: str, n: int = 5) -> DataFrame:
    """The latest ``n`` live overrides of each type; Spark keeps only n per task before the shuffle."""
    w = Window.partitionBy("assumption_type").orderBy(F.desc("approved_date"), F.desc("override_id"))
    return live_overrides(overrides, asof).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def effective_assumptions(base: DataFrame, overrides: DataFrame, asof: str) -> DataFrame:
    """(set_id, path) -> value in force: the latest approved, effective, unexpired override, else the base."""
    day = F.lit(asof).cast("date")
    live = overrides.where(
        (F.col("status") == "approved") & (F.col("effective_from") <= day)
        & (F.col("expires_at").isNull() | (F.col("expires_at") > day))
    )
    everything = base.select("set_id", "path", "value", F.lit(None).cast("date").alias("effective_from"), F.lit(False).alias("overridden")).unionByName(
        live.select("set_id", "path", "value", "effective_from", F.lit(True).alias("overridden"))
    )
    w = Window.partitionBy("set_id", "path").orderBy(F.desc("overridden"), F.desc("effective_from"), F.desc("value"))
    return everything.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def nested_lookup(settings: DataFrame, key: str) -> DataFrame:
    """One map of path -> value per key, so a path is read with ``settings[path]``."""
    return settings.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("settings")
    )
