"""Feature columns for life, annuity, lapse and mortality models; all native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.portfolio import sex_word, smoking_word  # noqa: F401  (re-exported scalars)
from ..refdata import lookup

# Ordinals, weights and state groups.
RATING_ORDINAL = {"Preferred Plus": 5, "Preferred": 4, "Standard Plus": 3, "Standard": 2, "Substandard": 1, "Declined": 0}
CONDITION_WEIGHT = {
    "hypertension": 2, "diabetes": 3, "heart_disease": 4, "cancer_history": 3, "asthma": 1, "depression": 2, "anxiety": 1, "high_cholesterol": 1,
}
HIGH_COST = ["CA", "NY", "CT", "NJ", "MA", "HI", "MD", "WA"]
REGIONS = {
    "northeast": ["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA"],
    "southeast": ["DE", "MD", "DC", "VA", "WV", "KY", "TN", "NC", "SC", "GA", "FL", "AL", "MS", "AR", "LA"],
    "midwest": ["OH", "MI", "IN", "WI", "IL", "MN", "IA", "MO", "ND", "SD", "NE", "KS"],
    "west": ["MT", "WY", "CO", "NM", "ID", "UT", "AZ", "NV", "WA", "OR", "CA", "AK", "HI"],
}
HIGH_RISK_STATES = ["WV", "MS", "AL", "LA", "KY", "AR", "TN", "SC", "OK"]


def flag(c: Column) -> Column:
    return c.cast("int")


def log_floor(c: Column, floor: float) -> Column:
    return F.log(F.greatest(c, F.lit(floor)))


def within(c: Column, low: float, high: float) -> Column:
    """low <= c < high."""
    return (c >= low) & (c < high)


def demographic(df: DataFrame, age: str = "issue_age") -> DataFrame:
    a = F.col(age)
    out = {
        "age_squared": a * a,
        "age_log": log_floor(a.cast("double"), 1.0),
        "age_band_5yr": (F.floor(a / 5) * 5).cast("int"),
        "age_band_10yr": (F.floor(a / 10) * 10).cast("int"),
        "young_adult": a < 30,
        "middle_age": within(a, 30, 50),
        "pre_retirement": within(a, 50, 65),
        "senior": a >= 65,
        "years_to_retirement": F.greatest(F.lit(0), 65 - a),
        "retirement_eligible": a >= 62,
        "low_mortality_age": a < 40,
        "medium_mortality_age": within(a, 40, 60),
        "high_mortality_age": a >= 60,
    }
    if "gender" in df.columns:
        out |= {"gender_male": flag(F.col("gender") == "M"), "gender_female": flag(F.col("gender") == "F")}
    if "marital_status" in df.columns:
        m = F.col("marital_status")
        out |= {"married": m == "Married", "single": m == "Single", "previously_married": m.isin("Divorced", "Widowed")}
    return df.withColumns(out)


def bmi_risk(b: Column) -> Column:
    """U-shaped score with its floor between 22 and 25."""
    return (
        F.when(b.isNull() | (b <= 0), 1.0)
        .when(b.between(22, 25), 0.9)
        .when(b.between(18.5, 22), 1.0 + (22 - b) * 0.05)
        .when((b > 25) & (b <= 30), 1.0 + (b - 25) * 0.04)
        .when(b > 30, 1.0 + (b - 25) * 0.08)
        .otherwise(1.4)
    )


def health(df: DataFrame) -> DataFrame:
    smokes = F.upper("smoker_status").isin("SMOKER", "YES", "TRUE", "Y")
    b = F.col("bmi")
    df = df.withColumns(
        {
            "is_smoker": flag(F.coalesce(smokes, F.lit(False))),
            "bmi": F.col("weight_pounds") / (F.col("height_inches") * F.col("height_inches")) * 703,
        }
    ).withColumns(
        {
            "is_nonsmoker": 1 - F.col("is_smoker"),
            "underweight": b < 18.5, "normal_weight": within(b, 18.5, 25), "overweight": within(b, 25, 30), "obese": b >= 30, "severely_obese": b >= 35,
            "bmi_risk_score": bmi_risk(b),
            "health_rating_numeric": lookup(F.col("health_rating"), RATING_ORDINAL, 2).cast("int"),
            "preferred_health": F.col("health_rating").isin("Preferred Plus", "Preferred"),
            "substandard_health": F.col("health_rating") == "Substandard",
        }
    )
    known = [c for c in CONDITION_WEIGHT if f"history_{c}" in df.columns]
    if known:
        has = {c: flag(F.col(f"history_{c}")) for c in known}
        total = reduce(lambda x, y: x + y, has.values())
        severity = reduce(lambda x, y: x + y, [h * CONDITION_WEIGHT[c] for c, h in has.items()])
        df = df.withColumns({"total_health_conditions": total, "health_severity_score": severity, "no_health_conditions": total == 0})
    return df


def income_percentile(x: Column) -> Column:
    return (
        F.when(x.isNull() | (x <= 0), 0.0).when(x < 25000, 20.0).when(x < 50000, 40.0).when(x < 75000, 60.0)
        .when(x < 100000, 75.0).when(x < 150000, 85.0).when(x < 200000, 92.0).otherwise(95.0)
    )


def financial(df: DataFrame) -> DataFrame:
    inc, face, prem = F.col("annual_income").cast("double"), F.col("face_amount"), F.col("annual_premium")
    ratio, burden = F.try_divide(face, inc), F.try_divide(prem, inc)
    out = {
        "income_log": log_floor(inc, 1000.0), "low_income": inc < 35000, "middle_income": within(inc, 35000, 75000),
        "high_income": within(inc, 75000, 150000), "very_high_income": inc >= 150000, "income_percentile": income_percentile(inc),
        "face_amount_log": log_floor(face, 1000.0), "small_coverage": face < 100000, "medium_coverage": within(face, 100000, 500000),
        "large_coverage": within(face, 500000, 1000000), "jumbo_coverage": face >= 1000000, "face_amount_per_1k": face / 1000,
        "coverage_multiple": face / F.greatest(inc, F.lit(1.0)), "low_coverage_ratio": ratio < 3, "adequate_coverage_ratio": within(ratio, 3, 10),
        "high_coverage_ratio": ratio >= 10, "potential_anti_selection": ratio > 20,
        "premium_to_income_pct": prem / F.greatest(inc, F.lit(1.0)) * 100, "high_premium_burden": burden > 0.1, "low_premium_burden": burden < 0.02,
    }
    if "net_worth" in df.columns:
        w = F.col("net_worth").cast("double")
        out |= {"net_worth_log": log_floor(w, 1000.0), "high_net_worth": w > 1000000, "negative_net_worth": w < 0}
    return df.withColumns(out)


def policy(df: DataFrame) -> DataFrame:
    t, mode, freq = F.col("product_type"), F.col("payment_mode"), F.col("premium_frequency")
    kinds = ["Term", "Whole Life", "Universal Life", "Variable Life", "Variable Universal Life"]
    out = {f"is_{k.lower().replace(' ', '_')}": t == k for k in kinds}
    return df.withColumns(
        out
        | {
            "simple_product": t == "Term", "complex_product": t.isin("Variable Life", "Variable Universal Life", "Variable"),
            "permanent_product": t.isin("Whole Life", "Universal Life"),
            "annual_pay": mode == "Annual", "monthly_pay": mode == "Monthly", "semi_frequent_pay": mode.isin("Quarterly", "Semi-Annual"),
            "frequent_payment": freq > 1,
            "payment_frequency_risk_factor": F.when(freq == 1, 1.0).when(freq <= 4, 1.2).otherwise(1.5),
            "had_medical_exam": F.col("medical_exam") == "Yes", "agent_sale": F.col("agent_id").isNotNull(), "direct_sale": F.col("agent_id").isNull(),
        }
    )


def actuarial(df: DataFrame, table: DataFrame) -> DataFrame:
    """qx and life expectancy by join on (age, gender, smoker_status), risk bands and the single-premium estimate.

    ``table`` holds issue_age, gender, smoker_status, qx, life_expectancy; a few hundred rows.
    """
    q, e = F.col("qx"), F.col("life_expectancy")
    return df.join(F.broadcast(table), ["issue_age", "gender", "smoker_status"], "left").withColumns(
        {
            "low_mortality_risk": q < 0.005, "medium_mortality_risk": within(q, 0.005, 0.015), "high_mortality_risk": q >= 0.015,
            "long_life_expectancy": e > 25, "medium_life_expectancy": e.between(15, 25), "short_life_expectancy": e < 15,
            "approx_net_single_premium": F.col("face_amount") * q * 0.97, "risk_adjusted_coverage": F.col("face_amount") * q,
        }
    )


def geographic(df: DataFrame) -> DataFrame:
    s = F.col("state_code")
    return df.withColumns(
        {
            "high_cost_state": s.isin(HIGH_COST), **{f"{r}_region": s.isin(v) for r, v in REGIONS.items()},
            "zip_first_digit": F.substring("zip_code", 1, 1).cast("int"), "zip_prefix": F.substring("zip_code", 1, 3),
        }
    )


def temporal(df: DataFrame) -> DataFrame:
    d, m = F.col("issue_date"), F.month("issue_date")
    out = {
        "issue_year": F.year(d), "issue_month": m, "issue_quarter": F.quarter(d), "issue_weekday": F.weekday(d) + 1,
        "winter_issue": m.isin(12, 1, 2), "spring_issue": m.isin(3, 4, 5), "summer_issue": m.isin(6, 7, 8), "fall_issue": m.isin(9, 10, 11),
        "year_end_issue": m.isin(11, 12), "days_since_2000": F.datediff(d, F.to_date(F.lit("2000-01-01"))),
    }
    if "birth_date" in df.columns:
        y = F.year("birth_date")
        out |= {
            "age_in_days": F.datediff(d, F.col("birth_date")), "birth_year": y, "gen_z": y >= 1997, "millennial": y.between(1981, 1996),
            "gen_x": y.between(1965, 1980), "boomer": y.between(1946, 1964),
        }
    return df.withColumns(out)


def interactions(df: DataFrame) -> DataFrame:
    """Products of columns made by the groups above."""
    a, male, smk = F.col("issue_age"), F.col("gender_male"), F.col("is_smoker")
    return df.withColumns(
        {
            "age_male_interaction": a * male, "age_smoker_interaction": a * smk, "age_squared_smoker_interaction": a * a * smk,
            "coverage_age_interaction": F.col("face_amount_log") * a, "income_coverage_interaction": F.col("income_log") * F.col("face_amount_log"),
            "health_age_interaction": F.col("health_rating_numeric") * a, "age_gender_smoker_interaction": a * male * smk,
        }
    )


def longevity(df: DataFrame, table: DataFrame) -> DataFrame:
    """Annuitant survival and retirement timing; ``table`` as in ``actuarial`` without smokers."""
    a, e = F.col("issue_age"), F.col("life_expectancy")
    return df.join(F.broadcast(table), ["issue_age", "gender"], "left").withColumns(
        {
            "survival_probability": 1 - F.col("qx"), "high_longevity_risk": e > 20, "medium_longevity_risk": e.between(10, 20), "low_longevity_risk": e < 10,
            "early_retirement": a < 59.5, "normal_retirement": within(a, 59.5, 65), "late_retirement": a >= 65, "rmd_age": a >= 72,
            "expected_retirement_years": F.when(a >= 65, F.greatest(F.lit(0), 25 - (a - 65))).otherwise(25),
        }
    )


def investment(df: DataFrame, asof: str) -> DataFrame:
    """Annuity premium size, guarantees, payout and surrender measures."""
    p, g, m = F.col("premium_amount"), F.col("guaranteed_rate"), F.col("monthly_payment")
    option, invest = F.col("payout_option"), F.col("investment_option")
    charge = (p - F.col("surrender_value")) / p
    days = F.datediff(F.lit(asof).cast("date"), F.col("contract_date"))
    years = days / F.lit(365.25).cast("double")
    return df.withColumns(
        {
            "premium_log": log_floor(p, 1000.0), "small_premium": p < 50000, "medium_premium": within(p, 50000, 250000), "large_premium": within(p, 250000, 1000000),
            "jumbo_premium": p >= 1000000, "conservative_investor": invest == "Conservative", "moderate_investor": invest == "Moderate", "aggressive_investor": invest == "Aggressive",
            "guaranteed_rate_pct": g * 100, "high_guaranteed_rate": g > 0.02, "low_guaranteed_rate": g < 0.015,
            "life_only_payout": option == "Life Only", "period_certain_payout": option.contains("Certain"), "joint_life_payout": option.contains("Joint"),
            "payout_risk_factor": F.when(option.contains("Life Only"), 1.0).when(option.contains("Certain"), 0.8).otherwise(0.6),
            "annual_payout_rate": m * 12 / p, "adequate_monthly_income": m > 1000, "low_monthly_income": m < 500,
            "surrender_charge_rate": charge, "high_surrender_charges": charge > 0.1,
            "contract_duration_days": days, "contract_duration_years": years, "early_surrender_risk_period": years < 5,
        }
    )


def lapse(df: DataFrame, products: list[str]) -> DataFrame:
    per_1000 = F.col("annual_premium") / F.col("face_amount") * 1000
    d, a = F.col("policy_duration"), F.col("attained_age")
    out = {
        "log_face_amount": F.log1p("face_amount"), "high_face_amount": flag(F.col("face_amount") > 1000000), "premium_per_1000": per_1000,
        "high_premium_ratio": flag(per_1000 > 20), "early_duration": flag(d <= 2), "mature_policy": flag(d >= 10), "duration_squared": d * d,
        "retirement_age": flag(a >= 65), "young_adult": flag(a <= 35), "middle_aged": flag((a > 35) & (a < 65)),
    }
    optional = {
        "interest_rate_10y": {"high_interest_environment": lambda c: c > 0.04, "low_interest_environment": lambda c: c < 0.02},
        "unemployment_rate": {"high_unemployment": lambda c: c > 0.06},
        "credit_score": {"low_credit_score": lambda c: c < 650, "excellent_credit": lambda c: c >= 750},
        "payment_history": {"perfect_payment_history": lambda c: c == 1.0, "payment_issues": lambda c: c < 0.9},
        "competitive_rate_spread": {"poor_competitive_position": lambda c: c > 0.005, "strong_competitive_position": lambda c: c < -0.005},
    }
    for name, tests in optional.items():
        if name in df.columns:
            out |= {k: flag(t(F.col(name))) for k, t in tests.items()}
    out |= {f"product_{p.lower().replace(' ', '_')}": flag(F.col("product_type") == p) for p in products}
    return df.withColumns(out)


def mortality(df: DataFrame) -> DataFrame:
    a, d, b = F.col("attained_age"), F.col("policy_duration"), F.col("bmi")
    smk = flag(F.col("smoker_status") == "Smoker")
    conditions = [c for c, t in df.dtypes if c.startswith(("medical_", "condition_")) and t in ("int", "bigint", "double")]
    out = {
        "age_squared": a * a, "age_cubed": a * a * a, "gender_m": flag(F.col("gender") == "M"), "gender_f": flag(F.col("gender") == "F"),
        "bmi_underweight": flag(b < 18.5), "bmi_normal": flag(within(b, 18.5, 25)), "bmi_overweight": flag(within(b, 25, 30)), "bmi_obese": flag(b >= 30),
        "bmi_extreme_obese": flag(b >= 35), "age_smoker_interaction": a * smk, "duration_squared": d * d, "early_duration": flag(d <= 2),
        "mature_duration": flag(d >= 10), "high_risk_geography": flag(F.col("state_code").isin(HIGH_RISK_STATES)),
    }
    if conditions:
        total = reduce(lambda x, y: x + y, [F.col(c) for c in conditions])
        out |= {"total_medical_conditions": total, "has_major_condition": flag(total > 2)}
    return df.withColumns(out)


FACE_CUTS = [(50_000, "<50K"), (100_000, "50K-100K"), (250_000, "100K-250K"), (500_000, "250K-500K"), (1_000_000, "500K-1M"), (5_000_000, "1M-5M")]
AGE_CUTS = [(25, "<25"), (35, "25-35"), (45, "35-45"), (55, "45-55"), (65, "55-65"), (75, "65-75"), (100, ">75")]


def right_closed(c: Column, cuts: list[tuple[float, str]], above: str | None) -> Column:
    """Label of the first cut that ``c`` does not exceed; values not above 0 have none."""
    out = F.when(c <= 0, None)
    for cut, label in cuts:
        out = out.when(c <= cut, label)
    return out.when(c.isNotNull(), F.lit(above)) if above else out


def derived_policy_fields(df: DataFrame, asof: str) -> DataFrame:
    years = F.datediff(F.lit(asof).cast("date"), F.col("issue_date")) / F.lit(365.25).cast("double")
    return df.withColumns(
        {
            "attained_age_rounded": F.bround(F.col("issue_age") + years).cast("int"),
            "policy_year": F.bround(years + 1).cast("int"),
            "face_amount_band": right_closed(F.col("face_amount"), FACE_CUTS, ">5M"),
            "issue_age_band": right_closed(F.col("issue_age"), AGE_CUTS, None),
        }
    )


def regime(df: DataFrame) -> DataFrame:
    """Scores of four economic regimes, their shares and the likeliest, per row of indicators."""
    g, u, i, s = (F.col(c) for c in ("gdp_growth", "unemployment", "inflation", "slope"))
    pos = lambda c: F.greatest(F.lit(0.0), c)
    raw = {
        "expansion": (pos(g) * 2 + pos(0.08 - u) * 3 + pos(0.03 - F.abs(i - 0.02)) * 2 + pos(s)) / 10,
        "recession": (pos(-g) * 4 + pos(u - 0.05) * 3 + pos(-s) * 2) / 8,
        "recovery": F.when((g > 0) & (u > 0.045), (pos(g) * 1.5 + pos(0.06 - u) * 2 + pos(s) * 1.5) / 6).otherwise(0.0),
        "stagflation": (pos(i - 0.04) * 4 + pos(0.01 - g) * 2) / 6,
    }
    df = df.withColumns({f"_{k}": F.least(F.lit(1.0), v) for k, v in raw.items()})
    total = reduce(lambda a, b: a + b, [F.col(f"_{k}") for k in raw])
    default = {"expansion": 0.6, "recession": 0.15, "recovery": 0.2, "stagflation": 0.05}
    df = df.withColumns({f"p_{k}": F.when(total > 0, F.col(f"_{k}") / total).otherwise(default[k]) for k in raw})
    best = F.greatest(*[F.col(f"p_{k}") for k in raw])
    name = F.coalesce(*[F.when(F.col(f"p_{k}") == best, k) for k in raw])
    return df.withColumns({"regime": name, "confidence": best}).drop(*[f"_{k}" for k in raw])


def row_confidence(required: list[Column], age: Column, duration: Column) -> Column:
    """.8 less .1 per missing field, .15 at edge ages, .1 for old policies; held within .3-.95."""
    missing = reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in required])
    c = (
        0.8 - missing * 0.1 - F.when((age < 18) | (age > 85), 0.15).otherwise(0.0) - F.when(duration > 30, 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.3), F.least(F.lit(0.95), c))
