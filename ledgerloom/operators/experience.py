"""Experience studies: expected and actual deaths, lapses, credibility, cedent history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata
from .skew import running_totals

FULL_CREDIBILITY_DEATHS = 1082
CHI_SQUARE_95 = 3.84
LAPSED = ["Lapsed", "Surrendered"]


def with_select_qx(policies: DataFrame) -> DataFrame:
    """Add ``qx`` from the select-and-ultimate table; ages outside it use the law behind the table."""
    spark = policies.sparkSession
    sex = F.when(F.col("gender") == "F", "FEMALE").otherwise("MALE")
    smoking = F.when(F.col("smoker_status") == "Smoker", "SMOKER").otherwise("NON-SMOKER")
    duration = F.when(F.col("policy_duration") <= 25, F.col("policy_duration")).otherwise(refdata.ULTIMATE)
    keyed = policies.withColumns({"_age": F.col("attained_age"), "_sex": sex, "_smk": smoking, "_dur": duration})
    rates = refdata.select_ultimate_table(spark).select(
        F.col("age").alias("_age"), F.col("sex").alias("_sex"), F.col("smoking").alias("_smk"),
        F.col("duration").alias("_dur"), "qx",
    )
    law = refdata.law_rate(F.col("_age"), F.col("_sex"), F.col("_smk"))
    return (
        keyed.join(F.broadcast(rates), ["_age", "_sex", "_smk", "_dur"], "left")  # 8,632 rows
        .withColumn("qx", F.coalesce("qx", law))
        .drop("_age", "_sex", "_smk", "_dur")
    )


def with_grid_qx(policies: DataFrame, age: str = "attained_age") -> DataFrame:
    """Add ``qx`` from the densified five-year grid; ages beyond 120 take the last rate."""
    grid = refdata.grid_mortality(policies.sparkSession).withColumnRenamed("age", "_age")
    keyed = policies.withColumn("_age", F.least(F.greatest(F.col(age), F.lit(0)), F.lit(120)))
    return keyed.join(F.broadcast(grid), ["_age", "gender", "smoker_status"], "left").drop("_age")  # 484 rows


def with_improvement(policies: DataFrame, years: Column) -> DataFrame:
    scale = refdata.improvement_scale(policies.sparkSession).select(
        F.col("age").alias("attained_age"),
        F.when(F.col("sex") == "FEMALE", "F").otherwise("M").alias("gender"),
        "annual_improvement",
    )
    default = F.when(F.col("attained_age") < 65, -0.015).otherwise(-0.010)
    return (
        policies.join(F.broadcast(scale), ["attained_age", "gender"], "left")  # 242 rows
        .withColumn("improvement_factor", F.pow(1 + F.coalesce("annual_improvement", default), years))
        .drop("annual_improvement")
    )


def adjusted_qx(base: Column, improvement: Column, experience: Column) -> Column:
    return F.greatest(F.lit(0.0001), F.least(F.lit(0.5), base * improvement * experience))


def credibility(deaths: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt(deaths / F.lit(float(FULL_CREDIBILITY_DEATHS))))


def actual_to_expected(rows: DataFrame, by: list[str], qx: str = "qx", deaths: str = "death_indicator") -> DataFrame:
    """A/E ratio, credibility, significance and rating factor by segment, in one aggregate."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("policies"),
        F.sum(qx).alias("expected_deaths"),
        F.sum(deaths).alias("actual_deaths"),
        F.sum("face_amount").alias("total_face_amount"),
    )
    ae = F.try_divide(F.col("actual_deaths").cast("double"), F.col("expected_deaths"))
    gap = F.col("actual_deaths") - F.col("expected_deaths")
    z = F.col("credibility_factor")
    return out.withColumns({"ae_ratio": ae, "credibility_factor": credibility(F.col("actual_deaths"))}).withColumns(
        {
            "significant": (F.col("actual_deaths") >= 10)
            & (F.try_divide(gap * gap, F.col("expected_deaths")) > CHI_SQUARE_95),
            "rating_factor": z * F.col("ae_ratio") + (1 - z),
        }
    )


def lapse_rates(policies: DataFrame, max_year: int = 15) -> DataFrame:
    """Lapse rate by product and policy year, with the product's overall rate as year 0."""
    year = F.floor("duration_years").cast("int")
    tagged = policies.select(
        "product_type",
        F.when(year.between(1, max_year), year).alias("policy_year"),
        F.col("policy_status").isin(LAPSED).cast("int").alias("lapsed"),
    )
    return (
        tagged.rollup("product_type", "policy_year")
        .agg(F.count(F.lit(1)).alias("policies_at_risk"), F.sum("lapsed").alias("lapses"), F.grouping_id().alias("g"))
        .where((F.col("g") == 1) | ((F.col("g") == 0) & F.col("policy_year").isNotNull()))
        .select(
            "product_type",
            F.when(F.col("g") == 1, 0).otherwise(F.col("policy_year")).alias("policy_year"),
            "policies_at_risk",
            "lapses",
            (F.col("lapses") / F.col("policies_at_risk")).alias("lapse_rate"),
        )
    )


def survival_curve(qx: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``px_from_start``: probability of reaching each age from the table's first age."""
    w = Window.partitionBy(*keys).orderBy("age").rowsBetween(Window.unboundedPreceding, -1)
    return qx.withColumn("survival", F.exp(F.coalesce(F.sum(F.log1p(-F.col("qx"))).over(w), F.lit(0.0))))


def life_expectancy(qx: DataFrame, keys: list[str], floor: float = 0.001, last_age: int = 120) -> DataFrame:
    """Whole years expected to be lived from each age; the sum stops once survivors fall to ``floor``.

    Table-sized work: each age meets the later ages of its own table.
    """
    s = survival_curve(qx, keys).where(F.col("age") <= last_age)
    # survivors at the end of age t, from age x, is S(t+1)/S(x) with S(t+1) = S(t)(1-q(t))
    later = s.select(*keys, F.col("age").alias("t"), (F.col("survival") * (1 - F.col("qx"))).alias("s_end"))
    pairs = s.select(*keys, "age", "survival").join(later, keys).where(F.col("t") >= F.col("age"))
    left = F.col("s_end") / F.col("survival")
    return pairs.groupBy(*keys, "age").agg(
        F.coalesce(F.sum(F.when(left > floor, left)), F.lit(0.0)).alias("life_expectancy")
    )


# --- cedent history -------------------------------------------------------

def _recency(years: DataFrame) -> DataFrame:
    return years.withColumn("_rn", F.row_number().over(Window.partitionBy("cedent_id").orderBy(F.desc("year"))))


def band(value: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose cut the value exceeds, else ``otherwise``."""
    out = None
    for cut, label in cuts:
        out = F.when(value > cut, label) if out is None else out.when(value > cut, label)
    return out.otherwise(otherwise)


def cedent_experience(years: DataFrame) -> DataFrame:
    """Recent-three against all-year loss ratio, premium stability, underwriting quality and size.

    A cedent has one row per calendar year, so the per-cedent window is short.
    """
    lr, p, ae = F.col("loss_ratio"), F.col("premium_volume"), F.col("mean_ae")
    recent, mean = F.col("recent_loss_ratio"), F.col("mean_loss_ratio")
    out = _recency(years).groupBy("cedent_id").agg(
        F.count(F.lit(1)).alias("years"),
        F.avg(F.when(F.col("_rn") <= 3, lr)).alias("recent_loss_ratio"),
        F.avg(lr).alias("mean_loss_ratio"),
        F.stddev_pop(lr).alias("loss_ratio_sd"),
        F.max_by("premium_volume", "year").alias("recent_premium"),
        F.try_divide(F.stddev_pop(p), F.avg(p)).alias("premium_cv"),
        F.avg("ae_ratio").alias("mean_ae"),
    )
    return out.withColumns(
        {
            "loss_trend": F.when(recent < mean * 0.95, "improving").when(recent > mean * 1.05, "deteriorating").otherwise("stable"),
            "volume_stability": F.when(F.col("premium_cv") < 0.2, "stable").when(F.col("premium_cv") < 0.4, "moderate").otherwise("volatile"),
            "underwriting_quality": F.when(ae < 0.85, "excellent").when(ae < 1.0, "good").when(ae > 1.2, "poor").otherwise("average"),
            "size_category": band(F.col("recent_premium"), [(100_000_000, "large"), (10_000_000, "medium")], "small"),
        }
    )


def cedent_distribution(years: DataFrame) -> DataFrame:
    """Loss-ratio moments per cedent; skewness and excess kurtosis carry the sample correction."""
    x = F.col("loss_ratio")
    out = years.groupBy("cedent_id").agg(
        F.count(x).alias("years"),
        F.avg(x).alias("mean_lr"),
        F.expr("percentile(loss_ratio, 0.5)").alias("median_lr"),  # one value per calendar year
        F.stddev_samp(x).alias("sd_lr"),
        F.skewness(x).alias("_g1"),
        F.kurtosis(x).alias("_g2"),
        F.min(x).alias("min_lr"),
        F.max(x).alias("max_lr"),
    )
    n = F.col("years").cast("double")
    return out.withColumns(
        {
            "cv_lr": F.try_divide("sd_lr", "mean_lr"),
            "skew_lr": F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis_lr": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)),
        }
    ).drop("_g1", "_g2")


def cedent_credibility(years: DataFrame) -> DataFrame:
    out = years.groupBy("cedent_id").agg(F.count(F.lit(1)).alias("years"), F.avg("premium_volume").alias("mean_premium"))
    z = F.least(F.lit(1.0), F.sqrt(F.col("years") * F.col("mean_premium") / 10_000_000))
    return out.withColumn("credibility", z).withColumn(
        "significance", band(F.col("credibility"), [(0.8, "High"), (0.5, "Medium")], "Low")
    )


def cedent_trend(years: DataFrame) -> DataFrame:
    """Mean of the last three years against the mean of the years before them."""
    lr = F.col("loss_ratio")
    out = _recency(years).groupBy("cedent_id").agg(
        F.count(F.lit(1)).alias("years"),
        F.avg(F.when(F.col("_rn") <= 3, lr)).alias("recent_lr"),
        F.avg(F.when(F.col("_rn") > 3, lr)).alias("earlier_lr"),
    ).where(F.col("years") >= 3)
    earlier = F.coalesce("earlier_lr", "recent_lr")
    pct = F.when(earlier > 0, (F.col("recent_lr") - earlier) / earlier * 100).otherwise(0.0)
    t = F.col("trend_pct")
    return out.withColumn("earlier_lr", earlier).withColumn("trend_pct", pct).withColumn(
        "trend", F.when(F.abs(t) < 5, "Stable").when(t <= -5, "Improving").otherwise("Deteriorating")
    )


def underwriting_stability(years: DataFrame, concentration: DataFrame) -> DataFrame:
    """Mean A/E, loss-ratio spread, premium growth per year, policy-count variation, concentration band.

    ``concentration`` holds (cedent_id, concentration).
    """
    out = years.groupBy("cedent_id").agg(
        F.count(F.lit(1)).alias("years"),
        F.avg("ae_ratio").alias("mean_ae"),
        F.stddev_samp("loss_ratio").alias("sd_lr"),
        F.min_by("premium_volume", "year").alias("_first"),
        F.max_by("premium_volume", "year").alias("_last"),
        F.try_divide(F.stddev_samp("policy_count"), F.avg("policy_count")).alias("policy_cv"),
    )
    growth = F.when(F.col("years") > 1, (F.try_divide("_last", "_first") - 1) / F.col("years") * 100)
    return (
        out.join(concentration, "cedent_id", "left")
        .withColumn("premium_growth_pct", growth)
        .withColumn("volatility_band", band(F.col("sd_lr"), [(0.15, "High"), (0.10, "Moderate")], "Stable"))
        .withColumn("concentration_band", band(F.col("concentration"), [(0.4, "High"), (0.25, "Moderate")], "Diversified"))
        .drop("_first", "_last")
    )


def market_position(years: DataFrame) -> DataFrame:
    """Score of the mean loss ratio on a .60-.90 scale, with the rank among cedents beside it."""
    out = years.groupBy("cedent_id").agg(F.avg("loss_ratio").alias("mean_lr"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - (F.col("mean_lr") - 0.60) / F.lit(0.30)) * 100))
    s = F.col("position_score")
    # Share of the other cedents with a higher ratio, from running counts over the distinct ratios.
    ratios = running_totals(out.groupBy("mean_lr").agg(F.count(F.lit(1)).alias("_n")), "mean_lr", {"_upto": "_n"}).select("mean_lr", "_upto")
    n = out.agg(F.count(F.lit(1))).scalar()
    above = F.when(n > 1, (n - F.col("_upto")) / (n - 1)).otherwise(F.lit(0.0))
    out = out.join(ratios, "mean_lr")
    return out.withColumn("position_score", score).withColumn("peer_percentile", above * 100).drop("_upto").withColumn(
        "position", F.when(s >= 75, "Top quartile").when(s >= 50, "Above median").otherwise("Below median")
    )


def weighted_recent(years: DataFrame, newest_first: bool = True) -> DataFrame:
    """Latest-three weighted loss ratio: .5/.3/.2 from the newest (or, for parity, from the oldest)."""
    last = _recency(years).where(F.col("_rn") <= 3)
    n = F.max("_rn").over(Window.partitionBy("cedent_id"))
    pos = F.col("_rn") if newest_first else F.col("_n") - F.col("_rn") + 1
    w = F.when(pos == 1, 0.5).when(pos == 2, 0.3).otherwise(0.2)
    return (
        last.withColumn("_n", n)
        .where(F.col("_n") == 3)
        .groupBy("cedent_id")
        .agg(F.sum(F.col("loss_ratio") * w).alias("weighted_loss_ratio"))
    )
