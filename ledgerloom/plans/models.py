"""Model training, scoring and comparison on the policy, claim, label and event tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from .. import canonical as cn
from ..functions import features as ft
from ..operators import experience as ex
from ..operators import integrate as ig
from ..operators import ml
from ..operators import series as sr
from ..operators import sheets as sh
from ..session import cut_lineage, scratch_path
from .duck import duck
from .features import _curve_rows
from .registry import query

NUM = ["issue_age", "face_amount", "policy_duration", "attained_age"]
CAT = ["gender", "smoker_status", "product_type"]


def _policies(spark, d):
    return cut_lineage(cn.policies(spark, d).select("policy_id", "annual_premium", "policy_status", "death_indicator", *NUM, *CAT))


@query("M1 M2 T5")
def premium_regressors(spark, d):
    _, metrics = ml.train_regressors(_policies(spark, d), "policy_id", "annual_premium", NUM, CAT)
    return metrics.select("model", "rmse", "mae", "r2", "mape")


@query(
    "M2",
    duck("policies", "SELECT regr_slope(annual_premium, face_amount) AS slope, regr_intercept(annual_premium, face_amount) AS intercept, regr_r2(annual_premium, face_amount) AS r2 FROM policies"),
    r6="slope r2", r2="intercept",
)
def premium_line(spark, d):
    v = VectorAssembler(inputCols=["face_amount"], outputCol="features").transform(cn.policies(spark, d).select("face_amount", "annual_premium"))
    m = LinearRegression(labelCol="annual_premium", solver="normal").fit(v)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept), float(m.summary.r2))], "slope double, intercept double, r2 double")


@query("M3")
def frequency_and_severity(spark, d):
    by_treaty = cn.exposures(spark, d).groupBy("treaty_id").agg(F.sum("sum_insured").alias("sum_insured"), F.sum("risk_count").alias("risk_count"), F.avg("sum_insured").alias("mean_insured"))
    f = ig.frequency_data(by_treaty, cn.claims(spark, d), "treaty_id", "risk_count").withColumn("claim_count", F.col("claim_count").cast("double"))
    f = f.where("risk_count > 0").withColumn("log_risks", F.log("risk_count"))
    freq = ml.frequency_model(f, "claim_count", ["sum_insured", "mean_insured"], offset="log_risks")
    s = ig.severity_data(cn.claims(spark, d), cn.treaties(spark, d).select("treaty_id", "business_line", "retention"), "treaty_id")
    sev = ml.severity_model(s, "log_severity", ["units", "retention"], ["business_line"])
    a = freq.transform(f).groupBy("treaty_id").agg(F.avg("prediction").alias("expected_count"))
    b = sev.transform(s).groupBy("treaty_id").agg(F.avg("prediction").alias("expected_log_severity"))
    return a.join(b, "treaty_id")


def _lapse(spark, d):
    return _policies(spark, d).withColumn("lapsed", F.col("policy_status").isin("Lapsed", "Surrendered").cast("int"))


@query("M4 T5 A30")
def lapse_classifiers(spark, d):
    _, auc = ml.train_classifiers(_lapse(spark, d), "policy_id", "lapsed", NUM, CAT)
    auc = cut_lineage(auc)
    return auc.join(ml.best_model(auc, "auc", lowest=False).select("model", F.lit(True).alias("best")), "model", "left").fillna(False, ["best"])


@query("M5 M13 F21")
def calibrated_lapse_scores(spark, d):
    p = _lapse(spark, d)
    models, _ = ml.train_classifiers(p, "policy_id", "lapsed", NUM, CAT, which=["logistic"])
    unseen = cut_lineage(ml.out_of_fold(p, "policy_id", "lapsed", NUM, CAT))
    scored = ml.probability(models["logistic"], p).select("policy_id", "lapsed", "score")
    out = ml.calibrate(unseen, "lapsed").transform(scored)
    return out.select("policy_id", "score", "calibrated", (1 - F.pow(1 - F.col("calibrated"), F.lit(1 / 12))).alias("monthly_rate"))


@query(
    "M7",
    duck("policies", "SELECT policy_id, greatest(0.2, least(10.0, death_indicator / greatest(0.001::DOUBLE, face_amount / 1e8))) AS ae_target FROM policies"),
    r6="ae_target",
)
def ae_targets(spark, d):
    p = cn.policies(spark, d).withColumn("expected", F.col("face_amount") / 1e8)
    return ml.ae_target(p, "death_indicator", "expected").select("policy_id", "ae_target")


@query("M6 M7")
def mortality_ensemble(spark, d):
    rated = ex.with_select_qx(cn.policies(spark, d))
    cells = rated.groupBy("attained_age", "gender", "smoker_status", "product_type").agg(
        F.sum("qx").alias("expected"), F.sum("death_indicator").alias("actual"), F.avg("face_amount").alias("mean_face")
    )
    data = cut_lineage(ml.ae_target(cells, "actual", "expected").withColumn("cell", F.concat_ws("|", "attained_age", "gender", "smoker_status", "product_type")))
    models, _ = ml.train_regressors(data, "cell", "ae_target", ["attained_age", "mean_face"], ["gender", "smoker_status", "product_type"])
    return ml.ensemble(models, ml.fill_text(data, ["gender", "smoker_status", "product_type"]), "cell")


@query("M8")
def rate_forecast_errors(spark, d):
    return ml.maturity_forecasts(_curve_rows(spark, d), ["y2", "y5", "y10"])


_level = "CASE WHEN kind = 'equity' THEN ln(value) ELSE value END"


@query(
    "M8",
    duck("economy", f"""SELECT series, kind, train_rows, count(*) AS test_rows, slope, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, sqrt(avg(move * move)) AS last_value_rmse, 1 - sqrt(avg(e * e)) / sqrt(avg(move * move)) AS skill FROM (
      SELECT *, start + slope * gap - move AS e FROM split JOIN (SELECT series, count(*) AS train_rows, regr_slope(move, gap) AS slope, regr_intercept(move, gap) AS start FROM split WHERE r <= floor(n * 0.8) GROUP BY 1) USING (series) WHERE r > floor(n * 0.8))
      GROUP BY ALL""",
      long_series="SELECT series, CASE WHEN series IN ('view', 'purchase') THEN 'equity' ELSE 'rate' END AS kind, date, value FROM economy",
      gaps=f"""SELECT *, {_level} - avg({_level}) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS gap, lead({_level}, 3) OVER (PARTITION BY series ORDER BY date) - {_level} AS move,
        row_number() OVER (PARTITION BY series ORDER BY date) AS place FROM long_series""",
      split="SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS r, count(*) OVER (PARTITION BY series) AS n FROM gaps WHERE place >= 5 AND move IS NOT NULL"),
    r6="slope rmse mae last_value_rmse skill",
)
def rate_and_equity_forecasts(spark, d):
    """Errors of the forecasts three days ahead for three rates and two equity series."""
    kind = F.when(F.col("series").isin("view", "purchase"), "equity").otherwise("rate")
    return ml.reverting_forecasts(cn.economy(spark, d).withColumn("kind", kind), horizon=3, window=5).select(
        "series", "kind", "train_rows", "test_rows", "slope", "rmse", "mae", "last_value_rmse", "skill")


_share = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(
    "M9 U2",
    f"""WITH r AS (SELECT doc_id, 1 - quality AS bad FROM labels), c AS (SELECT count(*) AS n, sum(bad) AS p FROM r)
      SELECT bad, count(*) AS rows FROM r, c WHERE bad <> CASE WHEN p * 2 > n THEN 1 ELSE 0 END OR {_share} <
        CASE WHEN p < n * 0.05 OR p > n * 0.5 THEN least(p, n - p) * (0.85::DOUBLE / 0.15::DOUBLE) / greatest(p, n - p) ELSE 1.0 END GROUP BY bad""",
)
def balanced_labels(spark, d):
    rows = cn.table(spark, d, "labels").select("doc_id", F.col("quality").alias("good")).withColumn("bad", 1 - F.col("good"))
    out = ml.balance(rows, "bad", "doc_id", 0.15)
    return out.groupBy("bad").agg(F.count(F.lit(1)).alias("rows"))


@query("M10 T4")
def premium_feature_importance(spark, d):
    models, _ = ml.train_regressors(_policies(spark, d), "policy_id", "annual_premium", NUM, CAT, which=["random_forest"])
    return ml.importances(spark, models["random_forest"]).orderBy(F.desc("importance")).limit(10)


@query("M11 M12 M13")
def saved_model_scores(spark, d):
    p = _policies(spark, d)
    models, metrics = ml.train_regressors(p, "policy_id", "annual_premium", NUM, CAT, which=["linear"])
    path = scratch_path(spark, "model")
    ml.save_model(models["linear"], path, metrics.withColumn("trained_on", F.lit("policies")))
    model, meta = ml.load_model(spark, path)
    rmse = meta.select("rmse").scalar()
    scored = model.transform(ml.fill_text(p, CAT)).withColumn("error", F.col("annual_premium") - F.col("prediction"))
    return scored.groupBy("product_type").agg(F.count(F.lit(1)).alias("policies"), (F.avg("prediction") / F.avg("annual_premium")).alias("mean_ratio"), F.avg("error").alias("mean_error")).withColumn("test_rmse", rmse)


@query("M13 A42")
def lapse_age_elasticity(spark, d):
    p = _lapse(spark, d)
    models, _ = ml.train_classifiers(p, "policy_id", "lapsed", NUM, CAT, which=["logistic"])
    m = models["logistic"]
    base = p.groupBy(*CAT).agg(*[F.avg(c).alias(c) for c in NUM])
    base = ml.probability(m, base, "base_y").select(*CAT, *NUM, "base_y")
    grid = ml.sensitivity_grid(base, "issue_age", F.lit(20.0), F.lit(70.0))
    pts = ml.probability(m, grid, "y").withColumn("x", F.col("issue_age"))
    return sr.elasticity(pts, CAT)


@query("K10")
def embedding_kmeans_distance(spark, d):
    e = ml.kmeans_clusters(cn.table(spark, d, "embeddings"), "embedding", 5)
    return sh.centre_distance(e, "embedding", "cluster", 64).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("distance").alias("mean_distance"), F.max("outlier_score").alias("max_score")
    )
