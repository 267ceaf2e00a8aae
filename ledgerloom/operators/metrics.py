"""Model metrics as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import running_totals


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """RMSE, MAE, R² and MAPE (a zero target counts as one)."""
    e = F.col(y) - F.col(p)
    safe = F.when(F.col(y) == 0, 1.0).otherwise(F.col(y))
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"), (F.avg(F.abs(e / safe)) * 100).alias("mape"),
    )


def residual_moments(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(
        F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("sd_residual"), F.skewness(e).alias("skew_residual"), F.kurtosis(e).alias("kurtosis_residual")
    )


def validation_report(df: DataFrame, y: str, p: str, tolerance: float = 0.1) -> DataFrame:
    """Ratio of mean prediction to mean target, its stability, error measures and residual moments in one aggregate."""
    e = F.col(y) - F.col(p)
    return df.agg(
        (F.avg(p) / F.avg(y)).alias("mean_ratio"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"), F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("sd_residual"),
    ).withColumn("stable", F.abs(F.col("mean_ratio") - 1) < tolerance)


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before anything is ranked."""
    return df.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties at half weight, from running counts over score ranges."""
    ranked = running_totals(_by_score(df, label, score), "_s", {"cum_neg": "neg"})
    below = F.col("cum_neg") - F.col("neg")
    out = ranked.agg(
        F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    return out.select((F.col("u") / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def best_f1(df: DataFrame, label: str, score: str) -> DataFrame:
    """Threshold with the highest F1 when scores at or above it count as positive; the highest threshold on ties."""
    cells = _by_score(df, label, score)
    ranked = running_totals(cells, "_s", {"cum_pos": "pos", "cum_neg": "neg"})
    total = cells.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    r = ranked.withColumn("_t", total)
    tp = F.col("_t.p") - F.col("cum_pos") + F.col("pos")
    fp = F.col("_t.n") - F.col("cum_neg") + F.col("neg")
    f1 = 2 * tp / (2 * tp + fp + F.col("_t.p") - tp)
    best = r.select(
        F.struct(F.round(f1, 9).alias("k"), F.col("_s").alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / F.col("_t.p")).alias("recall"), f1.alias("f1")).alias("b")
    ).agg(F.max("b").alias("b"))
    return best.select("b.threshold", "b.precision", "b.recall", "b.f1")
