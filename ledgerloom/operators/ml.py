"""Feature preparation, training, scoring and model comparison with pyspark.ml."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import metrics as mt

SEED = 42


def fill_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("MISSING")) for c in columns})


def preparation(numeric: list[str], categorical: list[str], scale: bool = False) -> list:
    """Label encoding that keeps unseen values, median imputation, one feature vector."""
    stages = [
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep") if categorical else None,
        Imputer(inputCols=numeric, outputCols=[f"{c}_im" for c in numeric], strategy="median") if numeric else None,
        VectorAssembler(
            inputCols=[f"{c}_im" for c in numeric] + [f"{c}_ix" for c in categorical], outputCol="raw_features" if scale else "features", handleInvalid="keep"
        ),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True) if scale else None,
    ]
    return [s for s in stages if s is not None]


def split(df: DataFrame, key: str, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Split on a hash of the key, so the parts do not depend on partitioning or a lost executor."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1000))
    return df.where(bucket >= int(test * 1000)), df.where(bucket < int(test * 1000))


#: Values searched for each model, whatever the size of the table.
REGRESSION_GRID = {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5], "forest_depth": [4, 6], "boosting_depth": [3, 5]}


def regressors(label: str, grid: dict[str, list] | None = None) -> dict[str, tuple]:
    """Models and their grids: linear, elastic net, forest and boosting."""
    g = REGRESSION_GRID | (grid or {})
    lr = LinearRegression(labelCol=label, maxIter=50)
    en = LinearRegression(labelCol=label, maxIter=50, regParam=0.1)
    rf = RandomForestRegressor(labelCol=label, seed=SEED, numTrees=20)
    gb = GBTRegressor(labelCol=label, seed=SEED, maxIter=15)
    return {
        "linear": (lr, ParamGridBuilder().addGrid(lr.regParam, g["regParam"]).build()),
        "elastic_net": (en, ParamGridBuilder().addGrid(en.elasticNetParam, g["elasticNetParam"]).build()),
        "random_forest": (rf, ParamGridBuilder().addGrid(rf.maxDepth, g["forest_depth"]).build()),
        "gradient_boosting": (gb, ParamGridBuilder().addGrid(gb.maxDepth, g["boosting_depth"]).build()),
    }


def train_regressors(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], folds: int = 3, which: list[str] | None = None):
    """Fit each model (grid search by cross-validation where its grid has a choice); returns models and a metrics table."""
    train, test = split(fill_text(df, categorical), key)
    prep = Pipeline(stages=preparation(numeric, categorical)).fit(train)
    # Folds and boosting rounds read the training rows many times. Lost blocks are recomputed from the scan.
    tr = prep.transform(train).select(key, label, "features").persist()
    te = prep.transform(test).select(key, label, "features")
    models, parts = {}, []
    for name, (est, grid) in regressors(label).items():
        if which and name not in which:
            continue
        if len(grid) > 1:
            cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=min(folds, 3), seed=SEED, parallelism=2)
            model = cv.fit(tr).bestModel
        else:
            model = est.fit(tr, grid[0] if grid else {})
        models[name] = PipelineModel([*prep.stages, model])
        parts.append(mt.regression_metrics(model.transform(te), label, "prediction").withColumn("model", F.lit(name)))
    tr.unpersist()
    return models, reduce(lambda a, b: a.unionByName(b), parts)


def best_model(metrics: DataFrame, by: str = "rmse", lowest: bool = True) -> DataFrame:
    pick = F.min_by if lowest else F.max_by
    end = F.min if lowest else F.max
    return metrics.agg(pick("model", by).alias("model"), end(by).alias(by))


def frequency_model(df: DataFrame, label: str, numeric: list[str], offset: str | None = None):
    """Poisson regression of claim counts; ``offset`` is the column with the log of the risks."""
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=label, maxIter=25, regParam=0.01, **({"offsetCol": offset} if offset else {}))
    return Pipeline(stages=[*preparation(numeric, [], scale=True), glm]).fit(df)


def severity_model(df: DataFrame, label: str, numeric: list[str], categorical: list[str]):
    est = LinearRegression(labelCol=label, maxIter=50)
    return Pipeline(stages=[*preparation(numeric, categorical), est]).fit(fill_text(df, categorical))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2·n_class) as column ``weight``."""
    t = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("p"))).scalar()
    w = F.when(F.col(label) == 1, t.getField("n") / (2.0 * t.getField("p"))).otherwise(t.getField("n") / (2.0 * (t.getField("n") - t.getField("p"))))
    return df.withColumn("weight", w)


class _WithoutSummary:
    """Fits the model, then saves it and reads it back, which leaves the training summary behind.

    The summary holds the session, which tasks can't be sent once anything in it was observed (``DataFrame.observe``).
    """

    def _fit(self, dataset):
        model = super()._fit(dataset)
        path = scratch_path(dataset.sparkSession, "classifier")
        model.write().save(path)
        return type(model).load(path)


class Logistic(_WithoutSummary, LogisticRegression):
    pass


class Forest(_WithoutSummary, RandomForestClassifier):
    pass


class Perceptron(_WithoutSummary, MultilayerPerceptronClassifier):
    pass


def classifiers(label: str, width: int) -> dict[str, tuple]:
    """Lapse models and the grids searched for them."""
    lr = Logistic(labelCol=label, weightCol="weight", maxIter=50)
    rf = Forest(labelCol=label, weightCol="weight", seed=SEED, numTrees=20)
    gb = GBTClassifier(labelCol=label, weightCol="weight", seed=SEED, maxIter=15)
    nn = Perceptron(labelCol=label, layers=[width, 16, 8, 2], maxIter=60, seed=SEED)
    return {
        "logistic": (lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()),
        "random_forest": (rf, ParamGridBuilder().addGrid(rf.maxDepth, [4, 6]).build()),
        "gradient_boosting": (gb, ParamGridBuilder().addGrid(gb.maxDepth, [4]).build()),
        "neural_network": (nn, ParamGridBuilder().build()),
    }


def train_classifiers(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], which: list[str] | None = None, folds: int = 3, search: bool = True):
    """Fit the lapse classifiers, each with the best setting of its grid by cross-validated AUC (the first setting without ``search``); returns models and AUC per model on the held-out part."""
    train, test = split(fill_text(df, categorical), key)
    prep = Pipeline(stages=preparation(numeric, categorical, scale=True)).fit(train)
    tr = class_weights(prep.transform(train), label).select(key, label, "weight", "features").persist()
    te = prep.transform(test).select(key, label, "features")
    models, parts = {}, []
    for name, (est, grid) in classifiers(label, len(numeric) + len(categorical)).items():
        if which and name not in which:
            continue
        if search and len(grid) > 1:
            rank = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
            model = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=rank, numFolds=folds, seed=SEED, parallelism=2).fit(tr).bestModel
        else:
            model = est.fit(tr, grid[0])
        scored = model.transform(te).withColumn("score", vector_to_array("probability")[1])
        models[name] = PipelineModel([*prep.stages, model])
        parts.append(mt.auc(scored, label, "score").select("auc", F.lit(name).alias("model")))
    tr.unpersist()
    return models, reduce(lambda a, b: a.unionByName(b), parts)


def probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1])


def out_of_fold(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], name: str = "logistic", folds: int = 3) -> DataFrame:
    """Scores of a classifier for rows it has not seen: each fold of a hash of the key is scored by a model of the others."""
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1)), F.lit(folds))
    parts = []
    for k in range(folds):
        models, _ = train_classifiers(df.where(fold != k), key, label, numeric, categorical, which=[name], search=False)
        parts.append(probability(models[name], df.where(fold == k)).select(key, label, "score"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def calibrate(scored: DataFrame, label: str, score: str = "score", width: float = 1e-4):
    """Isotonic map from score to observed rate. Scores within one bin of ``width`` are pooled into a weighted point at their mean for the fit; scoring takes the full score."""
    pooled = scored.groupBy(F.floor(F.col(score) / width).alias("_bin")).agg(F.avg(score).alias(score), F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol=score, labelCol="rate", weightCol="w", predictionCol="calibrated").fit(pooled)


def ae_target(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """A/E ratio with the expectation floored at .001, clipped to .2-10."""
    ratio = F.col(actual) / F.greatest(F.col(expected), F.lit(0.001))
    return df.withColumn("ae_target", F.greatest(F.lit(0.2), F.least(F.lit(10.0), ratio)))


ENSEMBLE = {"linear": 0.3, "random_forest": 0.35, "gradient_boosting": 0.35}


def ensemble(models: dict, df: DataFrame, key: str) -> DataFrame:
    """Weighted mean of the models' predictions, clipped to .25-5. Models add columns to the same rows; nothing is joined."""
    out = df
    use = {m: w for m, w in ENSEMBLE.items() if m in models}
    first = next(iter(models.values()))
    out = PipelineModel(first.stages[:-1]).transform(out)
    for m in use:
        out = models[m].stages[-1].transform(out).withColumnRenamed("prediction", f"p_{m}")
    mean = reduce(lambda a, b: a + b, [F.col(f"p_{m}") * w for m, w in use.items()]) / sum(use.values())
    return out.select(key, *[f"p_{m}" for m in use], F.greatest(F.lit(0.25), F.least(F.lit(5.0), mean)).alias("adjustment"))


def maturity_forecasts(wide: DataFrame, maturities: list[str], horizon: int = 5, lags: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """One forest per maturity on lagged values of all maturities; test RMSE and MAE on the last fifth."""
    from .series import by_date, chronological_split

    s = wide.withColumn("series", F.lit("curve"))
    feats = [F.lag(m, k).over(by_date()).alias(f"{m}_lag{k}") for m in maturities for k in lags]
    base = s.select("series", "date", *maturities, *feats, *[F.lead(m, horizon).over(by_date()).alias(f"{m}_target") for m in maturities]).dropna()
    base = chronological_split(base)
    names = [f"{m}_lag{k}" for m in maturities for k in lags] + maturities
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(base)
    parts = []
    for m in maturities:
        model = RandomForestRegressor(labelCol=f"{m}_target", seed=SEED, numTrees=10, maxDepth=4).fit(vec.where("split = 'train'"))
        scored = model.transform(vec.where("split = 'test'"))
        parts.append(mt.regression_metrics(scored, f"{m}_target", "prediction").select(F.lit(m).alias("maturity"), "rmse", "mae"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def reverting_forecasts(s: DataFrame, horizon: int = 5, window: int = 10, share: float = 0.8) -> DataFrame:
    """A forecaster for every series at once: series, kind, train_rows, test_rows, slope, rmse, mae, last_value_rmse, skill.

    ``s`` is long (series, kind, date, value): rates of any number of maturities and equity levels, which are taken in logs so that
    a change is a return. The change over ``horizon`` rows is regressed on the distance from the mean of the last ``window``
    rows, over the first ``share`` of each series; the fit of all series is one grouped aggregate, so neither the driver nor a task
    runs through series. Errors are those of the rest, against the last value as forecast; skill is 1 less their ratio. An equity
    level that is not positive is a gap. Series that are too short to have a test row are left out.
    """
    from .series import by_date, chronological_split, rolling

    level = F.when(F.col("kind") != "equity", F.col("value")).otherwise(F.when(F.col("value") > 0, F.ln(F.when(F.col("value") > 0, F.col("value")))))
    base = s.withColumn("level", level).where("level is not null")
    base = base.withColumns({"gap": F.col("level") - rolling(F.col("level"), window, F.avg), "move": F.lead("level", horizon).over(by_date()) - F.col("level")})
    base = chronological_split(base.where("gap is not null and move is not null"), share)
    fits = base.where("split = 'train'").groupBy("series").agg(
        F.count(F.lit(1)).alias("train_rows"), F.coalesce(F.regr_slope("move", "gap"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("move", "gap"), F.avg("move")).alias("start"),
    )
    error = F.col("start") + F.col("slope") * F.col("gap") - F.col("move")
    return (
        base.where("split = 'test'").join(fits, "series").groupBy("series", "kind", "train_rows", "slope").agg(
            F.count(F.lit(1)).alias("test_rows"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(F.col("move") * F.col("move"))).alias("last_value_rmse"))
        .withColumn("skill", 1 - F.try_divide("rmse", "last_value_rmse"))
    )


def portable_share(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that md5 draws for a key, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def balance(df: DataFrame, label: str, key: str, target: float = 0.15, low: float = 0.05, high: float = 0.5) -> DataFrame:
    """Thin the larger class so that the smaller makes up ``target``, where positives are below ``low`` or above ``high``.

    A hash of the key decides, so a rerun keeps the same rows. Otherwise, or where thinning would add rows, all rows stay.
    """
    c = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))).scalar()
    p, n = c.getField("p"), c.getField("n")
    minority, majority = F.least(p, n - p), F.greatest(p, n - p)
    larger = F.when(p * 2 > n, 1).otherwise(0)
    skewed = (p < n * low) | (p > n * high)
    keep = F.when(skewed, minority * ((1 - target) / target) / majority).otherwise(F.lit(1.0))
    return df.where((F.col(label) != larger) | (portable_share(F.col(key)) < keep))


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Normalised importance per feature (absolute coefficients for linear models)."""
    last = model.stages[-1]
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n.rsplit("_", 1)[0], abs(float(v))) for n, v in zip(names, values.toArray())]
    total = sum(v for _, v in rows) or 1.0
    return spark.createDataFrame([(n, v / total) for n, v in rows], "feature string, importance double")


def save_model(model: PipelineModel, path: str, metadata: DataFrame) -> None:
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata")


def sensitivity_grid(base: DataFrame, variable: str, low: Column, high: Column, points: int = 11) -> DataFrame:
    """Each base row at ``points`` evenly spaced values of one variable; ``base`` is small (one row per segment)."""
    at = base.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return at.withColumns({"base_x": F.col(variable).cast("double"), variable: low + (high - low) * F.col("_i") / (points - 1)}).drop("_i")


def kmeans_clusters(df: DataFrame, vector: str, k: int = 5) -> DataFrame:
    """Cluster id per row of array vectors."""
    v = df.withColumn("features", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    return KMeans(k=k, seed=SEED, maxIter=20).fit(v).transform(v).drop("features").withColumnRenamed("prediction", "cluster")


def area_under_curve(scored: DataFrame, label: str, score: str = "score") -> float:
    """Library cross-check of ``metrics.auc``."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score, metricName="areaUnderROC", numBins=0).evaluate(scored)
