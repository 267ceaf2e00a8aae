"""Trained models in a session that has observed metrics."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerloom.operators import ml


@pytest.mark.parametrize("name", ["logistic", "random_forest", "gradient_boosting", "neural_network"])
def test_classifiers_score_after_an_observation(spark, name):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3
    rows = spark.range(400).select("id", (F.col("id") % 50).alias("x"), F.lit("a").alias("kind"), (F.col("id") % 50 > 24).cast("int").alias("y"))
    models, auc = ml.train_classifiers(rows, "id", "y", ["x"], ["kind"], which=[name], search=name == "logistic")
    assert auc.first()["auc"] > 0.9
    assert ml.probability(models[name], rows).where("score between 0 and 1").count() == 400
