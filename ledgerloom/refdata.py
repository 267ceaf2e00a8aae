"""Small reference tables. Each has a fixed number of rows, so broadcasting it is bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Yearly death rates at every fifth age from 20 to 100.
GRID_AGES = list(range(20, 101, 5))
GRID_RATES = {
    ("M", "Nonsmoker"): [
        0.00067, 0.00076, 0.00088, 0.00102, 0.00137, 0.00211, 0.00322, 0.00456, 0.00656, 0.01177,
        0.01823, 0.02934, 0.04756, 0.07658, 0.12334, 0.19876, 0.31234,
    ],
    ("F", "Nonsmoker"): [
        0.00043, 0.00048, 0.00053, 0.00056, 0.00078, 0.00123, 0.00191, 0.00284, 0.00432, 0.00738,
        0.01234, 0.02045, 0.03456, 0.05823, 0.09876, 0.16745, 0.28934,
    ],
    ("M", "Smoker"): [
        0.00168, 0.00190, 0.00220, 0.00255, 0.00343, 0.00528, 0.00805, 0.01140, 0.01640, 0.02943,
        0.04558, 0.07335, 0.11890, 0.19145, 0.30835, 0.49690, 0.78085,
    ],
    ("F", "Smoker"): [
        0.00108, 0.00120, 0.00133, 0.00140, 0.00195, 0.00308, 0.00478, 0.00710, 0.01080, 0.01845,
        0.03085, 0.05113, 0.08640, 0.14558, 0.24690, 0.41863, 0.72335,
    ],
}
# Exponential mortality law a * exp(b * (age - 20)).
LAW = {
    ("FEMALE", "NON-SMOKER"): (0.0001, 0.085),
    ("FEMALE", "SMOKER"): (0.00015, 0.095),
    ("MALE", "NON-SMOKER"): (0.00015, 0.09),
    ("MALE", "SMOKER"): (0.0002, 0.10),
}
ULTIMATE = 999


def law_rate(age: Column, sex: Column, smoking: Column) -> Column:
    rate = F.lit(None).cast("double")
    for (s, k), (a, b) in LAW.items():
        rate = F.when((sex == s) & (smoking == k), F.lit(a) * F.exp(F.lit(b) * (age - 20))).otherwise(rate)
    return F.least(F.lit(0.8), F.greatest(F.lit(0.0001), rate))


def select_ultimate_table(spark: SparkSession) -> DataFrame:
    """(age, sex, smoking, duration, qx): ages 18-100, durations 1-25 and 999 for ultimate."""
    cells = [(s, k) for s, k in LAW]
    durations = F.concat(F.sequence(F.lit(1), F.lit(25)), F.array(F.lit(ULTIMATE)))
    base = (
        spark.range(18, 101)
        .select(F.col("id").cast("int").alias("age"), F.explode(F.array(*[F.struct(
            F.lit(s).alias("sex"), F.lit(k).alias("smoking")) for s, k in cells])).alias("c"))
        .select("age", "c.sex", "c.smoking", F.explode(durations).alias("duration"))
    )
    d = F.col("duration")
    selection = F.when(d <= 25, F.greatest(F.lit(0.3), 1 - F.lit(0.8) * F.exp(F.lit(-0.2) * d))).otherwise(F.lit(1.0))
    return base.withColumn("qx", law_rate(F.col("age"), F.col("sex"), F.col("smoking")) * selection)


def improvement_scale(spark: SparkSession) -> DataFrame:
    """(age, sex, annual_improvement) for ages 0-120."""
    age = F.col("age")
    by_age = F.when(age < 30, -0.020).when(age < 65, -0.015).when(age < 85, -0.010).otherwise(-0.005)
    return (
        spark.range(0, 121)
        .select(F.col("id").cast("int").alias("age"), F.explode(F.array(F.lit("MALE"), F.lit("FEMALE"))).alias("sex"))
        .withColumn("annual_improvement", by_age * F.when(F.col("sex") == "FEMALE", 0.9).otherwise(1.0))
    )


def grid_mortality(spark: SparkSession) -> DataFrame:
    """(age, gender, smoker_status, qx) for every age 0-120: the five-year grid, interpolated, ends held."""
    rows = [(a, g, s, q) for (g, s), rates in GRID_RATES.items() for a, q in zip(GRID_AGES, rates)]
    grid = spark.createDataFrame(rows, "grid_age int, gender string, smoker_status string, rate double")
    w = Window.partitionBy("gender", "smoker_status").orderBy("grid_age")
    steps = grid.withColumns(
        {
            "next_rate": F.coalesce(F.lead("rate").over(w), F.col("rate")),
            "first": F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("grid_age")),
            "last": F.coalesce(F.lead("grid_age").over(w) - 1, F.lit(120)),
        }
    )
    step = (F.col("age") - F.col("grid_age")) / F.lit(5.0)
    held = (F.col("age") <= F.col("grid_age")) | (F.col("grid_age") >= 100)
    return steps.withColumn("age", F.explode(F.sequence("first", "last"))).select(
        "age",
        "gender",
        "smoker_status",
        F.when(held, F.col("rate")).otherwise(F.col("rate") + (F.col("next_rate") - F.col("rate")) * step).alias("qx"),
    )


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal dimension table."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def lookup(key: Column, values: dict[str, float], default: float | None = None) -> Column:
    """A literal map as one expression; keeps a factor lookup inside the projection."""
    out = F.lit(default).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out
