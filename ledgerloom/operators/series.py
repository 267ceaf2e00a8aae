"""Daily series: lags, rolling statistics, indicators and splits.

Input is long, (series, date, value): one row per day and series, so a partition
by series holds a calendar's worth of rows however large the event table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import skew_join

def by_date():
    return Window.partitionBy("series").orderBy("date")


def rolling(c: Column, n: int, how, ready: bool = True) -> Column:
    """``how`` over the last n rows; NULL until n rows exist."""
    w = by_date().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, how(c).over(w)) if ready else how(c).over(w)


def change(c: Column, n: int = 1) -> Column:
    return c - F.lag(c, n).over(by_date())


def pct_change(c: Column, n: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, n).over(by_date())) - 1


def log_change(c: Column, n: int = 1) -> Column:
    return F.log(c) - F.log(F.lag(c, n).over(by_date()))


def rate_features(s: DataFrame, horizon: int = 5) -> DataFrame:
    """Levels lagged 1 and 5, rolling mean 10 and 252, rolling deviation 20 and 30, change, and the target ``horizon`` ahead."""
    v = F.col("value")
    return s.withColumns(
        {
            "lag_1": F.lag(v, 1).over(by_date()), "lag_5": F.lag(v, 5).over(by_date()),
            "ma_10": rolling(v, 10, F.avg), "ma_252": rolling(v, 252, F.avg),
            "sd_20": rolling(v, 20, F.stddev_samp), "sd_30": rolling(v, 30, F.stddev_samp),
            "change_1": change(v), "pct_1": pct_change(v), "pct_20": pct_change(v, 20), "log_change": log_change(v),
            "target": F.lead(v, horizon).over(by_date()),
        }
    )


def rsi(s: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from simple means of gains and losses."""
    d = change(F.col("value"))
    s = s.withColumn("_d", d).withColumns({"_g": F.greatest(F.col("_d"), F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    # The first difference is NULL; greatest() ignores NULL, so it is masked again.
    s = s.withColumns({"_g": F.when(F.col("_d").isNotNull(), F.col("_g")), "_l": F.when(F.col("_d").isNotNull(), F.col("_l"))})
    up, down = rolling(F.col("_g"), n, F.avg), rolling(F.col("_l"), n, F.avg)
    s = s.withColumns({"_up": up, "_down": down})
    strength = F.when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0))))
    return s.withColumn("rsi", F.when(F.col("_up").isNotNull(), strength)).drop("_d", "_g", "_l", "_up", "_down")


def equity_features(s: DataFrame) -> DataFrame:
    """Moving averages and their spread, momentum, volatility regime and RSI."""
    v = F.col("value")
    s = rsi(s).withColumns({"return_1": pct_change(v), "momentum_20": pct_change(v, 20), "ma_5": rolling(v, 5, F.avg), "ma_20": rolling(v, 20, F.avg)})
    s = s.withColumn("volatility_20", rolling(F.col("return_1"), 20, F.stddev_samp))
    mean_vol = F.avg("volatility_20").over(Window.partitionBy("series"))
    return s.withColumns({"ma_spread": F.col("ma_5") / F.col("ma_20") - 1, "high_volatility": F.coalesce(F.col("volatility_20") > mean_vol, F.lit(False))})


def annual_volatility(s: DataFrame, periods: int = 12) -> DataFrame:
    d = s.withColumn("_lc", log_change(F.col("value")))
    return d.groupBy("series").agg((F.stddev_samp("_lc") * F.sqrt(F.lit(float(periods)))).alias("volatility"), F.avg("value").alias("mean_rate"), F.count("value").alias("n"))


def mean_reversion(s: DataFrame, periods: int = 12) -> DataFrame:
    """Minus the slope of the change on the level before it, annualised, held within .01-.5."""
    d = s.withColumn("_x", F.lag("value", 1).over(by_date())).withColumn("_y", F.col("value") - F.col("_x"))
    slope = d.groupBy("series").agg(F.regr_slope("_y", "_x").alias("slope"))
    return slope.withColumn("mean_reversion", F.greatest(F.lit(0.01), F.least(F.lit(0.5), -F.col("slope") * periods)))


def elasticity(points: DataFrame, by: list[str]) -> DataFrame:
    """corr·sd(y)/sd(x) on logs against the base point; points has x, y, base_x, base_y."""
    lx = F.log(F.greatest(F.lit(0.001), F.col("x") / F.col("base_x")))
    ly = F.log(F.greatest(F.lit(0.001), F.col("y") / F.col("base_y")))
    p = points.withColumns({"_lx": lx, "_ly": ly})
    fit = F.corr("_lx", "_ly") * F.stddev_pop("_ly") / F.nullif(F.stddev_pop("_lx"), F.lit(0.0))
    out = p.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), fit.alias("elasticity"))
    e = F.when(F.col("points") < 3, 0.0).otherwise(F.coalesce("elasticity", F.lit(0.0)))
    return out.withColumn("elasticity", e).withColumn("direction", F.when(F.col("elasticity") > 0, "positive").otherwise("negative"))


def year_on_year(monthly: DataFrame) -> DataFrame:
    """Change against the value twelve rows earlier."""
    return monthly.withColumn("yoy", pct_change(F.col("value"), 12))


def chronological_split(s: DataFrame, share: float = 0.8) -> DataFrame:
    """First ``share`` of each series to train, the rest to test."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    return s.withColumn("split", F.when(F.row_number().over(by_date()) <= F.floor(n * share), "train").otherwise("test"))


def curve_measures(wide: DataFrame) -> DataFrame:
    """Slope, curvature, real rate and inversion from columns y2, y5, y10 and inflation."""
    return wide.withColumns(
        {
            "slope": F.col("y10") - F.col("y2"), "curvature": 2 * F.col("y5") - F.col("y2") - F.col("y10"), "real_rate": F.col("y10") - F.col("inflation"),
            "inverted": F.col("y2") > F.col("y10"),
        }
    )


def as_of_join(rows: DataFrame, states: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """Attach to each row the latest state of its key at or before its time; NULL where there is none, or where a key or the time is NULL.

    Of states with one key and time the one that is largest in ``columns`` counts. Without a key ``time`` is a date: states are
    spread to the days they hold and met in an equi join, so no window ever runs over the big side. With a key see ``_keyed_as_of``.
    """
    if key:
        return _keyed_as_of(rows, states, key, time, columns)
    once = states.where(F.col(time).isNotNull()).groupBy(time).agg(F.max(F.struct(*columns)).alias("_s")).select(time, "_s.*")
    newest = once.agg(F.max_by(F.struct(time, *columns), time)).scalar()
    last = once.agg(F.max(time)).scalar()
    spans = once.withColumn("_next", F.lead(time).over(Window.partitionBy(F.lit(0)).orderBy(time)))  # one row per date
    end = F.coalesce(F.date_sub("_next", 1), F.col(time))
    daily = spans.withColumn("_day", F.explode(F.sequence(F.col(time), F.greatest(F.col(time), end)))).select("_day", *columns)
    # After the last state, the last state holds: those rows, maybe most, take it as a scalar and meet no key.
    after = F.col(time) >= last
    joined = skew_join(rows.withColumn("_day", F.when(~after, F.col(time))), daily, "_day", "left")
    return joined.withColumn("_new", newest).withColumns({c: F.when(after, F.col("_new")[c]).otherwise(F.col(c)) for c in columns}).drop("_day", "_new")


def _keyed_as_of(rows: DataFrame, states: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """Rows and states in one order by key and time, cut into ranges; each range fills forward on its own.

    A key with a third of all rows lies in many ranges. What such a range's head needs is the newest state of the ranges
    before it, if that is of the same key: one row per range carries it over the cut. Times of any type will do.
    """
    complete = F.lit(True)
    for c in [*key, time]:
        complete = complete & F.col(c).isNotNull()
    known = states.where(complete).groupBy(*key, time).agg(F.max(F.struct(*columns)).alias("_state"))
    mine = rows.select("*", F.lit(None).cast(known.schema["_state"].dataType).alias("_state"), F.lit(1).alias("_kind"), F.xxhash64(*rows.columns).alias("_tie"))
    both = mine.unionByName(known.select("*", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie")), allowMissingColumns=True)
    cut = cut_lineage(both.repartitionByRange(*key, time, "_kind", "_tie").withColumn("_range", F.spark_partition_id()), "as-of")
    whose = F.struct(*key)
    newest = F.max_by(F.struct(whose.alias("key"), "_state"), F.when(F.col("_kind") == 0, F.struct(*key, time)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = cut.groupBy("_range").agg(newest.alias("_newest")).select("_range", F.last("_newest", ignorenulls=True).over(before).alias("_carried"))
    upto = Window.partitionBy("_range", *key).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_here", F.last("_state", ignorenulls=True).over(upto)).where("_kind = 1").join(carried, "_range")
    state = F.coalesce("_here", F.when((F.col("_carried.key") == whose) & F.col(time).isNotNull(), F.col("_carried._state")))
    return filled.withColumn("_found", state).select(*rows.columns, *[F.col("_found")[c].alias(c) for c in columns])


def latest_values(states: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """One row: each column's value at the newest time where it is known."""
    return states.agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])
