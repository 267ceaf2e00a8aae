"""Joins and prefix sums that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1 / 1000
HOT_ROWS = 1_000_000
#: Rows of a heavy key that one task joins; its salts follow from its sketched count.
ROWS_PER_SALT = 1_000_000
#: Tasks that rows with a NULL key, which match nothing, are spread over.
NULL_SALTS = 4096


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, rows: int = HOT_ROWS) -> Column:
    """Heavy keys of ``df`` as one scalar subquery: a map from hash to estimated rows.

    A frequent-items sketch finds them in one pass, with no shuffle of the rows.
    At most ``1 / share`` keys can qualify, which bounds the map. A miss costs
    only balance: both join sides read the same map, so results do not depend on it.
    """
    sketch = df.select(_key_hash(keys).alias("_k")).agg(
        F.expr("approx_top_k(_k, 1000, 10000)").alias("_top"), F.count(F.lit(1)).alias("_n")
    )
    floor = F.greatest(F.lit(float(rows)), F.col("_n") * F.lit(share))
    heavy = F.filter("_top", lambda t: t["count"] > floor)
    return sketch.select(F.map_from_arrays(F.transform(heavy, lambda t: t["item"]), F.transform(heavy, lambda t: t["count"])).alias("_hot")).scalar()


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str] | str,
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    share: float = HOT_SHARE,
    rows: int = HOT_ROWS,
    hot: Column | None = None,
) -> DataFrame:
    """Equi join in which the rows of a heavy key are spread over tasks of about ``rows_per_salt`` rows.

    Only the rows of ``small`` with a heavy key are repeated. Spark still turns
    this into a broadcast join when ``small`` is measured to be small.
    ``how`` is inner, left, left_semi or left_anti; ``small`` may hold repeated keys.
    ``hot`` takes an earlier ``hot_keys`` result, so a derived ``big`` is not computed twice.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = hot_keys(big, keys, share, rows) if hot is None else hot
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # Row hash plus partition id: identical copies of one row spread out too.
    spread = F.xxhash64(*[F.col(c) for c in big.columns]) + F.spark_partition_id()
    salts = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(F.try_element_at(hot, _key_hash(keys)), F.lit(0)) / F.lit(rows_per_salt)))
    left = big.withColumn("_salt", F.pmod(spread, F.when(null_key, F.lit(NULL_SALTS).cast("long")).otherwise(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def attach(rows: DataFrame, stats: DataFrame, keys: list[str] | str, hot: Column | None = None) -> DataFrame:
    """Put group statistics back on every row (``stats`` has one row per key)."""
    return skew_join(rows, stats, keys, "left", hot=hot)


def running_totals(df: DataFrame, order: str, totals: dict[str, str], buckets: int = 256) -> DataFrame:
    """Add running sums over a global order without sorting everything in one task.

    ``df`` must hold one row per value of ``order`` (aggregate first). Rows fall
    into ranges cut at sketched quantiles; the ranges' own totals, at most
    ``buckets`` rows, carry the offsets. ``totals`` maps new column -> summed column.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(order, cuts, 10000).alias("_e")).scalar()
    ranged = df.withColumn("_e", edges).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(order)))).drop("_e")
    per_range = ranged.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.withColumns({n: F.sum(c).over(inside) for n, c in totals.items()})
    joined = joined.join(F.broadcast(offsets), "_b")  # at most `buckets` rows
    return joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in totals}).drop(
        "_b", *[f"_o_{n}" for n in totals]
    )


def with_neighbours(df: DataFrame, sheet: str, idx: str, reach: int, chunk: int = 50_000) -> tuple[DataFrame, Window]:
    """Cut an ordered sheet into chunks that overlap by ``reach`` rows.

    Returns the rows, each repeated into the chunks that need it, and the window
    to evaluate over. ``own_rows`` drops the repeats afterwards. One sheet with
    a third of all rows is thus shared by many tasks.
    """
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(idx) - reach) / chunk))
    last = F.floor((F.col(idx) + reach) / chunk)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return spread, Window.partitionBy(sheet, "_chunk").orderBy(idx)


def own_rows(df: DataFrame, idx: str, chunk: int = 50_000) -> DataFrame:
    return df.where(F.col("_chunk") == F.floor(F.col(idx) / chunk)).drop("_chunk")
