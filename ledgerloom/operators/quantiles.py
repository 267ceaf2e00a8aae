"""Exact, linearly interpolated quantiles with a stated number of rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import skew_join

ACCURACY = 10_000
MARGIN = 10 / ACCURACY
#: Distinct values of one group and rank that a task may sort.
BUDGET = 1_000_000
#: Sub-ranges that a bracket over the budget is cut into.
PIECES = 128


def _per_group(values: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``values`` with the columns of ``table``, which has one row per group (one row if ``by`` is empty)."""
    if by:
        return skew_join(values, table, by, "inner")
    one = table.select(F.struct(*table.columns).alias("s")).scalar()
    return values.withColumn("_s", one).select("*", "_s.*").drop("_s")


def _count_brackets(values: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """How often each value in the bracket of a target occurs: by, n_values, _i, _v, _c. NULL stands for all values below the bracket."""
    cuts = [max(0.0, p - MARGIN) for p in ps] + [min(1.0, p + MARGIN) for p in ps]
    sketch = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_values"), F.percentile_approx("_v", cuts, ACCURACY).alias("_e")
    )
    small = F.col("n_values") <= ACCURACY
    lows = [
        F.when(small | F.lit(p - MARGIN <= 0), F.lit(float("-inf"))).otherwise(F.col("_e")[i])
        for i, p in enumerate(ps)
    ]
    highs = [
        F.when(small | F.lit(p + MARGIN >= 1), F.lit(float("inf"))).otherwise(F.col("_e")[len(ps) + i])
        for i, p in enumerate(ps)
    ]
    brackets = sketch.select(
        *by,
        "n_values",
        F.array(*[F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"))
                  for i, (lo, hi) in enumerate(zip(lows, highs))]).alias("_br"),
    )
    return (
        _per_group(values, brackets, by).select(*by, "n_values", "_v", F.explode("_br").alias("_t"))
        .where(F.col("_v") <= F.col("_t.hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_t.lo"), F.col("_v")))
        .groupBy(*by, "n_values", F.col("_t.i").alias("_i"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def _rank(ps: list[float]) -> tuple[Column, Column]:
    """The exact position of target ``_i`` among its group's values, and the position below it."""
    pos = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_i") + 1) * (F.col("n_values") - 1)
    return pos, F.floor(pos)


def narrow(counted: DataFrame, keys: list[str], ps: list[float], budget: int, pieces: int = PIECES) -> DataFrame:
    """``counted`` (keys, n_values, _v, _c) with no more than ``budget`` rows of one key.

    A key over the budget is cut at sketched quantiles of its values into ``pieces`` sub-ranges; their rows are counted,
    the two that can hold the target's neighbours stay, and the counts of those below are added to the NULL row.
    Each round leaves about 2 / ``pieces`` of a key's rows and reads only what the round before left.
    """
    if budget < 4 * pieces:
        raise ValueError(f"a budget under {4 * pieces} rows cannot be reached with {pieces} pieces")
    pos, floor = _rank(ps)
    done = None
    while True:
        sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        over = cut_lineage(
            counted.join(sizes.where(F.col("_rows") > budget).drop("_rows"), keys, "left_semi").where("_v is not null")
            .groupBy(*keys).agg(F.percentile_approx("_v", [j / pieces for j in range(1, pieces)], 20 * pieces).alias("_cuts")),
            "quantile-cuts",
        )
        if not over.limit(1).count():
            return counted if done is None else done.unionByName(counted)
        fits = counted.join(over.select(*keys), keys, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        # NULL stays below everything; a piece's number is that of its upper edge.
        number = F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda e: e < F.col("_v"))))
        placed = cut_lineage(skew_join(counted, over, keys, "inner").withColumn("_piece", number).drop("_cuts"), "quantile-pieces")
        per_piece = placed.groupBy(*keys, "n_values", "_piece").agg(F.sum("_c").alias("_pc"))
        upto = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)  # one row per piece
        chosen = (
            per_piece.withColumn("_cum", F.sum("_pc").over(upto)).withColumn("_k", floor)
            .withColumn("_holds", (F.col("_cum") > F.col("_k")) & (F.col("_cum") - F.col("_pc") <= F.least(F.col("_k") + 1, F.col("n_values") - 1)))
            .groupBy(*keys, "n_values").agg(
                F.min(F.when(F.col("_holds"), F.col("_piece"))).alias("_first"), F.max(F.when(F.col("_holds"), F.col("_piece"))).alias("_last"),
                F.min(F.when(F.col("_holds"), F.col("_cum") - F.col("_pc"))).alias("_below"),
            )
        )
        chosen = cut_lineage(chosen, "quantile-chosen")
        kept = skew_join(placed, chosen.drop("n_values", "_below"), keys, "inner").where("_piece >= _first and _piece <= _last and _v is not null")
        below = chosen.where("_below > 0").select(*keys, "n_values", F.lit(None).cast("double").alias("_v"), F.col("_below").alias("_c"))
        counted = cut_lineage(kept.select(*keys, "n_values", "_v", "_c").unionByName(below), "quantile-narrowed")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], budget: int = BUDGET) -> DataFrame:
    """One row per group: the columns of ``by``, ``n_values`` and one column per entry of ``probs``.

    ``percentile`` keeps every distinct value of a group in one buffer. Here a
    mergeable sketch first brackets each target rank; the bracket (some 0.2 % of a large group), counted by
    value and staged, is narrowed until it has no more than ``budget`` distinct values, and those are sorted.
    Groups no larger than the sketch are bracketed by their whole range.
    A bracket that missed its rank would raise, never give a wrong answer. Rows with a NULL in ``by``
    or a NULL or NaN value are left out.
    """
    names, ps = list(probs), [float(p) for p in probs.values()]
    values = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    keys = [*by, "_i"]
    ranked = narrow(cut_lineage(_count_brackets(values, by, ps), "quantile-brackets"), keys, ps, budget)
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    pos, floor = _rank(ps)
    hits = (
        ranked.withColumn("_cum", F.sum("_c").over(upto))
        .withColumn("_pos", pos)
        .withColumn("_k", floor)
        .withColumn("_k1", F.least(F.col("_k") + 1, F.col("n_values") - 1))
    )

    def at(rank: str):
        return F.max(F.when((F.col("_cum") > F.col(rank)) & (F.col("_cum") - F.col("_c") <= F.col(rank)), F.col("_v")))

    found = hits.groupBy(*keys, "n_values").agg(
        at("_k").alias("_lo"), at("_k1").alias("_hi"), F.max(F.col("_pos") - F.col("_k")).alias("_f")
    )
    missed = F.col("_lo").isNull() | F.col("_hi").isNull()
    answer = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(
        F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))
    )
    return found.withColumn("_q", answer).groupBy(*by, "n_values").agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )
