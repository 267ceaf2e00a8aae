"""The whole cleaning of a policy table as it comes, with a log of what each step changed and the quality before and after."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import clean as cl
from .quality import keep_last


@dataclass(frozen=True)
class Cleaned:
    """``rows``: the clean table. ``actions``: step, action, column_name, cells. ``quality``: stage, rows, completeness, consistency, quality_score."""

    rows: DataFrame
    actions: DataFrame
    quality: DataFrame


class _Watch:
    """Counts taken while the rows pass by. Each is placed in a stage that ends in a written table, so a task that runs again is not counted twice."""

    def __init__(self):
        self.made: list[tuple[int, str, dict[str, str | None], Observation]] = []

    def count(self, df: DataFrame, step: int, action: str, counts: dict[str | None, F.Column]) -> DataFrame:
        seen = Observation(f"{action}-{os.urandom(4).hex()}")
        names = {f"c{i}": c for i, c in enumerate(counts)}
        self.made.append((step, action, names, seen))
        return df.observe(seen, *[e.alias(f"c{i}") for i, e in enumerate(counts.values())])

    def step(self, df: DataFrame, step: int, action: str, columns: list[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``apply`` the step and count the cells of ``columns`` that it changed."""
        if not columns:
            return df
        names = df.columns
        after = apply(df.withColumns({f"_was_{c}": F.col(c) for c in columns}))
        counts = {c: F.count_if(~F.col(c).eqNullSafe(F.col(f"_was_{c}"))) for c in columns}
        return self.count(after, step, action, counts).select(names)

    def rows(self) -> list[tuple]:
        return [(step, action, c, int(seen.get[n])) for step, action, names, seen in self.made for n, c in names.items()]


def _quality(found: list[tuple], stage: str, cells: int, positive: list[str]) -> tuple:
    """70 % completeness and 30 % product of the shares that are not negative, from the counts of ``stage``."""
    n = {c: k for _, action, c, k in found if action == stage}
    rows = n["rows"]
    if not rows or not cells:
        return stage, rows, None, None, None
    complete = n["filled"] / (rows * cells)
    consistent = reduce(lambda a, c: a * (1 - n[c] / rows), positive, 1.0)
    return stage, rows, complete, consistent, (0.7 * complete + 0.3 * consistent) * 100


def clean_dataset(
    df: DataFrame, keys: list[str], order: str, asof: str, absolute: tuple[str, ...] = ("face_amount",), rounded: tuple[str, ...] = ("face_amount", "premium"),
    capped: tuple[str, ...] = ("face_amount", "premium"),
) -> Cleaned:
    """Type, trim, repair, standardise, normalise, drop duplicates, fill, cap and apply the rules.

    ``df`` is a policy table as it was landed: any column may be text, ``order`` is its row number. Text columns are typed by their names.
    Of rows with equal ``keys``, as they were landed, the last in ``order`` stays. Amounts and premiums are filled with
    the median, other numbers with the mean, text with the mode, dates with the last date before in ``order``.
    Cells are counted over all rows up to the step that drops duplicates, and over the rows that stay after it; cells that
    could not be read as their type are counted as unreadable and are gaps from then on. Empty table: no rows, counts of 0 and no score.
    The counts are taken by observed metrics in the passes that write the table, four in all.
    """
    watch, names, fields = _Watch(), df.columns, [c for c in df.columns if c != order]
    kept = {f"_key_{c}": F.col(c) for c in keys}
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in fields])
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    raw = df.withColumns(kept | {"_filled": filled} | {f"_raw_{c}": F.col(c) for c in text})
    typed = cl.coerce_types(raw, text)
    kinds = {f.name: f.dataType for f in typed.schema.fields}
    retyped = [c for c in text if not isinstance(kinds[c], T.StringType)]
    numbers = [c for c in fields if isinstance(kinds[c], T.NumericType)]
    days = [c for c in fields if isinstance(kinds[c], (T.DateType, T.TimestampType))]
    positive = [c for c in numbers if any(w in c.lower() for w in ("amount", "premium", "age"))]
    negative = {c: F.count_if(F.col(c) < 0) for c in positive}

    d = watch.count(typed, 0, "before", {"rows": F.count(F.lit(1)), "filled": F.coalesce(F.sum("_filled"), F.lit(0)), **negative})
    if retyped:
        d = watch.count(d, 1, "type", {c: F.count(c) for c in retyped})
        d = watch.count(d, 1, "unreadable", {c: F.count_if(F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull()) for c in retyped})
    spaced = [c for c in text if c not in retyped]
    if spaced:
        d = watch.count(d, 1, "trim", {c: F.count_if(F.col(c) != F.col(f"_raw_{c}")) for c in spaced})
    d = d.select(*names, *kept)
    d = watch.step(d, 2, "repair_date", days, lambda x: x.withColumns({c: cl.repair_future(F.col(c), asof) for c in days}))
    kinds_of = [c for c in names if c in cl.CATEGORIES]
    d = watch.step(d, 3, "standardise", kinds_of, lambda x: cl.standardise_categories(x, {c: c for c in kinds_of}))
    amounts = [c for c in dict.fromkeys([*absolute, *rounded]) if c in numbers]
    d = watch.step(d, 4, "normalise_amount", amounts, lambda x: cl.normalise_amounts(x, [c for c in absolute if c in amounts], [c for c in rounded if c in amounts]))
    d = cut_lineage(d, "clean-typed")

    d = keep_last(d, list(kept), [F.desc(order)]).select(names)
    d = cut_lineage(watch.count(d, 5, "rows_kept", {None: F.count(F.lit(1))}), "clean-once")

    fills = cl.fill_values(d.select(fields))
    # Dates first: their joins lie below all counts, which then belong to the tasks that write.
    d = d.withColumns({f"_day_{c}": F.col(c) for c in days})
    for c in days:
        d = cl.forward_fill(d, order, c)
    if days:
        d = watch.count(d, 6, "fill_forward", {c: F.count_if(~F.col(c).eqNullSafe(F.col(f"_day_{c}"))) for c in days}).select(names)
    for how in ("median", "mean", "mode"):
        mine = {c: v for c, (kind, v) in fills.items() if kind == how}
        d = watch.step(d, 6, f"fill_{how}", list(mine), lambda x, mine=mine: x.withColumns({c: F.coalesce(F.col(c), v) for c, v in mine.items()}))
    d = cut_lineage(d, "clean-filled")

    capping = [c for c in capped if c in numbers]
    d = watch.step(d, 7, "cap", capping, lambda x: cl.cap_outliers(x, capping))
    ruled = ["face_amount", "premium", "issue_age", "current_age"]
    if set(ruled) <= set(numbers):
        d = watch.step(d, 8, "rule", ruled, cl.actuarial_rules)
    d = watch.count(d, 9, "after", {"rows": F.count(F.lit(1)), "filled": F.coalesce(F.sum(filled), F.lit(0)), **negative})
    d = cut_lineage(d, "clean-done")

    found, spark = watch.rows(), df.sparkSession
    scores = [_quality(found, stage, len(fields), positive) for stage in ("before", "after")]
    gone = scores[0][1] - next(k for _, action, _, k in found if action == "rows_kept")
    log = [(step, action, c, k) for step, action, c, k in found if action not in ("before", "after", "rows_kept")]
    log.append((5, "drop_duplicates", None, gone))
    return Cleaned(
        d, spark.createDataFrame(log, "step int, action string, column_name string, cells long"),
        spark.createDataFrame(scores, "stage string, rows long, completeness double, consistency double, quality_score double"),
    )
