"""The named queries: a Spark job and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)
    days: tuple[str, ...] = ()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        # Sums of doubles depend on their order, so published values are rounded; dates are published as text.
        shown = {c: F.round(c, n) + F.lit(0.0) for c, n in self.digits.items()}
        shown |= {c: F.date_format(c, "yyyy-MM-dd") for c in self.days}
        return df.withColumns(shown) if shown else df

    def oracle(self) -> str | None:
        shown = [f"round({c}, {n}) + 0.0 AS {c}" for c, n in self.digits.items()]
        shown += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in self.days]
        if self.sql is None or not shown:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(shown)}) FROM ({self.sql})"


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, r2: str = "", r4: str = "", r6: str = "", day: str = ""):
    """Register a job. ``r2``, ``r4`` and ``r6`` name the columns published with that many digits, ``day`` the dates."""
    digits = {c: n for names, n in ((r2, 2), (r4, 4), (r6, 6)) for c in names.split()}

    def add(fn):
        QUERIES[fn.__name__] = Query(fn.__name__, ids, fn, sql, digits, tuple(day.split()))
        return fn

    return add
