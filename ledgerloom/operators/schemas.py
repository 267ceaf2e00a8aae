"""Landed files against the declared schema of their kind: required columns, types and gaps, one row per finding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FileKind:
    """What a kind of file is declared to hold: required columns, types, and columns that may well be empty."""

    required: tuple[str, ...]
    types: dict[str, str]
    sparse: tuple[str, ...] = ()


# The declared columns of the five file kinds.
FILE_KINDS = {
    "treaty": FileKind(("premium",), {"premium": "Float", "loss_ratio": "Float"}, ("limit", "cession_rate", "minimum_premium", "maximum_premium", "profit_commission", "aggregate_limit")),
    "claims": FileKind(("gross_claim_amount",), {"gross_claim_amount": "Float"}),
    "portfolio": FileKind(("total_sum_insured",), {"total_sum_insured": "Float", "number_of_risks": "Int"}),
    "catastrophe": FileKind(("event_id",), {"industry_loss": "Float", "modeled_loss": "Float"}),
    "development": FileKind(("incurred_amount",), {"incurred_amount": "Float", "paid_amount": "Float"}),
}
# Percent of missing cells above which a column is reported.
MISSING_CRITICAL, MISSING_WARNING, MISSING_SPARSE = 50.0, 20.0, 80.0

#: Each type with the next wider one: a value of a type can stand for any that a walk from it reaches.
WIDER = {"Int": "Float", "Float": "Decimal", "Decimal": "String", "Date": "Datetime", "Datetime": "String", "Boolean": "String"}


def family(kind: T.DataType) -> str:
    """The declared name that a Spark type goes by."""
    if isinstance(kind, T.IntegralType):
        return "Int"
    if isinstance(kind, T.FractionalType):
        return "Decimal" if isinstance(kind, T.DecimalType) else "Float"
    named = {T.StringType: "String", T.DateType: "Date", T.TimestampType: "Datetime", T.TimestampNTZType: "Datetime", T.BooleanType: "Boolean"}
    return next((name for t, name in named.items() if isinstance(kind, t)), kind.simpleString())


def steps_up(actual: str, declared: str) -> int | None:
    """How far up the lattice ``declared`` lies from ``actual``; None if it is not above."""
    at, n = actual, 0
    while at is not None:
        if at == declared:
            return n
        at, n = WIDER.get(at), n + 1
    return None


def type_level(actual: str, declared: str) -> str | None:
    """None for the declared type, INFO for a narrower number, WARNING for what would have to be converted."""
    if actual == declared:
        return None
    numbers = {"Int", "Float", "Decimal"}
    return "INFO" if steps_up(actual, declared) and {actual, declared} <= numbers else "WARNING"


def schema_findings(df: DataFrame, kind: str, kinds: dict[str, FileKind] = FILE_KINDS) -> DataFrame:
    """Findings on a landed file of ``kind``: check, level, column_name, declared, actual, affected_rows, missing_pct.

    Checks are required (a column that is not there), type (of the columns that are) and missing (each column's share of gaps
    against its band). Columns are read in one aggregate; types come from the schema alone. affected_rows is 0 where a check is not about rows. A file without rows has no gaps.
    """
    spec, schema = kinds[kind], df.schema
    none = F.lit(None)
    fixed = [("required", "CRITICAL", c, spec.types.get(c), None) for c in spec.required if c not in df.columns]
    fixed += [("type", level, c, declared, family(schema[c].dataType)) for c, declared in spec.types.items()
              if c in df.columns and (level := type_level(family(schema[c].dataType), declared))]

    def row(check, level, column, declared, actual, rows, share):
        return F.struct(check.alias("check"), level.alias("level"), F.lit(column).alias("column_name"), declared.cast("string").alias("declared"), actual.cast("string").alias("actual"),
                        rows.cast("long").alias("affected_rows"), share.cast("double").alias("missing_pct"))

    found = [row(F.lit(k), F.lit(level), c, F.lit(declared), F.lit(actual), F.lit(0), none) for k, level, c, declared, actual in fixed]
    for i, c in enumerate(df.columns):
        gaps = F.col("_rows") - F.col(f"_c{i}")
        share = F.when(F.col("_rows") > 0, gaps / F.col("_rows") * 100)
        if c in spec.sparse:
            level = F.when(share > MISSING_SPARSE, "WARNING")
        else:
            level = F.when(share > MISSING_CRITICAL, "CRITICAL").when(share > MISSING_WARNING, "WARNING")
        found.append(row(F.lit("missing"), level, c, none, none, gaps, share))
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.lit(kind).alias("file_kind"), F.explode(F.array(*found)).alias("f")).select("file_kind", "f.*").where("level is not null")
