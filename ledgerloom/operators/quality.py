"""Profiles, quality scores and validation rules, each in one or two passes over the table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles


def long_rows(values: list[tuple], names: list[str]) -> Column:
    """An exploded array of structs: turns one wide aggregate row into one row per column."""
    return F.explode(F.array(*[F.struct(*[v.alias(n) for v, n in zip(vs, names)]) for vs in values]))


def text_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) for every cell, values as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) without nulls. The value is part of the key, so no column becomes one task."""
    return text_of(df, columns).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k commonest values per column (ties by value); rank 1 is the mode."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count and percent per column, from one aggregate."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count(c).alias(c) for c in columns])
    out = one.select(long_rows([(F.lit(c), F.col("_n") - F.col(c), F.col("_n")) for c in columns], ["column_name", "missing", "n"]).alias("r")).select("r.*")
    pct = F.col("missing") / F.col("n") * 100
    return out.withColumn("missing_pct", pct).withColumn(
        "level", F.when(pct > 50, "CRITICAL").when(pct > 20, "WARNING").otherwise("OK")
    ).drop("n")


def column_profile(df: DataFrame, numeric: list[str]) -> DataFrame:
    """count, nulls, distinct, mean, sd, min, max, zeros, negatives and exact quartiles per numeric column."""
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for c in numeric:
        x = F.col(c).cast("double")
        parts = {
            "count": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
            "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0),
        }
        aggs += [e.alias(f"{c}|{k}") for k, e in parts.items()]
        rows.append((F.lit(c), F.col("_n") - F.col(f"`{c}|count`"), *[F.col(f"`{c}|{k}`") for k in parts]))
    names = ["column_name", "nulls", "count", "mean", "sd", "min", "max", "zeros", "negatives"]
    base = df.agg(*aggs).select(long_rows(rows, names).alias("r")).select("r.*")
    distinct = value_counts(df, numeric).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"))
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column_name", "x")
    q = exact_quantiles(cells, ["column_name"], "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n_values")
    return base.join(distinct, "column_name", "left").join(q, "column_name", "left")


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, distinct, mean length, parseable-date share and candidate key per text column."""
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for c in columns:
        s = F.col(c).cast("string")
        parts = {"count": F.count(s), "mean_length": F.avg(F.length(s)), "dates": F.count(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))}
        aggs += [e.alias(f"{c}|{k}") for k, e in parts.items()]
        rows.append((F.lit(c), F.col("_n"), *[F.col(f"`{c}|{k}`") for k in parts]))
    base = df.agg(*aggs).select(long_rows(rows, ["column_name", "rows", "count", "mean_length", "dates"]).alias("r")).select("r.*")
    distinct = value_counts(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"))
    return base.join(distinct, "column_name", "left").select(
        "column_name", "count", (F.col("rows") - F.col("count")).alias("nulls"), "distinct", "mean_length",
        (F.col("dates") > F.col("rows") * 0.8).alias("likely_date"),
        (F.col("distinct") == F.col("rows")).alias("candidate_key"),
        (F.col("distinct") / F.col("rows")).alias("distinct_ratio"),
    )


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, distinct rows and surplus copies; copies collapse before the shuffle."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``; Spark limits each task to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of filled cells, and rows and columns that miss something."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(filled).alias("_f"), F.count_if(filled < len(columns)).alias("rows_missing"),
        *[F.count(c).alias(f"_c_{c}") for c in columns],
    )
    cols = reduce(lambda a, b: a + b, [(F.col(f"_c_{c}") < F.col("rows")).cast("int") for c in columns])
    return one.select(
        "rows", "rows_missing", cols.cast("long").alias("columns_missing"), (F.col("_f") / (F.col("rows") * len(columns))).alias("completeness")
    )


def quality_score(df: DataFrame, columns: list[str], positive: list[str]) -> DataFrame:
    """70 % completeness, 30 % product of the non-negative shares."""
    n = F.count(F.lit(1))
    kept = [1 - F.count_if(F.col(c) < 0) / n for c in positive]
    base = completeness(df, columns)
    neg = df.agg(reduce(lambda a, b: a * b, kept).alias("consistency"))
    return base.withColumn("consistency", neg.scalar()).withColumn(
        "quality_score", (F.col("completeness") * 0.7 + F.col("consistency") * 0.3) * 100
    )


def simple_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """100 - 2·missing % - 3·duplicate %, not below 0."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    gaps = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    out = g.agg(
        (F.sum(gaps * F.col("n")) / (F.sum("n") * len(columns)) * 100).alias("missing_pct"),
        (F.sum(F.col("n") - 1) / F.sum("n") * 100).alias("duplicate_pct"),
    )
    return out.withColumn("score", F.greatest(F.lit(0.0), 100 - 2 * F.col("missing_pct") - 3 * F.col("duplicate_pct")))


def style_flags(text: Column) -> dict[str, Column]:
    """Case and date styles of one value."""
    letters = text.rlike(r"\p{L}")
    return {
        "upper": letters & (text == F.upper(text)),
        "lower": letters & (text == F.lower(text)),
        "title": letters & (text == F.initcap(text)) & (text != F.upper(text)),
        "iso": text.rlike(r"\d{4}-\d{2}-\d{2}"),
        "slash": text.rlike(r"\d{2}/\d{2}/\d{4}"),
        "dash": text.rlike(r"\d{2}-\d{2}-\d{4}"),
    }


def format_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: which styles occur, and whether more than one case or date style does."""
    v = value_counts(df, columns)
    flags = style_flags(F.col("value"))
    out = v.groupBy("column_name").agg(*[F.max(e).alias(n) for n, e in flags.items()])
    case = sum(F.col(n).cast("int") for n in ("upper", "lower", "title"))
    date = sum(F.col(n).cast("int") for n in ("iso", "slash", "dash"))
    return out.withColumn("inconsistent", (case > 1) | (date > 1))


def weighted_quality(df: DataFrame, text: list[str], numeric: list[str], invalid: dict[str, Column]) -> DataFrame:
    """.4 completeness + .3 consistency + .2 validity + .1 uniqueness.

    ``invalid`` maps a numeric column to the test that a value breaks its range.
    """
    every = text + numeric
    comp = completeness(df, every).select("completeness").scalar()
    mixed = format_consistency(df, text).agg(F.count_if("inconsistent")).scalar()
    n = F.count(F.lit(1))
    keys = value_counts(df, every).groupBy("column_name").agg(F.count(F.lit(1)).alias("d"))
    rows = df.agg(n.alias("n"), *[F.count_if(t).alias(f"_bad_{c}") for c, t in invalid.items()])
    ids = keys.where(F.col("d") == df.agg(n).scalar()).agg(F.count(F.lit(1))).scalar()
    bad = reduce(lambda a, b: a + b, [(F.col(f"_bad_{c}") > 0).cast("int") for c in invalid])
    return rows.select(
        comp.alias("completeness"), (1 - mixed / F.lit(len(every))).alias("consistency"),
        (1 - bad / F.lit(len(numeric))).alias("validity"), (ids / F.lit(len(every))).alias("uniqueness"),
    ).withColumn(
        "overall_score",
        F.col("completeness") * 0.4 + F.col("consistency") * 0.3 + F.col("validity") * 0.2 + F.col("uniqueness") * 0.1,
    )


# --- content types -------------------------------------------------------------------------

# Patterns per content type, tested in this order.
CONTENT_TYPES = {
    "date": [
        r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{2}/\d{2}/\d{2}$",
        r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$",
        r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$", r"^\d{4}-\d{2}$", r"^[A-Za-z]{3}\s+\d{4}$", r"^Q[1-4]\s+\d{4}$",
    ],
    "phone": [r"^\(\d{3}\)\s*\d{3}-\d{4}$", r"^\d{3}-\d{3}-\d{4}$", r"^\d{3}\.\d{3}\.\d{4}$", r"^\d{10}$", r"^\+1\d{10}$"],
    "email": [r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"],
    "currency": [r"^\$[\d,]+\.?\d*$", r"^[\d,]+\.?\d*\$?$", r"^USD\s*[\d,]+\.?\d*$", r"^[\d,]+\.?\d*\s*USD$"],
    "policy_id": [r"^[A-Z]{2,4}\d{6,}$", r"^POL[_-]?\d+$", r"^\d{8,12}$"],
    "ssn": [r"^\d{3}-\d{2}-\d{4}$", r"^\d{9}$"],
}


def content_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """First content type that more than 70 % of the values match (matches of its patterns added up)."""
    v = value_counts(df, columns)
    n, x = F.col("n"), F.col("value")
    rates = [
        (F.sum(n * reduce(lambda a, b: a + b, [x.rlike(p).cast("int") for p in ps])) / F.sum(n)).alias(f"rate_{t}")
        for t, ps in CONTENT_TYPES.items()
    ]
    out = v.groupBy("column_name").agg(*rates, (F.count(F.lit(1)) / F.sum(n)).alias("distinct_ratio"))
    pick = F.coalesce(
        *[F.when(F.col(f"rate_{t}") > 0.7, t) for t in CONTENT_TYPES],
        F.when(F.col("distinct_ratio") < 0.1, "categorical"), F.lit("text"),
    )
    return out.withColumn("content_type", pick)


# Spellings of a missing value.
MISSING_WORDS = ["na", "n/a", "null", "none", "-", "tbd"]


def column_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """Padding, mixed case, several date styles and disguised missing values per column, with severity."""
    v = text_of(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    x, n = F.col("value"), F.col("n")
    flags = style_flags(x)
    one_case = flags["upper"] | flags["lower"] | flags["title"]
    count = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    out = v.groupBy("column_name").agg(
        F.sum(n).alias("rows"), count(x.isNull()).alias("nulls"), count(F.trim(x) != x).alias("padded"),
        count(x.isNotNull() & ~one_case).alias("mixed_case"),
        count(x.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("iso_dates"), count(x.rlike(r"^\d{2}/\d{2}/\d{4}$")).alias("us_dates"),
        count(F.lower(x).isin(MISSING_WORDS)).alias("missing_words"), count(F.trim(x) == "").alias("blank"),
    )
    pct = F.col("nulls") / F.col("rows") * 100
    present = F.col("rows") - F.col("nulls")
    issues = F.array_compact(
        F.array(
            F.when(F.col("padded") > 0, "whitespace:warning"),
            F.when(F.col("mixed_case") > present * 0.2, "inconsistent_case:warning"),
            F.when((F.col("iso_dates") > 0) & (F.col("us_dates") > 0), "mixed_date_formats:warning"),
            F.when(pct > 50, "missing_data:critical").when(pct > 20, "missing_data:warning").when(pct > 0, "missing_data:info"),
        )
    )
    return out.withColumn("issues", issues)


def issue_score(issues: DataFrame) -> DataFrame:
    """100 less 10, 5 or 2 per critical, warning or info issue."""
    one = issues.select(F.explode_outer("issues").alias("i")).agg(
        *[F.count_if(F.col("i").endswith(s)).alias(s) for s in ("critical", "warning", "info")]
    )
    return one.withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("critical") - 5 * F.col("warning") - 2 * F.col("info")))


def structure_issues(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Empty rows, mostly empty rows and header-like first rows per file of (key, row_idx, cells)."""
    cells = F.col("cells")
    filled = F.size(F.filter(cells, lambda c: F.trim(c) != ""))
    size = F.size(cells)
    wordy = F.size(F.filter(cells, lambda c: F.trim(c).rlike(r"^[\p{L}_]+$")))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(filled == 0).alias("empty_rows"),
        F.count_if((filled > 0) & ((size - filled) > size * 0.8)).alias("sparse_rows"),
        F.count_if((F.col("row_idx") < 5) & (filled > 1) & (wordy >= filled * 0.8)).alias("header_like"),
    )


# Words in the name of a column that holds personal data, and value patterns.
PII_NAMES = ["ssn", "social_security", "tax_id", "phone", "email", "address"]
PII_VALUES = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}


def pii_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: whether its name is sensitive and the share of values that hold each pattern."""
    aggs, rows = [], []
    for c in columns:
        for k, p in PII_VALUES.items():
            aggs.append(F.avg(F.col(c).cast("string").rlike(p).cast("double")).alias(f"{c}|{k}"))
        rows.append((F.lit(c), F.lit(any(w in c.lower() for w in PII_NAMES)), *[F.col(f"`{c}|{k}`") for k in PII_VALUES]))
    return df.agg(*aggs).select(long_rows(rows, ["column_name", "name_match", *[f"{k}_rate" for k in PII_VALUES]]).alias("r")).select("r.*")


# --- rules -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """``broken`` is true for a row that violates the rule; NULL counts as kept."""

    name: str
    column: str
    broken: Column
    severity: str = "error"


def policy_rules() -> list[Rule]:
    c = F.col
    ratio = F.try_divide(c("premium"), c("face_amount"))
    return [
        Rule("issue_age_range", "issue_age", ~c("issue_age").between(0, 100)),
        Rule("issue_age_typical", "issue_age", ~c("issue_age").between(18, 75), "warning"),
        Rule("face_positive", "face_amount", c("face_amount") <= 0),
        Rule("face_reasonable", "face_amount", ~c("face_amount").between(10_000, 100_000_000), "warning"),
        Rule("premium_non_negative", "premium", c("premium") < 0),
        Rule("premium_ratio", "premium", (ratio <= 0.0001) | (ratio >= 0.2), "warning"),
        Rule("gender_values", "gender", ~c("gender").isin("M", "F", "U")),
        Rule("smoker_values", "smoker_status", ~c("smoker_status").isin("NS", "S", "U")),
        Rule("product_values", "product_type", ~c("product_type").isin(
            "TERM", "WHOLE_LIFE", "UNIVERSAL_LIFE", "VARIABLE_LIFE", "ANNUITY", "PENSION", "401K", "IRA")),
        Rule("status_values", "policy_status", ~c("policy_status").isin("ACTIVE", "LAPSED", "SURRENDERED", "MATURED", "CLAIM", "PENDING")),
        Rule("age_order", "current_age", c("current_age") < c("issue_age")),
        Rule("maturity_after_issue", "maturity_date", c("maturity_date") < c("issue_date")),
    ]


def rule_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Broken rows per rule, all rules in one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(r.broken).alias(r.name) for r in rules])
    rows = [(F.lit(r.name), F.lit(r.column), F.lit(r.severity), F.col(r.name), F.col(r.name) / F.col("_n")) for r in rules]
    return one.select(long_rows(rows, ["rule", "column_name", "severity", "affected_rows", "affected_share"]).alias("r")).select("r.*")


def failed_rules(df: DataFrame, rules: list[Rule], severity: str | None = None) -> DataFrame:
    """Add the names of the rules each row breaks."""
    use = [r for r in rules if severity in (None, r.severity)]
    return df.withColumn("failed", F.array_compact(F.array(*[F.when(r.broken, r.name) for r in use])))


def violation_samples(df: DataFrame, rules: list[Rule], idx: str, k: int = 5) -> DataFrame:
    """The first k broken rows of each rule by ``idx``."""
    broken = failed_rules(df, rules).select(idx, F.explode("failed").alias("rule"))
    w = Window.partitionBy("rule").orderBy(idx)
    return broken.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def validation_summary(df: DataFrame, rules: list[Rule], columns: list[str]) -> DataFrame:
    """Valid rows (no broken error rule), completeness, error and warning rule counts, quality level."""
    errors = [r for r in rules if r.severity == "error"]
    warns = [r for r in rules if r.severity == "warning"]
    any_error = reduce(lambda a, b: a | b, [F.coalesce(r.broken, F.lit(False)) for r in errors])
    gaps = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~any_error).alias("valid_rows"),
        ((1 - F.sum(gaps) / (F.count(F.lit(1)) * len(columns))) * 100).alias("completeness"),
        *[F.count_if(r.broken).alias(f"_r_{r.name}") for r in rules],
    )
    hit = lambda rs: reduce(lambda a, b: a + b, [(F.col(f"_r_{r.name}") > 0).cast("long") for r in rs])
    out = one.withColumns({"error_rules": hit(errors), "warning_rules": hit(warns)}).drop(*[f"_r_{r.name}" for r in rules])
    e, w, c = F.col("error_rules"), F.col("warning_rules"), F.col("completeness")
    level = (
        F.when((e > 10) | (c < 70), "REJECTED").when((e > 5) | (c < 90), "POOR").when((e > 0) | (c < 95), "ACCEPTABLE")
        .when((w > 5) | (c < 98), "GOOD").otherwise("PRISTINE")
    )
    return out.withColumn("quality_level", level)


def iqr_outliers(df: DataFrame, numeric: list[str], limit_pct: float = 15.0, factor: float = 1.5) -> DataFrame:
    """Values beyond ``factor`` IQR per column; columns with fewer than ten values are left out."""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column_name", "x").where("x IS NOT NULL")
    q = exact_quantiles(cells, ["column_name"], "x", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    bounds = q.where("n_values >= 10").select(
        "column_name", (F.col("q1") - factor * iqr).alias("lower_bound"), (F.col("q3") + factor * iqr).alias("upper_bound")
    )
    x = F.col("x")
    # One bounds row per column name: its size is the width of the table.
    placed = cells.join(F.broadcast(bounds), "column_name")
    out = placed.groupBy("column_name", "lower_bound", "upper_bound").agg(
        F.count(x).alias("n"), F.count_if((x < F.col("lower_bound")) | (x > F.col("upper_bound"))).alias("outliers")
    )
    return out.withColumn("outlier_pct", F.col("outliers") / F.col("n") * 100).withColumn("flagged", F.col("outlier_pct") > limit_pct)


def confidence_score(findings: DataFrame, mean_missing: Column | None = None) -> DataFrame:
    """100 - 15 per critical - 3 per warning - 1 per info - .3·(mean missing - 30), held within 0-100."""
    lv = F.col("level")
    one = findings.agg(*[F.count_if(lv == k).alias(k.lower()) for k in ("CRITICAL", "WARNING", "INFO")])
    base = 100 - 15 * F.col("critical") - 3 * F.col("warning") - F.col("info")
    if mean_missing is not None:
        base = base - F.greatest(F.lit(0.0), mean_missing - 30) * 0.3
    return one.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(100.0), base.cast("double")))).withColumn(
        "is_valid", F.col("critical") == 0
    )


@dataclass(frozen=True)
class Expectation:
    name: str
    holds: Column
    mostly: float = 1.0


# Accepted spellings of gender.
GENDER_WORDS = ["M", "F", "Male", "Female", "male", "female", "m", "f"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def expectations_for(schema: T.StructType) -> list[Expectation]:
    """Expectations chosen by column name, as (predicate, share of rows that must hold)."""
    out = []
    for f in schema.fields:
        c, name = F.col(f.name), f.name.lower()
        out.append(Expectation(f"{f.name}:not_null", c.isNotNull(), 0.8))
        number = isinstance(f.dataType, T.NumericType)
        if "policy" in name and "number" in name:
            out.append(Expectation(f"{f.name}:always_set", c.isNotNull()))
        elif ("premium" in name or "amount" in name) and number:
            out.append(Expectation(f"{f.name}:not_negative", c.isNull() | (c >= 0), 0.95))
        elif "age" in name and number:
            out.append(Expectation(f"{f.name}:0_to_120", c.isNull() | c.between(0, 120)))
        elif "date" in name:
            out.append(Expectation(f"{f.name}:mostly_set", c.isNotNull(), 0.9))
        elif "email" in name:
            out.append(Expectation(f"{f.name}:email", c.isNull() | c.rlike(EMAIL), 0.8))
        elif name in ("gender", "sex"):
            out.append(Expectation(f"{f.name}:known", c.isNull() | c.isin(GENDER_WORDS), 0.9))
    return out


def check_expectations(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """Observed share and success of every expectation, from one aggregate."""
    one = df.agg(*[F.avg(e.holds.cast("double")).alias(f"_{i}") for i, e in enumerate(expectations)])
    rows = [(F.lit(e.name), F.lit(e.mostly), F.col(f"_{i}"), F.col(f"_{i}") >= e.mostly) for i, e in enumerate(expectations)]
    return one.select(long_rows(rows, ["expectation", "mostly", "observed", "success"]).alias("r")).select("r.*")


def readiness(results: DataFrame) -> DataFrame:
    out = results.agg(F.count(F.lit(1)).alias("expectations"), F.count_if("success").alias("passed"))
    r = F.col("success_rate")
    return out.withColumn("success_rate", F.col("passed") / F.col("expectations")).withColumns(
        {
            "quality_score": r * 100,
            "compliance_score": F.when(r > 0.8, F.least(F.lit(100.0), r * 100 + 10)).otherwise(r * 80),
            "readiness": F.when(r > 0.9, "Production Ready").otherwise("Needs Attention"),
            "risk_level": F.when(r > 0.95, "Low").when(r > 0.8, "Medium").otherwise("High"),
        }
    )


UPLOAD_COLUMNS = ["policy_number", "issue_date", "face_amount", "annual_premium", "issue_age", "gender", "smoker_status",
                  "product_type", "state", "policy_status"]


def upload_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Score of uploaded policies per group: gaps, amounts, ages, spellings, in-force share, duplicates.

    Duplicates are found by first counting (group, policy number), so a large group is spread out.
    """
    use = [c for c in UPLOAD_COLUMNS if c in df.columns]
    c = F.col
    sums = [F.count(F.lit(1)).alias("n"), *[F.count_if(c(k).isNull()).alias(f"_m_{k}") for k in use]]
    sums += [
        F.min("face_amount").alias("_fmin"), F.max("face_amount").alias("_fmax"), F.min("issue_age").alias("_amin"), F.max("issue_age").alias("_amax"),
        F.count_if(~c("gender").isin("M", "F", "Male", "Female", "m", "f")).alias("_bad_gender"),
        F.count_if(~c("smoker_status").isin("Smoker", "Nonsmoker", "smoker", "nonsmoker", "S", "N")).alias("_bad_smoker"),
        F.count_if(c("annual_premium") < 0).alias("_neg"),
        F.count_if(c("policy_status").isin("Inforce", "inforce", "Active", "active")).alias("_inf"),
    ]
    per_key = df.groupBy(*by, "policy_number").agg(*sums)
    whole = ["n", *[f"_m_{k}" for k in use], "_bad_gender", "_bad_smoker", "_neg", "_inf"]
    out = per_key.groupBy(*by).agg(
        *[F.sum(x).alias(x) for x in whole], F.min("_fmin").alias("_fmin"), F.max("_fmax").alias("_fmax"), F.min("_amin").alias("_amin"),
        F.max("_amax").alias("_amax"), F.sum(F.when(c("policy_number").isNotNull(), c("n") - 1)).alias("duplicates"),
    )
    miss = [F.when(c(f"_m_{k}") / c("n") > 0.02, 10).when(c(f"_m_{k}") > 0, 2).otherwise(0) for k in use]
    errors = [F.when(c(f"_m_{k}") / c("n") > 0.02, 1).otherwise(0) for k in use] + [F.when(c("_neg") > 0, 1).otherwise(0)]
    lost = reduce(lambda a, b: a + b, miss) + (
        F.when(c("_fmin") < 1000, 3).otherwise(0) + F.when(c("_fmax") > 50_000_000, 2).otherwise(0)
        + F.when((c("_amin") < 0) | (c("_amax") > 90), 5).otherwise(0) + F.when(c("_bad_gender") > 0, 3).otherwise(0)
        + F.when(c("_bad_smoker") > 0, 3).otherwise(0) + F.when(c("_neg") > 0, 10).otherwise(0)
        + F.when(c("_inf") / c("n") < 0.60, 8).otherwise(0) + F.when(c("duplicates") > 0, 5).otherwise(0)
    )
    return out.select(
        *by, c("n").alias("policies"), "duplicates", reduce(lambda a, b: a + b, errors).alias("errors"),
        F.greatest(F.lit(0), 100 - lost).alias("quality_score"),
    ).withColumn("valid", c("errors") == 0)


def screen_submissions(yearly: DataFrame, key: str, floor: float = 5_000_000, min_years: int = 3) -> DataFrame:
    """Premium floor, years of experience, paired premium and claim rows, loss ratio outside .1-2."""
    lr = F.when(F.col("premium") > 0, F.col("claims") / F.col("premium")).otherwise(0.0)
    out = yearly.withColumn("_lr", lr).groupBy(key).agg(
        F.count(F.lit(1)).alias("years"), F.max_by("premium", "year").alias("latest_premium"),
        F.count_if(F.col("premium").isNull() | F.col("claims").isNull()).alias("unpaired"),
        F.count_if((F.col("_lr") > 2.0) | (F.col("_lr") < 0.1)).alias("odd_years"),
    )
    errors = F.array_compact(F.array(
        F.when(F.col("latest_premium") < floor, "premium below minimum"),
        F.when(F.col("years") < min_years, "too few years"),
        F.when(F.col("unpaired") > 0, "premium and claims differ in length"),
    ))
    return out.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def freshness_risk(df: DataFrame, columns: list[str], date: str, asof: str) -> DataFrame:
    """Columns missing more than 30 % and whether the newest date is older than 90 days."""
    n = F.count(F.lit(1))
    one = df.agg(F.max(date).alias("newest"), *[(1 - F.count(c) / n).alias(f"_m_{c}") for c in columns])
    gaps = F.array_compact(F.array(*[F.when(F.col(f"_m_{c}") > 0.3, c) for c in columns]))
    return one.select(
        F.col("newest").cast("date").alias("newest"), F.array_join(gaps, ",").alias("sparse_columns"),
        (F.datediff(F.lit(asof).cast("date"), F.col("newest")) > 90).alias("stale"),
    )


