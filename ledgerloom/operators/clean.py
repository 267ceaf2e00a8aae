"""Cleaning steps as column expressions over small statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .quality import keep_last
from .quantiles import exact_quantiles
from .skew import attach

# Accepted spellings of each standard category.
CATEGORIES = {
    "gender": {"M": ["M", "MALE", "1"], "F": ["F", "FEMALE", "2"], "U": ["U", "UNKNOWN", "0"]},
    "smoker_status": {"NS": ["NS", "N", "NO", "NON-SMOKER", "NONSMOKER", "0"], "S": ["S", "Y", "YES", "SMOKER", "1"], "U": ["U", "UNKNOWN"]},
    "policy_status": {
        "ACTIVE": ["ACTIVE", "A", "INFORCE", "IF", "IN FORCE", "1"], "LAPSED": ["LAPSED", "L", "LAPSE", "2"],
        "SURRENDERED": ["SURRENDERED", "S", "SURRENDER", "3"], "MATURED": ["MATURED", "M", "MATURE", "4"],
        "CLAIM": ["CLAIM", "C", "DEATH", "DEATH CLAIM", "5"], "PENDING": ["PENDING", "P", "0"],
    },
    "product_type": {
        "TERM": ["TERM", "TL", "TERM LIFE"], "WHOLE_LIFE": ["WL", "WHOLE", "WHOLE LIFE"], "UNIVERSAL_LIFE": ["UL", "UNIVERSAL", "UNIVERSAL LIFE"],
        "VARIABLE_LIFE": ["VL", "VARIABLE", "VARIABLE LIFE"], "ANNUITY": ["ANNUITY", "ANN"], "PENSION": ["PENSION", "PEN"],
        "401K": ["401K", "401(K)"], "IRA": ["IRA", "INDIVIDUAL RETIREMENT ACCOUNT"],
    },
    "underwriting_class": {
        "PREFERRED_PLUS": ["PP", "PREFERRED PLUS", "SUPER PREFERRED", "1"], "PREFERRED": ["P", "PREFERRED", "2"],
        "STANDARD_PLUS": ["SP", "STANDARD PLUS", "3"], "STANDARD": ["S", "STANDARD", "4"],
        "SUBSTANDARD": ["SS", "SUBSTANDARD", "RATED", "5"], "DECLINED": ["D", "DECLINED", "6"],
    },
}
POLICY_SPELLINGS = {
    "gender": {"M": ["m", "Male", "male"], "F": ["f", "Female", "female"]},
    "smoker_status": {"Smoker": ["smoker", "s", "S"], "Nonsmoker": ["nonsmoker", "n", "N"]},
    "policy_status": {"Inforce": ["inforce", "active", "Active"], "Lapsed": ["lapsed", "terminated", "Terminated"]},
}
CURRENCIES = {
    "USD": ["US$", "USd", "US Dollar", "United States Dollar", "U.S.D", "U$D"],
    "EUR": ["€", "EURO", "Euro", "European Euro", "EU"],
    "GBP": ["£", "British Pound", "Sterling", "UK Pound", "GBP."],
    "JPY": ["¥", "Yen", "Japanese Yen", "JPN", "JP¥"],
}
# Accepted date formats in order, with the pattern that parses them (one-digit days and months too) and their shape.
DATE_FORMATS = {
    "yyyy-MM-dd": ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    "dd/MM/yyyy": ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    "MM/dd/yyyy": ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    "dd-MMM-yyyy": ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    "dd-MMM-yy": ("d-MMM-yy", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"),
    "yyyyMMdd": ("yyyyMMdd", r"^\d{8}$"),
    "dd.MM.yyyy": ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    "MM-dd-yyyy": ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    "yyyy/MM/dd": ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
}
LINE_LOSS_RATIO = {"Property": 0.65, "Casualty": 0.72, "Marine": 0.68, "Aviation": 0.55}


def standard(c: Column, spellings: dict[str, list[str]], fold: bool = True) -> Column:
    """Standard category of a spelling; an unknown spelling stays as it is."""
    names: dict[str, str] = {}
    for name, words in spellings.items():
        for w in words:
            names.setdefault(w, name)
    # A lookup reads the spelling once and stays small code; a branch per name makes methods too long for the JVM to compile.
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.upper(F.trim(c)) if fold else c), c)


def standardise_categories(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Apply CATEGORIES to the columns present (column -> category kind)."""
    columns = columns or {c: c for c in CATEGORIES if c in df.columns}
    return df.withColumns({c: standard(F.col(c), CATEGORIES[k]) for c, k in columns.items()})


def standard_currency(c: Column) -> Column:
    """Symbols and letters only, any spelling to its ISO code; unknown text stays as it is."""
    clean = lambda s: "".join(ch for ch in s if ch.isascii() and ch.isalpha() or ch in "£€¥$")
    key = F.regexp_replace(F.trim(c), "[^A-Za-z£€¥$]", "")
    out = None
    for iso, words in CURRENCIES.items():
        forms = sorted({f for w in [*words, iso] for f in (clean(w), clean(w).upper(), clean(w).lower())})
        out = F.when(key.isin(forms), iso) if out is None else out.when(key.isin(forms), iso)
    return out.otherwise(c)


NUMBER_WORDS = ["age", "amount", "premium", "value", "benefit", "rate"]
DATE_WORDS = ["date", "time", "dob", "birth"]
FLAG_WORDS = ["is_", "has_", "flag"]


def coerce_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type text columns by their names: number, date, boolean, else trimmed text. What can't be read is NULL."""
    out = {}
    for c in columns:
        n, x = c.lower(), F.col(c)
        if any(w in n for w in NUMBER_WORDS):
            out[c] = F.regexp_replace(F.trim(x), "[,$]", "").try_cast("double")
        elif any(w in n for w in DATE_WORDS):
            out[c] = parse_date(x)
        elif any(w in n for w in FLAG_WORDS):
            word = F.lower(F.trim(x))
            out[c] = F.when(word.isin("1", "true", "yes", "y", "t"), True).when(word.isin("0", "false", "no", "n", "f"), False)
        else:
            out[c] = F.trim(x)
    return df.withColumns(out)


def _serial(c: Column) -> Column:
    """Day number of a spreadsheet date, else NULL."""
    n = F.when(F.trim(c).rlike(r"^\d{5}(\.\d*)?$"), F.trim(c).try_cast("double"))
    return F.when((n > 25569) & (n < 60000), n)


def _attempt(c: Column, name: str) -> Column:
    """The date in one format. Only text of the format's shape is parsed: a failed parse is far dearer than the test."""
    pattern, shape = DATE_FORMATS[name]
    text = F.trim(c)
    day = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
    # Two-digit years from 69 on belong to the last century.
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day) if name.endswith("-yy") else day


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """Serial day numbers first, then each format in order; the first that parses wins."""

    def read(text: Column) -> Column:
        serial = F.date_add(F.to_date(F.lit("1899-12-30")), F.floor(_serial(text)).cast("int"))
        return F.coalesce(serial, *[_attempt(text, f) for f in formats or DATE_FORMATS])

    # A lambda stays out of the generated code; all formats in it make methods too long for the JVM to compile.
    return F.get(F.transform(F.array(c), read), F.lit(0))


def date_format_used(c: Column, formats: list[str] | None = None) -> Column:
    out = F.when(_serial(c).isNotNull(), "serial")
    for f in formats or DATE_FORMATS:
        out = out.when(_attempt(c, f).isNotNull(), f)
    return out.otherwise(F.when(c.isNull(), "missing").otherwise("unparsed"))


def ambiguous_date(c: Column) -> Column:
    """Text that reads as a date both day first and month first, and differently."""
    a, b = _attempt(c, "dd/MM/yyyy"), _attempt(c, "MM/dd/yyyy")
    return F.coalesce(a != b, F.lit(False))


def repair_future(c: Column, asof: str) -> Column:
    """A date after both ``asof`` and 2050 belongs to the century before."""
    return F.when((c > F.lit(asof).cast("date")) & (F.year(c) > 2050), F.add_months(c, -1200)).otherwise(c)


def normalise_amounts(df: DataFrame, absolute: list[str], rounded: list[str]) -> DataFrame:
    out = {c: F.round((F.abs(c) if c in absolute else F.col(c)).cast("decimal(28,6)"), 2).cast("double") for c in dict.fromkeys([*absolute, *rounded])}
    return df.withColumns(out)


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mode); ties go to the smaller value."""
    from .quality import top_values

    return top_values(df, columns, 1).select("column_name", F.col("value").alias("mode"))


def fill_values(df: DataFrame) -> dict[str, tuple[str, Column]]:
    """How each column's gaps are filled (median, mean or mode) and with what; statistics come as scalar subqueries."""
    fills = {}
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    medians = [c for c in numeric if "amount" in c.lower() or "premium" in c.lower()]
    means = [c for c in numeric if c not in medians]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if medians:
        cells = df.select(*[F.col(c).cast("double").alias(c) for c in medians]).unpivot([], medians, "column_name", "x")
        q = exact_quantiles(cells, ["column_name"], "x", {"m": 0.5})
        one = q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("m"))).alias(c) for c in medians])
        stat = one.select(F.struct(*medians)).scalar()
        fills |= {c: ("median", stat.getField(c)) for c in medians}
    if means:
        stat = df.agg(F.struct(*[F.avg(c).alias(c) for c in means])).scalar()
        fills |= {c: ("mean", stat.getField(c)) for c in means}
    if text:
        one = column_modes(df, text).agg(*[F.max(F.when(F.col("column_name") == c, F.col("mode"))).alias(c) for c in text])
        stat = one.select(F.struct(*text)).scalar()
        fills |= {c: ("mode", stat.getField(c)) for c in text}
    types = dict(df.dtypes)
    return {c: (how, v.cast(types[c])) for c, (how, v) in fills.items()}


def smart_impute(df: DataFrame) -> DataFrame:
    """Median for amounts and premiums, mean for other numbers, mode for text."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, (_, v) in fill_values(df).items()})


def forward_fill(df: DataFrame, idx: str, column: str, chunk: int = 100_000) -> DataFrame:
    """Last earlier non-null value in the order of ``idx``, without one global window.

    Each range of ``chunk`` index values is filled on its own; the last value of
    the ranges before it fills its head. The ranges' last values are carried in the same
    way, ``chunk`` ranges at a time, so one task holds a row per chunk squared index values.
    """
    d = df.withColumn("_c", F.floor(F.col(idx) / chunk))
    inside = Window.partitionBy("_c").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    tails = d.groupBy("_c").agg(F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(idx))).alias("_tail"))
    upto = (Window.unboundedPreceding, -1)
    wide = tails.withColumn("_g", F.floor(F.col("_c") / chunk))
    ends = wide.groupBy("_g").agg(F.max_by("_tail", F.when(F.col("_tail").isNotNull(), F.col("_c"))).alias("_end"))
    starts = ends.select("_g", F.last("_end", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(*upto)).alias("_start"))
    near = F.last("_tail", ignorenulls=True).over(Window.partitionBy("_g").orderBy("_c").rowsBetween(*upto))
    heads = wide.withColumn("_near", near).join(starts, "_g").select("_c", F.coalesce("_near", "_start").alias("_head"))
    filled = d.withColumn("_f", F.last(column, ignorenulls=True).over(inside)).join(heads, "_c", "left")
    return filled.withColumn(column, F.coalesce("_f", "_head")).drop("_c", "_f", "_head")


def cap_outliers(df: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """Pull values beyond ``factor`` IQR back to the bound."""
    return _clip_at(df, columns, {"q1": 0.25, "q3": 0.75}, lambda s: (
        s["q1"] - factor * (s["q3"] - s["q1"]), s["q3"] + factor * (s["q3"] - s["q1"])))


def winsorise(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Infinities to NULL, then clip at the two quantiles."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns}
    return _clip_at(df.withColumns(finite), columns, {"q1": low, "q3": high}, lambda s: (s["q1"], s["q3"]))


def _clip_at(df: DataFrame, columns: list[str], probs: dict[str, float], bounds) -> DataFrame:
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "x")
    q = exact_quantiles(cells, ["column_name"], "x", probs)
    one = q.agg(*[F.max(F.when(F.col("column_name") == c, F.struct(*probs))).alias(c) for c in columns])
    stat = one.select(F.struct(*columns)).scalar()
    out = {}
    for c in columns:
        s = stat.getField(c)
        lo, hi = bounds({p: s.getField(p) for p in probs})
        out[c] = F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), hi), lo))
    return df.withColumns(out)


def drop_sigma_outliers(df: DataFrame, columns: list[str], sigma: float = 3.0, limit: float = 0.05) -> DataFrame:
    """Drop rows beyond ``sigma`` deviations, column by column only where they are under ``limit`` of the rows.

    All columns are judged on the statistics of the input.
    """
    moments = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])).scalar()
    out = {c: F.coalesce(F.abs(F.col(c) - moments.getField(c).getField("m")) > sigma * moments.getField(c).getField("s"), F.lit(False)) for c in columns}
    shares = df.agg(F.struct(*[F.avg(e.cast("double")).alias(c) for c, e in out.items()])).scalar()
    drop = reduce(lambda a, b: a | b, [e & (shares.getField(c) < limit) for c, e in out.items()])
    return df.where(~drop)


def actuarial_rules(df: DataFrame) -> DataFrame:
    """Ages within 0-120 and in order; premium within .0001-.2 of face; amounts not negative."""
    age = lambda c: F.when(F.col(c).isNotNull(), F.least(F.lit(120), F.greatest(F.lit(0), F.col(c))))
    face, p = F.abs("face_amount"), F.abs("premium")
    ratio = F.try_divide(F.col("premium"), F.col("face_amount"))
    prem = F.when(ratio > 0.2, F.col("face_amount") * 0.2).when(ratio < 0.0001, F.col("face_amount") * 0.0001).otherwise(F.col("premium"))
    older = F.when(F.col("current_age") < F.col("issue_age"), F.col("issue_age")).otherwise(F.col("current_age"))
    return (
        df.withColumn("premium", prem).withColumn("current_age", older)
        .withColumns({"face_amount": face, "premium": p, "issue_age": age("issue_age"), "current_age": age("current_age")})
    )


def impute_loss_ratio(df: DataFrame) -> DataFrame:
    from ..refdata import lookup

    return df.withColumn("loss_ratio", F.coalesce("loss_ratio", lookup(F.col("business_line"), LINE_LOSS_RATIO)))


def impute_premium(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Face times rate on line where both are known, else the median of the peer group."""
    by = by or ["treaty_type", "business_line"]
    med = exact_quantiles(df, by, "premium", {"median_premium": 0.5}).drop("n_values")
    out = attach(df, med, by)
    rol = F.col("face_amount") * F.col("rate_on_line") if "rate_on_line" in df.columns else F.lit(None).cast("double")
    return out.withColumn("premium", F.coalesce("premium", rol, "median_premium"))


def peer_outliers(df: DataFrame, by: list[str], value: str, sigma: float = 3.0) -> DataFrame:
    """Peer mean and deviation on each row and the beyond-sigma flag."""
    peers = df.groupBy(*by).agg(F.avg(value).alias("peer_mean"), F.stddev_samp(value).alias("peer_sd"))
    return attach(df, peers, by).withColumn(
        "peer_outlier", F.coalesce(F.abs(F.col(value) - F.col("peer_mean")) > sigma * F.col("peer_sd"), F.lit(False))
    )


def business_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "loss_ratio_outlier": F.coalesce(F.col("loss_ratio") > 5.0, F.lit(False)),
            "commission_outlier": F.coalesce(F.col("commission") > 0.5, F.lit(False)),
            "rate_outlier": F.coalesce(F.try_divide(F.col("premium"), F.col("limit_amount")) > 0.5, F.lit(False)),
        }
    )


def treaty_conflicts(df: DataFrame) -> DataFrame:
    """Differing premiums per (treaty, inception): versions, spread and the review flag on every row."""
    versions = df.groupBy("treaty_id", "inception_date", "premium").agg(F.count(F.lit(1)).alias("_n"))
    agg = versions.groupBy("treaty_id", "inception_date").agg(
        F.count("premium").alias("premium_versions"), F.max("premium").alias("max_premium"), F.min("premium").alias("min_premium")
    )
    spread = F.try_divide(F.col("max_premium") - F.col("min_premium"), F.col("max_premium"))
    flag = F.when((F.col("premium_versions") > 1) & (spread > 0.1), "NEEDS_REVIEW").otherwise("OK")
    return attach(df, agg.withColumn("data_quality_flag", flag), ["treaty_id", "inception_date"])


def clean_policies(df: DataFrame, asof: str) -> DataFrame:
    """Dedupe, repair dates, standardise, normalise, impute, cap and apply the rules, on a table that is typed already (see cleaning.py)."""
    d = keep_last(df, ["policy_id", "issue_date"], [F.desc("row_idx")])
    d = d.withColumn("issue_date", repair_future(F.col("issue_date"), asof))
    d = standardise_categories(d)
    d = cut_lineage(normalise_amounts(d, ["face_amount"], ["face_amount", "premium"]))
    d = cut_lineage(smart_impute(d))
    d = cap_outliers(d, ["face_amount", "premium"])
    return actuarial_rules(d)
