"""File typing, column mapping, treaty integration and relationship discovery.

Column-name jobs work on ``file_columns(file_id, position, column_name, data_type)``,
gathered from every landed file, so one job types a whole landing zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..refdata import small_table
from ..session import cut_lineage
from .quality import text_of
from .skew import skew_join

# Column names of each file type.
FILE_TYPES = {
    "treaty_master": {
        "required": ["treaty_id", "treaty_name", "treaty_type", "inception_date", "premium", "limit"],
        "optional": ["expiry_date", "retention", "commission", "brokerage", "cedant", "reinsurer", "currency", "territory", "business_line",
                     "cession_rate", "minimum_premium", "maximum_premium", "profit_commission"],
        "indicator": ["treaty", "inception", "expiry", "cedant", "reinsurer"],
    },
    "claims_history": {
        "required": ["claim_id", "treaty_id", "loss_date", "claim_amount"],
        "optional": ["reported_date", "paid_date", "reserve_amount", "cause_of_loss", "catastrophe_code", "latitude", "longitude", "status",
                     "recovery_amount", "adjuster", "claim_type", "development_year", "ultimate_loss"],
        "indicator": ["claim", "loss_date", "paid", "reserve", "catastrophe", "recovery", "ultimate", "development"],
    },
    "policy_exposures": {
        "required": ["policy_id", "sum_insured"],
        "optional": ["treaty_id", "deductible", "latitude", "longitude", "occupancy", "construction_type", "year_built", "protection_class",
                     "coverage_type", "policy_limits", "address", "zip_code", "state", "country"],
        "indicator": ["policy", "sum_insured", "deductible", "occupancy", "construction", "latitude", "longitude", "address", "coverage", "protection"],
    },
    "market_data": {
        "required": ["date"],
        "optional": ["gdp_growth", "interest_rate_10y", "cat_pcs_index", "insurance_stocks_index", "hard_market_indicator",
                     "regulatory_capital_ratio", "inflation_rate", "unemployment_rate", "sp500_index", "vix_index"],
        "indicator": ["gdp", "interest_rate", "market", "index", "inflation", "economic", "regulatory", "capital", "vix"],
    },
    "combined": {
        "required": ["treaty_id", "premium", "loss_ratio"],
        "optional": ["treaty_name", "treaty_type", "business_line", "cedant", "reinsurer", "commission", "brokerage", "expense_ratio", "combined_ratio"],
        "indicator": ["loss_ratio", "expense_ratio", "combined_ratio"],
    },
}
KEY_TERMS = {
    "treatyid": ["treaty", "id"], "claimid": ["claim", "id"], "policyid": ["policy", "id"], "lossdate": ["loss", "date"],
    "claimamount": ["claim", "amount"], "suminsured": ["sum", "insured"], "inceptiondate": ["inception", "date"], "expirydate": ["expiry", "date"],
}
VARIATIONS = {
    "loss_ratio": ["lossratio", "lr"], "expense_ratio": ["expenseratio", "er"], "premium": ["prem", "premium"], "commission": ["comm", "commission"],
}
# Name patterns, standard name, kind and expected format of each field.
FIELD_PATTERNS = [
    ("policy_id", "identifier", "alphanumeric", ["policy.*id", "policy.*num", "policy.*no", "pol.*id", "certificate.*num", "cert.*id", "contract.*num"]),
    ("face_amount", "monetary", "numeric", ["face.*amount", "sum.*assured", "sum.*insured", "benefit.*amount", "coverage.*amount", "death.*benefit", "face.*value", "insured.*amount"]),
    ("cash_value", "monetary", "numeric", ["cash.*value", "surrender.*value", "account.*value", "csv", "accumulation.*value", "fund.*value"]),
    ("premium_amount", "monetary", "numeric", ["premium", "annual.*premium", "modal.*premium", "gross.*premium", "net.*premium", "target.*premium"]),
    ("age", "demographic", "numeric", ["^age$", "current.*age", "attained.*age", "issue.*age", "birth.*age", "insured.*age"]),
    ("birth_date", "demographic", "date", ["birth.*date", "date.*birth", "dob", "birth.*day", "born.*date", "date.*born"]),
    ("issue_date", "temporal", "date", ["issue.*date", "effective.*date", "start.*date", "policy.*date", "inception.*date", "commence.*date"]),
    ("gender", "demographic", "categorical", ["^sex$", "^gender$", "insured.*sex", "insured.*gender"]),
    ("smoking_status", "risk_factor", "categorical", ["smok", "tobacco", "nicotine", "smoker.*status", "smoking.*ind"]),
    ("death_indicator", "event", "boolean", ["death", "deceased", "mortality", "died", "claim.*death", "benefit.*paid", "death.*claim"]),
    ("claim_amount", "monetary", "numeric", ["claim.*amount", "benefit.*paid", "death.*benefit.*paid", "claim.*payment", "settlement.*amount"]),
    ("duration", "temporal", "numeric", ["duration", "policy.*year", "anniversary", "years.*inforce", "time.*since.*issue"]),
]
# Canonical schemas of the five typed files.
SCHEMAS = {
    "treaty": (["treaty_id", "premium", "loss_ratio"], ["treaty_type", "business_line", "cedant", "reinsurer"]),
    "claims": (["claim_id", "treaty_id", "gross_claim_amount"], ["occurrence_date", "report_date", "reinsurance_recovery"]),
    "portfolio": (["portfolio_id", "total_sum_insured", "number_of_risks"], ["business_line", "territory", "premium_rate"]),
    "catastrophe": (["event_id", "event_type", "occurrence_date"], ["industry_loss", "modeled_loss", "location"]),
    "development": (["claim_id", "valuation_date", "incurred_amount"], ["paid_amount", "case_reserves", "development_quarter"]),
}
PRODUCT_FIELDS = {
    "LIFE": ["policy_id", "issue_date", "issue_age", "gender", "face_amount", "premium", "product_type", "policy_status"],
    "ANNUITY": ["policy_id", "issue_date", "issue_age", "gender", "premium", "product_type", "policy_status", "cash_value"],
    "RETIREMENT": ["policy_id", "issue_date", "issue_age", "contribution_amount", "account_balance", "product_type"],
}


#: Rows of ``by_file`` in one task, each with a dozen columns to come.
FILES_PER_TASK = 50_000


def by_file(rows: DataFrame) -> DataFrame:
    """Rows dealt by file_id to as many tasks as their number asks for, so that what a task holds does not grow with the table.

    The rows are counted first. Steps per file that follow need no further shuffle. Left to itself Spark would make one task of a
    file with one row group, however many columns its rows unfold to.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILES_PER_TASK))
    return rows.repartition(tasks, "file_id")


def squash(c: Column) -> Column:
    """Lower case without underscores and spaces."""
    return F.translate(F.lower(c), "_ ", "")


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """file_columns of the given tables, one row per column. Reads schemas, not data."""
    rows = [
        (name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "file_id string, position int, column_name string, data_type string")


def _matches(squashed: Column, pattern: str) -> Column:
    """Whether one column name answers to a pattern: same, all key terms, or a listed variation."""
    plain = pattern.replace("_", "")
    same = squashed == plain
    if plain in KEY_TERMS:
        return same | reduce(lambda a, b: a & b, [squashed.contains(t) for t in KEY_TERMS[plain]])
    if pattern in VARIATIONS:
        return same | reduce(lambda a, b: a | b, [squashed.contains(v) for v in VARIATIONS[pattern]])
    return same


def _type_scores(columns: DataFrame) -> DataFrame:
    """file_id and _scores, the score for every file type in their order, from one aggregate over the catalogue."""
    name = F.col("_n")
    aggs, keys = [], []
    for kind, groups in FILE_TYPES.items():
        for group, patterns in groups.items():
            for i, p in enumerate(patterns):
                test = name.contains(p) if group == "indicator" else _matches(name, p)
                aggs.append(F.max(test.cast("int")).alias(f"{kind}|{group}|{i}"))
    wide = columns.withColumn("_n", squash(F.col("column_name"))).groupBy("file_id").agg(*aggs)
    for kind, groups in FILE_TYPES.items():
        share = {
            g: reduce(lambda a, b: a + b, [F.col(f"`{kind}|{g}|{i}`") for i in range(len(ps))]) / len(ps) for g, ps in groups.items()
        }
        score = share["required"] * 0.7 + share["optional"] * 0.5 * 0.2 + share["indicator"] * 0.3 * 0.1
        keys.append(F.struct(F.lit(kind).alias("file_type"), (score * F.when(share["required"] < 0.5, 0.3).otherwise(1.0)).alias("confidence")))
    return wide.select("file_id", F.array(*keys).alias("_scores"))


def file_type_scores(columns: DataFrame) -> DataFrame:
    """Score of every file for every file type."""
    return _type_scores(columns).select("file_id", F.explode("_scores").alias("s")).select("file_id", "s.*")


def detect_file_types(columns: DataFrame) -> DataFrame:
    """Best file type per file; equal scores go to the type listed first."""
    ranked = F.transform("_scores", lambda s, i: F.struct(s["confidence"].alias("confidence"), (-i).alias("r"), s["file_type"].alias("file_type")))
    best = _type_scores(columns).select("file_id", F.array_max(ranked).alias("b"))
    return best.select("file_id", F.col("b.file_type").alias("file_type"), F.col("b.confidence").alias("confidence"))


def column_roles(columns: DataFrame, types: DataFrame) -> DataFrame:
    """required / optional / additional for each column of a typed file. A file has few columns, so none is heavy as a key."""
    name = F.col("_n")
    role = F.lit("additional")
    for kind, groups in FILE_TYPES.items():
        hit = {g: reduce(lambda a, b: a | b, [_matches(name, p) for p in groups[g]]) for g in ("required", "optional")}
        label = F.when(hit["required"], "required").when(hit["optional"], "optional").otherwise("additional")
        role = F.when(F.col("file_type") == kind, label).otherwise(role)
    return columns.join(types.select("file_id", "file_type"), "file_id", "left").withColumn("_n", squash(F.col("column_name"))).withColumn("role", role).drop("_n")


def map_columns(columns: DataFrame, schema: str) -> DataFrame:
    """Best column of each file for each field of a canonical schema.

    A name equal after squashing wins; else containment with a length ratio above
    .6, the best ratio first. Each column row meets the few expected fields as an array.
    """
    return map_all_columns(columns, [schema]).drop("target")


def map_all_columns(columns: DataFrame, schemas: list[str] | None = None) -> DataFrame:
    """``map_columns`` for each of ``schemas`` (all), named in column target, from one pass over the columns."""
    wanted = [(s, f, f in SCHEMAS[s][0]) for s in schemas or SCHEMAS for f in [*SCHEMAS[s][0], *SCHEMAS[s][1]]]
    name = F.col("_n")

    def hit(schema: str, field: str, required: bool) -> Column:
        t = field.replace("_", "").lower()
        near = name.contains(t) | F.lit(t).contains(name)
        score = F.when(name == t, 2.0).when(near, F.least(F.length(name), F.lit(len(t))) / F.greatest(F.length(name), F.lit(len(t))))
        return F.when(score > 0.6, F.struct(F.lit(schema).alias("target"), F.lit(field).alias("field"), F.lit(required).alias("required"), score.alias("score")))

    hits = columns.withColumn("_n", squash(F.col("column_name"))).select("file_id", "position", "column_name", F.explode(F.array_compact(F.array(*[hit(*w) for w in wanted]))).alias("_f"))
    best = hits.groupBy("file_id", "_f.target", "_f.field", "_f.required").agg(
        F.max(F.struct(F.col("_f.score").alias("score"), (-F.col("position")).alias("p"), "column_name")).alias("b")
    )
    return best.select("target", "file_id", "field", "required", F.col("b.column_name").alias("column_name"), F.least(F.lit(1.0), F.col("b.score")).alias("score"))


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns (old -> new)."""
    return df.withColumnsRenamed(mapping)


def missing_fields(columns: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(file_id, family, field) for each required field a file has no column for.

    One aggregate per file holds a flag for each field, so nothing is joined. A NULL name is no field's.
    """
    fields = list(dict.fromkeys(f for fs in required.values() for f in fs))
    name = F.lower("column_name")
    has = columns.groupBy("file_id").agg(*[F.max(F.coalesce(name == f, F.lit(False))).alias(f"_h{i}") for i, f in enumerate(fields)])
    gaps = [F.when(~F.col(f"_h{fields.index(f)}"), F.struct(F.lit(k).alias("family"), F.lit(f).alias("field"))) for k, fs in required.items() for f in fs]
    return has.select("file_id", F.explode(F.array_compact(F.array(*gaps))).alias("_w")).select("file_id", "_w.family", "_w.field")


def match_fields(profile: DataFrame) -> DataFrame:
    """Standard field of each profiled column: .7·.8 for the name plus .3·format score, kept above .5.

    ``profile`` has file_id, column_name, data_type, distinct, likely_date, completeness.
    """
    low, kind = F.lower("column_name"), F.col("data_type")
    number, text = kind.rlike("int|double|float|decimal"), kind == "string"
    formats = {
        "numeric": number.cast("double"), "categorical": (text & (F.col("distinct") < 50)).cast("double"),
        "boolean": (text & (F.col("distinct") <= 3)).cast("double"), "date": (F.col("likely_date") | kind.startswith("date") | kind.startswith("timestamp")).cast("double"),
        "alphanumeric": F.when(text, 0.7).otherwise(0.3),
    }
    options = []
    for i, (std, fkind, fmt, patterns) in enumerate(FIELD_PATTERNS):
        score = F.lit(0.8 * 0.7) + formats[fmt] * 0.3
        options.append(F.when(low.rlike("|".join(patterns)), F.struct(score.alias("score"), F.lit(-i).alias("o"), F.lit(std).alias("field"), F.lit(fkind).alias("kind"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    quality = F.least(F.lit(1.0), F.col("completeness") * 1.2)
    m = profile.withColumn("_b", best)
    ok = F.col("_b").isNotNull() & (F.col("_b.score") > 0.5)
    return m.withColumns(
        {
            "standard_field": F.when(ok, F.col("_b.field")),
            "field_kind": F.when(ok, F.col("_b.kind")),
            "match_score": F.when(ok, F.col("_b.score")),
            "confidence": F.when(ok, (F.col("_b.score") + quality) / 2).otherwise(quality),
        }
    ).drop("_b")


def data_domain(columns: DataFrame) -> DataFrame:
    n = F.lower("column_name")
    has = lambda *words: F.max(reduce(lambda a, b: a | b, [n.contains(w) for w in words]))
    flags = columns.groupBy("file_id").agg(
        has("policy").alias("p"), has("claim").alias("c"), has("mortality").alias("m"), has("premium", "amount").alias("f"), F.count(F.lit(1)).alias("columns")
    )
    domain = F.when(F.col("p"), "insurance_policy").when(F.col("c"), "claims").when(F.col("m"), "mortality").when(F.col("f"), "financial").otherwise("general")
    return flags.select("file_id", "columns", domain.alias("data_domain"))


# --- integration --------------------------------------------------------------------------

def claims_by_treaty(claims: DataFrame, years: int = 5) -> DataFrame:
    a = F.col("claim_amount")
    return claims.groupBy("treaty_id").agg(
        F.sum(a).alias("total_historical_claims"), F.count(a).alias("total_claim_count"), F.max(a).alias("largest_historical_claim"),
        F.avg(a).alias("average_claim_size"), F.stddev_samp(a).alias("claim_volatility"), (F.count(a) / years).alias("annual_claim_frequency"),
    )


def exposures_by_treaty(exposures: DataFrame) -> DataFrame:
    s = F.col("sum_insured")
    return exposures.groupBy("treaty_id").agg(
        F.sum(s).alias("total_sum_insured"), F.count(s).alias("total_policy_count"), F.avg(s).alias("average_policy_size"), F.max(s).alias("largest_policy_size")
    )


def portfolio_exposure(exposures: DataFrame) -> DataFrame:
    s = F.col("sum_insured")
    return exposures.agg(F.sum(s).alias("portfolio_sum_insured"), F.count(s).alias("portfolio_policy_count"), F.avg(s).alias("portfolio_avg_policy_size"))


def integrate_treaties(treaties: DataFrame, claims: DataFrame | None = None, exposures: DataFrame | None = None, market: DataFrame | None = None) -> DataFrame:
    """Treaty master with claim and exposure aggregates, portfolio totals where exposures carry no
    treaty, latest market values, and the availability score (1, else .3, .5 and .8)."""
    out = treaties
    if claims is not None:
        out = out.join(claims_by_treaty(claims), "treaty_id", "left")
    if exposures is not None and "treaty_id" in exposures.columns:
        out = out.join(exposures_by_treaty(exposures), "treaty_id", "left")
    for one in ([portfolio_exposure(exposures)] if exposures is not None and "treaty_id" not in exposures.columns else []) + ([market] if market is not None else []):
        out = out.withColumn("_one", one.select(F.struct(*one.columns)).scalar())
        out = out.withColumns({c: F.col(f"_one.{c}") for c in one.columns}).drop("_one")
    score = ((1.0 if claims is not None else 0.3) + (1.0 if exposures is not None else 0.5) + (1.0 if market is not None else 0.8)) / 3
    return out.withColumn("availability_score", F.lit(score))


def column_pairs(values: DataFrame) -> DataFrame:
    """Shared distinct values of every two columns of different datasets.

    ``values`` is distinct (dataset, column_name, value). Each value lists the columns
    that hold it, at most the number of columns, so the pairs made per value are bounded
    by the schema however many rows there are.
    """
    held = values.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("dataset", "column_name"))).alias("h"))
    # The same set of columns is counted once with its multiplicity before pairs are made.
    sets = held.where(F.size("h") > 1).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("h", "n", F.posexplode("h").alias("i", "a"))
    pairs = first.select("n", "a", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("b")).where(F.col("a.dataset") != F.col("b.dataset"))
    return pairs.groupBy(
        F.col("a.dataset").alias("dataset1"), F.col("a.column_name").alias("column1"), F.col("b.dataset").alias("dataset2"), F.col("b.column_name").alias("column2")
    ).agg(F.sum("n").alias("common_values"))


def relationships(tables: dict[str, tuple[DataFrame, list[str]]], same: list[tuple[str, str]]) -> DataFrame:
    """Links between datasets: columns of one name, or of the pairs in ``same``, that share values, with their cardinality."""
    parts = [text_of(df, cols).withColumn("dataset", F.lit(name)) for name, (df, cols) in tables.items()]
    cells = reduce(lambda a, b: a.unionByName(b), parts)
    counts = cells.where("value IS NOT NULL").groupBy("dataset", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    unique = counts.groupBy("dataset", "column_name").agg((F.max("n") == 1).alias("unique"))
    pairs = column_pairs(counts.select("dataset", "column_name", "value"))
    ok = F.col("column1") == F.col("column2")
    for a, b in same:
        ok = ok | ((F.col("column1") == a) & (F.col("column2") == b)) | ((F.col("column1") == b) & (F.col("column2") == a))
    u1 = unique.select(F.col("dataset").alias("dataset1"), F.col("column_name").alias("column1"), F.col("unique").alias("u1"))
    u2 = unique.select(F.col("dataset").alias("dataset2"), F.col("column_name").alias("column2"), F.col("unique").alias("u2"))
    out = pairs.where(ok).join(u1, ["dataset1", "column1"]).join(u2, ["dataset2", "column2"])
    kind = F.when(F.col("u1") & F.col("u2"), "one-to-one").when(F.col("u1") | F.col("u2"), "one-to-many").otherwise("many-to-many")
    return out.withColumns({"relationship": kind, "confidence": F.least(F.lit(1.0), F.col("common_values") / 100)}).drop("u1", "u2")


def column_overlap(columns: DataFrame) -> DataFrame:
    """Shared column names of every two datasets over the smaller column count, in percent.

    Joined on the name, so datasets without a common name are never paired. Datasets are the
    named tables of one study, a handful; use ``detect_file_types`` for a landing zone.
    """
    sizes = columns.groupBy("file_id").agg(F.count(F.lit(1)).alias("size"))
    a = columns.select(F.col("file_id").alias("dataset1"), "column_name")
    b = columns.select(F.col("file_id").alias("dataset2"), "column_name")
    common = a.join(b, "column_name").where("dataset1 < dataset2").groupBy("dataset1", "dataset2").agg(F.count(F.lit(1)).alias("common_columns"))
    s1 = sizes.select(F.col("file_id").alias("dataset1"), F.col("size").alias("s1"))
    s2 = sizes.select(F.col("file_id").alias("dataset2"), F.col("size").alias("s2"))
    return common.join(s1, "dataset1").join(s2, "dataset2").select(
        "dataset1", "dataset2", "common_columns", (F.col("common_columns") / F.least("s1", "s2") * 100).alias("strength")
    )


def column_classes(columns: DataFrame) -> DataFrame:
    """Files (file_id, column_name) by their set of column names, letters folded: class_id (its smallest file), columns, size, files."""
    sets = columns.groupBy("file_id").agg(F.array_sort(F.collect_set(F.lower("column_name"))).alias("columns"))
    return sets.groupBy("columns").agg(F.min("file_id").alias("class_id"), F.count(F.lit(1)).alias("files")).withColumn("size", F.size("columns"))


def class_members(columns: DataFrame) -> DataFrame:
    """file_id, class_id: which class of ``column_classes`` each file is in."""
    sets = columns.groupBy("file_id").agg(F.array_sort(F.collect_set(F.lower("column_name"))).alias("columns"))
    return skew_join(sets, column_classes(columns).select("columns", "class_id"), "columns", "inner").select("file_id", "class_id")


def overlap_by_class(columns: DataFrame, min_strength: float = 60.0) -> DataFrame:
    """``column_overlap`` of a landing zone, between classes of files: class1, class2, file_pairs, common_columns, strength.

    Files with one set of columns are one class, and a row of two classes stands for all pairs of their files; a class of
    two files or more also meets itself. Only pairs of at least ``min_strength`` percent are returned. A pair that strong shares
    one of the rarest columns of its smaller set, of which it may lack only so many, so classes meet there alone: a column
    that all files have is among those only where a set has no other that could be lacking.
    """
    classes = cut_lineage(column_classes(columns).where("size > 0"), "column-classes")
    cells = classes.select("class_id", "size", F.explode("columns").alias("column_name"))
    seen = cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n"))
    ordered = skew_join(cells, seen, "column_name", "inner").groupBy("class_id", "size").agg(F.array_sort(F.collect_list(F.struct("_n", "column_name"))).alias("_by"))
    rare = F.col("size") - F.ceil(F.col("size") * F.lit(min_strength) / 100).cast("int") + 1
    probes = ordered.select(F.col("class_id").alias("class1"), F.col("size").alias("s1"), F.explode(F.slice("_by.column_name", F.lit(1), rare)).alias("column_name"))
    index = cells.select(F.col("class_id").alias("class2"), F.col("size").alias("s2"), "column_name")
    later = (F.col("s2") > F.col("s1")) | ((F.col("s2") == F.col("s1")) & (F.col("class2") > F.col("class1")))
    met = cut_lineage(probes.join(index, "column_name").where(later).select("class1", "class2").distinct(), "column-pairs")
    side = lambda i: classes.select(F.col("class_id").alias(f"class{i}"), F.col("columns").alias(f"c{i}"), F.col("files").alias(f"f{i}"), F.col("size").alias(f"n{i}"))
    both = met.join(side(1), "class1").join(side(2), "class2").withColumn("common_columns", F.size(F.array_intersect("c1", "c2")))
    pairs = both.select(
        F.least("class1", "class2").alias("class1"), F.greatest("class1", "class2").alias("class2"), (F.col("f1") * F.col("f2")).alias("file_pairs"),
        "common_columns", (F.col("common_columns") / F.least("n1", "n2") * 100).alias("strength")).where(F.col("strength") >= min_strength)
    alike = classes.where("files > 1").select(
        F.col("class_id").alias("class1"), F.col("class_id").alias("class2"), F.expr("files * (files - 1) div 2").alias("file_pairs"), F.col("size").alias("common_columns"), F.lit(100.0).alias("strength"))
    return pairs.unionByName(alike)


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that two datasets share in one column."""
    return a.select(F.col(column).cast("string").alias(column)).intersect(b.select(F.col(column).cast("string").alias(column)))


def readiness(manifest: DataFrame) -> DataFrame:
    """.6 coverage + .4 quality over a manifest of (required, present, quality)."""
    return manifest.agg(
        F.avg(F.col("present").cast("double")).alias("coverage"), F.avg("quality").alias("quality")
    ).withColumn("readiness", F.col("coverage") * 0.6 + F.col("quality") * 0.4)


def frequency_data(exposures: DataFrame, claims: DataFrame, key: str, risks: str) -> DataFrame:
    """Exposure with claim counts (0 where none) and frequency per risk; claims are counted before the join."""
    n = claims.groupBy(key).agg(F.count(F.lit(1)).alias("claim_count"))
    return exposures.join(n, key, "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0))).withColumn(
        "frequency", F.try_divide("claim_count", risks)
    )


def severity_data(claims: DataFrame, portfolio: DataFrame, key: str) -> DataFrame:
    """Positive claims with portfolio attributes and the log amount."""
    return skew_join(claims.where("claim_amount > 0"), portfolio, key, "left").withColumn("log_severity", F.log("claim_amount"))


def first_period(rows: DataFrame, day: str, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Name of the first period that holds the row's day; ``periods`` is a short literal list (name, start, end)."""
    d = F.col(day)
    name = F.coalesce(*[F.when(d.between(F.lit(a).cast("date"), F.lit(b).cast("date")), n) for n, a, b in periods])
    return rows.withColumn("period", name)
