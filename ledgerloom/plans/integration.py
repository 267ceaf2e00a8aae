"""Integration of treaty files, column typing of a landing zone, relationships, joins and model metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import canonical as cn
from ..operators import integrate as ig
from ..operators import metrics as mt
from ..operators import quality as ql
from .duck import duck
from .registry import query

# --- joins ------------------------------------------------------------------------------

_agg = """SELECT treaty_id, sum(claim_amount) AS total_historical_claims, count(*) AS total_claim_count, max(claim_amount) AS largest_historical_claim, avg(claim_amount) AS average_claim_size, stddev_samp(claim_amount) AS claim_volatility, count(*) / 5 AS annual_claim_frequency FROM claims GROUP BY 1"""
_exp = "SELECT treaty_id, sum(sum_insured) AS total_sum_insured, count(*) AS total_policy_count, avg(sum_insured) AS average_policy_size, max(sum_insured) AS largest_policy_size FROM exposures GROUP BY 1"


@query("A1", duck("claims", _agg), r2="total_historical_claims", r4="average_claim_size claim_volatility annual_claim_frequency")
def claims_by_treaty(spark, d):
    return ig.claims_by_treaty(cn.claims(spark, d))


@query("A2", duck("exposures", _exp), r2="total_sum_insured", r4="average_policy_size")
def exposures_by_treaty(spark, d):
    return ig.exposures_by_treaty(cn.exposures(spark, d))


@query(
    "J1 J2 J21",
    duck("claims exposures treaties", f"SELECT treaty_id, treaty_name, treaty_type, total_historical_claims, total_claim_count, claim_volatility, total_sum_insured, total_policy_count, 1.0::DOUBLE * (1 + 1 + 0.8) / 3 AS availability_score FROM treaties LEFT JOIN ({_agg}) USING (treaty_id) LEFT JOIN ({_exp}) USING (treaty_id)"),
    r2="total_historical_claims total_sum_insured", r4="claim_volatility availability_score",
)
def integrated_treaties(spark, d):
    out = ig.integrate_treaties(cn.treaties(spark, d), cn.claims(spark, d), cn.exposures(spark, d))
    return out.select("treaty_id", "treaty_name", "treaty_type", "total_historical_claims", "total_claim_count", "claim_volatility", "total_sum_insured", "total_policy_count", "availability_score")


@query(
    "J3 A2",
    duck("exposures treaties", "SELECT treaty_id, treaty_type, sum(sum_insured) AS portfolio_sum_insured, count(*) AS portfolio_policy_count, avg(sum_insured) AS portfolio_avg_policy_size, (0.3 + 1 + 0.8)::DOUBLE / 3 AS availability_score FROM (SELECT t.treaty_id, t.treaty_type, e.sum_insured FROM treaties t, exposures e) GROUP BY ALL"),
    r2="portfolio_sum_insured", r4="portfolio_avg_policy_size availability_score",
)
def treaties_with_portfolio_totals(spark, d):
    return ig.integrate_treaties(cn.treaties(spark, d).select("treaty_id", "treaty_type"), exposures=cn.exposures(spark, d).drop("treaty_id"))


@query(
    "J6",
    duck("policies claims", """SELECT product_type, count(*) AS policies, sum(n) AS claims, sum(amt) / sum(face_amount) AS claim_share FROM policies JOIN (SELECT policy_id, count(*) AS n, sum(claim_amount) AS amt FROM claims GROUP BY 1) USING (policy_id) GROUP BY 1""".replace("sum(n) AS claims", "CAST(sum(n) AS BIGINT) AS claims")),
    r6="claim_share",
)
def policies_with_experience(spark, d):
    per = cn.claims(spark, d).groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"), F.sum("claim_amount").alias("amt"))
    return cn.policies(spark, d).join(per, "policy_id").groupBy("product_type").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("n").alias("claims"), (F.sum("amt") / F.sum("face_amount")).alias("claim_share")
    )


@query(
    "J7",
    duck("policies claims", "SELECT product_type, count(*) AS policies, count(lapse_date) AS with_history, CAST(avg(date_diff('day', issue_date, lapse_date)) AS DOUBLE) AS mean_days FROM policies LEFT JOIN (SELECT policy_id, max(loss_date) AS lapse_date FROM claims WHERE cause = 'R' GROUP BY 1) USING (policy_id) GROUP BY 1"),
    r6="mean_days",
)
def policies_with_lapse_history(spark, d):
    history = cn.claims(spark, d).where("cause = 'R'").groupBy("policy_id").agg(F.max("loss_date").alias("lapse_date"))
    return cn.policies(spark, d).join(history, "policy_id", "left").groupBy("product_type").agg(
        F.count(F.lit(1)).alias("policies"), F.count("lapse_date").alias("with_history"), F.avg(F.datediff("lapse_date", "issue_date")).alias("mean_days")
    )


_regions = "SELECT n_name AS region, avg(c_acctbal) AS median_income FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


@query(
    "J8",
    duck("policies_state", f"SELECT state, count(*) AS policies, any_value(median_income) AS median_income, bool_or(coalesce(median_income < 4500, false)) AS low_income_area FROM policies_state LEFT JOIN ({_regions}) ON state = region GROUP BY 1"),
    r4="median_income",
)
def policies_with_region_economics(spark, d):
    c = cn.table(spark, d, "customer")
    n = cn.table(spark, d, "nation")
    regions = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("region")).agg(F.avg("c_acctbal").alias("median_income"))
    by_state = cn.policies(spark, d, with_state=True).groupBy("state").agg(F.count(F.lit(1)).alias("policies"))
    return by_state.join(regions, by_state.state == regions.region, "left").select(
        "state", "policies", "median_income", F.coalesce(F.col("median_income") < 4500, F.lit(False)).alias("low_income_area")
    )


@query(
    "J15",
    duck("exposures claims", "SELECT treaty_id, count(*) AS cells, sum(claim_count)::DOUBLE AS claims, avg(frequency) AS mean_frequency FROM (SELECT e.treaty_id, coalesce(n, 0) AS claim_count, coalesce(n, 0) / risk_count AS frequency FROM exposures e LEFT JOIN (SELECT treaty_id, count(*) AS n FROM claims GROUP BY 1) c ON e.treaty_id = c.treaty_id) GROUP BY 1"),
    r6="claims mean_frequency",
)
def claim_frequency(spark, d):
    f = ig.frequency_data(cn.exposures(spark, d), cn.claims(spark, d), "treaty_id", "risk_count")
    return f.groupBy("treaty_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("claim_count").cast("double").alias("claims"), F.avg("frequency").alias("mean_frequency"))


@query(
    "J16",
    duck("claims treaties", "SELECT business_line, count(*) AS claims, avg(ln(claim_amount)) AS mean_log_severity, stddev_samp(ln(claim_amount)) AS sd_log_severity FROM claims LEFT JOIN treaties USING (treaty_id) WHERE claim_amount > 0 GROUP BY 1"),
    r6="mean_log_severity sd_log_severity",
)
def claim_severity(spark, d):
    s = ig.severity_data(cn.claims(spark, d), cn.treaties(spark, d).select("treaty_id", "business_line"), "treaty_id")
    return s.groupBy("business_line").agg(F.count(F.lit(1)).alias("claims"), F.avg("log_severity").alias("mean_log_severity"), F.stddev_samp("log_severity").alias("sd_log_severity"))


PERIODS = [("expansion", "1995-01-01", "1996-12-31"), ("shock", "1996-06-01", "1997-06-30"), ("recovery", "1997-07-01", "1999-12-31"), ("late", "2000-01-01", "2000-12-31")]


@query(
    "J18",
    duck("policies", "SELECT coalesce(CASE " + " ".join(f"WHEN issue_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in PERIODS) + " END, 'none') AS period, count(*) AS policies FROM policies GROUP BY 1"),
)
def policies_by_economic_period(spark, d):
    p = ig.first_period(cn.policies(spark, d), "issue_date", PERIODS)
    return p.groupBy(F.coalesce("period", F.lit("none")).alias("period")).agg(F.count(F.lit(1)).alias("policies"))


# --- relationships ---------------------------------------------------------------------------

REL = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_suppkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"]}
SAME = [("o_orderkey", "l_orderkey"), ("o_custkey", "c_custkey"), ("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")]


def _rel(t1, c1, t2, c2):
    (t1, c1), (t2, c2) = sorted([(t1, c1), (t2, c2)])
    return f"""SELECT '{t1}' AS dataset1, '{c1}' AS column1, '{t2}' AS dataset2, '{c2}' AS column2, (SELECT count(*) FROM (SELECT {c1} FROM {t1} INTERSECT SELECT {c2} FROM {t2})) AS common_values,
      CASE WHEN u1 AND u2 THEN 'one-to-one' WHEN u1 OR u2 THEN 'one-to-many' ELSE 'many-to-many' END AS relationship FROM (SELECT (SELECT count(DISTINCT {c1}) = count({c1}) FROM {t1}) AS u1, (SELECT count(DISTINCT {c2}) = count({c2}) FROM {t2}) AS u2)"""


_where = {c: t for t, cs in REL.items() for c in cs}


@query(
    "J19 U4",
    "SELECT *, least(1.0, common_values / 100.0)::DOUBLE AS confidence FROM (" + " UNION ALL ".join(_rel(_where[a], a, _where[b], b) for a, b in SAME) + ") WHERE common_values > 0",
    r4="confidence",
)
def dataset_relationships(spark, d):
    return ig.relationships({t: (cn.table(spark, d, t), cols) for t, cols in REL.items()}, SAME)


@query("U4", "SELECT count(*) AS common FROM (SELECT CAST(o_orderkey AS VARCHAR) FROM orders INTERSECT SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)")
def shared_policy_ids(spark, d):
    a = cn.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    b = cn.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return ig.common_values(a, b, "k").agg(F.count(F.lit(1)).alias("common"))


# --- landing zone: each part number is a file whose columns are drawn from its row ----------------

_names = ["treaty_id", "Treaty Name", "treaty_type", "inception_date", "premium", "limit", "claim_id", "loss_date", "claim_amount", "policy_id",
          "sum_insured", "date", "gdp_growth", "loss_ratio", "cedant", "gross_claim_amt", "number_risks", "address", "policy_number", "birth_date"]


def _landing(spark, d):
    """file_columns of a landing zone: one file per part, five to twelve columns picked by its keys."""
    p = cn.table(spark, d, "part")
    k = F.col("p_partkey")
    cols = F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long") + F.col("p_size") % 8)
    parts = ig.by_file(p.select(F.concat(F.lit("file_"), k).alias("file_id"), "p_partkey", "p_size"))
    rows = parts.select("file_id", k, F.posexplode(cols).alias("position", "j"))
    name = cn.pick((k % 20 + F.col("j") * (1 + k % 3)) % 20, _names)
    kind = F.when(name.contains("date"), "date").when(name.contains("amount") | name.isin("premium", "limit", "sum_insured", "loss_ratio"), "double").otherwise("string")
    first = rows.select("file_id", "position", name.alias("column_name"), kind.alias("data_type")).groupBy("file_id", "column_name", "data_type")
    return first.agg(F.min("position").alias("position")).select("file_id", "position", "column_name", "data_type")


_lz = f"""SELECT file_id, min(position) AS position, column_name FROM (SELECT 'file_' || p_partkey AS file_id, j AS position, ({_names!r})[(p_partkey % 20 + j * (1 + p_partkey % 3)) % 20 + 1] AS column_name
  FROM (SELECT *, unnest(range(0, 5 + p_size % 8)) AS j FROM part)) GROUP BY ALL"""
_sq = "replace(replace(lower(column_name), '_', ''), ' ', '')"


def _match_sql(pattern: str, col: str) -> str:
    plain = pattern.replace("_", "")
    same = f"{col} = '{plain}'"
    if plain in ig.KEY_TERMS:
        return f"({same} OR ({' AND '.join(f'contains({col}, {t!r})' for t in ig.KEY_TERMS[plain])}))"
    if pattern in ig.VARIATIONS:
        return f"({same} OR {' OR '.join(f'contains({col}, {t!r})' for t in ig.VARIATIONS[pattern])})"
    return f"({same})"


def _share(kind: str, group: str) -> str:
    ps = ig.FILE_TYPES[kind][group]
    test = [f"contains(sq, '{p}')" if group == "indicator" else _match_sql(p, "sq") for p in ps]
    return "(" + " + ".join(f"CAST(bool_or({t}) AS INT)" for t in test) + f") / {len(ps)}.0::DOUBLE"


_scores = " UNION ALL ".join(
    f"""SELECT file_id, '{k}' AS file_type, {i} AS o, (r * 0.7::DOUBLE + p * 0.5::DOUBLE * 0.2::DOUBLE + n * 0.3::DOUBLE * 0.1::DOUBLE) * CASE WHEN r < 0.5 THEN 0.3::DOUBLE ELSE 1 END AS confidence
      FROM (SELECT file_id, {_share(k, 'required')} AS r, {_share(k, 'optional')} AS p, {_share(k, 'indicator')} AS n FROM (SELECT *, {_sq} AS sq FROM lz) GROUP BY 1)"""
    for i, k in enumerate(ig.FILE_TYPES)
)
_types = f"SELECT file_id, file_type, confidence FROM ({_scores}) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, o) = 1"


@query("P5 P6 T2", duck("", _types, lz=_lz), r6="confidence")
def detected_file_types(spark, d):
    return ig.detect_file_types(_landing(spark, d))


_role = "CASE file_type " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN {' OR '.join(_match_sql(p, _sq) for p in g['required'])} THEN 'required' WHEN {' OR '.join(_match_sql(p, _sq) for p in g['optional'])} THEN 'optional' ELSE 'additional' END"
    for k, g in ig.FILE_TYPES.items()
) + " END"


@query("P7", duck("", f"SELECT file_type, role, count(*) AS columns FROM (SELECT file_type, {_role} AS role FROM lz JOIN ({_types}) USING (file_id)) GROUP BY ALL", lz=_lz))
def column_roles(spark, d):
    cols = _landing(spark, d)
    return ig.column_roles(cols, ig.detect_file_types(cols)).groupBy("file_type", "role").agg(F.count(F.lit(1)).alias("columns"))


def _map_sql(schema: str) -> str:
    req, opt = ig.SCHEMAS[schema]
    fields = ", ".join(f"('{f}', {f in req}, '{f.replace('_', '')}')" for f in [*req, *opt])
    return f"""SELECT file_id, field, required, column_name, least(1, score) AS score FROM (SELECT file_id, field, required, column_name, position, CASE WHEN sq = t THEN 2.0::DOUBLE WHEN contains(sq, t) OR contains(t, sq) THEN least(length(sq), length(t)) / greatest(length(sq), length(t))::DOUBLE END AS score
      FROM (SELECT *, {_sq} AS sq FROM lz), (VALUES {fields}) f(field, required, t)) WHERE score > 0.6 QUALIFY row_number() OVER (PARTITION BY file_id, field ORDER BY score DESC, position) = 1"""


@query("P1 P2", duck("", " UNION ALL ".join(f"SELECT '{s}' AS target, * FROM ({_map_sql(s)})" for s in ig.SCHEMAS), lz=_lz), r6="score")
def mapped_columns(spark, d):
    return ig.map_all_columns(_landing(spark, d))


TREATY_NAMES = {"s_suppkey": "treaty_id", "s_name": "cedant", "s_acctbal": "premium", "s_nationkey": "territory"}


@query("P1", "SELECT " + ", ".join(f"{a} AS {b}" for a, b in TREATY_NAMES.items()) + " FROM supplier")
def renamed_treaties(spark, d):
    return ig.apply_mapping(cn.table(spark, d, "supplier"), TREATY_NAMES)


_pf = ", ".join(f"('{k}', '{f}')" for k, fs in ig.PRODUCT_FIELDS.items() for f in fs)


@query(
    "V3 U7",
    duck("", f"SELECT family, field, count(*) AS files FROM (SELECT DISTINCT file_id FROM lz), (VALUES {_pf}) f(family, field) WHERE NOT EXISTS (SELECT 1 FROM lz WHERE lz.file_id = file_id AND lower(lz.column_name) = f.field AND false) AND (file_id, field) NOT IN (SELECT file_id, lower(column_name) FROM lz) GROUP BY ALL", lz=_lz),
)
def missing_required_fields(spark, d):
    return ig.missing_fields(_landing(spark, d), ig.PRODUCT_FIELDS).groupBy("family", "field").agg(F.count(F.lit(1)).alias("files"))


@query(
    "P20",
    duck("", """SELECT data_domain, count(*) AS files, CAST(sum(n) AS BIGINT) AS columns FROM (SELECT file_id, count(*) AS n, CASE WHEN bool_or(contains(lower(column_name), 'policy')) THEN 'insurance_policy' WHEN bool_or(contains(lower(column_name), 'claim')) THEN 'claims'
      WHEN bool_or(contains(lower(column_name), 'mortality')) THEN 'mortality' WHEN bool_or(contains(lower(column_name), 'premium') OR contains(lower(column_name), 'amount')) THEN 'financial' ELSE 'general' END AS data_domain FROM lz GROUP BY 1) GROUP BY 1""", lz=_lz),
)
def data_domains(spark, d):
    return ig.data_domain(_landing(spark, d)).groupBy("data_domain").agg(F.count(F.lit(1)).alias("files"), F.sum("columns").alias("columns"))


@query(
    "J20",
    duck("", """SELECT dataset1, dataset2, count(*) AS common_columns, count(*) / least(any_value(s1), any_value(s2)) * 100 AS strength FROM (
      SELECT a.kind AS dataset1, b.kind AS dataset2, column_name FROM k a JOIN k b USING (column_name) WHERE a.kind < b.kind) JOIN (SELECT kind AS dataset1, count(*) AS s1 FROM k GROUP BY 1) USING (dataset1) JOIN (SELECT kind AS dataset2, count(*) AS s2 FROM k GROUP BY 1) USING (dataset2) GROUP BY ALL""",
      lz=_lz, k="SELECT DISTINCT 'set_' || (CAST(substr(file_id, 6) AS INT) % 4) AS kind, column_name FROM lz"),
    r4="strength",
)
def dataset_column_overlap(spark, d):
    sets = _landing(spark, d).select(
        F.concat(F.lit("set_"), F.substring("file_id", 6, 12).cast("int") % 4).alias("file_id"), "column_name"
    ).distinct()
    return ig.column_overlap(sets)


@query(
    "J20",
    duck("", """SELECT least(a.class_id, b.class_id) AS class1, greatest(a.class_id, b.class_id) AS class2, CASE WHEN a.class_id = b.class_id THEN a.files * (a.files - 1) // 2 ELSE a.files * b.files END AS file_pairs,
      CAST(len(list_intersect(a.columns, b.columns)) AS INT) AS common_columns, len(list_intersect(a.columns, b.columns)) / least(len(a.columns), len(b.columns)) * 100 AS strength
      FROM classes a JOIN classes b ON a.class_id <= b.class_id WHERE (a.class_id < b.class_id OR a.files > 1) AND len(list_intersect(a.columns, b.columns)) / least(len(a.columns), len(b.columns)) * 100 >= 60""",
      lz=_lz, sets="SELECT file_id, list_sort(list(DISTINCT lower(column_name))) AS columns FROM lz GROUP BY 1", classes="SELECT columns, min(file_id) AS class_id, count(*) AS files FROM sets GROUP BY 1"),
    r4="strength",
)
def landing_zone_overlap(spark, d):
    """All files of the landing zone against each other, a row per two classes of files with one set of columns."""
    return ig.overlap_by_class(_landing(spark, d))


@query(
    "A44",
    duck("", f"SELECT coverage, quality, coverage * 0.6 + quality * 0.4 AS readiness FROM (SELECT avg(CAST(confidence > 0.3 AS INT)) AS coverage, avg(confidence) AS quality FROM ({_types}))", lz=_lz),
    r6="coverage quality readiness",
)
def landing_zone_readiness(spark, d):
    t = ig.detect_file_types(_landing(spark, d))
    return ig.readiness(t.select((F.col("confidence") > 0.3).alias("present"), F.col("confidence").alias("quality")))


_cols = ["policy_number", "face_amount", "premium", "issue_age", "issue_date", "gender", "smoker_status", "policy_id", "loss_ratio"]
_fm = {  # column -> (standard field, kind, format score rule)
    "policy_number": ("policy_id", "identifier", 0.7), "face_amount": ("face_amount", "monetary", 1.0), "premium": ("premium_amount", "monetary", 1.0),
    "issue_age": ("age", "demographic", 1.0), "issue_date": ("issue_date", "temporal", 1.0), "gender": ("gender", "demographic", 1.0),
    "smoker_status": ("smoking_status", "risk_factor", 1.0), "policy_id": ("policy_id", "identifier", 0.3),
}


@query(
    "P3 P4",
    duck("messy", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, " + (f"'{_fm[c][0]}' AS standard_field, {0.56 + 0.3 * _fm[c][2]}::DOUBLE AS match_score, ({0.56 + 0.3 * _fm[c][2]}::DOUBLE + least(1, count({c}) / count(*) * 1.2)) / 2 AS confidence FROM messy"
                                          if c in _fm else f"NULL AS standard_field, NULL AS match_score, least(1, count({c}) / count(*) * 1.2) AS confidence FROM messy") for c in _cols)),
    r6="match_score confidence",
)
def standard_field_matches(spark, d):
    m = cn.messy_policies(spark, d)
    types = F.create_map(*[x for c, t in m.dtypes if c in _cols for x in (F.lit(c), F.lit(t))])
    prof = ql.text_profile(m, _cols).select(
        F.lit("messy").alias("file_id"), "column_name", types[F.col("column_name")].alias("data_type"), "distinct", "likely_date",
        (F.col("count") / (F.col("count") + F.col("nulls"))).alias("completeness"),
    )
    return ig.match_fields(prof).select("column_name", "standard_field", "match_score", "confidence")


# --- model metrics on supplied scores ---------------------------------------------------------

_pred = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem"


def _scored(spark, d):
    return cn.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


@query(
    "A29",
    f"""SELECT sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) AS r2, avg(abs((y - p) / CASE WHEN y = 0 THEN 1 ELSE y END)) * 100 AS mape FROM ({_pred})""",
    r4="rmse mae mape", r6="r2",
)
def regression_metrics(spark, d):
    return mt.regression_metrics(_scored(spark, d), "y", "p")


@query(
    "A28 M12",
    f"""SELECT avg(e) AS mean_residual, stddev_pop(e) AS sd_residual, avg(((e - m) / s) ** 3) AS skew_residual, avg(((e - m) / s) ** 4) - 3 AS kurtosis_residual FROM (SELECT y - p AS e FROM ({_pred})), (SELECT avg(y - p) AS m, stddev_pop(y - p) AS s FROM ({_pred}))""",
    r2="mean_residual sd_residual", r6="skew_residual kurtosis_residual",
)
def residual_moments(spark, d):
    return mt.residual_moments(_scored(spark, d), "y", "p")


@query(
    "M12 A29",
    f"""SELECT mean_ratio, rmse, r2, abs(mean_ratio - 1) < 0.1 AS stable FROM (SELECT avg(p) / avg(y) AS mean_ratio, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) AS r2 FROM ({_pred}))""",
    r4="rmse", r6="mean_ratio r2",
)
def validation_report(spark, d):
    return mt.validation_report(_scored(spark, d), "y", "p").select("mean_ratio", "rmse", "r2", "stable")


_lab = "SELECT quality AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, d):
    docs = cn.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s"))
    return cn.table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


@query(
    "A30",
    f"""SELECT (sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (p * n) AS auc, any_value(p)::BIGINT AS positives, any_value(n)::BIGINT AS negatives FROM (
      SELECT y, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM ({_lab})) GROUP BY p, n""",
    r6="auc",
)
def score_auc(spark, d):
    return mt.auc(_labelled(spark, d), "y", "s")


@query(
    "A30 T5",
    f"""SELECT s AS threshold, tp / (tp + fp) AS precision, tp / p AS recall, 2 * tp / (2 * tp + fp + p - tp) AS f1 FROM (
      SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p FROM (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM ({_lab}) GROUP BY 1)) ORDER BY round(2 * tp / (2 * tp + fp + p - tp), 9) DESC, s DESC LIMIT 1""",
    r6="threshold precision recall f1",
)
def best_f1_threshold(spark, d):
    return mt.best_f1(_labelled(spark, d), "y", "s")


@query(
    "A34",
    duck("event_log", """SELECT correlation_id, count(*) AS sessions, sum(value) AS total_premium, avg(k) AS average_risk, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM event_log GROUP BY 1"""),
    r2="total_premium", r6="average_risk",
)
def pricing_session_rollup(spark, d):
    e = cn.event_log(spark, d)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return e.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("value").alias("total_premium"), F.avg("k").alias("average_risk"),
        F.date_format(F.min("ts"), fmt).alias("earliest"), F.date_format(F.max("ts"), fmt).alias("latest"),
    )


@query(
    "F19 G1",
    duck("cedent_years", """SELECT cedent_id, list_sum(list_transform(l[-3:], lambda x: x)) / len(l[-3:]) AS recent_mean, l[len(l)] AS newest, CASE WHEN len(l) >= 3 THEN l[len(l)] * 0.5::DOUBLE + l[len(l)-1] * 0.3::DOUBLE + l[len(l)-2] * 0.2::DOUBLE END AS weighted FROM (SELECT cedent_id, list(loss_ratio ORDER BY year) AS l FROM cedent_years GROUP BY 1)"""),
    r6="recent_mean newest weighted",
)
def cedent_ratio_arrays(spark, d):
    years = cn.cedent_years(spark, d)
    lists = years.groupBy("cedent_id").agg(F.array_sort(F.collect_list(F.struct("year", "loss_ratio"))).alias("h"))  # one entry per calendar year
    l = F.col("l")
    weights = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    pairs = F.arrays_zip(F.reverse(F.slice(l, F.greatest(F.lit(1), F.size(l) - 2), 3)).alias("v"), weights.alias("w"))
    out = lists.withColumn("l", F.transform("h", lambda x: x["loss_ratio"])).withColumn("z", pairs)
    mean3 = F.aggregate(F.slice(l, F.greatest(F.lit(1), F.size(l) - 2), 3), F.lit(0.0), lambda a, x: a + x) / F.least(F.size(l), F.lit(3))
    return out.select(
        "cedent_id", mean3.alias("recent_mean"), F.element_at(l, -1).alias("newest"),
        F.when(F.size(l) >= 3, F.aggregate("z", F.lit(0.0), lambda a, x: a + x["v"] * x["w"])).alias("weighted"),
    )


@query(
    "F18 S3",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS t FROM events""",
)
def event_payload_fields(spark, d):
    e = cn.table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    again = e.select("event_id", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))).alias("j"))
    return again.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"), F.get_json_object("j", "$.t").alias("t"))
