"""Profiles, quality scores, validation and cleaning over the messy policy view and the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import canonical as cn
from ..operators import clean as cl
from ..operators import cleaning as cg
from ..operators import quality as ql
from ..operators import schemas as sc
from ..session import cut_lineage
from .duck import duck
from .registry import query

ASOF = cn.ASOF
MESSY = ["policy_id", "policy_number", "gender", "smoker_status", "policy_status", "product_type", "face_amount", "premium", "issue_age",
         "current_age", "issue_date", "issue_text", "currency", "business_line", "loss_ratio"]
NUM = ["face_amount", "premium", "issue_age", "current_age", "loss_ratio", "commission"]
TXT = ["gender", "smoker_status", "policy_status", "product_type", "issue_text", "currency", "policy_number"]


def _each(cols, body: str) -> str:
    return " UNION ALL ".join(body.replace("{c}", c) for c in cols)


@query(
    "A11 V5",
    duck("messy", "SELECT *, CASE WHEN missing_pct > 50 THEN 'CRITICAL' WHEN missing_pct > 20 THEN 'WARNING' ELSE 'OK' END AS level FROM (" + _each(MESSY, "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM messy") + ")"),
    r6="missing_pct",
)
def missing_values(spark, d):
    return ql.missing_report(cn.messy_policies(spark, d), MESSY)


@query(
    "A12 A13",
    duck("messy", _each(NUM, "SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count({c}) AS count, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS sd, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, count(DISTINCT {c}) AS \"distinct\", quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM messy")),
    r4="mean sd min max q25 median q75",
)
def numeric_column_profile(spark, d):
    return ql.column_profile(cn.messy_policies(spark, d), NUM)


@query(
    "A13 A15",
    duck("messy", _each(TXT, "SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", avg(length({c})) AS mean_length, count(try_strptime({c}, '%Y-%m-%d')) > count(*) * 0.8 AS likely_date, count(DISTINCT {c}) = count(*) AS candidate_key, count(DISTINCT {c}) / count(*) AS distinct_ratio FROM messy")),
    r6="mean_length distinct_ratio",
)
def text_column_profile(spark, d):
    return ql.text_profile(cn.messy_policies(spark, d), TXT)


_vc = _each(["gender", "smoker_status", "policy_status", "product_type", "issue_age", "premium"], "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank FROM messy WHERE {c} IS NOT NULL GROUP BY 2")


@query("A14 T1", duck("messy", "SELECT column_name, value, n, CAST(rank AS INT) AS rank FROM (" + _vc.replace('"premium"', "").rsplit(" UNION ALL ", 1)[0] + ") WHERE rank <= 10"))
def top_values(spark, d):
    return ql.top_values(cn.messy_policies(spark, d), ["gender", "smoker_status", "policy_status", "product_type", "issue_age"])


_dups = ["policy_number", "gender", "smoker_status", "product_type"]


@query(
    "A16",
    duck("messy", f"SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT {', '.join(_dups)}, count(*) AS n FROM messy GROUP BY ALL)"),
)
def duplicate_rows(spark, d):
    return ql.duplicate_count(cn.messy_policies(spark, d), _dups)


_li = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("A16", f"SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT {', '.join(_li)}, count(*) AS n FROM lineitem GROUP BY ALL)")
def duplicate_claim_rows(spark, d):
    return ql.duplicate_count(cn.table(spark, d, "lineitem"), _li)


@query(
    "A17",
    duck("messy", "SELECT submission_id, count(*) - count(DISTINCT policy_number) AS duplicates, count(*) AS rows FROM messy GROUP BY 1"),
)
def duplicate_policy_numbers(spark, d):
    per_key = cn.messy_policies(spark, d).groupBy("submission_id", "policy_number").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("submission_id").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.sum("n").alias("rows"))


@query(
    "A18 W21",
    duck("claims", """SELECT policy_id, claim_number, loss_date, claim_amount, units FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, claim_number ORDER BY loss_date DESC, claim_amount DESC, treaty_id DESC, units DESC) AS rn FROM claims) WHERE rn = 1"""),
    day="loss_date",
)
def latest_claim_version(spark, d):
    order = [F.desc("loss_date"), F.desc("claim_amount"), F.desc("treaty_id"), F.desc("units")]
    return ql.keep_last(cn.claims(spark, d), ["policy_id", "claim_number"], order).select("policy_id", "claim_number", "loss_date", "claim_amount", "units")


_gaps = " + ".join(f"CAST({c} IS NULL AS INT)" for c in MESSY)


@query(
    "A19",
    duck("messy", f"SELECT count(*) AS rows, count(*) FILTER (({_gaps}) > 0) AS rows_missing, {' + '.join(f'CAST(count({c}) < count(*) AS BIGINT)' for c in MESSY)} AS columns_missing, 1 - sum({_gaps}) / (count(*) * {len(MESSY)}) AS completeness FROM messy"),
    r6="completeness",
)
def table_completeness(spark, d):
    return ql.completeness(cn.messy_policies(spark, d), MESSY)


@query(
    "A20",
    duck("messy", f"""SELECT *, (completeness * 0.7 + consistency * 0.3) * 100 AS quality_score FROM (SELECT count(*) AS rows, count(*) FILTER (({_gaps}) > 0) AS rows_missing, {' + '.join(f'CAST(count({c}) < count(*) AS BIGINT)' for c in MESSY)} AS columns_missing,
      1 - sum({_gaps}) / (count(*) * {len(MESSY)}) AS completeness, (1 - count(*) FILTER (face_amount < 0) / count(*)) * (1 - count(*) FILTER (premium < 0) / count(*)) * (1 - count(*) FILTER (issue_age < 0) / count(*)) AS consistency FROM messy)"""),
    r6="completeness consistency quality_score",
)
def table_quality_score(spark, d):
    return ql.quality_score(cn.messy_policies(spark, d), MESSY, ["face_amount", "premium", "issue_age"])


@query(
    "A22",
    duck("messy", f"""SELECT *, greatest(0, 100 - 2 * missing_pct - 3 * duplicate_pct) AS score FROM (SELECT sum(({' + '.join(f'CAST({c} IS NULL AS INT)' for c in MESSY)}) * n) / (sum(n) * {len(MESSY)}) * 100 AS missing_pct, sum(n - 1) / sum(n) * 100 AS duplicate_pct
      FROM (SELECT {', '.join(MESSY)}, count(*) AS n FROM messy GROUP BY ALL))"""),
    r6="missing_pct duplicate_pct score",
)
def simple_quality_score(spark, d):
    return ql.simple_score(cn.messy_policies(spark, d), MESSY)


_let = "regexp_matches(v, '\\p{L}')"
_sty = f"""max({_let} AND v = upper(v)) AS upper, max({_let} AND v = lower(v)) AS lower, max({_let} AND v = initcap_(v) AND v <> upper(v)) AS title,
  max(regexp_matches(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS iso, max(regexp_matches(v, '\\d{{2}}/\\d{{2}}/\\d{{4}}')) AS slash, max(regexp_matches(v, '\\d{{2}}-\\d{{2}}-\\d{{4}}')) AS dash"""
_init = "array_to_string(list_transform(string_split(v, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_sty = _sty.replace("initcap_(v)", _init)
_stxt = ["gender", "smoker_status", "policy_status", "product_type", "issue_text", "policy_number"]
_styles = "SELECT *, CAST(upper AS INT) + CAST(lower AS INT) + CAST(title AS INT) > 1 OR CAST(iso AS INT) + CAST(slash AS INT) + CAST(dash AS INT) > 1 AS inconsistent FROM (" + _each(_stxt, f"SELECT '{{c}}' AS column_name, {_sty} FROM (SELECT DISTINCT {{c}} AS v FROM messy WHERE {{c}} IS NOT NULL)") + ")"


@query("V18", duck("messy", _styles))
def format_consistency(spark, d):
    return ql.format_consistency(cn.messy_policies(spark, d), _stxt)


@query(
    "A21",
    duck("messy", f"""SELECT *, completeness * 0.4::DOUBLE + consistency * 0.3::DOUBLE + validity * 0.2::DOUBLE + uniqueness * 0.1::DOUBLE AS overall_score FROM (SELECT
      (SELECT avg(f) FROM ({_each(_stxt + NUM, 'SELECT count({c}) / count(*) AS f FROM messy')})) AS completeness, 1 - (SELECT count(*) FROM st WHERE inconsistent) / {len(_stxt + NUM)}.0::DOUBLE AS consistency,
      1 - (SELECT CAST(count(*) FILTER (face_amount < 0) > 0 AS INT) + CAST(count(*) FILTER (issue_age < 0 OR issue_age > 120) > 0 AS INT) FROM messy) / {len(NUM)}.0::DOUBLE AS validity,
      (SELECT count(*) FROM ({_each(_stxt + NUM, 'SELECT count(DISTINCT {c}) AS d FROM messy')}) WHERE d = (SELECT count(*) FROM messy)) / {len(_stxt + NUM)}.0::DOUBLE AS uniqueness)""", st=_styles),
    r6="completeness consistency validity uniqueness overall_score",
)
def weighted_quality(spark, d):
    bad = {"face_amount": F.col("face_amount") < 0, "issue_age": ~F.col("issue_age").between(0, 120)}
    return ql.weighted_quality(cn.messy_policies(spark, d), _stxt, NUM, bad)


_ct = ["policy_number", "issue_text", "gender"]
_rate = lambda t: f"sum({' + '.join('CAST(regexp_matches({c}, ' + chr(39) + p + chr(39) + ') AS INT)' for p in ql.CONTENT_TYPES[t])}) / count({{c}})".replace("{c}", "v")
_ctsql = _each(_ct, "SELECT '{c}' AS column_name, " + ", ".join(f"{_rate(t)} AS rate_{t}" for t in ql.CONTENT_TYPES) + ", count(DISTINCT v) / count(v) AS distinct_ratio FROM (SELECT {c} AS v FROM messy WHERE {c} IS NOT NULL)")


@query(
    "V16",
    duck("messy", "SELECT *, CASE " + " ".join(f"WHEN rate_{t} > 0.7 THEN '{t}'" for t in ql.CONTENT_TYPES) + f" WHEN distinct_ratio < 0.1 THEN 'categorical' ELSE 'text' END AS content_type FROM ({_ctsql})"),
    r6=" ".join(f"rate_{t}" for t in ql.CONTENT_TYPES) + " distinct_ratio",
)
def content_types(spark, d):
    return ql.content_types(cn.messy_policies(spark, d), _ct)


_icol = ["gender", "smoker_status", "product_type", "issue_text"]
_isql = _each(_icol, f"""SELECT '{{c}}' AS column_name, count(*) AS rows, count(*) - count(v) AS nulls, count(*) FILTER (trim(v) <> v) AS padded,
  count(*) FILTER (v IS NOT NULL AND NOT ({_let} AND (v = upper(v) OR v = lower(v) OR v = {_init}))) AS mixed_case, count(*) FILTER (regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) AS iso_dates,
  count(*) FILTER (regexp_matches(v, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$')) AS us_dates, count(*) FILTER (lower(v) IN ('na','n/a','null','none','-','tbd')) AS missing_words, count(*) FILTER (trim(v) = '') AS blank FROM (SELECT {{c}} AS v FROM messy)""")
_ISS = f"""SELECT *, list_filter([CASE WHEN padded > 0 THEN 'whitespace:warning' END, CASE WHEN mixed_case > (rows - nulls) * 0.2 THEN 'inconsistent_case:warning' END,
  CASE WHEN iso_dates > 0 AND us_dates > 0 THEN 'mixed_date_formats:warning' END, CASE WHEN nulls / rows > 0.5 THEN 'missing_data:critical' WHEN nulls / rows > 0.2 THEN 'missing_data:warning' WHEN nulls > 0 THEN 'missing_data:info' END], lambda x: x IS NOT NULL) AS iss FROM ({_isql})"""


@query("V15", duck("messy", f"SELECT * EXCLUDE (iss), array_to_string(iss, '; ') AS issues FROM ({_ISS})"))
def column_issues(spark, d):
    return ql.column_issues(cn.messy_policies(spark, d), _icol).withColumn("issues", F.array_join("issues", "; "))


@query(
    "V17",
    duck("messy", f"""SELECT *, greatest(0, 100 - 10 * critical - 5 * warning - 2 * info) AS score FROM (SELECT count(*) FILTER (i LIKE '%critical') AS critical, count(*) FILTER (i LIKE '%warning') AS warning, count(*) FILTER (i LIKE '%info') AS info
      FROM (SELECT unnest(iss) AS i FROM ({_ISS})))"""),
)
def profile_score(spark, d):
    return ql.issue_score(ql.column_issues(cn.messy_policies(spark, d), _icol))


@query(
    "V14",
    duck("sheets", """SELECT file_id, count(*) AS rows, count(*) FILTER (f = 0) AS empty_rows, count(*) FILTER (f > 0 AND n - f > n * 0.8) AS sparse_rows, count(*) FILTER (row_idx < 5 AND f > 1 AND w >= f * 0.8::DOUBLE) AS header_like FROM (
      SELECT *, len(cells) AS n, len(list_filter(cells, lambda c: trim(c) <> '')) AS f, len(list_filter(cells, lambda c: regexp_matches(trim(c), '^[\\p{L}_]+$'))) AS w FROM sheets) GROUP BY 1"""),
)
def sheet_structure_issues(spark, d):
    return ql.structure_issues(cn.sheets(spark, d), "line", "file_id")


_pii = [("documents", "text"), ("pages", "html")]


@query(
    "P21",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, false AS name_match, " + ", ".join(f"avg(CAST(regexp_matches({c}, '{p}') AS INT)) AS {k}_rate" for k, p in ql.PII_VALUES.items()) + f" FROM {t}" for t, c in _pii),
    r6=" ".join(f"{k}_rate" for k in ql.PII_VALUES),
)
def personal_data_rates(spark, d):
    parts = [ql.pii_rates(cn.table(spark, d, t), [c]) for t, c in _pii]
    return parts[0].unionByName(parts[1])


# --- rules ------------------------------------------------------------------------------------

def _std(spark, d):
    return cl.standardise_categories(cn.messy_policies(spark, d))


def _map(col: str, kind: str) -> str:
    return "CASE " + " ".join(f"WHEN upper(trim({col})) IN ({', '.join(chr(39) + w + chr(39) for w in ws)}) THEN '{k}'" for k, ws in cl.CATEGORIES[kind].items()) + f" ELSE {col} END"


STD = "SELECT * REPLACE (" + ", ".join(f"{_map(k, k)} AS {k}" for k in cl.CATEGORIES) + ") FROM messy"
RULES = {
    "issue_age_range": ("issue_age", "issue_age NOT BETWEEN 0 AND 100", "error"),
    "issue_age_typical": ("issue_age", "issue_age NOT BETWEEN 18 AND 75", "warning"),
    "face_positive": ("face_amount", "face_amount <= 0", "error"),
    "face_reasonable": ("face_amount", "face_amount NOT BETWEEN 10000 AND 100000000", "warning"),
    "premium_non_negative": ("premium", "premium < 0", "error"),
    "premium_ratio": ("premium", "premium / face_amount <= 0.0001 OR premium / face_amount >= 0.2", "warning"),
    "gender_values": ("gender", "gender NOT IN ('M','F','U')", "error"),
    "smoker_values": ("smoker_status", "smoker_status NOT IN ('NS','S','U')", "error"),
    "product_values": ("product_type", "product_type NOT IN ('TERM','WHOLE_LIFE','UNIVERSAL_LIFE','VARIABLE_LIFE','ANNUITY','PENSION','401K','IRA')", "error"),
    "status_values": ("policy_status", "policy_status NOT IN ('ACTIVE','LAPSED','SURRENDERED','MATURED','CLAIM','PENDING')", "error"),
    "age_order": ("current_age", "current_age < issue_age", "error"),
    "maturity_after_issue": ("maturity_date", "maturity_date < issue_date", "error"),
}


@query(
    "V1 V2 V6",
    duck("messy", " UNION ALL ".join(f"SELECT '{n}' AS rule, '{c}' AS column_name, '{s}' AS severity, count(*) FILTER ({b}) AS affected_rows, count(*) FILTER ({b}) / count(*) AS affected_share FROM std" for n, (c, b, s) in RULES.items()), std=STD),
    r6="affected_share",
)
def rule_report(spark, d):
    return ql.rule_report(_std(spark, d), ql.policy_rules())


@query(
    "T7 V1",
    duck("messy", "SELECT rule, row_idx, CAST(rank AS INT) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, row_idx, row_number() OVER (ORDER BY row_idx) AS rank FROM std WHERE {b}" for n, (c, b, s) in RULES.items()) + ") WHERE rank <= 5", std=STD),
)
def rule_violation_samples(spark, d):
    return ql.violation_samples(_std(spark, d), ql.policy_rules(), "row_idx").select("rule", "row_idx", "rank")


_err = " OR ".join(f"coalesce({b}, false)" for c, b, s in RULES.values() if s == "error")
_cnt = lambda sev: " + ".join(f"CAST(count(*) FILTER ({b}) > 0 AS BIGINT)" for c, b, s in RULES.values() if s == sev)


@query(
    "V4 V1",
    duck("messy", f"""SELECT *, CASE WHEN error_rules > 10 OR completeness < 70 THEN 'REJECTED' WHEN error_rules > 5 OR completeness < 90 THEN 'POOR' WHEN error_rules > 0 OR completeness < 95 THEN 'ACCEPTABLE' WHEN warning_rules > 5 OR completeness < 98 THEN 'GOOD' ELSE 'PRISTINE' END AS quality_level FROM (
      SELECT count(*) AS rows, count(*) FILTER (NOT ({_err})) AS valid_rows, (1 - sum({_gaps}) / (count(*) * {len(MESSY)})) * 100 AS completeness, {_cnt('error')} AS error_rules, {_cnt('warning')} AS warning_rules FROM std)""", std=STD),
    r6="completeness",
)
def validation_summary(spark, d):
    return ql.validation_summary(_std(spark, d), ql.policy_rules(), MESSY)


@query(
    "S16 V1",
    duck("messy", f"SELECT submission_id, count(*) FILTER (NOT ({_err})) AS stored, count(*) FILTER ({_err}) AS rejected FROM std GROUP BY 1", std=STD),
)
def valid_and_rejected_policies(spark, d):
    rows = ql.failed_rules(_std(spark, d), ql.policy_rules(), "error")
    return rows.groupBy("submission_id").agg(F.count_if(F.size("failed") == 0).alias("stored"), F.count_if(F.size("failed") > 0).alias("rejected"))


_onum = ["face_amount", "premium", "issue_age", "loss_ratio"]


@query(
    "C11 V5",
    duck("messy", "SELECT *, outliers / n * 100 AS outlier_pct, outliers / n * 100 > 15 AS flagged FROM (" + _each(_onum, "SELECT '{c}' AS column_name, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound, count({c}) AS n, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM messy, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM messy) GROUP BY q1, q3") + ")"),
    r4="lower_bound upper_bound", r6="outlier_pct",
)
def interquartile_outliers(spark, d):
    return ql.iqr_outliers(cn.messy_policies(spark, d), _onum)


@query(
    "V7 V8",
    duck("messy claims", """SELECT critical, warning, info, greatest(0, least(100, 100 - 15 * critical - 3 * warning - info))::DOUBLE AS confidence, critical = 0 AS is_valid FROM (SELECT
      (SELECT CAST(count(*) FILTER (recovery > claim_amount) > 0 AS BIGINT) FROM claims) + (SELECT CAST(count(*) FILTER (loss_ratio + commission < 0) > 0 AS BIGINT) FROM messy) AS critical,
      (SELECT CAST(count(*) FILTER (loss_ratio > 2) > 0 AS BIGINT) + CAST(count(*) FILTER (commission > 0.5) > 0 AS BIGINT) FROM messy) AS warning, (SELECT CAST(count(*) FILTER (premium > limit_amount) > 0 AS BIGINT) FROM messy) AS info)"""),
)
def business_rule_confidence(spark, d):
    m = cn.messy_policies(spark, d)
    c = F.col
    treaty = [
        ql.Rule("high_loss_ratio", "loss_ratio", c("loss_ratio") > 2, "WARNING"), ql.Rule("high_commission", "commission", c("commission") > 0.5, "WARNING"),
        ql.Rule("negative_combined", "combined", c("loss_ratio") + c("commission") < 0, "CRITICAL"), ql.Rule("premium_over_limit", "premium", c("premium") > c("limit_amount"), "INFO"),
    ]
    claim = [ql.Rule("over_recovery", "recovery", c("recovery") > c("claim_amount"), "CRITICAL")]
    found = ql.rule_report(m, treaty).unionByName(ql.rule_report(cn.claims(spark, d), claim)).where("affected_rows > 0")
    return ql.confidence_score(found.withColumn("level", c("severity")))


_exp = {
    "policy_number:not_null": ("policy_number IS NOT NULL", 0.8), "policy_number:always_set": ("policy_number IS NOT NULL", 1.0),
    "face_amount:not_null": ("face_amount IS NOT NULL", 0.8), "face_amount:not_negative": ("face_amount IS NULL OR face_amount >= 0", 0.95),
    "premium:not_null": ("premium IS NOT NULL", 0.8), "premium:not_negative": ("premium IS NULL OR premium >= 0", 0.95),
    "issue_age:not_null": ("issue_age IS NOT NULL", 0.8), "issue_age:0_to_120": ("issue_age IS NULL OR issue_age BETWEEN 0 AND 120", 1.0),
    "issue_date:not_null": ("issue_date IS NOT NULL", 0.8), "issue_date:mostly_set": ("issue_date IS NOT NULL", 0.9),
    "gender:not_null": ("gender IS NOT NULL", 0.8), "gender:known": ("gender IS NULL OR gender IN ('M','F','Male','Female','male','female','m','f')", 0.9),
}
_expsql = " UNION ALL ".join(f"SELECT '{n}' AS expectation, {m}::DOUBLE AS mostly, avg(CAST({p} AS INT)) AS observed, avg(CAST({p} AS INT)) >= {m} AS success FROM messy" for n, (p, m) in _exp.items())
_ecols = ["policy_number", "face_amount", "premium", "issue_age", "issue_date", "gender"]


@query("V11", duck("messy", _expsql), r6="observed")
def expectation_results(spark, d):
    m = cn.messy_policies(spark, d).select(*_ecols)
    return ql.check_expectations(m, ql.expectations_for(m.schema))


@query(
    "V12",
    duck("messy", f"""SELECT *, r * 100 AS quality_score, CASE WHEN r > 0.8 THEN least(100, r * 100 + 10) ELSE r * 80 END AS compliance_score, CASE WHEN r > 0.9 THEN 'Production Ready' ELSE 'Needs Attention' END AS readiness,
      CASE WHEN r > 0.95 THEN 'Low' WHEN r > 0.8 THEN 'Medium' ELSE 'High' END AS risk_level FROM (SELECT count(*) AS expectations, count(*) FILTER (success) AS passed, count(*) FILTER (success) / count(*) AS r FROM ({_expsql}))""").replace("SELECT *, r * 100", "SELECT expectations, passed, r AS success_rate, r * 100"),
    r6="success_rate quality_score compliance_score",
)
def expectation_readiness(spark, d):
    m = cn.messy_policies(spark, d).select(*_ecols)
    return ql.readiness(ql.check_expectations(m, ql.expectations_for(m.schema)))


@query(
    "V13",
    duck("messy", f"SELECT max(day) AS newest, '' AS sparse_columns, date_diff('day', max(day), DATE '{ASOF}') > 90 AS stale FROM (SELECT * FROM messy)"),
    day="newest",
)
def freshness_risk(spark, d):
    m = cn.messy_policies(spark, d).withColumn("day", cl.parse_date(F.col("issue_text")))
    orders = cn.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderdate").cast("date").alias("real_day"))
    return ql.freshness_risk(m.drop("day").join(orders, "row_idx"), MESSY, "real_day", ASOF)


_up = ["policy_number", "issue_date", "face_amount", "annual_premium", "issue_age", "gender", "smoker_status", "product_type", "policy_status"]


@query(
    "V9",
    duck("messy", f"""SELECT submission_id, n AS policies, dup AS duplicates, {' + '.join(f'CAST(m_{c} / n > 0.02 AS INT)' for c in _up)} + CAST(neg > 0 AS INT) AS errors, ({' + '.join(f'CAST(m_{c} / n > 0.02 AS INT)' for c in _up)} + CAST(neg > 0 AS INT)) = 0 AS valid,
      greatest(0, 100 - ({' + '.join(f'CASE WHEN m_{c} / n > 0.02 THEN 10 WHEN m_{c} > 0 THEN 2 ELSE 0 END' for c in _up)} + CASE WHEN fmin < 1000 THEN 3 ELSE 0 END + CASE WHEN fmax > 50000000 THEN 2 ELSE 0 END
        + CASE WHEN amin < 0 OR amax > 90 THEN 5 ELSE 0 END + CASE WHEN bg > 0 THEN 3 ELSE 0 END + CASE WHEN bs > 0 THEN 3 ELSE 0 END + CASE WHEN neg > 0 THEN 10 ELSE 0 END + CASE WHEN inf / n < 0.6 THEN 8 ELSE 0 END + CASE WHEN dup > 0 THEN 5 ELSE 0 END)) AS quality_score
      FROM (SELECT submission_id, count(*) AS n, count(*) - count(DISTINCT policy_number) AS dup, {', '.join(f'count(*) - count({c}) AS m_{c}' for c in _up)}, min(face_amount) AS fmin, max(face_amount) AS fmax, min(issue_age) AS amin, max(issue_age) AS amax,
        count(*) FILTER (gender NOT IN ('M','F','Male','Female','m','f')) AS bg, count(*) FILTER (smoker_status NOT IN ('Smoker','Nonsmoker','smoker','nonsmoker','S','N')) AS bs, count(*) FILTER (annual_premium < 0) AS neg,
        count(*) FILTER (policy_status IN ('Inforce','inforce','Active','active')) AS inf FROM (SELECT *, premium AS annual_premium FROM messy) GROUP BY 1)"""),
)
def policy_upload_scores(spark, d):
    return ql.upload_score(cn.messy_policies(spark, d).withColumnRenamed("premium", "annual_premium"), ["submission_id"])


@query(
    "V10",
    duck("cedent_years", """SELECT cedent_id, years, latest_premium, unpaired, odd_years, array_to_string(list_filter([CASE WHEN latest_premium < 5000000 THEN 'premium below minimum' END, CASE WHEN years < 3 THEN 'too few years' END, CASE WHEN unpaired > 0 THEN 'premium and claims differ in length' END], lambda x: x IS NOT NULL), '; ') AS errors,
      NOT (latest_premium < 5000000 OR years < 3 OR unpaired > 0) AS valid FROM (SELECT cedent_id, count(*) AS years, arg_max(premium_volume, year) AS latest_premium, count(*) FILTER (premium_volume IS NULL OR incurred_claims IS NULL) AS unpaired,
      count(*) FILTER (loss_ratio > 2 OR loss_ratio < 0.1) AS odd_years FROM cedent_years GROUP BY 1)"""),
    r2="latest_premium",
)
def submission_screening(spark, d):
    y = cn.cedent_years(spark, d).withColumnsRenamed({"premium_volume": "premium", "incurred_claims": "claims"})
    return ql.screen_submissions(y, "cedent_id").withColumn("errors", F.array_join("errors", "; "))


# --- cleaning -----------------------------------------------------------------------------------

@query(
    "P9",
    duck("messy", _each(list(cl.CATEGORIES), "SELECT '{c}' AS column_name, count(DISTINCT m.{c}) AS before, count(DISTINCT s.{c}) AS after FROM messy m JOIN std s USING (row_idx)"), std=STD),
)
def category_standardisation(spark, d):
    m, s = cn.messy_policies(spark, d), _std(spark, d)
    cols = list(cl.CATEGORIES)
    n = lambda df, name: ql.value_counts(df, cols).groupBy("column_name").agg(F.count(F.lit(1)).alias(name))
    return n(m, "before").join(n(s, "after"), "column_name")


def _sp(col, kind):
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(chr(39) + w + chr(39) for w in ws)}) THEN '{k}'" for k, ws in cl.POLICY_SPELLINGS[kind].items()) + f" ELSE {col} END"


@query(
    "P10 P12",
    duck("messy", f"SELECT {_sp('gender', 'gender')} AS gender, {_sp('smoker_status', 'smoker_status')} AS smoker_status, {_sp('policy_status', 'policy_status')} AS policy_status, count(*) AS policies FROM messy GROUP BY ALL"),
)
def policy_standardisation(spark, d):
    m = cn.messy_policies(spark, d).withColumns({c: cl.standard(F.col(c), w, fold=False) for c, w in cl.POLICY_SPELLINGS.items()})
    return m.groupBy("gender", "smoker_status", "policy_status").agg(F.count(F.lit(1)).alias("policies"))


@query(
    "P13",
    duck("messy", "SELECT currency, CASE currency WHEN 'US$' THEN 'USD' WHEN 'usd' THEN 'USD' WHEN 'Euro' THEN 'EUR' WHEN '€' THEN 'EUR' WHEN 'British Pound' THEN 'GBP' WHEN '¥' THEN 'JPY' WHEN 'JPN' THEN 'JPY' END AS currency_clean, count(*) AS n FROM messy GROUP BY ALL"),
)
def currency_standardisation(spark, d):
    return cn.messy_policies(spark, d).groupBy("currency", cl.standard_currency(F.col("currency")).alias("currency_clean")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C14",
    duck("messy", "SELECT row_idx, CASE WHEN row_idx % 6 <> 5 THEN day END AS parsed, (['yyyy-MM-dd','dd/MM/yyyy','dd-MMM-yyyy','yyyyMMdd','serial','unparsed'])[row_idx % 6 + 1] AS format_used FROM messy"),
    day="parsed",
)
def parsed_messy_dates(spark, d):
    t = F.col("issue_text")
    return cn.messy_policies(spark, d).select("row_idx", cl.parse_date(t).alias("parsed"), cl.date_format_used(t).alias("format_used"))


@query(
    "C14",
    duck("messy", "SELECT (['yyyy-MM-dd','dd/MM/yyyy','dd-MMM-yyyy','yyyyMMdd','serial','unparsed'])[row_idx % 6 + 1] AS format_used, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM messy GROUP BY 1"),
    r6="share",
)
def date_parse_rates(spark, d):
    n = cn.messy_policies(spark, d).groupBy(cl.date_format_used(F.col("issue_text")).alias("format_used")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / n.agg(F.sum("n")).scalar())


@query(
    "C14",
    duck("messy", "SELECT submission_id, count(*) AS dates, count(*) FILTER (row_idx % 6 = 1 AND day(day) <= 12 AND day(day) <> month(day)) AS ambiguous FROM messy GROUP BY 1"),
)
def ambiguous_dates(spark, d):
    return cn.messy_policies(spark, d).groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("dates"), F.count_if(cl.ambiguous_date(F.col("issue_text"))).alias("ambiguous")
    )


@query(
    "P8 F16",
    duck("messy", """SELECT row_idx, face_amount AS face_amount, CASE WHEN row_idx % 6 <> 5 THEN day END AS issue_date, CASE row_idx % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS is_smoker, trim(gender) AS gender FROM messy"""),
    day="issue_date",
)
def types_from_names(spark, d):
    m = cn.messy_policies(spark, d)
    raw = m.select(
        "row_idx", F.concat(F.lit(" $"), F.col("face_amount").cast("decimal(18,2)").cast("string")).alias("face_amount"), F.col("issue_text").alias("issue_date"),
        F.element_at(F.array(F.lit("Yes "), F.lit("no"), F.lit("0"), F.lit("unknown")), (F.col("row_idx") % 4 + 1).cast("int")).alias("is_smoker"), "gender",
    )
    return cl.coerce_types(raw, ["face_amount", "issue_date", "is_smoker", "gender"])


@query(
    "C2 C3 C15",
    duck("messy", f"""SELECT row_idx, CASE WHEN issue_date > DATE '{ASOF}' AND year(issue_date) > 2050 THEN CAST(issue_date - INTERVAL 100 YEAR AS DATE) ELSE issue_date END AS issue_date, CAST(round(CAST(abs(face_amount) AS DECIMAL(28,6)), 2) AS DOUBLE) AS face_amount, CAST(round(CAST(premium AS DECIMAL(28,6)), 2) AS DOUBLE) AS premium, trim(gender) AS gender FROM messy"""),
    r2="face_amount premium", day="issue_date",
)
def repaired_dates_and_amounts(spark, d):
    m = cn.messy_policies(spark, d).withColumn("issue_date", cl.repair_future(F.col("issue_date"), ASOF))
    m = cl.normalise_amounts(m, ["face_amount"], ["premium"])
    return m.select("row_idx", "issue_date", "face_amount", "premium", F.trim("gender").alias("gender"))


_mode = lambda c: f"(SELECT {c} FROM messy WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "C4 C8",
    duck("messy", f"""SELECT row_idx, coalesce(gender, {_mode('gender')}) AS gender, coalesce(smoker_status, {_mode('smoker_status')}) AS smoker_status, coalesce(face_amount, (SELECT quantile_cont(face_amount, 0.5) FROM messy)) AS face_amount,
      coalesce(premium, (SELECT quantile_cont(premium, 0.5) FROM messy)) AS premium, coalesce(loss_ratio, (SELECT avg(loss_ratio) FROM messy)) AS loss_ratio FROM messy"""),
    r6="face_amount premium loss_ratio",
)
def smart_imputation(spark, d):
    return cl.smart_impute(cn.messy_policies(spark, d).select("row_idx", "gender", "smoker_status", "face_amount", "premium", "loss_ratio"))


@query("C5", duck("messy", "SELECT count(*) AS rows FROM messy WHERE face_amount IS NOT NULL AND premium IS NOT NULL AND gender IS NOT NULL"))
def complete_rows(spark, d):
    return cn.messy_policies(spark, d).dropna(subset=["face_amount", "premium", "gender"]).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "W15 C4",
    duck("messy", "SELECT row_idx, last_value(v IGNORE NULLS) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS issue_date FROM (SELECT row_idx, CASE WHEN row_idx % 6 <> 5 THEN day END AS v FROM messy)"),
    day="issue_date",
)
def forward_filled_dates(spark, d):
    m = cn.messy_policies(spark, d).select("row_idx", cl.parse_date(F.col("issue_text")).alias("issue_date"))
    return cl.forward_fill(m, "row_idx", "issue_date", chunk=4096)


@query(
    "C6",
    duck("messy", "SELECT business_line, count(*) AS n, avg(coalesce(loss_ratio, CASE business_line WHEN 'Property' THEN 0.65 WHEN 'Casualty' THEN 0.72 WHEN 'Marine' THEN 0.68 ELSE 0.55 END::DOUBLE)) AS mean_loss_ratio FROM messy GROUP BY 1"),
    r6="mean_loss_ratio",
)
def imputed_loss_ratio(spark, d):
    return cl.impute_loss_ratio(cn.messy_policies(spark, d)).groupBy("business_line").agg(F.count(F.lit(1)).alias("n"), F.avg("loss_ratio").alias("mean_loss_ratio"))


@query(
    "C7 J13",
    duck("messy", "SELECT row_idx, coalesce(premium, quantile_cont(premium, 0.5) OVER (PARTITION BY treaty_type, business_line)) AS premium FROM messy"),
    r6="premium",
)
def imputed_premium(spark, d):
    return cl.impute_premium(cn.messy_policies(spark, d).select("row_idx", "treaty_type", "business_line", "premium", "face_amount")).select("row_idx", "premium")


_cap = lambda c, f: f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, (SELECT quantile_cont({c}, 0.75) + {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM messy)), (SELECT quantile_cont({c}, 0.25) - {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM messy)) END AS {c}"


@query("C9", duck("messy", f"SELECT row_idx, {_cap('face_amount', 3)}, {_cap('premium', 3)} FROM messy"), r6="face_amount premium")
def capped_outliers(spark, d):
    return cl.cap_outliers(cn.messy_policies(spark, d).select("row_idx", "face_amount", "premium"), ["face_amount", "premium"])


_win = lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM messy)), (SELECT quantile_cont({c}, 0.01) FROM messy)) END AS {c}"


@query("C12", duck("messy", f"SELECT row_idx, {_win('face_amount')}, {_win('loss_ratio')} FROM messy"), r6="face_amount loss_ratio")
def winsorised_amounts(spark, d):
    return cl.winsorise(cn.messy_policies(spark, d).select("row_idx", "face_amount", "loss_ratio"), ["face_amount", "loss_ratio"])


_sig = lambda c: f"coalesce(abs({c} - (SELECT avg({c}) FROM messy)) > 3 * (SELECT stddev_samp({c}) FROM messy), false)"


@query(
    "C10",
    duck("messy", f"""SELECT count(*) AS kept, sum(face_amount) AS face_amount FROM messy WHERE NOT (({_sig('face_amount')} AND (SELECT avg(CAST({_sig('face_amount')} AS INT)) FROM messy) < 0.05)
      OR ({_sig('premium')} AND (SELECT avg(CAST({_sig('premium')} AS INT)) FROM messy) < 0.05) OR ({_sig('issue_age')} AND (SELECT avg(CAST({_sig('issue_age')} AS INT)) FROM messy) < 0.05))"""),
    r2="face_amount",
)
def sigma_filtered_rows(spark, d):
    m = cn.messy_policies(spark, d).select("row_idx", "face_amount", "premium", "issue_age")
    return cl.drop_sigma_outliers(m, ["face_amount", "premium", "issue_age"]).agg(F.count(F.lit(1)).alias("kept"), F.sum("face_amount").alias("face_amount"))


@query(
    "C13",
    duck("messy", """SELECT row_idx, least(120, greatest(0, issue_age)) AS issue_age, least(120, greatest(0, greatest(current_age, issue_age))) AS current_age, abs(face_amount) AS face_amount,
      abs(CASE WHEN premium / face_amount > 0.2 THEN face_amount * 0.2::DOUBLE WHEN premium / face_amount < 0.0001 THEN face_amount * 0.0001::DOUBLE ELSE premium END) AS premium FROM messy"""),
    r6="face_amount premium",
)
def actuarial_rules_applied(spark, d):
    return cl.actuarial_rules(cn.messy_policies(spark, d)).select("row_idx", "issue_age", "current_age", "face_amount", "premium")


@query(
    "W19 J14",
    duck("messy", """SELECT row_idx, treaty_type, business_line, loss_ratio, avg(loss_ratio) OVER w AS peer_mean, stddev_samp(loss_ratio) OVER w AS peer_sd, coalesce(abs(loss_ratio - avg(loss_ratio) OVER w) > 3 * stddev_samp(loss_ratio) OVER w, false) AS peer_outlier
      FROM messy WINDOW w AS (PARTITION BY treaty_type, business_line)"""),
    r6="loss_ratio peer_mean peer_sd",
)
def peer_group_outliers(spark, d):
    m = cn.messy_policies(spark, d).select("row_idx", "treaty_type", "business_line", "loss_ratio")
    return cl.peer_outliers(m, ["treaty_type", "business_line"], "loss_ratio")


@query(
    "P14",
    duck("messy", """SELECT business_line, count(*) FILTER (loss_ratio > 5) AS loss_ratio_outliers, count(*) FILTER (commission > 0.5) AS commission_outliers, count(*) FILTER (premium / limit_amount > 0.5) AS rate_outliers FROM messy GROUP BY 1"""),
)
def business_outlier_flags(spark, d):
    m = cl.business_flags(cn.messy_policies(spark, d).withColumn("commission", F.col("commission")))
    return m.groupBy("business_line").agg(
        F.count_if("loss_ratio_outlier").alias("loss_ratio_outliers"), F.count_if("commission_outlier").alias("commission_outliers"), F.count_if("rate_outlier").alias("rate_outliers")
    )


@query(
    "A10",
    duck("claims", """SELECT treaty_id, inception_date, CAST(versions AS BIGINT) AS premium_versions, flag AS data_quality_flag, count(*) AS rows FROM (
      SELECT treaty_id, inception_date, v AS versions, CASE WHEN v > 1 AND (mx - mn) / mx > 0.1 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS flag FROM
        (SELECT treaty_id, date_trunc('year', loss_date) AS inception_date, units AS premium FROM claims) JOIN
        (SELECT treaty_id, date_trunc('year', loss_date) AS inception_date, count(DISTINCT units) AS v, max(units) AS mx, min(units) AS mn FROM claims GROUP BY ALL) USING (treaty_id, inception_date)) GROUP BY ALL"""),
    day="inception_date",
)
def treaty_term_conflicts(spark, d):
    rows = cn.claims(spark, d).select("treaty_id", F.trunc("loss_date", "year").alias("inception_date"), F.col("units").alias("premium"))
    return cl.treaty_conflicts(rows).groupBy("treaty_id", "inception_date", "premium_versions", "data_quality_flag").agg(F.count(F.lit(1)).alias("rows"))


_dedup = "SELECT * FROM messy QUALIFY row_number() OVER (PARTITION BY policy_id, issue_date ORDER BY row_idx DESC) = 1"
_shaped = "SELECT * REPLACE (" + ", ".join(f"{_map(k, k)} AS {k}" for k in cl.CATEGORIES) + f""", CASE WHEN issue_date > DATE '{ASOF}' AND year(issue_date) > 2050 THEN CAST(issue_date - INTERVAL 100 YEAR AS DATE) ELSE issue_date END AS issue_date,
  round(abs(face_amount), 2) AS face_amount, round(CAST(premium AS DECIMAL(18, 4)), 2)::DOUBLE AS premium) FROM dedup"""
_mode_s = lambda c: f"(SELECT {c} FROM shaped WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_filled = "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, {_mode_s(c)}) AS {c}" for c in ("gender", "smoker_status")) + ", " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM shaped)) AS {c}" for c in ("face_amount", "premium")) + ") FROM shaped"
_bound = lambda c: f"greatest(least({c}, (SELECT quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM filled)), (SELECT quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM filled)) AS {c}"


@query(
    "C1 C5",
    duck("messy", """SELECT policy_id, gender, smoker_status, policy_status, product_type, abs(face_amount) AS face_amount,
      abs(CASE WHEN premium / face_amount > 0.2 THEN face_amount * 0.2::DOUBLE WHEN premium / face_amount < 0.0001 THEN face_amount * 0.0001::DOUBLE ELSE premium END) AS premium,
      least(120, greatest(0, issue_age)) AS issue_age, least(120, greatest(0, greatest(current_age, issue_age))) AS current_age, issue_date FROM capped""",
      dedup=_dedup, shaped=_shaped, filled=_filled, capped=f"SELECT * REPLACE ({_bound('face_amount')}, {_bound('premium')}) FROM filled"),
    r4="face_amount premium", day="issue_date",
)
def cleaned_policies(spark, d):
    return cl.clean_policies(cn.messy_policies(spark, d), ASOF).select(
        "policy_id", "gender", "smoker_status", "policy_status", "product_type", "face_amount", "premium", "issue_age", "current_age", "issue_date"
    )


# The table as it is landed: numbers and dates as text, a part of the rows sent again later with another premium.
_landed_sql = """SELECT row_idx, policy_id, ' ' || gender AS gender, smoker_status, policy_status, product_type, underwriting_class, face_amount, CAST(CAST(premium * part AS DECIMAL(18, 4)) AS DOUBLE) AS premium, issue_age, current_age,
  CASE WHEN k % 43 = 0 THEN issue_date WHEN k % 6 <> 5 THEN day END AS issue_date, CASE WHEN k % 43 = 0 THEN strftime(issue_date, '%Y-%m-%d') ELSE issue_text END AS issue_key FROM (
  SELECT *, row_idx AS k, 1 AS part FROM messy UNION ALL SELECT * REPLACE (row_idx + 60000000 AS row_idx), row_idx, 2 FROM messy WHERE row_idx % 20 = 7)"""
_SPELLED = ("gender", "smoker_status", "policy_status", "product_type", "underwriting_class")
_typed_sql = "SELECT * REPLACE (" + ", ".join(f"trim({c}) AS {c}" for c in _SPELLED) + ") FROM landed"
_formed_sql = "SELECT * REPLACE (" + ", ".join(f"{_map(c, c)} AS {c}" for c in _SPELLED if c in cl.CATEGORIES) + f""", CASE WHEN issue_date > DATE '{ASOF}' AND year(issue_date) > 2050 THEN CAST(issue_date - INTERVAL 100 YEAR AS DATE) ELSE issue_date END AS issue_date,
  round(abs(face_amount), 2) AS face_amount, round(CAST(premium AS DECIMAL(18, 4)), 2)::DOUBLE AS premium) FROM typed"""
_once_sql = "SELECT * FROM formed QUALIFY row_number() OVER (PARTITION BY policy_id, issue_key ORDER BY row_idx DESC) = 1"
_mode_o = lambda c: f"(SELECT {c} FROM once WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_whole_sql = "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, {_mode_o(c)}) AS {c}" for c in _SPELLED) + ", " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM once)) AS {c}" for c in ("face_amount", "premium")) + ", last_value(issue_date IGNORE NULLS) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS issue_date) FROM once"
_held_sql = f"SELECT * REPLACE ({_bound('face_amount').replace('filled', 'whole')}, {_bound('premium').replace('filled', 'whole')}) FROM whole"
_ruled_sql = """SELECT * REPLACE (abs(face_amount) AS face_amount, abs(CASE WHEN premium / face_amount > 0.2 THEN face_amount * 0.2::DOUBLE WHEN premium / face_amount < 0.0001 THEN face_amount * 0.0001::DOUBLE ELSE premium END) AS premium,
  CAST(least(120, greatest(0, issue_age)) AS INT) AS issue_age, CAST(least(120, greatest(0, greatest(current_age, issue_age))) AS INT) AS current_age) FROM held"""
_WHOLE = dict(landed=_landed_sql, typed=_typed_sql, formed=_formed_sql, once=_once_sql, whole=_whole_sql, held=_held_sql, ruled=_ruled_sql)


def _landed(spark, d):
    m = cn.messy_policies(spark, d).withColumns({"k": F.col("row_idx"), "part": F.lit(1)})
    again = m.where("k % 20 = 7").withColumns({"row_idx": F.col("k") + 60_000_000, "part": F.lit(2)})
    return m.unionByName(again).select(
        "row_idx", "policy_id", F.concat(F.lit(" "), "gender").alias("gender"), *_SPELLED[1:],
        F.concat(F.lit("$"), F.format_number("face_amount", 2)).alias("face_amount"), (F.col("premium") * F.col("part")).cast("decimal(18,4)").cast("string").alias("premium"),
        "issue_age", "current_age", F.when(F.col("k") % 43 == 0, F.date_format("issue_date", "yyyy-MM-dd")).otherwise(F.col("issue_text")).alias("issue_date"),
    )


def _clean_landed(spark, d):
    return cg.clean_dataset(_landed(spark, d), ["policy_id", "issue_date"], "row_idx", ASOF)


@query("C1 C2 C3 C4 C15", duck("messy", "SELECT * EXCLUDE (issue_key) FROM ruled", **_WHOLE), r4="face_amount premium", day="issue_date")
def cleaned_dataset(spark, d):
    """Stages the table four times while the query is being built."""
    return _clean_landed(spark, d).rows


_differs = lambda step, action, old, new, columns: " UNION ALL ".join(
    f"SELECT {step} AS step, '{action}' AS action, '{c}' AS column_name, count(*) FILTER (o.{c} IS DISTINCT FROM n.{c}) AS cells FROM {old} o JOIN {new} n USING (row_idx)" for c in columns)
_named = [c for c in _SPELLED if c in cl.CATEGORIES]


@query(
    "C1",
    duck("messy", " UNION ALL ".join([
        *[f"SELECT 1 AS step, 'type' AS action, '{c}' AS column_name, count({c}) AS cells FROM typed" for c in ("face_amount", "premium", "issue_date")],
        *[f"SELECT 1, 'unreadable', '{c}', count(*) FILTER ({c} IS NULL AND {raw} IS NOT NULL) FROM typed" for c, raw in (("face_amount", "face_amount"), ("premium", "premium"), ("issue_date", "issue_key"))],
        *[f"SELECT 1, 'trim', '{c}', count(*) FILTER (o.{c} <> n.{c}) FROM landed o JOIN typed n USING (row_idx)" for c in _SPELLED],
        _differs(2, "repair_date", "typed", "formed", ["issue_date"]), _differs(3, "standardise", "typed", "formed", _named), _differs(4, "normalise_amount", "typed", "formed", ["face_amount", "premium"]),
        "SELECT 5, 'drop_duplicates', NULL, (SELECT count(*) FROM formed) - (SELECT count(*) FROM once)",
        _differs(6, "fill_median", "once", "whole", ["face_amount", "premium"]), _differs(6, "fill_mean", "once", "whole", ["policy_id", "issue_age", "current_age"]), _differs(6, "fill_mode", "once", "whole", _SPELLED),
        _differs(6, "fill_forward", "once", "whole", ["issue_date"]), _differs(7, "cap", "whole", "held", ["face_amount", "premium"]), _differs(8, "rule", "held", "ruled", ["face_amount", "premium", "issue_age", "current_age"]),
    ]), **_WHOLE),
)
def cleaning_actions(spark, d):
    """Cells that each step of the cleaning changed, by column."""
    return _clean_landed(spark, d).actions


_FIELDS = ("policy_id", *_SPELLED, "face_amount", "premium", "issue_age", "current_age", "issue_date")
_score_sql = lambda stage, view, date: f"""SELECT '{stage}' AS stage, count(*) AS rows, ({' + '.join(f'count({date if c == "issue_date" else c})' for c in _FIELDS)}) / (count(*) * {len(_FIELDS)}) AS completeness,
  {' * '.join(f'(1 - count(*) FILTER ({c} < 0) / count(*))' for c in ('face_amount', 'premium', 'issue_age', 'current_age'))} AS consistency FROM {view}"""


@query(
    "C1 A20",
    duck("messy", f"SELECT *, (0.7 * completeness + 0.3 * consistency) * 100 AS quality_score FROM ({_score_sql('before', 'landed', 'issue_key')} UNION ALL {_score_sql('after', 'ruled', 'issue_date')})", **_WHOLE),
    r6="completeness consistency quality_score",
)
def cleaning_quality(spark, d):
    """Quality of the landed and of the cleaned table, counted in the cleaning's own passes."""
    return _clean_landed(spark, d).quality


# Five landed files with the faults that schemas are checked for.
_KIND_SQL = {
    "treaty": "SELECT treaty_id, CASE WHEN treaty_id % 10 > 0 THEN CAST(premium AS VARCHAR) END AS premium, CAST(0.6 AS DOUBLE) AS loss_ratio, CASE WHEN treaty_id % 4 = 0 THEN 0.3 END AS cession_rate, CASE WHEN treaty_id % 10 = 0 THEN limit_amount END AS aggregate_limit, CASE WHEN treaty_id % 4 = 0 THEN business_line END AS reinsurer FROM treaties",
    "claims": "SELECT policy_id AS claim_id, treaty_id, CAST(units AS BIGINT) AS gross_claim_amount, CASE WHEN claim_number % 4 = 1 THEN recovery END AS reinsurance_recovery FROM claims",
    "portfolio": "SELECT exposure_id AS portfolio_id, sum_insured AS total_sum_insured, CAST(risk_count AS DOUBLE) AS number_of_risks, CASE WHEN exposure_id % 10 < 7 THEN line END AS territory FROM exposures",
    "catastrophe": "SELECT event_type, ts AS occurrence_date, CASE WHEN event_id % 10 < 3 THEN value END AS industry_loss, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS modeled_loss FROM events",
    "development": "SELECT policy_id AS claim_id, loss_date AS valuation_date, CAST(claim_amount AS DECIMAL(18, 2)) AS incurred_amount, CASE WHEN policy_id % 10 < 8 THEN recovery END AS paid_amount FROM claims",
}


def _kind_files(spark, d):
    t, c, x, e = cn.treaties(spark, d), cn.claims(spark, d), cn.exposures(spark, d), cn.table(spark, d, "events")
    some = lambda test, value: F.when(F.expr(test), value)
    return {
        "treaty": t.select("treaty_id", some("treaty_id % 10 > 0", F.col("premium").cast("string")).alias("premium"), F.lit(0.6).alias("loss_ratio"), some("treaty_id % 4 = 0", F.lit(0.3)).alias("cession_rate"),
                           some("treaty_id % 10 = 0", F.col("limit_amount")).alias("aggregate_limit"), some("treaty_id % 4 = 0", F.col("business_line")).alias("reinsurer")),
        "claims": c.select(F.col("policy_id").alias("claim_id"), "treaty_id", F.col("units").cast("long").alias("gross_claim_amount"), some("claim_number % 4 = 1", F.col("recovery")).alias("reinsurance_recovery")),
        "portfolio": x.select(F.col("exposure_id").alias("portfolio_id"), F.col("sum_insured").alias("total_sum_insured"), F.col("risk_count").cast("double").alias("number_of_risks"), some("exposure_id % 10 < 7", F.col("line")).alias("territory")),
        "catastrophe": e.select("event_type", F.col("ts").alias("occurrence_date"), some("event_id % 10 < 3", F.col("value")).alias("industry_loss"), F.col("value").cast("decimal(18,2)").cast("string").alias("modeled_loss")),
        "development": c.select(F.col("policy_id").alias("claim_id"), F.col("loss_date").alias("valuation_date"), F.col("claim_amount").cast("decimal(18,2)").alias("incurred_amount"), some("policy_id % 10 < 8", F.col("recovery")).alias("paid_amount")),
    }


# The type of each declared column as SQL sees it, and its place in the lattice.
_family_sql = lambda t: f"CASE WHEN {t} IN ('BIGINT', 'INTEGER') THEN 'Int' WHEN {t} IN ('DOUBLE', 'FLOAT') THEN 'Float' WHEN {t} LIKE 'DECIMAL%' THEN 'Decimal' WHEN {t} = 'VARCHAR' THEN 'String' ELSE {t} END"


def _findings_sql():
    columns = {
        "treaty": ["treaty_id", "premium", "loss_ratio", "cession_rate", "aggregate_limit", "reinsurer"], "claims": ["claim_id", "treaty_id", "gross_claim_amount", "reinsurance_recovery"],
        "portfolio": ["portfolio_id", "total_sum_insured", "number_of_risks", "territory"], "catastrophe": ["event_type", "occurrence_date", "industry_loss", "modeled_loss"],
        "development": ["claim_id", "valuation_date", "incurred_amount", "paid_amount"],
    }
    missing = " UNION ALL ".join(f"SELECT '{k}' AS file_kind, '{c}' AS column_name, '{'sparse' if c in sc.FILE_KINDS[k].sparse else 'usual'}' AS band, count(*) - count({c}) AS affected_rows, (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM f_{k}" for k, cs in columns.items() for c in cs)
    typed = " UNION ALL ".join(f"SELECT '{k}' AS file_kind, '{c}' AS column_name, '{t}' AS declared, {_family_sql(f'any_value(typeof({c}))')} AS actual FROM f_{k}" for k, cs in columns.items() for c, t in sc.FILE_KINDS[k].types.items() if c in cs)
    absent = " UNION ALL ".join(f"SELECT '{k}', 'required', 'CRITICAL', '{c}', {repr(sc.FILE_KINDS[k].types[c]) if c in sc.FILE_KINDS[k].types else 'NULL'}, NULL, 0, NULL" for k, cs in columns.items() for c in sc.FILE_KINDS[k].required if c not in cs)
    return f"""SELECT file_kind, 'missing' AS "check", CASE WHEN band = 'sparse' THEN 'WARNING' WHEN missing_pct > 50 THEN 'CRITICAL' ELSE 'WARNING' END AS level, column_name, NULL AS declared, NULL AS actual, affected_rows, missing_pct
      FROM ({missing}) WHERE missing_pct > CASE band WHEN 'sparse' THEN 80 ELSE 20 END
      UNION ALL SELECT file_kind, 'type', CASE WHEN actual IN ('Int', 'Float') AND declared IN ('Float', 'Decimal') THEN 'INFO' ELSE 'WARNING' END, column_name, declared, actual, 0, NULL FROM ({typed}) WHERE declared <> actual
      UNION ALL {absent}"""


@query("V5", duck("treaties claims exposures", _findings_sql(), **{f"f_{k}": q for k, q in _KIND_SQL.items()}), r6="missing_pct")
def typed_schema_findings(spark, d):
    """The five files are landed as Parquet and checked as they are read back."""
    found = [sc.schema_findings(cut_lineage(df, f"landed-{kind}"), kind) for kind, df in _kind_files(spark, d).items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
