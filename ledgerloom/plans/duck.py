"""The same insurance views in SQL, for the side-by-side check."""

from __future__ import annotations

VIEWS = {
    "policies": """SELECT *, CAST(floor(duration_years) + 1 AS INT) AS policy_duration,
        CAST(issue_age + floor(duration_years) AS INT) AS attained_age FROM (
        SELECT o_orderkey AS policy_id, o_custkey AS customer_id,
        'SUB-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS submission_id,
        CAST(o_orderdate AS DATE) AS issue_date, o_totalprice AS face_amount,
        o_totalprice * (0.005::DOUBLE + 0.001::DOUBLE * (o_orderkey % 20)) AS annual_premium,
        CAST(18 + o_custkey % 63 AS INT) AS issue_age,
        CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
        CASE WHEN o_custkey % 7 = 0 THEN 'Smoker' ELSE 'Nonsmoker' END AS smoker_status,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Term' WHEN '2-HIGH' THEN 'Whole Life'
          WHEN '3-MEDIUM' THEN 'Universal Life' WHEN '4-NOT SPECIFIED' THEN 'Variable'
          WHEN '5-LOW' THEN 'Group Life' END AS product_type,
        CASE o_orderstatus WHEN 'O' THEN 'Inforce' WHEN 'F' THEN 'Lapsed' ELSE 'Surrendered' END AS policy_status,
        (['Preferred Plus','Preferred','Standard Plus','Standard','Substandard'])[o_orderkey % 5 + 1] AS underwriting_class,
        CAST(o_orderstatus = 'F' AND o_orderkey % 10 = 0 AS INT) AS death_indicator,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365.25::DOUBLE AS duration_years
        FROM orders)""",
    "policies_state": """SELECT p.*, n_name AS state FROM policies p JOIN customer ON customer_id = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "claims": """SELECT l_orderkey AS policy_id, l_suppkey AS treaty_id, l_linenumber AS claim_number,
        l_extendedprice AS claim_amount, CAST(l_shipdate AS DATE) AS loss_date,
        l_extendedprice * l_discount AS recovery, l_returnflag AS cause, l_linestatus AS claim_status,
        l_quantity AS units FROM lineitem""",
    "treaties": """SELECT s_suppkey AS treaty_id, s_name AS treaty_name, s_nationkey AS cedent_id,
        (['quota_share','surplus_share','excess_of_loss','stop_loss'])[s_suppkey % 4 + 1] AS treaty_type,
        (['individual_life_term','individual_life_universal','individual_life_whole','group_life','annuities'])[s_suppkey % 5 + 1] AS business_line,
        s_acctbal AS premium, CAST(10000 + 2000 * (s_suppkey % 10) AS DOUBLE) AS retention,
        CAST(10000 + 2000 * (s_suppkey % 10) AS DOUBLE) * 3 AS limit_amount,
        0.1::DOUBLE + 0.05::DOUBLE * (s_suppkey % 10) AS retention_rate,
        DATE '1995-01-01' + CAST(s_suppkey % 28 AS INT) AS inception_date FROM supplier""",
    "exposures": """SELECT p_partkey AS exposure_id, p_partkey % (SELECT count(*) FROM supplier) AS treaty_id,
        p_type AS line, p_retailprice AS sum_insured, p_size AS risk_count FROM part""",
    "cedent_years": """SELECT *, incurred_claims / premium_volume AS loss_ratio,
        incurred_claims / premium_volume / 0.62::DOUBLE AS ae_ratio FROM (
        SELECT cedent_id, year(loss_date) AS year, CAST(sum(CAST(claim_amount AS DECIMAL(18,2))) AS DOUBLE) AS premium_volume,
        CAST(sum(CAST(recovery AS DECIMAL(18,4))) AS DOUBLE) * 12 AS incurred_claims,
        count(*) AS policy_count, CAST(sum(CAST(units AS DECIMAL(18,2))) AS DOUBLE) * 10000 AS face_amount_inforce
        FROM claims JOIN treaties USING (treaty_id) GROUP BY ALL)""",
    "economy": """SELECT event_type AS series, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL""",
    "event_log": """SELECT event_id, event_type, ts, user_id AS correlation_id, value,
        CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "sheets": """SELECT doc_id AS file_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS row_idx,
        unnest(string_split(text, chr(10))) AS line, string_split(unnest(string_split(text, chr(10))), ' ') AS cells FROM documents""",
}
VIEWS["messy"] = """SELECT o_orderkey AS row_idx, CASE WHEN k % 50 = 0 AND k > 0 THEN k - 1 ELSE k END AS policy_id,
  'POL' || lpad(CAST(CASE WHEN k % 50 = 0 AND k > 0 THEN k - 1 ELSE k END AS VARCHAR), 7, '0') AS policy_number, 'SUB-' || lpad(CAST(c % 20 AS VARCHAR), 2, '0') AS submission_id,
  (['M','male','F','Female','f','m',' M','X',NULL])[k % 9 + 1] AS gender, (['Smoker','s','NON-SMOKER','N','nonsmoker','Y',NULL])[k % 7 + 1] AS smoker_status,
  (['Inforce','active','IF','lapsed','Terminated','S','C','Pending'])[k % 8 + 1] AS policy_status, (['Term','TL','Whole Life','UL','VL','401(k)'])[k % 6 + 1] AS product_type,
  (['Preferred Plus','P','SP','Standard','Rated','D'])[k % 6 + 1] AS underwriting_class, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 23 = 0 THEN -price ELSE price END AS face_amount,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 29 = 0 THEN price * 0.5::DOUBLE ELSE price * 0.01::DOUBLE END AS premium, age AS issue_age,
  CAST(CASE WHEN k % 41 = 0 THEN age - 3 ELSE age + k % 20 END AS INT) AS current_age, issue AS issue_date,
  CASE k % 6 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%d/%m/%Y') WHEN 2 THEN strftime(day, '%d-%b-%Y') WHEN 3 THEN strftime(day, '%Y%m%d')
    WHEN 4 THEN CAST(date_diff('day', DATE '1899-12-30', day) AS VARCHAR) ELSE 'n/a' END AS issue_text, day,
  CASE WHEN k % 47 = 0 THEN issue - 30 ELSE issue + CAST(k % 5000 AS INT) END AS maturity_date, (['US$','usd','Euro','€','British Pound','¥','JPN'])[k % 7 + 1] AS currency,
  (['Property','Casualty','Marine','Aviation'])[k % 4 + 1] AS business_line, (['quota_share','surplus','excess_of_loss'])[k % 3 + 1] AS treaty_type,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 53 = 0 THEN 6.0::DOUBLE ELSE 0.3::DOUBLE + (k % 100) * 0.01::DOUBLE END AS loss_ratio, 0.1::DOUBLE + (k % 60) * 0.01::DOUBLE AS commission,
  price * 0.05::DOUBLE + (k % 13) * 100 AS limit_amount
  FROM (SELECT *, CAST(CASE WHEN k % 31 = 0 THEN 130 WHEN k % 37 = 0 THEN -1 ELSE 18 + c % 63 END AS INT) AS age, CAST(CASE WHEN k % 43 = 0 THEN day + INTERVAL 100 YEAR ELSE day END AS DATE) AS issue
    FROM (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day FROM orders))"""
VIEWS["applicants"] = """SELECT *, CAST(60 + policy_id % 17 AS INT) AS height_inches, CAST(110 + policy_id % 150 AS INT) AS weight_pounds,
  (['Married','Single','Divorced','Widowed'])[customer_id % 4 + 1] AS marital_status, underwriting_class AS health_rating, policy_id % 11 = 0 AS history_diabetes, policy_id % 13 = 0 AS history_heart_disease,
  policy_id % 3 = 0 AS history_hypertension, policy_id % 8 = 0 AS history_asthma, CAST(20000 + (customer_id % 300) * 1000 AS DOUBLE) AS annual_income, CAST((policy_id % 700) * 3000 - 50000 AS DOUBLE) AS net_worth,
  (['Annual','Monthly','Quarterly','Semi-Annual'])[policy_id % 4 + 1] AS payment_mode, ([1,12,4,2])[policy_id % 4 + 1] AS premium_frequency, CASE WHEN policy_id % 3 = 0 THEN 'No' ELSE 'Yes' END AS medical_exam,
  CASE WHEN policy_id % 4 <> 0 THEN policy_id % 100 END AS agent_id, (['CA','NY','TX','FL','OH','WA','GA','CO','PA','AL'])[customer_id % 10 + 1] AS state_code, lpad(CAST(policy_id % 100000 AS VARCHAR), 5, '0') AS zip_code,
  CAST(issue_date - to_years(issue_age) AS DATE) AS birth_date, 0.011::DOUBLE + (policy_id % 4) * 0.005::DOUBLE AS guaranteed_rate,
  (['Life Only','10 Year Certain','Joint Life','Period Certain 20'])[policy_id % 4 + 1] AS payout_option, face_amount * 0.005::DOUBLE AS monthly_payment, face_amount * (0.82::DOUBLE + (policy_id % 5) * 0.04::DOUBLE) AS surrender_value,
  CAST(600 + policy_id % 200 AS INT) AS credit_score, 0.85::DOUBLE + (policy_id % 4) * 0.05::DOUBLE AS payment_history FROM policies"""

VIEWS["labelled_sheets"] = """SELECT file_id, row_idx + (row_idx + 3) // 7 AS row_idx, line, cells, false AS labelled FROM landed_sheets
  UNION ALL SELECT file_id, row_idx + (row_idx + 3) // 7 + 1, junk, string_split(junk, ' '), true FROM (
    SELECT *, CASE row_idx // 7 % 3 WHEN 0 THEN '' WHEN 1 THEN 'Total: ' || row_idx ELSE 'End of report - page footer' END AS junk FROM landed_sheets WHERE row_idx % 7 = 3)"""

NEEDS = {"applicants": ["policies"], "policies_state": ["policies"], "cedent_years": ["claims", "treaties"]}


def duck(views: str, body: str, **extra: str) -> str:
    """``body`` with the named views, and any further ones given as keywords, in front."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        parts[name] = VIEWS[name]

    for name in views.split():
        need(name)
    parts.update(extra)
    if not parts:
        return body
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + " " + body
