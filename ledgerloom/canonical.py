"""Insurance views over the supplied star schema.

Each view is a projection of as few tables as its columns need, so a job that
does not use ``state`` never joins orders to customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.skew import skew_join

ASOF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan that has fewer splits than the cluster has cores.

    A file with one row group is one task, however costly the work on its rows.
    A scan that already has enough splits is left alone, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(index: Column, values: list) -> Column:
    """The ``index``-th of a few literal values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


PRODUCTS = {
    "1-URGENT": "Term",
    "2-HIGH": "Whole Life",
    "3-MEDIUM": "Universal Life",
    "4-NOT SPECIFIED": "Variable",
    "5-LOW": "Group Life",
}
CLASSES = ["Preferred Plus", "Preferred", "Standard Plus", "Standard", "Substandard"]
TREATY_TYPES = ["quota_share", "surplus_share", "excess_of_loss", "stop_loss"]
LINES = ["individual_life_term", "individual_life_universal", "individual_life_whole", "group_life", "annuities"]


def policies(spark: SparkSession, sf_dir: str, asof: str = ASOF, with_state: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    product = F.lit(None).cast("string")
    for code, name in PRODUCTS.items():
        product = F.when(F.col("o_orderpriority") == code, name).otherwise(product)
    status = F.when(F.col("o_orderstatus") == "O", "Inforce").when(F.col("o_orderstatus") == "F", "Lapsed")
    days = F.datediff(F.lit(asof).cast("date"), F.col("issue_date"))
    p = o.select(
        key.alias("policy_id"),
        cust.alias("customer_id"),
        F.concat(F.lit("SUB-"), F.lpad((cust % 20).cast("string"), 2, "0")).alias("submission_id"),
        F.col("o_orderdate").cast("date").alias("issue_date"),
        F.col("o_totalprice").alias("face_amount"),
        (F.col("o_totalprice") * (F.lit(0.005) + F.lit(0.001) * (key % 20))).alias("annual_premium"),
        (F.lit(18) + cust % 63).cast("int").alias("issue_age"),
        F.when(cust % 2 == 0, "M").otherwise("F").alias("gender"),
        F.when(cust % 7 == 0, "Smoker").otherwise("Nonsmoker").alias("smoker_status"),
        product.alias("product_type"),
        status.otherwise("Surrendered").alias("policy_status"),
        pick(key % 5, CLASSES).alias("underwriting_class"),
        ((F.col("o_orderstatus") == "F") & (key % 10 == 0)).cast("int").alias("death_indicator"),
    ).withColumn("duration_years", days / F.lit(365.25).cast("double"))
    p = p.withColumn("policy_duration", (F.floor("duration_years") + 1).cast("int")).withColumn(
        "attained_age", (F.col("issue_age") + F.floor("duration_years")).cast("int")
    )
    if not with_state:
        return p
    home = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("state"))
    )
    return skew_join(p, home, "customer_id", "inner")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("policy_id"),
        F.col("l_suppkey").alias("treaty_id"),
        F.col("l_linenumber").alias("claim_number"),
        price.alias("claim_amount"),
        F.col("l_shipdate").cast("date").alias("loss_date"),
        (price * F.col("l_discount")).alias("recovery"),
        F.col("l_returnflag").alias("cause"),
        F.col("l_linestatus").alias("claim_status"),
        F.col("l_quantity").alias("units"),
    )


def treaties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    retention = (F.lit(10000) + F.lit(2000) * (k % 10)).cast("double")
    return table(spark, sf_dir, "supplier").select(
        k.alias("treaty_id"),
        F.col("s_name").alias("treaty_name"),
        F.col("s_nationkey").alias("cedent_id"),
        pick(k % 4, TREATY_TYPES).alias("treaty_type"),
        pick(k % 5, LINES).alias("business_line"),
        F.col("s_acctbal").alias("premium"),
        retention.alias("retention"),
        (retention * 3).alias("limit_amount"),
        (F.lit(0.1) + F.lit(0.05) * (k % 10)).alias("retention_rate"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 28).cast("int")).alias("inception_date"),
    )


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    treaty_count = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    return table(spark, sf_dir, "part").select(
        k.alias("exposure_id"),
        (k % treaty_count).alias("treaty_id"),
        F.col("p_type").alias("line"),
        F.col("p_retailprice").alias("sum_insured"),
        F.col("p_size").alias("risk_count"),
    )


def cedent_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premium, incurred and counts by cedent and loss year.

    Money is summed in decimals, so a sum doesn't depend on the order of its rows. Claims are summed by treaty and year first, so only those sums meet the treaties.
    """
    by_treaty = (
        claims(spark, sf_dir)
        .groupBy("treaty_id", F.year("loss_date").alias("year"))
        .agg(
            F.sum(F.col("claim_amount").cast("decimal(18,2)")).alias("p"),
            F.sum(F.col("recovery").cast("decimal(18,4)")).alias("r"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("units").cast("decimal(18,2)")).alias("u"),
        )
    )
    premium, incurred = F.sum("p").cast("double"), F.sum("r").cast("double") * 12
    return (
        by_treaty.join(treaties(spark, sf_dir).select("treaty_id", "cedent_id"), "treaty_id")
        .groupBy("cedent_id", "year")
        .agg(
            premium.alias("premium_volume"),
            incurred.alias("incurred_claims"),
            F.sum("n").alias("policy_count"),
            (F.sum("u").cast("double") * 10000).alias("face_amount_inforce"),
        )
        .withColumn("loss_ratio", F.col("incurred_claims") / F.col("premium_volume"))
        .withColumn("ae_ratio", F.col("loss_ratio") / F.lit(0.62))
    )


def economy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day and series: (series, date, value). Days times series, so small at any scale."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"))
        .agg(F.avg("value").alias("value"))
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("correlation_id"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rows of every document: (file_id, row_idx, line, cells). The row index comes from the source."""
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
        .select(
            "file_id",
            F.col("row_idx").cast("long").alias("row_idx"),
            "line",
            F.split("line", " ").alias("cells"),
        )
    )


def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as whole sheets: (file_id, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")


def labelled_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets with known junk put in: after every seventh row a blank one, a total or a page footer (``labelled``)."""
    rows, i = sheets(spark, sf_dir), F.col("row_idx")
    before = F.floor((i + 3) / 7).cast("long")  # rows put in above this one
    kind = F.floor(i / 7) % 3
    junk = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("Total: "), i.cast("string"))).otherwise("End of report - page footer")
    own = F.struct((i + before).alias("row_idx"), F.col("line"), F.col("cells"), F.lit(False).alias("labelled"))
    put = F.struct((i + before + 1).alias("row_idx"), junk.alias("line"), F.split(junk, " ").alias("cells"), F.lit(True).alias("labelled"))
    both = F.when(i % 7 == 3, F.array(own, put)).otherwise(F.array(own))
    return rows.select("file_id", F.explode(both).alias("r")).select("file_id", "r.*")


def messy_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies as a careless source would send them: gaps, spellings, text dates, bad amounts and repeated keys."""
    o = table(spark, sf_dir, "orders")
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    age = F.when(k % 31 == 0, 130).when(k % 37 == 0, -1).otherwise(18 + c % 63).cast("int")
    issue = F.when(k % 43 == 0, F.add_months(day, 1200)).otherwise(day)
    text = (
        F.when(k % 6 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 6 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(k % 6 == 2, F.date_format(day, "dd-MMM-yyyy")).when(k % 6 == 3, F.date_format(day, "yyyyMMdd"))
        .when(k % 6 == 4, F.datediff(day, F.to_date(F.lit("1899-12-30"))).cast("string")).otherwise("n/a")
    )
    return o.select(
        k.alias("row_idx"),
        F.when((k % 50 == 0) & (k > 0), k - 1).otherwise(k).alias("policy_id"),
        F.concat(F.lit("POL"), F.lpad(F.when((k % 50 == 0) & (k > 0), k - 1).otherwise(k).cast("string"), 7, "0")).alias("policy_number"),
        F.concat(F.lit("SUB-"), F.lpad((c % 20).cast("string"), 2, "0")).alias("submission_id"),
        pick(k % 9, ["M", "male", "F", "Female", "f", "m", " M", "X", None]).alias("gender"),
        pick(k % 7, ["Smoker", "s", "NON-SMOKER", "N", "nonsmoker", "Y", None]).alias("smoker_status"),
        pick(k % 8, ["Inforce", "active", "IF", "lapsed", "Terminated", "S", "C", "Pending"]).alias("policy_status"),
        pick(k % 6, ["Term", "TL", "Whole Life", "UL", "VL", "401(k)"]).alias("product_type"),
        pick(k % 6, ["Preferred Plus", "P", "SP", "Standard", "Rated", "D"]).alias("underwriting_class"),
        F.when(k % 17 == 0, None).when(k % 23 == 0, -price).otherwise(price).alias("face_amount"),
        F.when(k % 19 == 0, None).when(k % 29 == 0, price * 0.5).otherwise(price * 0.01).alias("premium"),
        age.alias("issue_age"),
        F.when(k % 41 == 0, age - 3).otherwise(age + (k % 20).cast("int")).cast("int").alias("current_age"),
        issue.alias("issue_date"),
        text.alias("issue_text"),
        F.when(k % 47 == 0, F.date_sub(issue, 30)).otherwise(F.date_add(issue, (k % 5000).cast("int"))).alias("maturity_date"),
        pick(k % 7, ["US$", "usd", "Euro", "€", "British Pound", "¥", "JPN"]).alias("currency"),
        pick(k % 4, ["Property", "Casualty", "Marine", "Aviation"]).alias("business_line"),
        pick(k % 3, ["quota_share", "surplus", "excess_of_loss"]).alias("treaty_type"),
        F.when(k % 11 == 0, None).when(k % 53 == 0, 6.0).otherwise(F.lit(0.3) + (k % 100) * 0.01).alias("loss_ratio"),
        (F.lit(0.1) + (k % 60) * 0.01).alias("commission"),
        (price * 0.05 + (k % 13) * 100).alias("limit_amount"),
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with the personal, health, income and annuity fields that feature jobs read."""
    p = policies(spark, sf_dir)
    k, c = F.col("policy_id"), F.col("customer_id")
    return p.withColumns(
        {
            "height_inches": (F.lit(60) + k % 17).cast("int"),
            "weight_pounds": (F.lit(110) + k % 150).cast("int"),
            "marital_status": pick(c % 4, ["Married", "Single", "Divorced", "Widowed"]),
            "health_rating": F.col("underwriting_class"),
            "history_diabetes": k % 11 == 0,
            "history_heart_disease": k % 13 == 0,
            "history_hypertension": k % 3 == 0,
            "history_asthma": k % 8 == 0,
            "annual_income": (F.lit(20000) + (c % 300) * 1000).cast("double"),
            "net_worth": ((k % 700) * 3000 - 50000).cast("double"),
            "payment_mode": pick(k % 4, ["Annual", "Monthly", "Quarterly", "Semi-Annual"]),
            "premium_frequency": pick(k % 4, [1, 12, 4, 2]),
            "medical_exam": F.when(k % 3 == 0, "No").otherwise("Yes"),
            "agent_id": F.when(k % 4 != 0, k % 100),
            "state_code": pick(c % 10, ["CA", "NY", "TX", "FL", "OH", "WA", "GA", "CO", "PA", "AL"]),
            "zip_code": F.lpad((k % 100000).cast("string"), 5, "0"),
            "birth_date": F.add_months("issue_date", -12 * F.col("issue_age")),
            "premium_amount": F.col("face_amount"),
            "investment_option": pick(k % 3, ["Conservative", "Moderate", "Aggressive"]),
            "guaranteed_rate": F.lit(0.011) + (k % 4) * 0.005,
            "payout_option": pick(k % 4, ["Life Only", "10 Year Certain", "Joint Life", "Period Certain 20"]),
            "monthly_payment": F.col("face_amount") * 0.005,
            "surrender_value": F.col("face_amount") * (F.lit(0.82) + (k % 5) * 0.04),
            "contract_date": F.col("issue_date"),
            "condition_diabetes": (k % 11 == 0).cast("int"),
            "condition_heart": (k % 13 == 0).cast("int"),
            "condition_other": (k % 3 == 0).cast("int"),
            "credit_score": (F.lit(600) + k % 200).cast("int"),
            "payment_history": F.lit(0.85) + (k % 4) * 0.05,
        }
    )
