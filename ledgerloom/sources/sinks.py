"""Writers: cleaned data, keyed upserts, logs, reports and the file manifest."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_scratch
from .readers import latest_per


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list, partition: str = "submission_id") -> None:
    """Insert or replace rows by key; only partitions that receive rows or held an incoming key are read and rewritten.

    A row that moves leaves its old partition; one that has no rows left is deleted.
    """
    rows, gone = new, None
    if table_exists(spark, path):
        old = spark.read.parquet(path)
        touched = new.select(partition)
        if partition not in keys:
            touched = touched.union(old.join(new.select(keys).distinct(), keys, "left_semi").select(partition))
        touched = cut_lineage(touched.distinct(), "upsert-touched")
        rows = old.join(touched, partition, "left_semi").unionByName(new, allowMissingColumns=True)
    # The result is staged: the target must not be overwritten while it is still being read.
    staged = cut_lineage(latest_per(rows, keys, order), "upsert")
    if rows is not new:
        empty = touched.join(staged.select(partition).distinct(), partition, "left_anti")
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        gone = [unquote(r.folder) for r in old.select(partition, folder.alias("folder")).join(empty, partition, "left_semi").select("folder").distinct().collect()]
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    drop_scratch(spark, gone or [])  # at most one folder per touched partition


def store_policies(spark: SparkSession, path: str, checked: DataFrame, keys: list[str]) -> DataFrame:
    """Store rows with an empty ``failed`` list; returns stored and skipped counts per submission."""
    good = checked.where(F.size("failed") == 0).drop("failed")
    upsert(spark, path, good, keys, [F.desc("row_idx")])
    return checked.groupBy("submission_id").agg(
        F.count_if(F.size("failed") == 0).alias("stored"), F.count_if(F.size("failed") > 0).alias("skipped")
    )


def append_audit(entries: DataFrame, path: str) -> None:
    """Append (submission_id, action, user_name, details as JSON)."""
    payload = [c for c in entries.columns if c not in ("submission_id", "action", "user_name", "logged_at")]
    kept = [c for c in ("submission_id", "action", "user_name", "logged_at") if c in entries.columns]
    entries.select(*kept, F.to_json(F.struct(*payload)).alias("details")).write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def melt_results(priced: DataFrame, key: str, columns: list[str], section: str) -> DataFrame:
    """Result columns as (key, section, item, value) rows for export."""
    return priced.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "item", "value").withColumn(
        "section", F.lit(section)
    )


def append_manifest(entries: DataFrame, path: str) -> None:
    """Add the files of one load to the stored manifest."""
    entries.write.mode("append").parquet(path)


def file_manifest(df: DataFrame, name: str, landed: str | None = None) -> DataFrame:
    """One row per input file: rows, columns and completeness.

    ``landed`` names the file that ``df`` was landed as: a folder of part files is then one file, with a row also when it is empty.
    """
    data = [c for c in df.columns]
    filled = sum((F.col(c).isNotNull().cast("int") for c in data), F.lit(0))
    measures = [F.count(F.lit(1)).alias("rows"), F.lit(len(data)).alias("columns"), (F.avg(filled) / len(data)).alias("score")]
    if landed is not None:
        found = df.agg(*measures).withColumn("_file", F.lit(landed))
    else:
        found = df.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).groupBy("_file").agg(*measures)
    return found.select(F.col("_file").alias("file_name"), F.lit(name).alias("data_type"), "rows", "columns", "score")
