"""Scans of landed files, databases and stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
DELIMITERS = [",", ";", "|", "\t"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", all_text: bool = False) -> DataFrame:
    """CSV that keeps bad rows: with a schema, their text lands in ``_corrupt_record``."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("sep", sep)
    if schema is not None:
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return reader.option("columnNameOfCorruptRecord", CORRUPT).schema(full).csv(path)
    return reader.option("inferSchema", not all_text).csv(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected raw lines)."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields, at any depth, as top-level columns named parent_child."""

    def leaves(schema: T.StructType, at: str, name: str):
        for f in schema.fields:
            path, label = f"{at}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path + ".", label + sep)
            else:
                yield F.col(path).alias(label)

    return df.select(*leaves(df.schema, "", ""))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """A JSON array or object per file (or one object per line), flattened."""
    reader = spark.read.option("multiLine", multi_line)
    return flatten((reader.schema(schema) if schema else reader).json(path))


def find_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """Per file of ``path``: file_path and delimiter, the first of ``, ; | TAB`` that stands in more than half of all its lines (else a comma)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path")).where("trim(value) <> ''")
    split = [F.count_if(F.col("value").contains(d)) * 2 > F.count(F.lit(1)) for d in DELIMITERS]
    first = F.coalesce(*[F.when(ok, F.lit(d)) for ok, d in zip(split, DELIMITERS)], F.lit(","))
    return lines.groupBy("file_path").agg(first.alias("delimiter"))


def read_any_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files, each read with its own separator; columns missing in some files are NULL there.

    The driver gets the files' names, one list per separator, as it does for any scan.
    """
    found = find_delimiters(spark, path).groupBy("delimiter").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("delimiter").collect()
    parts = [read_csv(spark, r.files, sep=r.delimiter) for r in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else read_csv(spark, path, sep=",")


def read_fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int, int, str]], skip: int = 0) -> DataFrame:
    """Fixed-width text; ``layout`` lists (name, first position from 1, length, type). ``skip`` drops header lines."""
    rows = number_rows(spark, path).where(F.col("row_idx") >= skip).where("trim(line) <> ''")
    return rows.select(*[F.trim(F.substring("line", at, n)).try_cast(t).alias(name) for name, at, n, t in layout])


def number_rows(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as (file_id, row_idx, line) with indexes that follow the file from 0 without gaps.

    Lines are numbered inside their file split; the splits' line counts, one row per
    split, give each its starting index. No global sort and no single task per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"),
    )
    splits = lines.groupBy("file_id", "_at").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(starts, ["file_id", "_at"]).select(
        "file_id", (F.col("_start") + F.col("_m") - F.col("_first")).alias("row_idx"), "line"
    )


def read_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text as an ordered raw sheet: (file_id, row_idx, line, cells)."""
    pattern = "\\" + sep if sep == "|" else sep
    return number_rows(spark, path).withColumn("cells", F.split("line", pattern))


def read_jdbc(
    spark: SparkSession, url: str, table: str | None = None, query: str | None = None, limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None, **options: str,
) -> DataFrame:
    """Database table or query. ``partition`` is (column, lower, upper, tasks); a limit is pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition and not query:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    df = reader.load()
    return df.limit(limit) if limit else df


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def probe(df: DataFrame) -> DataFrame:
    """One row per column with its type and the table's row count."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    cols = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for f in df.schema.fields]))
    return n.select("n", cols.alias("c")).select("c.*", F.col("n").alias("rows"))


def read_submission(spark: SparkSession, path: str, submission_id: str) -> DataFrame:
    """Rows of one submission; the table is partitioned by it, so other folders are not read."""
    return spark.read.parquet(path).where(F.col("submission_id") == submission_id)


def newest_first(df: DataFrame, time: str) -> DataFrame:
    return df.orderBy(F.desc(time))


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """A folder as a stream of file batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)
