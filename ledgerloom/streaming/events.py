"""Event-time jobs over the event log. Each has a batch twin: the same function takes a static DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.readers import read_chunks

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)
DELAY = "1 hour"
#: Events that a history holds.
HISTORY = 10_000
#: Times go through JSON with all their digits.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100, glob: str = "events*.parquet") -> DataFrame:
    raw = read_chunks(spark, folder, EVENT_SCHEMA, glob=glob, files_per_trigger=files_per_trigger)
    return raw.select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("correlation_id"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def history(events: DataFrame, types: list[str], since: str) -> DataFrame:
    """Events of the given types after ``since``."""
    return events.withWatermark("ts", DELAY).where(F.col("event_type").isin(types) & (F.col("ts") >= F.lit(since).cast("timestamp")))


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per day and type."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", DELAY).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(
        F.col("window.start").alias("window_start"), "event_type", "events", "value"
    )


def rolling_sessions(events: DataFrame) -> DataFrame:
    """Statistics of the last 24 hours, every hour.

    Hours are summed first, so an event is one update of one state row; the 24 windows that an hour is in
    then take the hour's sums. Both steps keep state until the watermark passes a window's end. Values are summed
    as decimals of nine places, so a mean does not depend on the order of events.
    """
    sums = {"value": F.sum(F.col("value").cast("decimal(28,9)")), "values": F.count("value"), "k": F.sum("k"), "ks": F.count("k")}
    hours = events.withWatermark("ts", DELAY).groupBy(F.window("ts", "1 hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"), *[c.alias(n) for n, c in sums.items()]
    )
    w = F.window(F.window_time("hour"), "24 hours", "1 hour")
    return hours.groupBy(w).agg(
        F.sum("events").alias("sessions"), (F.sum("value").cast("double") / F.sum("values")).alias("average_value"), (F.sum("k") / F.sum("ks")).alias("average_risk"),
        F.max("newest").alias("latest"),
    ).select(F.col("window.end").alias("window_end"), "sessions", "average_value", "average_risk", "latest")


def freshness(rolled: DataFrame) -> DataFrame:
    """100 less 2 per hour of age of the newest event at the window's end, not below 0."""
    hours = (F.unix_timestamp("window_end") - F.unix_timestamp("latest")) / 3600
    return rolled.withColumn("freshness", F.greatest(F.lit(0.0), 100 - 2 * hours))


def chains(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of one correlation id with no pause longer than ``gap``."""
    # Sessions of one busy id are merged in each task before the shuffle.
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", DELAY).groupBy("correlation_id", w).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(
        "correlation_id", F.col("session_window.start").alias("started"), "events", "value"
    )


def unique_events(events: DataFrame) -> DataFrame:
    """First copy of each event; the watermark bounds what is remembered."""
    marked = events.withWatermark("ts", DELAY)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is there, then read the sink back. Output and progress live in the shared folder."""
    spark = stream.sparkSession
    out, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, str], None], mode: str = "append") -> str:
    """foreachBatch to a folder; ``handle`` writes each batch below a path named by its number, so a replay overwrites itself."""
    spark = stream.sparkSession
    out, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    q = (
        stream.writeStream.foreachBatch(lambda df, n: handle(df, f"{out}/batch={n}"))
        .option("checkpointLocation", progress).outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out


def with_lateness(events: DataFrame, delay: str = DELAY, buckets: int = 64) -> DataFrame:
    """``events`` with watermark (as it runs) and late: whether the row is older than what the stream had settled when it came.

    Other stateful operators drop such rows unseen. Rows are dealt by a hash of the event, so a busy id is spread over
    tasks, and stream through in Arrow batches; a bucket's state is its number of rows and late rows so far.
    A null time is never late. The first batch has no watermark and no late rows.
    """
    columns = events.columns
    marked = events.withWatermark("ts", delay).select("ts", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"), F.unix_millis("ts").alias("at"), F.to_json(F.struct(*columns), JSON).alias("row"))
    schema = "row string, watermark long, late boolean, bucket_rows long, bucket_late long"

    def mark(key, frames, state):
        edge = state.getCurrentWatermarkMs()
        rows, late_rows = state.get if state.exists else (0, 0)
        for f in frames:
            late = f["at"] < edge
            rows, late_rows = rows + len(f), late_rows + int(late.sum())
            yield f[["row"]].assign(watermark=edge, late=late, bucket_rows=rows, bucket_late=late_rows)
        state.update((rows, late_rows))

    judged = marked.groupBy("bucket").applyInPandasWithState(mark, schema, "rows long, late long", "append", "NoTimeout")
    return judged.select(F.from_json("row", events.schema, JSON).alias("e"), F.timestamp_millis("watermark").alias("watermark"), "late").select("e.*", "watermark", "late")


def split_late(batch: DataFrame, path: str) -> None:
    """On-time and late rows of a batch of ``with_lateness``, in two tables."""
    batch.write.mode("overwrite").partitionBy("late").parquet(path)


def newest_events(events: DataFrame, keep: int = HISTORY, buckets: int = 16) -> DataFrame:
    """A history of ``keep`` events: what each bucket of events holds of it whenever it changes, at most its own ``keep`` newest.

    The state of a bucket is a list, newest first by (ts, event_id); older rows than the last of a full list leave it.
    ``history`` of any moment is made of the buckets' lists by ``merged_history``. Null times count as the oldest.
    """
    rows = events.select(
        F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int").alias("bucket"), F.coalesce(F.unix_micros("ts"), F.lit(-(2**63))).alias("at"),
        F.coalesce("event_id", F.lit(-(2**63))).alias("id"), F.to_json(F.struct(*events.columns), JSON).alias("row"),
    )
    names = ["at", "id", "row"]

    def evict(key, frames, state):
        import pandas as pd

        held = pd.DataFrame(dict(zip(names, map(list, state.get))) if state.exists else {n: [] for n in names})
        for f in frames:
            both = pd.concat([held, f[names]]) if len(held) else f[names]
            held = both.sort_values(["at", "id"], ascending=False, kind="stable").head(keep)
        state.update(tuple(held[n].tolist() for n in names))
        yield held.assign(bucket=key[0])

    lists = rows.groupBy("bucket").applyInPandasWithState(evict, "at long, id long, row string, bucket int", "at array<long>, id array<long>, row array<string>", "update", "NoTimeout")
    return lists.select("bucket", "at", "id", F.from_json("row", events.schema, JSON).alias("event"))


def write_history(batch: DataFrame, path: str) -> None:
    """The lists of the buckets that a batch changed."""
    batch.write.mode("overwrite").parquet(path)


def merged_history(spark: SparkSession, path: str, keep: int = HISTORY) -> DataFrame:
    """The ``keep`` newest events over all buckets, from each bucket's last list. Reads at most ``keep`` rows per bucket beyond the batch numbers."""
    lists = spark.read.parquet(path)
    last = lists.groupBy("bucket").agg(F.max("batch").alias("batch"))  # one row per bucket
    return lists.join(F.broadcast(last), ["bucket", "batch"]).orderBy(F.desc("at"), F.desc("id")).limit(keep).select("event.*")


def validation_counters(batch: DataFrame, path: str) -> None:
    """Checks of one micro-batch as audit rows: rows, missing and out-of-range values per event type."""
    batch.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") < 0).alias("negative"),
        F.count_if(F.col("k").isNull()).alias("no_payload"),
    ).write.mode("overwrite").parquet(path)
