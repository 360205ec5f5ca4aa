"""Index jobs as a stream: admission, duplicates, states and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cron import next_run
from ..functions.paths import normalize_path
from ..shipping import ship_package

QUEUE = 10_000
WORKERS = 2


def request_stream(spark: SparkSession, folder: str, per_batch: int = QUEUE) -> DataFrame:
    """Requests from files of JSON, at most so many files per micro-batch; the source holds the rest back."""
    schema = "job_id string, path string, requested_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def without_active(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with the job that stands for them: an active one of the same normalised path, else the first request's own."""
    p = normalize_path(F.col("path"))
    active = jobs.filter(F.col("state").isin("Queued", "Processing")).groupBy(p.alias("norm")).agg(F.min("job_id").alias("active_id"))
    r = requests.withColumn("norm", p)
    first = F.first("job_id").over(Window.partitionBy("norm").orderBy("requested_at", "job_id"))
    return r.join(active, "norm", "left").withColumn("run_by", F.coalesce("active_id", first)).drop("norm", "active_id")


def dedupe_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first request per normalised path within the delay."""
    return requests.withColumn("norm", normalize_path(F.col("path"))).withWatermark("requested_at", delay).dropDuplicatesWithinWatermark(["norm"]).drop("norm")


def admitted(requests: DataFrame, queued: int, capacity: int = QUEUE) -> DataFrame:
    """Requests with `accepted`: folders always wait for a place, single contents are refused where the queue is full."""
    first = requests.orderBy("requested_at", "job_id").limit(max(0, capacity - queued)).select(F.col("job_id").alias("first_id")).distinct()
    near = requests.join(F.broadcast(first), F.col("job_id") == F.col("first_id"), "left")  # no more than the queue's capacity
    return near.withColumn("accepted", (F.col("kind") == "folder") | F.col("first_id").isNotNull()).drop("first_id")


def final_state(files: DataFrame) -> DataFrame:
    """(job_id, state, processed, failed): a job ends as completed though files fail, unless it was cancelled or found none that worked."""
    df = files.groupBy("job_id").agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.bool_or("cancelled").alias("c"))
    state = F.when(F.col("c"), "Cancelled").when((F.col("processed") == 0) & (F.col("failed") > 0), "Failed").otherwise("Completed")
    return df.select("job_id", state.alias("state"), "processed", "failed")


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules (name, next_run, every_minutes) whose time has come, with their next run after now."""
    late = F.unix_timestamp(now) - F.unix_timestamp("next_run")
    step = F.col("every_minutes") * 60
    after = F.timestamp_seconds(F.unix_timestamp("next_run") + (F.floor(late / step) + 1) * step)
    return schedules.filter(F.col("next_run") <= now).withColumn("then", after)


def due_rules(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules (name, rule, since) whose cron rule named a time after `since` and up to now, with that time and the next one after now."""
    ship_package(schedules.sparkSession)
    df = schedules.withColumns({"next_run": next_run(F.col("rule"), F.col("since")), "then": next_run(F.col("rule"), now)})
    return df.filter(F.col("next_run") <= now)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by event type in tumbling or sliding windows, for streams with late rows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
