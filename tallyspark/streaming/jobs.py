"""Progress events of jobs, pages and reviews as they come: over tables or as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long a job is kept after its last event.
EXPIRY = "1 hour"


def latest_state(events: DataFrame) -> DataFrame:
    """One row for each job: how many events, first and last time, and its last stage. Works on a stream too, in update or complete mode."""
    last = F.struct("ts", "event_id")
    return events.groupBy(F.col("user_id").alias("job")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("updated"), F.max_by("event_type", last).alias("stage"))


def job_states(events: DataFrame, done: Column, failed: Column) -> DataFrame:
    """As ``latest_state``, with done (its last event ends it) and error (the text of its last failed event, if that ended it)."""
    last = F.struct("ts", "event_id")
    g = events.groupBy(F.col("user_id").alias("job")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("updated"), F.max_by("event_type", last).alias("stage"),
        F.max_by(done | failed, last).alias("done"), F.max_by(F.when(failed, F.col("props")), last).alias("error"),
    )
    return g


def kept_jobs(states: DataFrame, now: Column) -> DataFrame:
    """The states that have not expired at ``now``."""
    return states.where(F.col("updated") >= now - F.expr(f"INTERVAL {EXPIRY}"))


def expired_jobs(stream: DataFrame, done: Column, failed: Column) -> DataFrame:
    """The last ``job_states`` of each job of a stream, in append mode, once an hour of event time has passed without an event; its
    state goes with it."""
    timed = stream.withWatermark("ts", "0 seconds")
    last = F.struct("ts", "event_id")
    return timed.groupBy(F.col("user_id").alias("job"), F.session_window("ts", EXPIRY)).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("updated"), F.max_by("event_type", last).alias("stage"),
        F.max_by(done | failed, last).alias("done"), F.max_by(F.when(failed, F.col("props")), last).alias("error"),
    ).drop("session_window")


def ingest_pages(stream: DataFrame, key: list[str]) -> DataFrame:
    """Revisions whose content was seen before are dropped, by a state of keys and content hashes."""
    return stream.withColumn("sha256", F.sha2("text", 256)).dropDuplicates([*key, "sha256"])


def review_stream(stream: DataFrame) -> DataFrame:
    """The latest decision of each figure and how many reviews it has had, in update mode. A review is told by its seq, so that
    one sent twice counts once."""
    once = stream.dropDuplicates(["stem", "key", "seq"])
    latest = F.struct("at", "seq")
    return once.groupBy("stem", "key").agg(F.count(F.lit(1)).alias("n_reviews"), F.max_by("decision", latest).alias("decision"), F.max("at").alias("at"))
