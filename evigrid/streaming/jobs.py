"""Job events as streams: state by job, stale jobs, month and window counts, seen keys."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIVE = ("pending", "running")
STATE = "status string, n bigint, updated bigint"
OUT = "job_id bigint, status string, n bigint"


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over Parquet files of events; zone-less times become UTC ones, as watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def month_counts(events: DataFrame, late: str = "31 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        status, n, _ = state.get
        state.remove()
        if status in ACTIVE:  # nothing came for too long
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "n": [n]})
        return
    status, n, updated = state.get if state.exists else ("pending", 0, 0)
    for frame in frames:
        for at, s in sorted(zip(frame["at"], frame["status"])):
            n += 1
            updated = max(updated, at)
            if status != "cancelled":
                status = s
    state.update((status, n, updated))
    state.setTimeoutTimestamp(int(updated) + 600_000 if updated else 600_000)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n": [n]})


def job_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """job_id, status, n after each batch: a cancelled job stays so; one without news for ten minutes of
    event time fails. Needs job_id, status and ts."""
    keyed = events.withWatermark("ts", late).select("job_id", "status", F.unix_millis("ts").alias("at"), "ts")
    return keyed.groupBy("job_id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def final_states(events: DataFrame) -> DataFrame:
    """The same as a batch: the last status by time, cancelled once it occurred."""
    last = F.max_by("status", F.struct("ts", "status"))
    cancelled = F.bool_or(F.col("status") == "cancelled")
    return events.groupBy("job_id").agg(F.when(cancelled, "cancelled").otherwise(last).alias("status"), F.count(F.lit(1)).alias("n"))
