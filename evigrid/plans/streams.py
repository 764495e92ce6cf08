"""Job events, as a stream run to its end and as batches."""
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import scratch, table
from ..streaming import jobs


def drained(spark, stream, name: str, mode: str):
    """All that a stream gives until its input is used up, written batch by batch to the shared folder.
    In complete mode the last batch is the result; else the batches together are."""
    path = scratch(spark, name)

    def keep(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={batch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out if mode == "complete" else out.drop("batch")


def event_source(spark, d):
    """Files named events.parquet of the folder, as a stream."""
    schema = table(spark, d, "events").schema
    return jobs.event_stream(spark, f"{d}/event[s].parquet", schema)


@query("""select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2""")
def daily_events_streamed(spark, d):
    """Windowed counts of a stream; all windows are taken at the end."""
    s = jobs.month_counts(event_source(spark, d))
    t = drained(spark, s, "daily_events_streamed", "complete")
    return t.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""with j as (select user_id as job_id, ts, event_id, case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'click' then 'running' when 'view' then 'running' else 'cancelled' end as status from events) select job_id, case when bool_or(status = 'cancelled') then 'cancelled' else arg_max(status, (ts, status)) end as status, count(*) as n from j group by 1""")
def job_final_states(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("click", "view"), "running").otherwise("cancelled")
    return jobs.final_states(table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", kind.alias("status")))


@query("""select distinct user_id from events""")
def first_seen_streamed(spark, d):
    s = jobs.first_seen(event_source(spark, d), "user_id", "3650 days")
    return drained(spark, s.select("user_id"), "first_seen_streamed", "append")
