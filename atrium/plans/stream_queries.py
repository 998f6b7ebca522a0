"""Registered streams over the event table, run to the end of what is there, and their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.operators import records
from atrium.plans.fixtures import oracle
from atrium.plans.record_queries import DEDUPED, RATED
from atrium.streaming import feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def mutations(spark, folder):
    rows = feeds.read_stream(spark, f"{folder}/events.parquet")
    op = F.expr("case event_type when 'signup' then 'create_root' when 'click' then 'create_reply' when 'view' then 'patch' when 'purchase' then 'attach' else 'delete' end")
    request = F.concat(F.lit("r"), (F.col("event_id") - F.col("event_id") % 7 * (F.col("event_id") % 2)).cast("string"))
    digest = F.sha2(F.concat("event_type", (F.col("event_id") % 3).cast("string")), 256)
    return rows.select("event_id", (F.col("user_id") % 10).alias("version_id"), F.col("user_id").alias("author"), request.alias("request_id"), op.alias("op"), "ts", digest.alias("request_hash"), "value", "event_type")


@query("stream_dedupe_requests", f"with {DEDUPED} select event_id, outcome from out")
def stream_dedupe_requests(spark, folder):
    return feeds.dedupe_requests(mutations(spark, folder))


@query("stream_revision_feed", "select version_id, event_id, row_number() over (partition by version_id order by ts, event_id) as revision from fx_mutations where op <> 'patch'")
def stream_revision_feed(spark, folder):
    return feeds.revision_feed(mutations(spark, folder).where("op <> 'patch'"))


@query("stream_upload_rate_limit", f"with recursive {RATED} select author, event_id, accepted from r")
def stream_upload_rate_limit(spark, folder):
    return feeds.upload_rate_limit(mutations(spark, folder), 2, 7 * 86400)


@query("stream_floor_counts", "select version_id, author % 4 as floor, cast(sum(case op when 'create_root' then 1 when 'delete' then -1 else 0 end) as bigint) as open_issues from fx_mutations group by 1, 2")
def stream_floor_counts(spark, folder):
    rows = feeds.live_floor_counts(mutations(spark, folder).withColumn("floor", F.col("author") % 4))
    return feeds.latest_update(feeds.run_to_end(rows, "floors", "update"), "version_id", "floor")


@query("stream_lagging_clients", "select author as client_id, version_id, max(event_id) as observed, max(case when event_id % 3 <> 0 then event_id end) as applied, coalesce(max(case when event_id % 3 <> 0 then event_id end), 0) < max(event_id) as stale from fx_mutations group by 1, 2")
def stream_lagging_clients(spark, folder):
    rows = mutations(spark, folder).select(F.col("author").alias("client_id"), "version_id", F.col("event_id").alias("revision"), (F.col("event_id") % 3 != 0).alias("applied"))
    return feeds.latest_update(feeds.run_to_end(feeds.lagging_clients(rows), "clients", "update"), "client_id", "version_id")


@query("stream_retention_sweep", """select event_id as attachment_id from events where case event_id % 3 when 0 then epoch((select max(ts) from events)) - epoch(ts) > 24 * 3600
    when 1 then epoch((select max(ts) from events)) - epoch(ts) > 5 * 86400 else event_id % 5 = 0 and epoch((select max(ts) from events)) - epoch(ts) > 5 * 86400 end""")
def stream_retention_sweep(spark, folder):
    rows = feeds.read_stream(spark, f"{folder}/events.parquet").select(
        F.col("event_id").alias("attachment_id"), F.expr("case event_id % 3 when 0 then 'staged' when 1 then 'detached' else 'attached' end").alias("state"), F.col("ts").alias("changed_at"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("comment_deleted_at")
    )
    return feeds.retention_sweep(rows, 24, 5)


@query("stream_lease_monitor", """with b as (select user_id as job_id, ts, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) < 43200 then 0 else 1 end as o from events),
    r as (select *, sum(o) over (partition by job_id order by ts rows unbounded preceding) as run from b), s as (select job_id, run, min(ts) as started, max(ts) as last_beat, count(*) as beats from r group by 1, 2)
    select job_id, epoch(started) as started, epoch(last_beat) as last_beat, beats, epoch(last_beat) + 43200 > epoch((select max(ts) from events)) - 86400 as open from s""")
def stream_lease_monitor(spark, folder):
    closed, still, _ = feeds.lease_monitor(mutations(spark, folder).select(F.col("author").alias("job_id"), "ts"), 43200, 86400)
    both = closed.withColumn("open", F.lit(False)).unionByName(still.withColumn("open", F.lit(True)))
    return both.select("job_id", records.seconds(F.col("started")).alias("started"), records.seconds(F.col("last_beat")).alias("last_beat"), "beats", "open")
