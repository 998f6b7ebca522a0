"""Structured streams over issue mutations. In-order input gives the same rows as the batch operators.

Event time and watermarks are this library's own. What a micro-batch writes goes to folders named by its number,
so a batch that is repeated after a failure replaces its rows. A row behind the watermark goes to a side table of
late rows where an operator has a watermark; it is never dropped in silence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from atrium.operators import records
from atrium.scratch import Scratch


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files at a path, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    # as a pattern the path may name a single file as well as a folder
    pattern = path[:-1] + f"[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def _collected(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Everything that batches wrote under a folder; an empty table where none did."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/b-none")
    return spark.read.schema(schema).parquet(f"{folder}/b-*")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote, with the number of the batch as ``_batch``."""
    scratch = Scratch(stream.sparkSession, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(scratch.path(f"out/b-{number:09d}"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return _collected(stream.sparkSession, scratch.path("out"), StructType([*stream.schema, *StructType.fromDDL("_batch int")]))


def _last_batch(spark: SparkSession, folder: str) -> int | None:
    """The highest number of the batches that were written whole under a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    done = [x.getPath().getName() for x in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return max((int(n[2:]) for n in done if n[2:].isdigit()), default=None)


def fold_to_end(stream: DataFrame, name: str, step: Callable[[DataFrame, DataFrame], dict[str, DataFrame]], kinds: dict[str, str], state: str, at: str | None = None) -> dict[str, DataFrame]:
    """Run a stream whose batches read the state that the batch before left, and return its tables.

    ``step(batch, state)`` gives the tables of ``kinds`` (name: schema), of which ``state`` replaces the one before. Batches are sorted
    and joined by Spark, so no key's rows are held by one Python process. With a folder ``at`` a later call goes on after the
    last batch that an earlier one finished there; its tables hold the rows of all batches. The state is written last, and a batch that is
    repeated replaces its rows.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, f"stream-{name}")
    if at is not None:
        scratch.root = at.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        before = scratch.path(f"{state}/b-{number - 1:09d}")
        old = spark.read.schema(kinds[state]).parquet(before) if number else spark.createDataFrame([], kinds[state])
        for key, frame in sorted(step(batch, old).items(), key=lambda x: x[0] == state):
            frame.write.mode("overwrite").parquet(scratch.path(f"{key}/b-{number:09d}"))

    stream.writeStream.option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = {key: _collected(spark, scratch.path(key), StructType.fromDDL(kind)) for key, kind in kinds.items() if key != state}
    last = _last_batch(spark, scratch.path(state))
    out[state] = spark.createDataFrame([], kinds[state]) if last is None else spark.read.schema(kinds[state]).parquet(scratch.path(f"{state}/b-{last:09d}"))
    return out


def dedupe_requests(mutations: DataFrame) -> DataFrame:
    """Outcome of each mutation as it arrives: ``event_id, outcome``; the first hash of every request is kept as state.

    A batch adds the requests that it is the first to name, in a folder of its number, and reads those of the batches before: the
    state is never written again, and Spark sorts and joins the requests.
    """
    spark = mutations.sparkSession
    scratch = Scratch(spark, "stream-dedupe")
    key = ["author", "request_id"]
    kind = StructType([*mutations.select(*key).schema, *StructType.fromDDL("known string")])
    inside = Window.partitionBy(*key).orderBy("ts", "event_id")

    def write(batch: DataFrame, number: int) -> None:
        first = scratch.path(f"first/b-{number:09d}")
        before = [scratch.path(f"first/b-{n:09d}") for n in range(number)]
        old = (spark.read.schema(kind).parquet(*before) if before else spark.createDataFrame([], kind)).alias("old")
        rows = batch.withColumns({"_n": F.row_number().over(inside), "_hash": F.first("request_hash").over(inside)}).alias("new")
        same = F.col("new.author").eqNullSafe(F.col("old.author")) & F.col("new.request_id").eqNullSafe(F.col("old.request_id"))
        seen = rows.join(old.withColumn("_seen", F.lit(True)), same, "left").select("new.*", "known", F.col("_seen").isNotNull().alias("_seen"))
        judged = seen.withColumn("outcome", F.when(~F.col("_seen") & (F.col("_n") == 1), "accepted").when(F.col("request_hash") == F.when(F.col("_seen"), F.col("known")).otherwise(F.col("_hash")), "replayed").otherwise("conflict"))
        judged.where("outcome = 'accepted'").select(*key, F.col("request_hash").alias("known")).write.mode("overwrite").parquet(first)
        judged.select("event_id", "outcome").write.mode("overwrite").parquet(scratch.path(f"out/b-{number:09d}"))

    rows = mutations.select(*key, "request_hash", "ts", "event_id")
    rows.writeStream.option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return _collected(spark, scratch.path("out"), StructType.fromDDL("event_id long, outcome string"))


def revision_feed(mutations: DataFrame) -> DataFrame:
    """Revision of each accepted mutation of its version: ``version_id, event_id, revision``; the last number of each is the state."""
    order = Window.partitionBy("version_id").orderBy("ts", "event_id")

    def step(batch: DataFrame, last: DataFrame) -> dict[str, DataFrame]:
        numbered = batch.join(last, "version_id", "left").withColumn("revision", F.row_number().over(order) + F.coalesce("last", F.lit(0)))
        counts = batch.groupBy("version_id").agg(F.count("*").alias("n"))
        state = last.join(counts, "version_id", "full_outer").select("version_id", (F.coalesce("last", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("last"))
        return {"out": numbered.select("version_id", "event_id", "revision"), "state": state}

    kinds = {"out": "version_id long, event_id long, revision long", "state": "version_id long, last long"}
    return fold_to_end(mutations.select("version_id", "ts", "event_id"), "revisions", step, kinds, "state")["out"]


def upload_rate_limit(hits: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """Accept an upload if its author has fewer than ``most`` accepted ones in the trailing window; rejections do not count.

    The state is each author's accepted uploads that the next batch's first one can still see, at most ``most``.
    """

    def step(batch: DataFrame, recent: DataFrame) -> dict[str, DataFrame]:
        timed = batch.select("author", records.seconds(F.col("ts")).alias("at"), "event_id", F.lit(None).cast("boolean").alias("accepted"))
        # accepted uploads of the batches before come first and keep their outcome
        judged = records.judge_uploads(timed.unionByName(recent), most, window_seconds)
        last = Window.partitionBy("author").orderBy(F.col("at").desc(), F.col("event_id").desc())
        state = judged.where("accepted").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).select("author", "at", "event_id", "accepted")
        return {"out": judged.where("fresh").select("author", "event_id", "accepted"), "state": state}

    kinds = {"out": "author long, event_id long, accepted boolean", "state": "author long, at double, event_id long, accepted boolean"}
    return fold_to_end(hits.select("author", "event_id", "ts"), "rate", step, kinds, "state")["out"]


def lease_monitor(beats: DataFrame, lease_seconds: int, lateness_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heartbeat sessions of each job (a gap of the lease or more ends one): closed ones, those still open, and late beats.

    The watermark is the newest beat of the batches before less the lateness. A session is closed once the watermark is a lease past its last
    beat; until then it is state. A beat behind the watermark changes nothing any more and goes to the late ones.
    """
    order = Window.partitionBy("job_id").orderBy("started", "last_beat")

    def step(batch: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
        mark = state.agg(F.max("newest").alias("_mark"))
        timed = batch.select("job_id", F.col("ts").cast("timestamp").alias("ts")).join(F.broadcast(mark))  # one row
        late = F.coalesce(records.seconds(F.col("ts")) < records.seconds(F.col("_mark")) - lateness_seconds, F.lit(False))
        fresh = timed.where(~late).select("job_id", F.col("ts").alias("started"), F.col("ts").alias("last_beat"), F.lit(1).cast("bigint").alias("beats"), F.col("ts").alias("newest"))
        rows = state.unionByName(fresh)
        reached = F.max("last_beat").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = F.when(reached.isNull() | (records.seconds(F.col("started")) - records.seconds(reached) >= lease_seconds), 1).otherwise(0)
        runs = rows.where("job_id is not null").withColumn("_o", opened).withColumn("_run", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        sessions = runs.groupBy("job_id", "_run").agg(F.min("started").alias("started"), F.max("last_beat").alias("last_beat"), F.sum("beats").alias("beats"))
        now = rows.agg(F.max("newest").alias("newest"))
        dated = sessions.join(F.broadcast(now))  # one row
        over = records.seconds(F.col("last_beat")) + lease_seconds <= records.seconds(F.col("newest")) - lateness_seconds
        columns = ["job_id", "started", "last_beat", "beats"]
        # the clock stays in the state even if no session does
        clock = now.select(F.lit(None).cast("long").alias("job_id"), F.lit(None).cast("timestamp").alias("started"), F.lit(None).cast("timestamp").alias("last_beat"), F.lit(0).cast("bigint").alias("beats"), "newest")
        return {"closed": dated.where(over).select(columns), "open": dated.where(~over).select(*columns, "newest").unionByName(clock), "late": timed.where(late).select("job_id", "ts")}

    sessions = "job_id long, started timestamp, last_beat timestamp, beats long"
    kinds = {"closed": sessions, "open": f"{sessions}, newest timestamp", "late": "job_id long, ts timestamp"}
    found = fold_to_end(beats.select("job_id", "ts"), "leases", step, kinds, "open")
    return found["closed"], found["open"].where("job_id is not null").drop("newest"), found["late"]


def live_floor_counts(mutations: DataFrame) -> DataFrame:
    """Running issue balance of each version and floor, in update mode."""
    sign = F.when(F.col("op") == "create_root", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return mutations.groupBy("version_id", "floor").agg(F.sum(sign).alias("open_issues"))


def latest_update(rows: DataFrame, *keys: str) -> DataFrame:
    """The last update-mode row of each key."""
    last = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *[c for c in rows.columns if c not in (*keys, "_batch")])).alias("r"))
    return last.select(*keys, "r.*").drop("_batch")


def lagging_clients(observed: DataFrame) -> DataFrame:
    """Highest observed and applied revision of each client as updates arrive (``client_id, version_id, revision, applied``)."""
    best = observed.groupBy("client_id", "version_id").agg(F.max("revision").alias("observed"), F.max(F.when(F.col("applied"), F.col("revision"))).alias("applied"))
    return best.withColumn("stale", F.coalesce(F.col("applied"), F.lit(0)) < F.col("observed"))


def retention_sweep(attachments: DataFrame, staged_hours: int, kept_days: int) -> DataFrame:
    """Attachments that have expired by the newest event time seen, batch by batch.

    The state is the attachments that have not expired yet, so a batch reads those and not all that came before; the clock is
    the newest ``changed_at`` so far.
    """

    def step(batch: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
        rows = state.unionByName(batch.withColumn("newest", F.col("changed_at")))
        clock = rows.agg(F.max("newest").alias("_now"))
        dated = rows.join(F.broadcast(clock))  # one row
        gone = records.expired_attachments(dated.where("attachment_id is not null"), F.col("_now"), staged_hours, kept_days).distinct()
        left = dated.where("attachment_id is not null").join(gone, "attachment_id", "left_anti").withColumn("newest", F.col("_now")).select(*rows.columns)
        only_clock = clock.select(*[F.col("_now").alias("newest") if f.name == "newest" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        return {"expired": gone, "pending": left.unionByName(only_clock)}

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in attachments.schema)
    newest = attachments.schema["changed_at"].dataType.simpleString()
    kinds = {"expired": f"attachment_id {attachments.schema['attachment_id'].dataType.simpleString()}", "pending": f"{kind}, newest {newest}"}
    return fold_to_end(attachments, "retention", step, kinds, "pending")["expired"].distinct()


def version_checks(mutations: DataFrame, at: str | None = None) -> dict[str, DataFrame]:
    """Compare-and-set of mutations in a stream (see ``records.judge_versions``): ``out`` and the comments as they are, ``state``.

    ``mutations``: ``comment_id, version_id, at, event_id, op, expected``. ``out`` has each one's outcome and the comment's row version after it;
    ``state`` holds every comment, tombstones too, so a thread keeps its place. Batches follow one another in time. With ``at`` the
    stream resumes.
    """

    def step(batch: DataFrame, old: DataFrame) -> dict[str, DataFrame]:
        none = lambda kind: F.lit(None).cast(kind)
        known = old.select("comment_id", none("double").alias("at"), none("long").alias("event_id"), F.lit("state").alias("op"), none("long").alias("expected"), F.col("row_version").alias("version"), F.col("deleted").alias("gone"))
        fresh = batch.select("comment_id", "at", "event_id", "op", F.col("expected").cast("long").alias("expected"), F.lit(0).cast("long").alias("version"), F.lit(False).alias("gone"))
        judged = records.judge_versions(known.unionByName(fresh))
        state = judged.groupBy("comment_id").agg(F.max("row_version").alias("row_version"), F.bool_or("deleted").alias("deleted")).where("row_version > 0")
        return {"out": judged.where("outcome <> 'state'").select("event_id", "comment_id", "outcome", "row_version", "deleted"), "state": state}

    kinds = {"out": "event_id long, comment_id long, outcome string, row_version long, deleted boolean", "state": "comment_id long, row_version long, deleted boolean"}
    return fold_to_end(mutations, "row-versions", step, kinds, "state", at)
