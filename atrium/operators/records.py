"""Versions, jobs, review issues and attachments: latest rows, sequences, retention and checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.functions import scalars
from atrium.operators import numbering
from atrium.scratch import Scratch


def seconds(c: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without time zone."""
    return c.cast("timestamp").cast("double")


def latest_published(versions: DataFrame) -> DataFrame:
    """The newest published version with a bundle of each venue."""
    order = Window.partitionBy("venue_no").orderBy(F.col("seq").desc())
    fine = versions.where("status = 'published' and bundle_hash is not null")
    return fine.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def assign_seq(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Sequence numbers of new versions: after the venue's highest, in order of ``version_id``."""
    top = existing.groupBy("venue_no").agg(F.max("seq").alias("_top"))
    n = F.row_number().over(Window.partitionBy("venue_no").orderBy("version_id"))
    return fresh.join(top, "venue_no", "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + n).drop("_top")


def generation_estimate(versions: DataFrame, latest: int = 20) -> DataFrame:
    """Expected duration in seconds: nearest-rank p75 of a venue's last positive durations, else of all venues'."""

    def p75(rows: DataFrame, keys: list[str]) -> DataFrame:
        newest = Window.partitionBy(*keys).orderBy(F.col("version_id").desc())
        kept = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= latest)
        by_size = Window.partitionBy(*keys).orderBy("duration_ms", "version_id")
        ranked = kept.withColumns({"_r": F.row_number().over(by_size), "_c": F.count("*").over(Window.partitionBy(*keys))})
        return ranked.where(F.col("_r") == F.ceil(F.col("_c") * 0.75)).select(*keys, "duration_ms")

    done = versions.where("status = 'published' and duration_ms > 0")
    own = p75(done, ["venue_no"])
    # the newest rows of all venues: found by a bounded sort, not by one window over everything
    everyone = p75(done.orderBy(F.col("version_id").desc()).limit(latest).withColumn("all", F.lit(1)), ["all"]).select(F.col("duration_ms").alias("global_ms"))
    venues = versions.select("venue_no").distinct()
    found = venues.join(own, "venue_no", "left").join(F.broadcast(everyone), how="left")
    return found.select("venue_no", F.greatest(F.lit(1), F.round(F.coalesce("duration_ms", "global_ms") / 1000)).cast("bigint").alias("seconds"))


def venue_overview(versions: DataFrame) -> DataFrame:
    """Per venue: versions by status, latest published one and whether any has a bundle."""
    counts = versions.groupBy("venue_no").agg(
        F.count("*").alias("versions"), F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.col("bundle_hash").isNotNull()).alias("has_bundle")
    )
    return counts.join(latest_published(versions).select("venue_no", F.col("seq").alias("latest_seq")), "venue_no", "left")


def content_address(blobs: DataFrame, content: str) -> DataFrame:
    """One row for each distinct content: its SHA-256 and how many rows share it."""
    return blobs.withColumn("hash", F.sha2(F.col(content).cast("string"), 256)).groupBy("hash").agg(F.count("*").alias("uses"))


def unreferenced_blobs(blobs: DataFrame, *references: DataFrame) -> DataFrame:
    """Blobs (``hash, bytes``) that none of the reference tables (``hash``) names."""
    used = references[0].select("hash")
    for r in references[1:]:
        used = used.union(r.select("hash"))
    return blobs.join(used.where("hash is not null").distinct(), "hash", "left_anti")


def expired_attachments(attachments: DataFrame, now: Column, staged_hours: int = 24, kept_days: int = 30) -> DataFrame:
    """Attachments to remove: staged over a day, detached or on a deleted comment for over thirty days."""
    age = lambda c: seconds(now) - seconds(F.col(c))
    staged = attachments.where((F.col("state") == "staged") & (age("changed_at") > staged_hours * 3600))
    detached = attachments.where((F.col("state") == "detached") & (age("changed_at") > kept_days * 86400))
    orphaned = attachments.where((F.col("state") == "attached") & (age("comment_deleted_at") > kept_days * 86400))
    return staged.union(detached).union(orphaned).select("attachment_id").distinct()


def attachment_usage(attachments: DataFrame, max_bytes: int = 25 * 1024 * 1024, max_count: int = 10) -> DataFrame:
    """Bytes and number of attachments of each comment, and whether a limit is passed."""
    used = attachments.groupBy("version_id", "comment_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    return used.withColumn("over_limit", (F.col("bytes") > max_bytes) | (F.col("files") > max_count))


def dedupe_requests(mutations: DataFrame) -> DataFrame:
    """Outcome of every mutation: the first use of a request is ``accepted``, a later one with the same hash
    ``replayed``, with another ``conflict``. A request is an author's id; order is (ts, event_id)."""
    order = Window.partitionBy("author", "request_id").orderBy("ts", "event_id")
    first = F.first("request_hash").over(order)
    n = F.row_number().over(order)
    return mutations.withColumn("outcome", F.when(n == 1, "accepted").when(F.col("request_hash") == first, "replayed").otherwise("conflict"))


def revision_numbers(mutations: DataFrame) -> DataFrame:
    """Accepted mutations of each version, numbered from 1 in order of (ts, event_id); a version may have any number of them."""
    return numbering.numbered(mutations.where("outcome = 'accepted'"), ["version_id"], ["ts", "event_id"], "revision")


def judge_versions(rows: DataFrame) -> DataFrame:
    """Compare-and-set of mutations against their comment's row version: ``comment_id, event_id, op, outcome, row_version, deleted``.

    ``rows``: ``comment_id, at, event_id, op, expected, version, gone``; an ``op`` of ``state`` carries what is known from before
    (``version``, 0 if there is no comment, and ``gone``) and comes first. A ``create`` of a comment that exists is ``exists``; any other
    mutation is ``not_found`` without a comment, ``deleted`` on a tombstone, ``stale`` if it expects another version than the
    present one, and else ``accepted``, which adds one. ``delete`` leaves a tombstone: the comment keeps its place and version. Rows of
    a comment stream by in order of (at, event_id); a task holds the present comment's version only.
    """

    def run(batches):
        held, version, gone = object(), 0, False
        for batch in batches:
            outcomes, versions, tombs = [], [], []
            for comment, op, expected, known, tomb in zip(batch.comment_id, batch.op, batch.expected, batch.version, batch.gone):
                if comment != held:
                    held, version, gone = comment, 0, False
                if op == "state":
                    version, gone, outcome = int(known), bool(tomb), "state"
                elif op == "create":
                    outcome = "exists" if version else "accepted"
                    version = version or 1
                elif not version:
                    outcome = "not_found"
                elif gone:
                    outcome = "deleted"
                elif expected != version:
                    outcome = "stale"
                else:
                    outcome, version, gone = "accepted", version + 1, op == "delete"
                outcomes.append(outcome)
                versions.append(version)
                tombs.append(gone)
            yield batch[["comment_id", "event_id", "op"]].assign(outcome=outcomes, row_version=versions, deleted=tombs)

    dealt = rows.repartition("comment_id").sortWithinPartitions("comment_id", F.col("op") != "state", "at", "event_id")
    columns = dealt.select("comment_id", "event_id", "op", F.coalesce("expected", F.lit(-1)).alias("expected"), F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("gone", F.lit(False)).alias("gone"))
    return columns.mapInPandas(run, "comment_id long, event_id long, op string, outcome string, row_version long, deleted boolean")


def unique_slugs(venues: DataFrame) -> DataFrame:
    """``tenant_id, venue_id, slug`` where venues, in order of (created, venue_id), take their name's slug or the first free ``-2``, ``-3`` ...

    ``venues``: ``tenant_id, venue_id, name, created``, whole numbers but for the name. ``b-k`` can be wanted by the rows of slug ``b``
    that find ``b`` taken, and by the first row of slug ``b-k``; whoever comes first has it. So a slug's rows count up, skip
    the numbers that such first rows took before them, and start at 2 where the bare form is gone. Slugs are placed by
    the count of numbers at their end, as a slug needs only those shorter by one number. No slug's rows are held by one task.
    """
    scratch = Scratch(venues.sparkSession, "slugs")
    key, time = ["tenant_id", "base"], F.struct("created", "venue_id")
    named = venues.select("tenant_id", F.col("venue_id").cast("long").alias("venue_id"), F.col("created").cast("long").alias("created"), scalars.slugify(F.col("name")).alias("base"))
    rows = scratch.keep("rows", numbering.numbered(named, key, ["created", "venue_id"], "i"))
    number = "^(.+)-([2-9]|[1-9][0-9]{1,17})$"
    firsts = rows.where("i = 1").select(*key, time.alias("t"))
    rivals = firsts.where(F.col("base").rlike(number)).select("tenant_id", F.col("base").alias("rival"), F.regexp_extract("base", number, 1).alias("base"), F.regexp_extract("base", number, 2).cast("long").alias("k"), "t")
    rivals = rivals.join(firsts.select(*key), key, "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("k")))
    rivals = scratch.keep("rivals", rivals)
    late = rivals.select("tenant_id", F.col("rival").alias("base")).where("false")
    depth = F.size(F.split(F.regexp_extract("base", "((-([2-9]|[1-9][0-9]{1,17}))*)$", 1), "-")) - 1
    out, most = [], rows.agg(F.max(depth)).collect()[0][0] or 0
    none = F.expr("cast(array() as array<bigint>)")
    for level in range(most + 1):
        mine = rows.where(depth == level).join(late.withColumn("late", F.lit(1).cast("long")), key, "left").withColumn("i", F.col("i") + F.coalesce("late", F.lit(0))).drop("late")
        # the row that would take k, after s skips, is the one that counts k - s
        wanted = rivals.select(*key, F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("k") - F.col("r") + 1), F.col("k"))).alias("i")).distinct()
        times = wanted.join(mine.select(*key, "i", time.alias("t")), [*key, "i"]).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("i", "t"))).alias("at"))
        listed = rivals.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("rivals")).join(times, key)
        row_at = lambda s, x: F.try_element_at("at", x["k"] - F.size(s))
        skipped = F.aggregate("rivals", none, lambda s, x: F.when(F.coalesce(x["t"] < row_at(s, x), F.lit(False)), F.concat(s, F.array(x["k"]))).otherwise(s))
        placed = mine.join(listed.select(*key, skipped.alias("skips")), key, "left")
        before = F.filter(F.transform(F.coalesce("skips", none), lambda k, j: k - j), lambda x: x <= F.col("i"))
        placed = scratch.keep(f"placed-{level}", placed.select("tenant_id", "venue_id", "created", "base", (F.col("i") + F.size(before)).alias("n")))
        out.append(placed)
        taken = placed.select("tenant_id", F.concat_ws("-", "base", F.col("n").cast("string")).alias("rival"), time.alias("by")).join(rivals.select("tenant_id", "rival", "t"), ["tenant_id", "rival"])
        late = taken.where("by < t").select("tenant_id", F.col("rival").alias("base"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select("tenant_id", "venue_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))


def lagging_clients(observed: DataFrame, applied: DataFrame) -> DataFrame:
    """Highest observed and applied revision of each client, and whether it lags."""
    a = observed.groupBy("client_id", "version_id").agg(F.max("revision").alias("observed"))
    b = applied.groupBy("client_id", "version_id").agg(F.max("revision").alias("applied"))
    return a.join(b, ["client_id", "version_id"], "left").withColumn("stale", F.coalesce(F.col("applied"), F.lit(0)) < F.col("observed"))


def judge_uploads(hits: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """Outcomes of uploads in order: ``author, at, event_id, accepted, fresh``.

    ``hits``: ``author, at (seconds), event_id, accepted``; rows whose outcome is known keep it and are not ``fresh``. Each author's
    rows stream by in order through one task, which holds the last accepted times only.
    """

    def run(batches):
        author, recent, first = None, [], True
        for batch in batches:
            outcomes, fresh = [], []
            for who, at, known in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if first or who != author:
                    author, recent, first = who, [], False
                recent = [x for x in recent if x > at - window_seconds]
                fine = len(recent) < most if known is None else known
                if fine:
                    recent.append(at)
                outcomes.append(fine)
                fresh.append(known is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(outcomes, pa.bool_()), pa.array(fresh, pa.bool_())], ["author", "at", "event_id", "accepted", "fresh"])

    dealt = hits.select(F.col("author").cast("long").alias("author"), "at", F.col("event_id").cast("long").alias("event_id"), "accepted").where("at is not null")
    ordered = dealt.repartition("author").sortWithinPartitions("author", F.col("accepted").isNull(), "at", "event_id")
    return ordered.mapInArrow(run, "author long, at double, event_id long, accepted boolean, fresh boolean")


def upload_rate_limit(hits: DataFrame, most: int, window_seconds: int) -> DataFrame:
    """Which uploads are accepted: fewer than ``most`` accepted ones in the trailing window of the same author.

    A rejection does not count, so acceptance depends on earlier acceptances. Uploads without a time are left out.
    """
    timed = hits.select("author", seconds(F.col("ts")).alias("at"), "event_id", F.lit(None).cast("boolean").alias("accepted"))
    return judge_uploads(timed, most, window_seconds).select("author", "event_id", "accepted")


def lease_expiries(beats: DataFrame, lease_seconds: int = 60) -> DataFrame:
    """Sessions of heartbeats of each job: a gap of more than the lease interrupts it."""
    order = Window.partitionBy("job_id").orderBy("ts")
    opened = F.when(seconds(F.col("ts")) - seconds(F.lag("ts").over(order)) >= lease_seconds, 1).otherwise(F.when(F.lag("ts").over(order).isNull(), 1).otherwise(0))
    runs = beats.withColumn("_o", opened).withColumn("run", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("job_id", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("last_beat"), F.count("*").alias("beats"))


def live_floor_counts(mutations: DataFrame) -> DataFrame:
    """Issues opened minus deleted for each version and floor, from accepted mutations."""
    sign = F.when(F.col("op") == "create_root", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return mutations.where("outcome = 'accepted'").groupBy("version_id", "floor").agg(F.sum(sign).alias("open_issues"))


def issue_filter(issues: DataFrame, kind: str, user: int) -> DataFrame:
    """Issues of a queue tab: active, assigned to the user, unassigned, or closed (deleted ones are closed)."""
    closed = (F.col("status") == "closed") | F.col("deleted_at").isNotNull()
    tests = {"active": ~closed, "assigned_to_me": ~closed & (F.col("assignee") == user), "unassigned": ~closed & F.col("assignee").isNull(), "closed": closed}
    return issues.where(tests[kind])


def validate_issue_rows(issues: DataFrame) -> DataFrame:
    """Violations of issue rows: body, due date, position and request id; one row for each."""
    body = F.regexp_replace("body", "\\r\\n?", "\n")
    bad_body = F.coalesce((F.char_length(F.trim(F.regexp_replace(body, "\\s+", " "))) == 0) | (F.char_length(body) > 4000) | body.rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f]"), F.lit(True))
    date = F.try_to_timestamp(F.col("due"), F.lit("yyyy-MM-dd")).cast("date")
    bad_due = F.col("due").isNotNull() & ~F.coalesce(F.date_format(date, "yyyy-MM-dd") == F.col("due"), F.lit(False))
    bad_place = ~F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    bad_request = ~F.coalesce(F.lower("request_uuid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))
    codes = F.array(F.when(bad_body, F.lit("body")), F.when(bad_due, F.lit("due_date")), F.when(bad_place, F.lit("position")), F.when(bad_request, F.lit("request_id")))
    return issues.select("issue_id", F.explode(F.array_compact(codes)).alias("code"))


def issue_threads(comments: DataFrame, users: DataFrame, attachments: DataFrame) -> DataFrame:
    """Root comments with author, assignee, ordered replies and numbers of live attachments.

    ``comments``: ``comment_id, root_id (null for a root), author, assignee, created_at``. Replies are in order of
    (created_at, comment_id).
    """
    name = lambda key, out: users.select(F.col("user_id").alias(key), F.col("user_name").alias(out))
    replies = comments.where("root_id is not null").groupBy(F.col("root_id").alias("comment_id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("comment_id").alias("id")))).alias("r"))
    files = attachments.where("state = 'attached'").groupBy("comment_id").agg(F.count("*").alias("files"))
    roots = comments.where("root_id is null").join(name("author", "author_name"), "author", "left").join(name("assignee", "assignee_name"), "assignee", "left")
    rows = roots.join(replies, "comment_id", "left").join(files, "comment_id", "left")
    return rows.select("comment_id", "author_name", "assignee_name", F.coalesce(F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("replies"), F.coalesce("files", F.lit(0)).alias("files"))


def servable_media(attachments: DataFrame, comments: DataFrame, versions: DataFrame) -> DataFrame:
    """Attached files of live comments in published versions that have a bundle."""
    live = comments.where("deleted_at is null").select("comment_id", "version_id")
    published = versions.where("status = 'published' and bundle_hash is not null").select("version_id")
    return attachments.where("state = 'attached'").join(live, "comment_id").join(published, "version_id").select("attachment_id", "comment_id", "version_id")


def anchor_violations(issues: DataFrame, levels: DataFrame, features: DataFrame) -> DataFrame:
    """Issues whose level or feature does not exist, or whose feature lies on another level (one without a level may)."""
    known = levels.select("venue_id", "level_id", F.lit(True).alias("_level"))
    placed = features.select("venue_id", "feature_id", F.col("level_ref").alias("_on"), F.lit(True).alias("_feature"))
    rows = issues.join(known, ["venue_id", "level_id"], "left").join(placed, ["venue_id", "feature_id"], "left")
    reason = (
        F.when(F.col("_level").isNull(), "level_missing")
        .when(F.col("feature_id").isNotNull() & F.col("_feature").isNull(), "feature_missing")
        .when(F.col("_on").isNotNull() & (F.col("_on") != F.col("level_id")), "feature_on_other_level")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("issue_id", "reason")


def package_integrity(members: DataFrame, blobs: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members whose content is not in the store, and packages that no version refers to."""
    lost = members.join(blobs.select("hash").distinct(), "hash", "left_anti").select("package_id", "path", "hash")
    idle = members.select("package_id").distinct().join(references.select("package_id").distinct(), "package_id", "left_anti")
    return lost, idle


def orphans(versions: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Draft versions without a live job, and running jobs whose lease has run out."""
    live = jobs.where(F.col("state").isin("queued", "running")).select("version_id").distinct()
    drafts = versions.where("status = 'draft'").join(live, "version_id", "left_anti").select(F.lit("draft_without_job").alias("code"), F.col("version_id").alias("subject"))
    stale = jobs.where((F.col("state") == "running") & (seconds(F.col("lease_until")) < seconds(now))).select(F.lit("lease_expired").alias("code"), F.col("job_id").alias("subject"))
    return drafts.union(stale)


def recent_evaluation(evaluations: DataFrame, targets: DataFrame) -> DataFrame:
    """Newest evaluation of each package, and whether the current target has another version or bundle."""
    order = Window.partitionBy("package_id").orderBy(F.col("evaluated_at").desc(), F.col("evaluation_id").desc())
    newest = evaluations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    current = targets.select("venue_no", F.col("version_id").alias("_version"), F.col("bundle_hash").alias("_bundle"))
    rows = newest.join(current, "venue_no", "left")
    same = (F.col("version_id") == F.col("_version")) & (F.col("bundle_hash") == F.col("_bundle"))
    return rows.select("package_id", "evaluation_id", (~F.coalesce(same, F.lit(False))).alias("stale"))


def _resolved(path: Column, target: Column) -> tuple[Column, Column]:
    """A reference's path inside its package, and what is wrong with the reference."""
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    clean = F.regexp_replace(F.regexp_replace(F.concat(folder, target), "(^|/)(\\./)+", "$1"), "//+", "/")
    # a parent takes away the folder before it; those that find none stay in front
    step = lambda done, part: F.when((part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    clean = F.array_join(F.aggregate(F.split(clean, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    wrong = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "external_reference")
        .when(target.rlike("^[/\\\\]"), "absolute_reference")
        .when(clean.rlike("^\\.\\./|/\\.\\.(/|$)|^\\.\\.$"), "escaping_reference")
    )
    return clean, wrong


def tile_member_closure(members: DataFrame, refs: DataFrame, roots: DataFrame, max_depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """Members of each package that its root reaches over references, with their depth, and the refusals.

    ``members``: ``package_id, path``; ``refs``: ``package_id, path, target`` (relative to the member's folder); ``roots``:
    ``package_id, path``. Refusals are rows ``package_id, code, subject``: a package without root or with several, references that are
    external, absolute or leave the package, that name no member, tilesets (``.json``) that are referred to more than once or
    are the root, other members than ``.glb``, and members only deeper than ``max_depth``. Each round joins the last round's
    new members to the references, so rounds are bounded by the depth.
    """
    from atrium.scratch import Scratch

    scratch = Scratch(members.sparkSession, "closure")
    clean, wrong = _resolved(F.col("path"), F.col("target"))
    links = scratch.keep("links", refs.select("package_id", "path", F.when(wrong.isNull(), clean).otherwise(F.col("target")).alias("target"), wrong.alias("wrong")).distinct())
    found = roots.join(members, ["package_id", "path"], "left_semi").select("package_id", "path").distinct()
    seen = scratch.keep("depth-0", found.withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 2):
        step = seen.where(F.col("depth") == depth - 1).join(links.where("wrong is null"), ["package_id", "path"]).select("package_id", F.col("target").alias("path")).distinct()
        fresh = step.join(members, ["package_id", "path"], "left_semi").join(seen, ["package_id", "path"], "left_anti").withColumn("depth", F.lit(depth))
        following = scratch.keep(f"depth-{depth}", seen.unionByName(fresh))
        scratch.drop(f"depth-{depth - 1}")
        seen = following
        if not seen.where(F.col("depth") == depth).limit(1).count():
            break
    inside = seen.where(F.col("depth") <= max_depth)
    used = links.join(inside.select("package_id", "path"), ["package_id", "path"], "left_semi")
    row = lambda frame, code, subject: frame.select("package_id", F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.col(subject).alias("subject"))
    known = members.select("package_id", F.col("path").alias("target"))
    counted = members.select("package_id").distinct().join(found.groupBy("package_id").agg(F.count("*").alias("n"), F.min("path").alias("root")), "package_id", "left")
    fine = used.where("wrong is null")
    twice = fine.where("target like '%.json'").groupBy("package_id", "target").agg(F.count("*").alias("n"))
    twice = twice.join(found.select("package_id", F.col("path").alias("target"), F.lit(1).alias("_root")), ["package_id", "target"], "left").where("n > 1 or _root = 1")
    refused = (
        row(counted.where("n is null").withColumn("subject", F.lit("")), "missing_root", "subject")
        .union(row(counted.where("n > 1"), "several_roots", "root"))
        .union(row(used.where("wrong is not null"), F.col("wrong"), "target"))
        .union(row(fine.join(known, ["package_id", "target"], "left_anti").select("package_id", "target").distinct(), "unresolved_reference", "target"))
        .union(row(fine.where("target not like '%.json' and target not like '%.glb'").select("package_id", "target").distinct(), "foreign_content", "target"))
        .union(row(twice, "tileset_cycle", "target"))
        .union(row(seen.where(F.col("depth") > max_depth), "too_deep", "path"))
    )
    return inside, refused
