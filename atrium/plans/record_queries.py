"""Registered queries over search entries, versions, issues and attachments, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import scalars
from atrium.operators import records, search as finder
from atrium.plans.fixtures import fixture, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def entries(spark, folder):
    rows = fixture(spark, folder, "fx_search")
    labels = F.create_map(F.lit("en"), F.col("label_en"), F.lit("ja"), F.col("label_ja"))
    return finder.search_index(rows.select("venue_id", F.col("entry_id").alias("feature_id"), "feature_type", "category", "ordinal", labels.alias("labels"), F.create_map(F.lit("en"), F.col("alt_label")).alias("alt_labels")))


NORM = "trim(regexp_replace(lower(nfc_normalize({})), '\\s+', ' ', 'g'))"


@query("search_index", f"select venue_id, entry_id as feature_id, {NORM.format('label_en')} || '|' || {NORM.format('label_ja')} as labels, {NORM.format('alt_label')} as alt_labels from fx_search")
def search_index(spark, folder):
    return entries(spark, folder).select("venue_id", "feature_id", F.array_join("labels", "|").alias("labels"), F.array_join("alt_labels", "|").alias("alt_labels"))


@query("search", f"""
    with e as (select *, {NORM.format('label_en')} as l1, {NORM.format('label_ja')} as l2, {NORM.format('alt_label')} as a1 from fx_search), q as (select *, {NORM.format('text')} as t from fx_queries),
    j as (select q.query_id, e.entry_id as feature_id, q.t = '' as listed, q.category as wanted, e.l1, e.ordinal = q.level_ordinal as here,
      case when l1 = t or l2 = t then 500 when a1 = t then 450 when starts_with(l1, t) or starts_with(l2, t) then 400 when starts_with(a1, t) then 350 when contains(l1, t) or contains(l2, t) then 300 when contains(a1, t) then 250
           when contains(e.category, t) or contains(e.feature_type, t) then 200 else 0 end as base
      from q join e on e.venue_id = q.venue_id where case q.category when 'shops' then e.feature_type = 'occupant' when 'facilities' then e.feature_type in ('amenity', 'kiosk') else true end),
    s as (select *, case when listed then 0 else base + case when here then 20 else 0 end end as score from j where (listed and wanted <> 'all') or (not listed and base > 0))
    select query_id, rank, feature_id, score from (select *, row_number() over (partition by query_id order by score desc, case when listed and not here then 1 else 0 end, l1, feature_id) as rank from s) where rank <= 50""")
def search(spark, folder):
    return finder.search(entries(spark, folder), fixture(spark, folder, "fx_queries"))


@query("latest_published", "select venue_no, version_id, seq from (select *, row_number() over (partition by venue_no order by seq desc) as n from fx_versions where status = 'published' and bundle_hash is not null) where n = 1")
def latest_published(spark, folder):
    return records.latest_published(fixture(spark, folder, "fx_versions")).select("venue_no", "version_id", "seq")


@query("assign_seq", """with old as (select * from fx_versions where version_id % 5 <> 0), fresh as (select venue_no, version_id from fx_versions where version_id % 5 = 0)
    select f.venue_no, f.version_id, coalesce((select max(seq) from old where old.venue_no = f.venue_no), 0) + row_number() over (partition by f.venue_no order by f.version_id) as seq from fresh f""")
def assign_seq(spark, folder):
    rows = fixture(spark, folder, "fx_versions")
    return records.assign_seq(rows.where("version_id % 5 = 0").select("venue_no", "version_id"), rows.where("version_id % 5 <> 0")).select("venue_no", "version_id", "seq")


@query("generation_estimate", """with done as (select * from fx_versions where status = 'published' and duration_ms > 0 and venue_no % 7 <> 0),
    own as (select *, row_number() over (partition by venue_no order by version_id desc) as n from done), o2 as (select *, row_number() over (partition by venue_no order by duration_ms, version_id) as r, count(*) over (partition by venue_no) as c from own where n <= 20),
    g as (select duration_ms, row_number() over (order by duration_ms, version_id) as r, count(*) over () as c from (select * from done order by version_id desc limit 20))
    select v.venue_no, greatest(1, cast(round(coalesce((select duration_ms from o2 where o2.venue_no = v.venue_no and r = cast(ceil(c * 0.75e0) as bigint)), (select duration_ms from g where r = cast(ceil(c * 0.75e0) as bigint))) / 1000.0e0) as bigint)) as seconds
    from (select distinct venue_no from fx_versions) v""")
def generation_estimate(spark, folder):
    rows = fixture(spark, folder, "fx_versions")
    return records.generation_estimate(rows.withColumn("duration_ms", F.when(F.col("venue_no") % 7 != 0, F.col("duration_ms"))))


@query("venue_overview", """select v.venue_no, count(*) as versions, count(*) filter (where status = 'published') as published, count(*) filter (where status = 'failed') as failed, bool_or(bundle_hash is not null) as has_bundle,
    max(case when status = 'published' and bundle_hash is not null then seq end) as latest_seq from fx_versions v group by 1""")
def venue_overview(spark, folder):
    return records.venue_overview(fixture(spark, folder, "fx_versions"))


@query("content_address", "select sha256(cast(order_key % 50 as varchar)) as hash, count(*) as uses from fx_paths group by 1")
def content_address(spark, folder):
    return records.content_address(fixture(spark, folder, "fx_paths").withColumn("content", F.col("order_key") % 50), "content")


@query("unreferenced_blobs", """select hash, bytes from (select sha256(cast(o_orderkey as varchar)) as hash, o_orderkey as k, cast(floor(o_totalprice) as bigint) as bytes from orders)
    where k % 3 <> 0 and k % 4 <> 0""")
def unreferenced_blobs(spark, folder):
    blobs = fixture(spark, folder, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("bigint").alias("bytes"))
    return records.unreferenced_blobs(blobs.select("hash", "bytes"), blobs.where("k % 3 = 0"), blobs.where("k % 4 = 0"))


def attachments(spark, folder):
    rows = fixture(spark, folder, "events")
    return rows.select(
        F.col("event_id").alias("attachment_id"), (F.col("user_id") % 10).alias("version_id"), (F.col("event_id") % 37).alias("comment_id"), F.floor(F.col("value") * 100000).cast("bigint").alias("bytes"),
        F.expr("case event_id % 3 when 0 then 'staged' when 1 then 'detached' else 'attached' end").alias("state"), F.col("ts").alias("changed_at"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("comment_deleted_at"),
    )


NOW = "(select max(ts) from events)"


@query("expired_attachments", f"""select event_id as attachment_id from events where case event_id % 3 when 0 then epoch({NOW}) - epoch(ts) > 24 * 3600 when 1 then epoch({NOW}) - epoch(ts) > 5 * 86400 else event_id % 5 = 0 and epoch({NOW}) - epoch(ts) > 5 * 86400 end""")
def expired_attachments(spark, folder):
    now = fixture(spark, folder, "events").agg(F.max("ts").alias("_now"))
    rows = attachments(spark, folder).join(F.broadcast(now))
    return records.expired_attachments(rows, F.col("_now"), kept_days=5)


@query("attachment_usage", "select user_id % 10 as version_id, event_id % 37 as comment_id, cast(sum(cast(floor(value * 100000) as bigint)) as bigint) as bytes, count(*) as files, sum(cast(floor(value * 100000) as bigint)) > 20000000 or count(*) > 4 as over_limit from events group by 1, 2")
def attachment_usage(spark, folder):
    return records.attachment_usage(attachments(spark, folder), 20_000_000, 4)


DEDUPED = """out as (select *, case when n = 1 then 'accepted' when request_hash = first_hash then 'replayed' else 'conflict' end as outcome
    from (select *, row_number() over w as n, first(request_hash) over w as first_hash from fx_mutations window w as (partition by author, request_id order by ts, event_id)))"""


def deduped(spark, folder):
    return records.dedupe_requests(fixture(spark, folder, "fx_mutations"))


@query("dedupe_requests", f"with {DEDUPED} select event_id, outcome from out")
def dedupe_requests(spark, folder):
    return deduped(spark, folder).select("event_id", "outcome")


@query("revision_numbers", f"with {DEDUPED} select version_id, event_id, row_number() over (partition by version_id order by ts, event_id) as revision from out where outcome = 'accepted'")
def revision_numbers(spark, folder):
    return records.revision_numbers(deduped(spark, folder)).select("version_id", "event_id", "revision")


@query("lagging_clients", f"""with {DEDUPED}, r as (select author, version_id, event_id, row_number() over (partition by version_id order by ts, event_id) as revision from out where outcome = 'accepted')
    select author as client_id, version_id, max(revision) as observed, max(case when event_id % 3 <> 0 then revision end) as applied, coalesce(max(case when event_id % 3 <> 0 then revision end), 0) < max(revision) as stale from r group by 1, 2""")
def lagging_clients(spark, folder):
    rows = records.revision_numbers(deduped(spark, folder)).withColumnRenamed("author", "client_id")
    return records.lagging_clients(rows, rows.where("event_id % 3 <> 0"))


@query("live_floor_counts", f"with {DEDUPED} select version_id, author % 4 as floor, cast(sum(case op when 'create_root' then 1 when 'delete' then -1 else 0 end) as bigint) as open_issues from out where outcome = 'accepted' group by 1, 2")
def live_floor_counts(spark, folder):
    return records.live_floor_counts(deduped(spark, folder).withColumn("floor", F.col("author") % 4))


#: Each author's events one after the other, with the accepted times that the next one can see.
RATED = """e as (select user_id as author, event_id, epoch(ts) as sec, row_number() over (partition by user_id order by ts, event_id) as n from events),
    r(author, n, event_id, accepted, recent) as (select author, n, event_id, true, [sec] from e where n = 1
      union all select e.author, e.n, e.event_id, len(list_filter(r.recent, lambda x: x > e.sec - 604800)) < 2, case when len(list_filter(r.recent, lambda x: x > e.sec - 604800)) < 2 then list_append(list_filter(r.recent, lambda x: x > e.sec - 604800), e.sec) else list_filter(r.recent, lambda x: x > e.sec - 604800) end
        from r join e on e.author = r.author and e.n = r.n + 1)"""


@query("upload_rate_limit", f"with recursive {RATED} select author, event_id, accepted from r")
def upload_rate_limit(spark, folder):
    rows = fixture(spark, folder, "events").select(F.col("user_id").alias("author"), "ts", "event_id")
    return records.upload_rate_limit(rows, 2, 7 * 86400)


@query("lease_monitor", """with b as (select user_id as job_id, ts, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) < 43200 then 0 else 1 end as o from events),
    r as (select *, sum(o) over (partition by job_id order by ts rows unbounded preceding) as run from b) select job_id, cast(run as bigint) as run, min(ts) as started, max(ts) as last_beat, count(*) as beats from r group by 1, 2""")
def lease_monitor(spark, folder):
    return records.lease_expiries(fixture(spark, folder, "events").select(F.col("user_id").alias("job_id"), F.col("ts")), 43200)


@query("issue_filter", "select event_id as issue_id, 'active' as tab from events where event_id % 4 <> 0 and event_id % 7 <> 0 union all select event_id, 'assigned_to_me' from events where event_id % 4 <> 0 and event_id % 7 <> 0 and user_id % 5 = 3 union all select event_id, 'unassigned' from events where event_id % 4 <> 0 and event_id % 7 <> 0 and user_id % 5 = 0 union all select event_id, 'closed' from events where event_id % 4 = 0 or event_id % 7 = 0")
def issue_filter(spark, folder):
    rows = fixture(spark, folder, "events").select(
        F.col("event_id").alias("issue_id"), F.when(F.col("event_id") % 4 == 0, "closed").otherwise("open").alias("status"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("deleted_at"), F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 5).alias("assignee")
    )
    out = None
    for tab in ("active", "assigned_to_me", "unassigned", "closed"):
        part = records.issue_filter(rows, tab, 3).select("issue_id", F.lit(tab).alias("tab"))
        out = part if out is None else out.union(part)
    return out


@query("validate_issue_rows", """
    select doc_id as issue_id, 'body' as code from documents where doc_id % 11 = 0 or (doc_id % 11 <> 1 and length(text) > 4000)
    union all select doc_id, 'due_date' from documents where doc_id % 5 in (0, 1)
    union all select doc_id, 'position' from documents where doc_id % 9 = 0
    union all select doc_id, 'request_id' from documents where doc_id % 4 = 0""")
def validate_issue_rows(spark, folder):
    rows = fixture(spark, folder, "documents").select(
        F.col("doc_id").alias("issue_id"),
        F.when(F.col("doc_id") % 11 == 0, " \r\n ").when(F.col("doc_id") % 11 == 1, "fine\r\ntext").otherwise(F.col("text")).alias("body"),
        F.expr("case doc_id % 5 when 0 then '2024-02-30' when 1 then '2024-2-3' when 2 then '2024-02-29' end").alias("due"),
        F.when(F.col("doc_id") % 9 == 0, 181.0).otherwise(139.7).alias("lon"), F.lit(35.6).alias("lat"),
        F.when(F.col("doc_id") % 4 == 0, "nope").otherwise("0F8FAD5B-d9cb-469f-a165-70867728950e").alias("request_uuid"),
    )
    return records.validate_issue_rows(rows)


@query("due_class", "select o_orderkey, case when d < 0 then 'overdue' when d <= 3 then 'due_soon' end as due from (select o_orderkey, o_orderkey % 9 - 3 as d from orders)")
def due_class(spark, folder):
    today = F.lit("2024-05-01").cast("date")
    return fixture(spark, folder, "orders").select("o_orderkey", scalars.due_class(F.date_add(today, (F.col("o_orderkey") % 9 - 3).cast("int")), today).alias("due"))


@query("slugify", r"select s_suppkey, case when s_suppkey % 10 = 0 then 'venue' else 'cafe-' || regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') end as slug from supplier")
def slugify(spark, folder):
    name = F.when(F.col("s_suppkey") % 10 == 0, "駅！").otherwise(F.concat(F.lit("  Café "), "s_name", F.lit("! ")))
    return fixture(spark, folder, "supplier").select("s_suppkey", scalars.slugify(name).alias("slug"))


@query("icon_of", "select s_suppkey, case s_suppkey % 3 when 0 then lower(s_name) when 1 then '.hidden' else 'a.b' end as icon from supplier")
def icon_of(spark, folder):
    path = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/marker/"), F.lower("s_name"), F.lit(".png"))).when(F.col("s_suppkey") % 3 == 1, "x/.hidden").otherwise("a.b.gif")
    return fixture(spark, folder, "supplier").select("s_suppkey", scalars.icon_of(path).alias("icon"))


@query("markdown_summary", "select doc_id, case when length(t) > 80 then substr(t, 1, 80) || '…' else t end as summary from (select doc_id, regexp_replace(trim(string_split(text, chr(10))[1]), '\\s+', ' ', 'g') as t from documents)")
def markdown_summary(spark, folder):
    body = F.concat(F.lit("  \r\n![pic](a.png)\r\n"), F.col("text"))
    return fixture(spark, folder, "documents").select("doc_id", scalars.markdown_summary(body).alias("summary"))


UUID = "0f8fad5b-d9cb-469f-a165-{:012d}"


@query("attachment_refs", f"select doc_id, case when doc_id % 3 = 0 then '{UUID.format(1)},{UUID.format(2)}' else '' end as refs from documents")
def attachment_refs(spark, folder):
    a, b = (f"![x](attachment:{UUID.format(k)})" for k in (1, 2))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(a), F.col("text"), F.lit(b + a))).otherwise(F.concat(F.col("text"), F.lit("![x](attachment:nope)")))
    return fixture(spark, folder, "documents").select("doc_id", F.array_join(scalars.attachment_refs(body), ",").alias("refs"))


def comments(spark, folder):
    """Orders as comments: two thirds are replies to the root before them."""
    rows = fixture(spark, folder, "orders")
    k = F.col("o_orderkey")
    return rows.select(
        k.alias("comment_id"), F.when(k % 3 != 0, k - k % 3).alias("root_id"), (F.col("o_custkey") % 50).alias("author"), F.when(k % 4 != 0, F.col("o_custkey") % 7).alias("assignee"), ((k * 7) % 1000).alias("created_at"),
        (k % 40).alias("version_id"), F.when(k % 11 == 0, F.lit(1)).alias("deleted_at"),
    )


def users(spark, folder):
    return fixture(spark, folder, "customer").where("c_custkey < 45").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))


def files(spark, folder):
    return fixture(spark, folder, "events").select(F.col("event_id").alias("attachment_id"), (F.col("event_id") % 500).alias("comment_id"), F.expr("case event_id % 3 when 0 then 'staged' else 'attached' end").alias("state"))


@query("issue_threads", """with c as (select o_orderkey as k, o_custkey % 50 as author, case when o_orderkey % 4 <> 0 then o_custkey % 7 end as assignee, (o_orderkey * 7) % 1000 as t from orders),
    u as (select c_custkey, c_name from customer where c_custkey < 45)
    select k as comment_id, (select c_name from u where c_custkey = author) as author_name, (select c_name from u where c_custkey = assignee) as assignee_name,
      coalesce((select string_agg(cast(r.k as varchar), ',' order by r.t, r.k) from c r where r.k % 3 <> 0 and r.k - r.k % 3 = c.k), '') as replies,
      (select count(*) from events where event_id % 500 = c.k and event_id % 3 <> 0) as files from c where k % 3 = 0""")
def issue_threads(spark, folder):
    return records.issue_threads(comments(spark, folder), users(spark, folder), files(spark, folder))


@query("servable_media", """select e.event_id as attachment_id, e.event_id % 500 as comment_id, (e.event_id % 500) % 40 as version_id from events e join fx_versions v on v.version_id = (e.event_id % 500) % 40 and v.status = 'published' and v.bundle_hash is not null
    where e.event_id % 3 <> 0 and (e.event_id % 500) % 11 <> 0 and exists (select 1 from orders where o_orderkey = e.event_id % 500)""")
def servable_media(spark, folder):
    return records.servable_media(files(spark, folder), comments(spark, folder), fixture(spark, folder, "fx_versions"))


@query("anchor_violations", """with i as (select f.venue_id, f.feature_id, f.level_ref, f.pos, case when f.pos % 7 = 0 then 'L99' else coalesce(case when f.pos % 5 = 0 then 'L' || cast(f.pos % 25 as varchar) end, f.level_ref, 'L0') end as lv, case when f.pos % 11 = 0 then 'none' else f.feature_id end as ft from fx_features f where feature_type = 'unit')
    select ft0 as issue_id, reason from (select i.feature_id as ft0, case when not exists (select 1 from fx_levels l where l.venue_id = i.venue_id and l.level_id = i.lv) then 'level_missing' when i.ft = 'none' then 'feature_missing' when i.level_ref is not null and i.level_ref <> i.lv then 'feature_on_other_level' end as reason from i) where reason is not null""")
def anchor_violations(spark, folder):
    features = fixture(spark, folder, "fx_features")
    pos = F.col("pos")
    level = F.when(pos % 7 == 0, "L99").otherwise(F.coalesce(F.when(pos % 5 == 0, F.concat(F.lit("L"), (pos % 25).cast("string"))), "level_ref", F.lit("L0")))
    issues = features.where("feature_type = 'unit'").select("venue_id", F.col("feature_id").alias("issue_id"), level.alias("level_id"), F.when(pos % 11 == 0, "none").otherwise(F.col("feature_id")).alias("feature_id"))
    return records.anchor_violations(issues, fixture(spark, folder, "fx_levels"), features)


@query("package_integrity", """select 'lost:' || cast(l_suppkey as varchar) || ':' || cast(l_orderkey as varchar) || ':' || cast(l_linenumber as varchar) as finding from lineitem where l_partkey % 9 = 0
    union all select distinct 'idle:' || cast(l_suppkey as varchar) from lineitem where l_suppkey % 4 = 1""")
def package_integrity(spark, folder):
    rows = fixture(spark, folder, "lineitem")
    members = rows.select(F.col("l_suppkey").alias("package_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"))
    blobs = rows.where("l_partkey % 9 <> 0").select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"))
    lost, idle = records.package_integrity(members, blobs, members.where("package_id % 4 <> 1"))
    return lost.select(F.concat_ws(":", F.lit("lost"), "package_id", "path").alias("finding")).union(idle.select(F.concat_ws(":", F.lit("idle"), "package_id").alias("finding")))


@query("orphans", """with j as (select o_orderkey as k, case o_orderkey % 4 when 0 then 'queued' when 1 then 'running' else 'done' end as state, (o_orderkey * 13) % 600 as lease from orders where o_orderkey % 5 <> 0)
    select 'draft_without_job' as code, v.version_id as subject from fx_versions v where v.status = 'draft' and not exists (select 1 from j where j.k = v.version_id and j.state in ('queued', 'running')) union all select 'lease_expired', k from j where state = 'running' and lease < 300""")
def orphans(spark, folder):
    k = F.col("o_orderkey")
    jobs = fixture(spark, folder, "orders").where("o_orderkey % 5 <> 0").select(k.alias("job_id"), k.alias("version_id"), F.expr("case o_orderkey % 4 when 0 then 'queued' when 1 then 'running' else 'done' end").alias("state"), F.timestamp_seconds(k * 13 % 600).alias("lease_until"))
    return records.orphans(fixture(spark, folder, "fx_versions"), jobs, F.timestamp_seconds(F.lit(300)))


@query("recent_evaluation", """with e as (select o_orderkey as evaluation_id, o_custkey as package_id, o_custkey % 20 as venue_no, o_orderkey % 50 as evaluated, v.version_id, v.bundle_hash from orders join fx_versions v on v.version_id = o_orderkey - o_orderkey % 4),
    n as (select *, row_number() over (partition by package_id order by evaluated desc, evaluation_id desc) as n from e), t as (select venue_no, version_id, bundle_hash from (select *, row_number() over (partition by venue_no order by seq desc) as n from fx_versions where status = 'published' and bundle_hash is not null) where n = 1)
    select package_id, evaluation_id, not coalesce(n.version_id = t.version_id and n.bundle_hash = t.bundle_hash, false) as stale from n left join t on t.venue_no = n.venue_no where n = 1""")
def recent_evaluation(spark, folder):
    versions = fixture(spark, folder, "fx_versions")
    k = F.col("o_orderkey")
    rows = fixture(spark, folder, "orders").select(k.alias("evaluation_id"), F.col("o_custkey").alias("package_id"), (F.col("o_custkey") % 20).alias("venue_no"), (k % 50).alias("evaluated_at"), (k - k % 4).alias("version_id"))
    return records.recent_evaluation(rows.join(versions.select("version_id", "bundle_hash"), "version_id"), records.latest_published(versions))


#: Parts as members of a package: a binary tree of tilesets, some of which are missing, with a few references to refuse.
PACKAGE = """m as (select distinct cast(p_partkey as bigint) as k from part where p_partkey % 13 <> 5), r as (select k, k * 2 + 1 as t from m union all select k, k * 2 + 2 from m),
    walk(k, depth) as (select cast(0 as bigint), 0 union select r.t, depth + 1 from walk w join r on r.k = w.k join m on m.k = r.t where depth < 9), d as (select k, min(depth) as depth from walk group by 1)"""


def package(spark, folder):
    parts = fixture(spark, folder, "part").where("p_partkey % 13 <> 5").select(F.col("p_partkey").cast("bigint").alias("k"))
    name = lambda c: F.concat(F.lit("a/t"), c.cast("string"), F.lit(".json"))
    members = parts.select(F.lit("p").alias("package_id"), name(F.col("k")).alias("path"), "k")
    k = F.col("k")
    there = lambda c: F.concat(F.lit("./../a/t"), c.cast("string"), F.lit(".json"))
    odd = F.when(k % 50 == 1, F.lit("https://x/y.glb")).when(k % 50 == 2, F.lit("/abs.glb")).when(k % 50 == 3, F.lit("../../up.glb")).when(k % 50 == 4, F.lit("t0.json")).when(k % 50 == 6, F.lit("note.txt"))
    refs = members.select("package_id", "path", F.explode(F.array_compact(F.array(there(k * 2 + 1), there(k * 2 + 2), odd))).alias("target"))
    return members.select("package_id", "path"), refs, members.where("k = 0").select("package_id", "path")


@query("tile_member_closure", f"with recursive {PACKAGE} select 'p' as package_id, 'a/t' || k || '.json' as path, depth from d where depth <= 8")
def tile_member_closure(spark, folder):
    return records.tile_member_closure(*package(spark, folder))[0]


@query("tile_refusals", f"""with recursive {PACKAGE}, u as (select r.k, r.t from r join d on d.k = r.k and d.depth <= 8), o as (select k from d where depth <= 8)
    select 'p' as package_id, 'too_deep' as code, 'a/t' || k || '.json' as subject from d where depth > 8
    union all select distinct 'p', 'unresolved_reference', 'a/t' || t || '.json' from u where t not in (select k from m)
    union all select 'p', 'external_reference', 'https://x/y.glb' from o where k % 50 = 1 union all select 'p', 'absolute_reference', '/abs.glb' from o where k % 50 = 2
    union all select 'p', 'escaping_reference', '../../up.glb' from o where k % 50 = 3 union all select distinct 'p', 'tileset_cycle', 'a/t0.json' from o where k % 50 = 4
    union all select distinct 'p', x.code, 'a/note.txt' from o, (values ('unresolved_reference'), ('foreign_content')) x(code) where k % 50 = 6""")
def tile_refusals(spark, folder):
    return records.tile_member_closure(*package(spark, folder))[1]


@query("map_category_code", """select p_partkey, case p_partkey % 6 when 0 then 'elevator' when 1 then 'museum' when 2 then 'ticketgate' when 3 then 'unspecified' when 4 then 'b022' else 'hall' end as category from part""")
def map_category_code(spark, folder):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("B022", " A015 ", "C104", "B777", "b022", "hall")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return fixture(spark, folder, "part").select("p_partkey", scalars.map_category_code(raw).alias("category"))
