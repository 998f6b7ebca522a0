"""Registered per-floor views, slab rows, route figures and bulk additions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.operators import views
from atrium.plans.fixtures import fixture, oracle
from atrium.plans.network_queries import CLEAN, clean
from atrium.plans.venue_queries import PLANES, resolve_level_planes as level_planes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


@query("floor_slice", f"""with {CLEAN}, e as (select g.venue_id, g.path_id, g.rpath_id, a.ordinal as ao, b.ordinal as bo from good_edges g join good_nodes a on a.venue_id = g.venue_id and a.node_id = g.from_id join good_nodes b on b.venue_id = g.venue_id and b.node_id = g.to_id)
    select venue_id, ao as ordinal, 'path' as kind, cast(path_id as varchar) as item from e where ao = bo
    union all select * from (select distinct venue_id, unnest([ao, bo]), 'link', cast(least(path_id, rpath_id) as varchar) || ':' || cast(greatest(path_id, rpath_id) as varchar) from e where ao <> bo)
    union all select venue_id, ordinal, 'facility', cast(facility_id as varchar) from fx_facilities union all select venue_id, ordinal, 'junction', cast(node_id as varchar) from good_nodes""")
def floor_slice(spark, folder):
    nodes, edges = clean(spark, folder)
    return views.floor_slice(fixture(spark, folder, "fx_facilities"), nodes, edges)


@query("priority_top_n", "select venue_id, level_id, feature_id, rank from (select venue_id, level_id, unit_id as feature_id, row_number() over (partition by venue_id, level_id order by k % 4, unit_id) as rank from fx_units) where rank <= 5")
def priority_top_n(spark, folder):
    rows = fixture(spark, folder, "fx_units").select("venue_id", "level_id", F.col("unit_id").alias("feature_id"), (F.col("k") % 4).alias("priority"))
    return views.priority_top_n(rows, 5)


@query("surface_rows", f"""with {PLANES}, z as (select venue_id, level_id, height_mm - min(height_mm) over (partition by venue_id) as scene_z_mm from planes),
    p as (select * from z where level_id <> 'L7'), u as (select u.*, scene_z_mm from fx_units u join p on p.level_id = u.level_id)
    select venue_id, level_id, unit_id as owner, 'surface' as kind, scene_z_mm as z_mm, false as assumed, 1.0e0 as confidence from u
    union all select venue_id, level_id, unit_id, 'ceiling', scene_z_mm + coalesce(cast(round(height * 1000) as bigint), 3000), height is null, case when height is null then 0.3e0 else 1.0e0 end from u
    union all select venue_id, level_id, level_id, 'slab', scene_z_mm, false, 1.0e0 from p""")
def surface_rows(spark, folder):
    return views.surface_rows(fixture(spark, folder, "fx_units"), level_planes(spark, folder).where("level_id <> 'L7'"))


@query("route_quality", """with r as (select 'V' || cast(o_custkey % 6 as varchar) as venue_id, o_custkey % 6 <> 5 and o_orderkey % 4 <> 0 as routed, 10 + o_orderkey % 7 as raw, 2 + o_orderkey % 3 as kept, 100 + o_orderkey % 50 as raw_m, 90 + o_orderkey % 40 as smooth_m, o_orderkey % 5 as wall from orders)
    select venue_id, count(*) as pairs, count(*) filter (where routed) as routed, round(sum(case when routed then kept end) / sum(case when routed then raw end), 6) as retention, round(sum(case when routed then smooth_m end) / sum(case when routed then raw_m end), 6) as length_ratio,
      max(case when routed then wall end) as near_wall_max, round(avg(case when routed then wall end), 6) as near_wall_mean from r group by 1""")
def route_quality(spark, folder):
    k = F.col("o_orderkey")
    rows = fixture(spark, folder, "orders").select(
        F.concat(F.lit("V"), (F.col("o_custkey") % 6).cast("string")).alias("venue_id"), ((F.col("o_custkey") % 6 != 5) & (k % 4 != 0)).alias("routed"), (10 + k % 7).alias("raw_vertices"), (2 + k % 3).alias("kept_vertices"),
        (100 + k % 50).alias("raw_m"), (90 + k % 40).alias("smooth_m"), (k % 5).alias("near_wall"),
    )
    return views.route_quality(rows)


@query("add_connections", f"""with {CLEAN}, w as (select a.venue_id, a.node_id as request_id, a.node_id as from_id, case when a.node_id % 9 = 0 then -5 when a.node_id % 8 = 0 then a.node_id else b.node_id end as to_id from good_nodes a join good_nodes b on b.venue_id = a.venue_id and b.rn = a.rn + 1
      and b.ordinal = case when a.node_id % 7 = 0 then a.ordinal + 1 else a.ordinal end),
    j as (select w.*, row_number() over (partition by w.venue_id, least(from_id, to_id), greatest(from_id, to_id) order by request_id) as f,
      case when b.node_id is null then 'unknown_junction' when from_id = to_id then 'same_junction' when a.ordinal <> b.ordinal then 'other_floor'
           when exists (select 1 from good_edges e where e.venue_id = w.venue_id and least(e.from_id, e.to_id) = least(w.from_id, w.to_id) and greatest(e.from_id, e.to_id) = greatest(w.from_id, w.to_id)) then 'exists' end as r
      from w join good_nodes a on a.venue_id = w.venue_id and a.node_id = w.from_id left join good_nodes b on b.venue_id = w.venue_id and b.node_id = w.to_id),
    k as (select *, coalesce(r, case when f > 1 then 'exists' end) as reason from j)
    select venue_id, request_id, reason, cast(null as bigint) as path_id from k where reason is not null
    union all select k.venue_id, request_id, 'added', coalesce((select max(greatest(path_id, rpath_id)) from good_edges e where e.venue_id = k.venue_id), 0) + 2 * row_number() over (partition by k.venue_id order by request_id) - 1 from k where reason is null""")
def add_connections(spark, folder):
    nodes, edges = clean(spark, folder)
    step = nodes.select("venue_id", "node_id", "rn", F.when(F.col("node_id") % 7 == 0, F.col("ordinal") + 1).otherwise(F.col("ordinal")).alias("ordinal"))
    then = nodes.select("venue_id", "ordinal", (F.col("rn") - 1).alias("rn"), F.col("node_id").alias("_to"))
    to = F.when(F.col("node_id") % 9 == 0, -5).when(F.col("node_id") % 8 == 0, F.col("node_id")).otherwise(F.col("_to"))
    wanted = step.join(then, ["venue_id", "ordinal", "rn"]).select("venue_id", F.col("node_id").alias("request_id"), F.col("node_id").alias("from_id"), to.alias("to_id"), F.lit(5).alias("cost"))
    added, refused = views.add_connections(nodes, edges, wanted)
    return refused.select("venue_id", "request_id", "reason", F.lit(None).cast("bigint").alias("path_id")).union(added.select("venue_id", "request_id", F.lit("added"), "path_id"))
