"""Registered queries over walking networks, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from atrium.functions import scalars
from atrium.operators import graph, network, travel
from atrium.plans.fixtures import fixture, oracle
from atrium.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (session, folder) and its SQL over the derived tables."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def clean(spark, folder):
    """Nodes on mapped floors, and the paths between them with a valid cost."""
    nodes, _ = network.mapped_nodes(fixture(spark, folder, "fx_nodes").drop("ordinal"))
    paths, _ = network.invalid_costs(fixture(spark, folder, "fx_paths"))
    edges, _ = network.dangling_edges(paths, nodes)
    return nodes, edges


#: The same tables in SQL.
CLEAN = """good_nodes as (select * from fx_nodes where floor <> 'R'),
good_edges as (select p.* from fx_paths p where p.cost >= 0
  and exists (select 1 from good_nodes n where n.venue_id = p.venue_id and n.node_id = p.from_id)
  and exists (select 1 from good_nodes n where n.venue_id = p.venue_id and n.node_id = p.to_id))"""


@query("network_warnings", f"""
    with {CLEAN}
    select venue_id, 'unmapped_floor' as code, cast(node_id as varchar) as subject from fx_nodes where floor = 'R'
    union all select venue_id, 'invalid_cost', cast(path_id as varchar) from fx_paths where cost < 0
    union all select p.venue_id, 'dangling_edge', cast(path_id as varchar) from fx_paths p where cost >= 0
      and not (exists (select 1 from good_nodes n where n.venue_id = p.venue_id and n.node_id = p.from_id)
           and exists (select 1 from good_nodes n where n.venue_id = p.venue_id and n.node_id = p.to_id))""")
def network_warnings(spark, folder):
    nodes, first = network.mapped_nodes(fixture(spark, folder, "fx_nodes").drop("ordinal"))
    return first.union(network.path_warnings(fixture(spark, folder, "fx_paths"), nodes))


@query("read_network", """
    select venue_id, node_id, arg_max(altitude, pos) as altitude, max(pos) as pos from (
      select venue_id, node_id, coalesce(altitude, -1e0) as altitude, rn as pos from fx_nodes union all
      select venue_id, node_id, coalesce(altitude, -1e0) + 1e0, rn + 100000 from fx_nodes where node_id % 9 = 0) group by 1, 2""")
def read_network(spark, folder):
    nodes = fixture(spark, folder, "fx_nodes").select("venue_id", "node_id", F.coalesce("altitude", F.lit(-1.0)).alias("altitude"), F.col("rn").alias("pos"))
    again = nodes.where("node_id % 9 = 0").select("venue_id", "node_id", (F.col("altitude") + 1.0).alias("altitude"), (F.col("pos") + 100000).alias("pos"))
    return network.latest_nodes(nodes.union(again))


@query("dangling_edges", f"with {CLEAN} select venue_id, path_id, from_id, to_id from good_edges")
def dangling_edges(spark, folder):
    return clean(spark, folder)[1].select("venue_id", "path_id", "from_id", "to_id")


@query("edge_ordinals", """
    select p.venue_id, p.path_id, p.variant, coalesce(case when p.order_key % 3 = 0 then 2e0 end, n.ordinal) as ordinal
    from fx_paths p left join fx_nodes n on n.venue_id = p.venue_id and n.node_id = p.from_id""")
def edge_ordinals(spark, folder):
    paths = fixture(spark, folder, "fx_paths").withColumn("floor", F.when(F.col("order_key") % 3 == 0, "F3"))
    return network.edge_ordinals(paths, fixture(spark, folder, "fx_nodes")).select("venue_id", "path_id", "variant", "ordinal")


@query("unmatched_levels", """
    select n.venue_id, n.ordinal, count(*) as nodes from fx_nodes n
    where not exists (select 1 from fx_levels l where l.venue_id = n.venue_id and l.ordinal = n.ordinal and l.pos % 5 <> 0) group by 1, 2""")
def unmatched_levels(spark, folder):
    return network.unmatched_levels(fixture(spark, folder, "fx_nodes"), fixture(spark, folder, "fx_levels").where("pos % 5 <> 0"))


@query("collapse_reciprocal", f"""
    with {CLEAN}, numbered as (select *, row_number() over (partition by venue_id, from_id, to_id, path_id, rpath_id order by cost) as occ from good_edges),
    kept as (select a.* from numbered a where not exists (select 1 from numbered b where b.venue_id = a.venue_id and b.from_id = a.to_id and b.to_id = a.from_id
             and b.path_id = a.rpath_id and b.rpath_id = a.path_id and b.occ = a.occ and b.path_id < a.path_id))
    select venue_id, from_id, to_id, path_id, cost, count(*) over (partition by venue_id, least(path_id, rpath_id), greatest(path_id, rpath_id)) > 1 as conflict from kept""")
def collapse_reciprocal(spark, folder):
    return network.collapse_reciprocal(clean(spark, folder)[1]).select("venue_id", "from_id", "to_id", "path_id", "cost", "conflict")


@query("decode_edge_columns", """
    select venue_id, path_id, variant, case direction when 1 then 'forward' when 2 then 'reverse' else 'both' end as travel, barrier <> 0 as has_barrier, gate <> 0 as has_gate,
           case when (edge_kind = 'vertical') = (lift is not null) then edge_kind else 'normal' end as kind,
           case when (edge_kind = 'vertical') = (lift is not null) then lift end as lift,
           case when (edge_kind = 'vertical') = (lift is not null) then clearance end as clearance_m
    from (select *, case when order_key % 7 <> 0 then vertical end as lift from fx_paths)""")
def decode_edge_columns(spark, folder):
    paths = fixture(spark, folder, "fx_paths").withColumn("vertical", F.when(F.col("order_key") % 7 != 0, F.col("vertical")))
    return network.decode_edge_columns(paths).select("venue_id", "path_id", "variant", "travel", "has_barrier", "has_gate", "kind", "lift", "clearance_m")


@query("edge_allowed", """
    select venue_id, path_id, variant, coalesce(vertical, '') not in ('stairs', 'escalator') as wheelchair,
           (clearance is null or clearance >= 1.2e0) and barrier = 0 as careful,
           start_minute < 0 or (case when start_minute <= end_minute then 1350 >= start_minute and 1350 < end_minute else 1350 >= start_minute or 1350 < end_minute end) as late,
           gate = 0 and coalesce(vertical, '') <> 'stairs' as gated from fx_paths""")
def edge_allowed(spark, folder):
    p = network.RouteProfile
    profiles = {"wheelchair": p(wheelchair=True), "careful": p(min_clearance_m=1.2, pass_barriers=False), "late": p(minute=1350), "gated": p(accessible_only=True, stairs=False)}
    return fixture(spark, folder, "fx_paths").select("venue_id", "path_id", "variant", *[network.edge_allowed(x).alias(k) for k, x in profiles.items()])


@query("degree", f"""
    with {CLEAN} select venue_id, node_id, count(*) as degree from (select venue_id, from_id as node_id from good_edges union all select venue_id, to_id from good_edges where to_id <> from_id) group by 1, 2""")
def degree(spark, folder):
    return network.degree(clean(spark, folder)[1])


@query("connection_keys", f"""
    with {CLEAN} select distinct venue_id, case when path_id % 3 <> 0 then 'p:' || cast(least(path_id, rpath_id) as varchar) || ':' || cast(greatest(path_id, rpath_id) as varchar)
      else 'n:' || cast(least(from_id, to_id) as varchar) || ':' || cast(greatest(from_id, to_id) as varchar) end as connection_key from good_edges""")
def connection_keys(spark, folder):
    edges = clean(spark, folder)[1]
    return network.connection_keys(edges.withColumn("path_id", F.when(F.col("path_id") % 3 != 0, F.col("path_id"))))


#: Components in SQL: smallest node reachable from each node.
REACH = """links as (select venue_id, from_id as a, to_id as b from good_edges union select venue_id, to_id, from_id from good_edges),
reach(venue_id, node_id, seen) as (select venue_id, node_id, node_id from good_nodes union select r.venue_id, r.node_id, l.b from reach r join links l on l.venue_id = r.venue_id and l.a = r.seen),
comp as (select venue_id, node_id, min(seen) as component from reach group by 1, 2)"""


@query("connected_components", f"with recursive {CLEAN}, {REACH} select venue_id, node_id, component from comp")
def connected_components(spark, folder):
    return network.connected_components(*clean(spark, folder))


REPORT = f"""with recursive {CLEAN}, {REACH},
sizes as (select c.venue_id, component, count(*) as size, count(distinct n.ordinal) as floors from comp c join good_nodes n using (venue_id, node_id) group by 1, 2),
ranked as (select *, row_number() over (partition by venue_id order by size desc, component) as k from sizes)"""


@query("connectivity_report", REPORT + """
    select r.venue_id, cast(sum(size) as bigint) as nodes, (select count(*) from good_edges e where e.venue_id = r.venue_id) as edges, count(*) as components,
           round(max(size) / sum(size), 6) as largest_share, max(case when k = 1 then floors end) as floors_in_largest, count(*) filter (where size = 1) as isolated
    from ranked r group by r.venue_id""")
def connectivity_report(spark, folder):
    return network.connectivity_report(*clean(spark, folder))


#: The network without the paths of some nodes, so that there is something to find.
TORN = CLEAN.replace("good_edges as (", "every_edge as (") + ", good_edges as (select * from every_edge where from_id % 41 <> 0 and to_id % 41 <> 0)"


@query("network_qa", f"""with recursive {TORN}, {REACH}
    select venue_id, 'disconnected_component' as code, cast(count(distinct component) as varchar) as subject from comp group by 1 having count(distinct component) > 1
    union all select venue_id, 'isolated_node', cast(node_id as varchar) from good_nodes n
    where not exists (select 1 from good_edges e where e.venue_id = n.venue_id and n.node_id in (e.from_id, e.to_id))""")
def network_qa(spark, folder):
    nodes, edges = clean(spark, folder)
    return network.network_qa(nodes, edges.where("from_id % 41 <> 0 and to_id % 41 <> 0"))


@query("network_profile", f"""with {CLEAN}, deg as (select venue_id, node_id, count(*) as d from (select venue_id, from_id as node_id from good_edges union all select venue_id, to_id from good_edges where to_id <> from_id) group by 1, 2)
    select venue_id, 'edge_kind' as measure, edge_kind as bucket, count(*) as n from good_edges group by 1, 3
    union all select n.venue_id, 'degree', cast(coalesce(d, 0) as varchar), count(*) from good_nodes n left join deg using (venue_id, node_id) group by 1, 3
    union all select venue_id, 'floor', cast(cast(ordinal as int) as varchar), count(*) from good_nodes group by 1, 3""")
def network_profile(spark, folder):
    return network.network_profile(*clean(spark, folder))


#: A fifth of the torn network's paths, so that there are dead ends.
THIN = TORN.replace("and to_id % 41 <> 0)", "and to_id % 41 <> 0 and path_id % 5 = 0)")


@query("shape_profile", f"""with recursive {THIN}, {REACH},
    deg as (select venue_id, node_id from (select venue_id, from_id as node_id from good_edges union all select venue_id, to_id from good_edges where to_id <> from_id) group by 1, 2 having count(*) = 1),
    leaf as (select e.venue_id, (path_id % 150) / 10.0e0 as m from good_edges e where exists (select 1 from deg d where d.venue_id = e.venue_id and d.node_id in (e.from_id, e.to_id)))
    select venue_id, 'component_size' as measure, cast(size as varchar) as bucket, count(*) as n from (select venue_id, component, count(*) as size from comp group by 1, 2) group by 1, 3
    union all select venue_id, 'leaf_metres', case when m >= 10 then '10+' else cast(cast(floor(m) as bigint) as varchar) end, count(*) from leaf group by 1, 3""")
def shape_profile(spark, folder):
    nodes, edges = clean(spark, folder)
    thin = edges.where("from_id % 41 <> 0 and to_id % 41 <> 0 and path_id % 5 = 0")
    return network.shape_profile(nodes, thin, thin.select("venue_id", "path_id", ((F.col("path_id") % 150) / F.lit(10.0)).alias("metres")))


@query("edit_junctions", f"""with {CLEAN}, x as (select venue_id, node_id, ordinal, lon, lat, case node_id % 5 when 0 then 'move' when 1 then 'delete' when 2 then 'add' end as op, row_number() over (partition by venue_id order by node_id) as request_id from good_nodes)
    select n.venue_id, n.node_id, n.ordinal, case when n.node_id % 5 = 0 and n.node_id % 15 <> 0 then n.lon + 0.25e0 else n.lon end as lon from good_nodes n where n.node_id % 5 <> 1
    union all select venue_id, (select max(node_id) from good_nodes g where g.venue_id = x.venue_id) + row_number() over (partition by venue_id order by request_id), ordinal, lon + 0.25e0 from x where op = 'add'""")
def edit_junctions(spark, folder):
    from pyspark.sql import Window

    nodes, _ = clean(spark, folder)
    op = F.expr("case node_id % 5 when 0 then 'move' when 1 then 'delete' when 2 then 'add' end")
    number = F.row_number().over(Window.partitionBy("venue_id").orderBy("node_id"))
    edits = nodes.withColumns({"op": op, "request_id": number}).where("op is not null")
    # moves of every third such junction are off the globe, and deletions of unknown ones are refused as well
    lat = F.when((F.col("op") == "move") & (F.col("node_id") % 15 == 0), 95.0).otherwise(F.col("lat"))
    edits = edits.select("venue_id", "request_id", "op", "node_id", "ordinal", (F.col("lon") + 0.25).alias("lon"), lat.alias("lat"))
    stray = edits.where("op = 'delete'").withColumns({"node_id": F.col("node_id") + 10_000_000, "request_id": F.col("request_id") + 10_000_000})
    return network.edit_junctions(nodes, edits.unionByName(stray))[0].select("venue_id", "node_id", "ordinal", "lon")


def _edited(spark, folder):
    nodes, edges = clean(spark, folder)
    moved = F.when(F.col("node_id") % 5 == 0, F.col("lon") + 0.5).otherwise(F.col("lon"))
    added = nodes.where("node_id % 8 = 0").withColumn("node_id", F.col("node_id") + 1000000)
    fresh = edges.where("path_id % 9 = 0").withColumns({"path_id": F.col("path_id") + 10000000, "rpath_id": F.col("rpath_id") + 10000000})
    return nodes, nodes.where("node_id % 11 <> 0").withColumn("lon", moved).unionByName(added), edges, edges.where("path_id % 7 <> 0").unionByName(fresh)


@query("network_diff", f"""with {CLEAN}, keys as (select distinct venue_id, least(path_id, rpath_id) as a, greatest(path_id, rpath_id) as b, max(case when path_id % 7 <> 0 then 1 else 0 end) over (partition by venue_id, least(path_id, rpath_id), greatest(path_id, rpath_id)) as stays from good_edges)
    select n.venue_id, count(*) filter (where node_id % 8 = 0) as junctions_added, count(*) filter (where node_id % 5 = 0 and node_id % 11 <> 0) as junctions_moved, count(*) filter (where node_id % 11 = 0) as junctions_deleted,
           (select count(distinct cast(least(path_id, rpath_id) as varchar) || ':' || cast(greatest(path_id, rpath_id) as varchar)) from good_edges e where e.venue_id = n.venue_id and path_id % 9 = 0) as connections_added, (select count(*) from keys k where k.venue_id = n.venue_id and stays = 0) as connections_deleted
    from good_nodes n group by n.venue_id""")
def network_diff(spark, folder):
    old, new, before, after = _edited(spark, folder)
    return network.network_diff(old, new, before, after)


@query("connections_inside", f"with {CLEAN} select venue_id, path_id, from_id, to_id from good_edges where from_id % 3 <> 0 and to_id % 3 <> 0")
def connections_inside(spark, folder):
    nodes, edges = clean(spark, folder)
    return network.connections_inside(edges, nodes.where("node_id % 3 <> 0")).select("venue_id", "path_id", "from_id", "to_id")


@query("connections_along", f"""with {CLEAN}, s as (select venue_id, node_id, lead(node_id) over (partition by venue_id order by ordinal, rn) as nxt from good_nodes)
    select e.venue_id, e.path_id, e.from_id, e.to_id from good_edges e where exists (select 1 from s where s.venue_id = e.venue_id and ((s.node_id = e.from_id and s.nxt = e.to_id) or (s.node_id = e.to_id and s.nxt = e.from_id)))""")
def connections_along(spark, folder):
    nodes, edges = clean(spark, folder)
    sequence = nodes.select("venue_id", (F.col("ordinal") * 1000000 + F.col("rn")).alias("position"), "node_id")
    return network.connections_along(edges, sequence).select("venue_id", "path_id", "from_id", "to_id")


#: Metres between two rows ``a`` and ``b``, in SQL.
_APART = "2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


#: What the rows of a part have, with the type.
EDITED = {"from_id": "bigint", "to_id": "bigint", "cost": "bigint", "path_count": "bigint", "lon": "double", "reason": "string"}


@query("apply_network_edits", f"""with {CLEAN}, j as (
      select venue_id, node_id, ordinal, case when node_id % 7 = 3 and node_id % 5 <> 0 then lon + 0.25e0 else lon end as lon, lat from good_nodes where node_id % 6 <> 0
      union all select n.venue_id, m.top + row_number() over (partition by n.venue_id order by node_id), ordinal, lon + 0.25e0, lat
      from good_nodes n join (select venue_id, max(node_id) as top from good_nodes group by 1) m on m.venue_id = n.venue_id where node_id % 11 = 5),
    cut as (select distinct venue_id, order_key from good_edges where variant = 0 and order_key % 9 = 0 and order_key % 90 <> 0),
    kept as (select e.venue_id, path_id, rpath_id, from_id, to_id, cost from good_edges e where from_id % 6 <> 0 and to_id % 6 <> 0
      and not exists (select 1 from cut c where c.venue_id = e.venue_id and c.order_key = e.order_key)),
    w as (select a.venue_id, a.node_id * 10 + 4 as request_id, a.node_id as from_id, case when a.node_id % 20 = 1 then a.node_id else b.node_id end as to_id
      from good_nodes a join good_nodes b on b.venue_id = a.venue_id and b.rn = a.rn + 2 and b.ordinal = case when a.node_id % 28 = 1 then a.ordinal + 1 else a.ordinal end where a.node_id % 4 = 1),
    seen as (select w.*, row_number() over (partition by w.venue_id, least(from_id, to_id), greatest(from_id, to_id) order by request_id) as f, cast(round({_APART} * 1000) as bigint) as cost,
      case when a.node_id is null or b.node_id is null then 'unknown_junction' when from_id = to_id then 'same_junction' when a.ordinal <> b.ordinal then 'other_floor' when h.venue_id is not null then 'exists' end as r
      from w left join j a on a.venue_id = w.venue_id and a.node_id = w.from_id left join j b on b.venue_id = w.venue_id and b.node_id = w.to_id
      left join (select distinct venue_id, least(from_id, to_id) as low, greatest(from_id, to_id) as high from kept) h on h.venue_id = w.venue_id and h.low = least(w.from_id, w.to_id) and h.high = greatest(w.from_id, w.to_id)),
    judged as (select *, coalesce(r, case when f > 1 then 'exists' end) as reason from seen),
    fresh as (select g.*, coalesce(t.top, 0) + 2 * row_number() over (partition by g.venue_id order by request_id) as p from judged g
      left join (select venue_id, max(greatest(path_id, rpath_id)) as top from kept group by 1) t on t.venue_id = g.venue_id where reason is null),
    paths as (select * from kept union all select venue_id, p - 1, p, from_id, to_id, cost from fresh union all select venue_id, p, p - 1, to_id, from_id, cost from fresh),
    once as (select venue_id, min({{'p': path_id, 'a': from_id, 'b': to_id}}) as s from paths group by venue_id, least(path_id, rpath_id), greatest(path_id, rpath_id)),
    deg as (select venue_id, node_id, count(*) as d from (select venue_id, s.a as node_id from once union all select venue_id, s.b from once where s.b <> s.a) group by 1, 2)
    select 'junction' as part, j.venue_id, j.node_id as id, cast(null as bigint) as from_id, cast(null as bigint) as to_id, cast(null as bigint) as cost, coalesce(d, 0) as path_count, lon, cast(null as varchar) as reason from j left join deg using (venue_id, node_id)
    union all select 'path', venue_id, path_id, from_id, to_id, cost, null, null, null from paths
    union all select 'refused', venue_id, request_id, null, null, null, null, null, reason from judged where reason is not null
    union all select 'refused', venue_id, node_id * 10 + 2, null, null, null, null, null, 'off_the_globe' from good_nodes where node_id % 7 = 3 and node_id % 5 = 0
    union all select 'refused', venue_id, node_id * 10 + 6, null, null, null, null, null, 'unknown_junction' from good_nodes where node_id % 50 = 0
    union all select 'refused', venue_id, path_id * 10 + 5, null, null, null, null, null, 'unknown_connection' from good_edges where variant = 0 and order_key % 90 = 0""")
def apply_network_edits(spark, folder):
    scratch = Scratch(spark, "network")
    nodes, edges = (scratch.keep(name, rows) for name, rows in zip(("nodes", "edges"), clean(spark, folder)))
    node, none = F.col("node_id"), F.lit(None).cast("bigint")

    def edit(rows, op, k, number="node_id", lat=F.col("lat"), **more):
        """The requests of one kind, numbered by the row's own id."""
        get = lambda c, kind: more.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
        places = [get("ordinal", "double"), (get("lon", "double") + 0.25).alias("lon"), lat.cast("double").alias("lat")]
        return rows.select("venue_id", (F.col(number) * 10 + k).alias("request_id"), F.lit(op).alias("op"), get("node_id", "bigint"), *places, *[get(c, "bigint") for c in ("from_id", "to_id", "path_id", "rpath_id")])

    moves = edit(nodes.where("node_id % 7 = 3"), "move", 2, lat=F.when(node % 5 == 0, 95.0).otherwise(F.col("lat")))
    gone = edit(nodes.where("node_id % 6 = 0"), "delete", 1).union(edit(nodes.where("node_id % 50 = 0"), "delete", 6, node_id=node + 10_000_000_000))
    then = nodes.select("venue_id", "ordinal", (F.col("rn") - 2).alias("rn"), node.alias("_to"))
    step = nodes.where("node_id % 4 = 1").select("venue_id", "node_id", "rn", F.when(node % 28 == 1, F.col("ordinal") + 1).otherwise(F.col("ordinal")).alias("ordinal")).join(then, ["venue_id", "ordinal", "rn"])
    links = edit(step, "connect", 4, lat=none, from_id=node, to_id=F.when(node % 20 == 1, node).otherwise(F.col("_to")))
    # ids in either order, and of every tenth such connection ids that none has
    far = F.when(F.col("order_key") % 90 == 0, 10_000_000_000).otherwise(0)
    odd = F.col("order_key") % 2 == 1
    cut = edit(edges.where("variant = 0 and order_key % 9 = 0"), "disconnect", 5, "path_id", lat=none, node_id=none, from_id=none, to_id=none,
               path_id=F.when(odd, F.col("rpath_id")).otherwise(F.col("path_id")) + far, rpath_id=F.when(odd, F.col("path_id")).otherwise(F.col("rpath_id")) + far)
    edits = moves.union(gone).union(edit(nodes.where("node_id % 11 = 5"), "add", 3)).union(links).union(cut)
    junctions, paths, refused = network.apply_network_edits(nodes, edges, edits)
    part = lambda rows, name, key, *have: rows.select(F.lit(name).alias("part"), "venue_id", F.col(key).alias("id"), *[F.col(c).cast(k) if c in have else F.lit(None).cast(k).alias(c) for c, k in EDITED.items()])
    return part(junctions, "junction", "node_id", "path_count", "lon").union(part(paths, "path", "path_id", "from_id", "to_id", "cost")).union(part(refused, "refused", "request_id", "reason"))


@query("export_network", f"""with {CLEAN}, numbered as (select e.*, row_number() over (partition by e.venue_id order by from_id, to_id, path_id) as n,
      a.ordinal as ao, b.ordinal as bo, a.short as af, b.short as bf
      from good_edges e join (select venue_id, node_id, ordinal, floor as short from good_nodes) a on a.venue_id = e.venue_id and a.node_id = e.from_id
      join (select venue_id, node_id, ordinal, floor as short from good_nodes) b on b.venue_id = e.venue_id and b.node_id = e.to_id)
    select venue_id, case r when 0 then from_id else to_id end as fnodeid, case r when 0 then to_id else from_id end as tnodeid, case r when 0 then 2 * n - 1 else 2 * n end as pathid,
           case r when 0 then 2 * n else 2 * n - 1 end as rpathid, cost, cast(round(cost / 1000.0e0 / 1.4e0) as bigint) as traveltime,
           case when af <> bf then (case r when 0 then af else bf end) end as ffloor, case when af <> bf then (case r when 0 then bf else af end) end as tofloor,
           (case r when 0 then ao else bo end) * 4.0e0 as altitude
    from numbered, (select 0 as r union all select 1)""")
def export_network(spark, folder):
    return network.export_network(*clean(spark, folder))


def directed(edges):
    """Both directions of every edge, but for those that are one way."""
    there = edges.where("coalesce(direction, 0) <> 2").select("venue_id", "from_id", "to_id", "cost")
    back = edges.where("coalesce(direction, 0) <> 1").select("venue_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "cost")
    return there.union(back)


@query("shortest_paths", f"""with recursive {CLEAN},
    steps as (select venue_id, a, b, min(cost) as cost from (select venue_id, from_id as a, to_id as b, cost from good_edges where coalesce(direction, 0) <> 2
              union all select venue_id, to_id, from_id, cost from good_edges where coalesce(direction, 0) <> 1) where a <> b group by 1, 2, 3),
    od as (select node_id as od_id, venue_id, node_id as source, lead(node_id, 20) over (partition by venue_id order by ordinal, rn) as target from good_nodes),
    asked as (select * from od where target is not null),
    walk(od_id, venue_id, node, cost) using key (od_id, venue_id, node) as (
      select od_id, venue_id, source, cast(0 as double) from asked
      union select w.od_id, w.venue_id, s.b, min(w.cost + s.cost) from walk w join steps s on s.venue_id = w.venue_id and s.a = w.node
            left join recurring.walk r on r.od_id = w.od_id and r.venue_id = w.venue_id and r.node = s.b
            where r.cost is null or w.cost + s.cost < r.cost group by 1, 2, 3)
    select a.od_id, w.cost from asked a left join walk w on w.od_id = a.od_id and w.node = a.target""")
def shortest_paths(spark, folder):
    from pyspark.sql import Window

    nodes, edges = clean(spark, folder)
    later = F.lead("node_id", 20).over(Window.partitionBy("venue_id").orderBy("ordinal", "rn"))
    pairs = nodes.select(F.col("node_id").alias("od_id"), "venue_id", F.col("node_id").alias("source"), later.alias("target"))
    return graph.shortest_paths(directed(edges), pairs.where("target is not null")).select("od_id", "cost")


#: Edges open at ten in the morning, and what closes more to a wheelchair or to walkers, in SQL.
AT_TEN = """barrier = 0 and (start_minute < 0 or end_minute < 0 or (start_minute <= end_minute and 600 >= start_minute and 600 < end_minute)
      or (start_minute > end_minute and (600 >= start_minute or 600 < end_minute)))"""
WHEELED = f"{AT_TEN} and coalesce(vertical, '') not in ('stairs', 'escalator') and coalesce(clearance, 9) >= 0.8 and order_key % 11 <> 0"
WALKED = f"{AT_TEN} and gate = 0"


def travel_sql(passable: str, ahead: int) -> str:
    """Ways over passable edges from each node to the one that stands ``ahead`` places after it in its venue."""
    return f"""{CLEAN}, passable as (select * from good_edges where {passable}),
    links as (select venue_id, a, b, s.w, s.e from (select venue_id, a, b, min({{'w': w, 'e': e}}) as s from (select venue_id, from_id as a, to_id as b, cast(cost as double) as w, path_id as e from passable where coalesce(direction, 0) <> 2
              union all select venue_id, to_id, from_id, cast(cost as double), path_id from passable where coalesce(direction, 0) <> 1) where a <> b group by 1, 2, 3)),
    asked as (select * from (select node_id as od_id, venue_id, node_id as source, lead(node_id, {ahead}) over (partition by venue_id order by ordinal, rn) as target from good_nodes) where target is not null),
    walk(od_id, venue_id, node, s) using key (od_id, venue_id, node) as (
      select od_id, venue_id, source, {{'c': 0e0, 'o': cast(-1 as bigint), 'h': 0, 'p': cast(-1 as bigint)}} from asked
      union select n.od_id, n.venue_id, n.b, min(n.s) from (select w.od_id, w.venue_id, t.b, {{'c': w.s.c + t.w, 'o': case when w.s.h = 0 then t.e else w.s.o end, 'h': w.s.h + 1, 'p': w.node}} as s from walk w join links t on t.venue_id = w.venue_id and t.a = w.node) n
            left join recurring.walk r on r.od_id = n.od_id and r.venue_id = n.venue_id and r.node = n.b where r.s is null or n.s < r.s group by 1, 2, 3)"""


def travelled(spark, folder, profile, ahead):
    """The same of a profile at ten in the morning."""
    from pyspark.sql import Window

    nodes, paths = clean(spark, folder)
    edges = paths.withColumns({"edge_id": F.col("path_id"), "accessible_only": F.col("gate") == 1, "barrier": F.col("barrier") == 1, "wheelchair": F.col("order_key") % 11 != 0})
    later = F.lead("node_id", ahead).over(Window.partitionBy("venue_id").orderBy("ordinal", "rn"))
    pairs = nodes.select(F.col("node_id").alias("od_id"), "venue_id", F.col("node_id").alias("source"), later.alias("target"))
    return travel.settled_paths(edges, pairs.where("target is not null"), replace(profile, at_minute=600))


@query("profile_paths", f"""with recursive {travel_sql(WHEELED, 3)}
    select a.od_id, w.s.c as cost, w.s.h as hops, case when w.s.o >= 0 then w.s.o end as first_edge from asked a left join walk w on w.od_id = a.od_id and w.node = a.target""")
def profile_paths(spark, folder):
    return travelled(spark, folder, travel.WHEELCHAIR, 3)[0]


@query("profile_path_steps", f"""with recursive {travel_sql(WALKED, 20)},
    way(od_id, venue_id, node, s) as (select w.* from walk w join asked a on w.od_id = a.od_id and w.node = a.target
      union all select w.* from way y join walk w on w.od_id = y.od_id and w.node = y.s.p where y.s.h > 0)
    select y.od_id, y.s.h as position, y.node, t.e as edge_id from way y left join links t on t.venue_id = y.venue_id and t.a = y.s.p and t.b = y.node""")
def profile_path_steps(spark, folder):
    return travelled(spark, folder, travel.WALKING, 20)[1]
