"""Registered spatial queries, and their SQL without any grid: every point against every segment of its floor."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import geometry
from atrium.operators import resolve, spatial, synthesis
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


def _at(i, j):
    return F.struct(((F.lit(27953200) + i) / F.lit(200000.0)).alias("lon"), ((F.lit(7136000) + j) / F.lit(200000.0)).alias("lat"))


def unit_rings(spark, folder, where="true"):
    """Closed rectangles of the units."""
    units = fixture(spark, folder, "fx_units").where(where)
    i0, i1, j0, j1 = (F.col(c) for c in ("i0", "i1", "j0", "j1"))
    points = F.array(_at(i0, j0), _at(i1, j0), _at(i1, j1), _at(i0, j1), _at(i0, j0))
    return units.select("venue_id", "ordinal", F.col("unit_id").alias("shape_id"), "level_id", "category", points.alias("points"))


def node_points(spark, folder):
    return fixture(spark, folder, "fx_nodes").select("venue_id", "ordinal", F.col("node_id").alias("point_id"), "lon", "lat")


#: Unit rectangles as segments, and the distance of a point to one in SQL.
SEG = """segs as (select venue_id, ordinal, unit_id as shape_id, k, category, (27953200 + case e when 0 then i0 when 1 then i1 when 2 then i1 else i0 end) / 200000.0e0 as ax,
  (7136000 + case e when 0 then j0 when 1 then j0 when 2 then j1 else j1 end) / 200000.0e0 as ay, (27953200 + case e when 0 then i1 when 1 then i1 when 2 then i0 else i0 end) / 200000.0e0 as bx,
  (7136000 + case e when 0 then j0 when 1 then j1 when 2 then j1 else j0 end) / 200000.0e0 as b_y from fx_units, range(4) t(e))"""
DEG = "(6371000.0e0 * 3.141592653589793e0 / 180.0e0)"
OFFSET = f"""offs as (select *, (ax - lon) * cos(radians(lat)) * {DEG} as x1, (ay - lat) * {DEG} as y1, (bx - ax) * cos(radians(lat)) * {DEG} as dx, (b_y - ay) * {DEG} as dy from near),
  dist as (select *, sqrt(pow(x1 + t * dx, 2) + pow(y1 + t * dy, 2)) as metres from (select *, case when dx * dx + dy * dy > 0 then greatest(0.0e0, least(1.0e0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) else 0.0e0 end as t from offs))"""
HAV = "2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("point_in_shape", """select n.venue_id, n.ordinal, n.node_id as point_id, u.unit_id as shape_id from fx_nodes n join fx_units u on u.level_id = n.level_id and n.i > u.i0 and n.i < u.i1 and n.j > u.j0 and n.j < u.j1""")
def point_in_shape(spark, folder):
    return spatial.inside_shapes(node_points(spark, folder), spatial.ring_segments(unit_rings(spark, folder)))


@query("clip_to_venue", f"""with {SEG}, near as (select n.venue_id, n.node_id, n.lon, n.lat, s.* exclude (venue_id, ordinal) from fx_nodes n join segs s on s.venue_id = n.venue_id and s.ordinal = n.ordinal), {OFFSET}
    select venue_id, node_id as point_id from fx_nodes n where exists (select 1 from fx_units u where u.level_id = n.level_id and n.i > u.i0 and n.i < u.i1 and n.j > u.j0 and n.j < u.j1)
      or exists (select 1 from dist d where d.venue_id = n.venue_id and d.node_id = n.node_id and d.metres <= 2.0e0)""")
def clip_to_venue(spark, folder):
    return spatial.clip_to_venue(node_points(spark, folder), spatial.ring_segments(unit_rings(spark, folder))).select("venue_id", "point_id")


@query("building_by_containment", """select n.venue_id, n.node_id as point_id, 'H' || cast(min(u.k % 3) as varchar) as building_id from fx_nodes n join fx_units u on u.level_id = n.level_id and n.i > u.i0 and n.i < u.i1 and n.j > u.j0 and n.j < u.j1
    group by 1, 2 having count(distinct u.k % 3) = 1""")
def building_by_containment(spark, folder):
    buildings = fixture(spark, folder, "fx_units").select("venue_id", F.col("unit_id").alias("shape_id"), F.concat(F.lit("H"), (F.col("k") % 3).cast("string")).alias("building_id"))
    return spatial.building_by_containment(node_points(spark, folder), spatial.ring_segments(unit_rings(spark, folder)), buildings)


@query("building_of_boundary_points", """with p as (select o.venue_id, opening_id, level_id, i, j0 + 2 as j from fx_openings o), h as (select p.venue_id, p.opening_id, (u.k // 50) % 7 as b from p join fx_units u on u.level_id = p.level_id and p.i between u.i0 and u.i1 and p.j between u.j0 and u.j1)
    select venue_id, opening_id as point_id, 'H' || min(b) as building_id from h group by 1, 2 having count(distinct b) = 1""")
def building_of_boundary_points(spark, folder):
    """Middles of openings, which lie on the boundaries of the units beside them."""
    buildings = fixture(spark, folder, "fx_units").select("venue_id", F.col("unit_id").alias("shape_id"), F.concat(F.lit("H"), (F.floor(F.col("k") / 50) % 7).cast("string")).alias("building_id"))
    return spatial.building_by_containment(middles(spark, folder), spatial.ring_segments(unit_rings(spark, folder)), buildings)


@query("nearest_node", f"""select venue_id, point_id, rank, node_id, round(metres, 6) as metres from (
      select *, row_number() over (partition by venue_id, point_id order by metres, node_id) as rank from (
        select f.venue_id, f.facility_id as point_id, n.node_id, {HAV.format(a="f", b="n")} as metres from fx_facilities f join fx_nodes n on n.venue_id = f.venue_id and n.ordinal = f.ordinal) where metres <= 8.0e0) where rank <= 3""")
def nearest_node(spark, folder):
    points = fixture(spark, folder, "fx_facilities").select("venue_id", "ordinal", F.col("facility_id").alias("point_id"), "lon", "lat")
    return spatial.nearest_nodes(points, fixture(spark, folder, "fx_nodes"), 8.0, 3).withColumn("metres", F.round("metres", 6))


def edge_segments(spark, folder):
    from atrium.plans.network_queries import clean

    nodes, edges = clean(spark, folder)
    a = nodes.select("venue_id", F.col("node_id").alias("from_id"), F.col("ordinal"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    b = nodes.select("venue_id", F.col("node_id").alias("to_id"), F.col("ordinal").alias("_o"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    both = edges.where("variant = 0").join(a, ["venue_id", "from_id"]).join(b, ["venue_id", "to_id"]).where("ordinal = _o")
    return both.select("venue_id", "ordinal", F.col("path_id").alias("shape_id"), "ax", "ay", "bx", "by")


#: The place on a segment by the share along it in degrees, and its distance in SQL.
ON_LINE = f"""shares as (select *, case when pow(bx - ax, 2) + pow(b_y - ay, 2) > 2.220446049250313e-16 then greatest(0.0e0, least(1.0e0, ((lon - ax) * (bx - ax) + (lat - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) else 0.0e0 end as t from near),
  places as (select *, ax + t * (bx - ax) as on_lon, ay + t * (b_y - ay) as on_lat from shares), spots as (select *, {HAV.replace("{a}.lon", "lon").replace("{a}.lat", "lat").replace("{b}.lon", "on_lon").replace("{b}.lat", "on_lat")} as metres from places)"""


def facility_points(spark, folder):
    """Facilities as points; those with a junk label are on a floor that has no network."""
    ordinal = F.when(F.col("facility_id") % 19 == 0, 99.0).otherwise(F.col("ordinal"))
    return fixture(spark, folder, "fx_facilities").select("venue_id", ordinal.alias("ordinal"), F.col("facility_id").alias("point_id"), "lon", "lat")


SNAPPED = f"""good_nodes as (select * from fx_nodes where floor <> 'R'),
    lines as (select p.venue_id, a.ordinal, p.path_id as shape_id, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as b_y from fx_paths p join good_nodes a on a.venue_id = p.venue_id and a.node_id = p.from_id join good_nodes b on b.venue_id = p.venue_id and b.node_id = p.to_id
      where p.variant = 0 and p.cost >= 0 and a.ordinal = b.ordinal),
    near as (select f.venue_id, f.facility_id as point_id, f.lon, f.lat, f.facility_id % 19 = 0 as lost, s.* exclude (venue_id, ordinal) from fx_facilities f join lines s on s.venue_id = f.venue_id and (s.ordinal = f.ordinal or f.facility_id % 19 = 0)), {ON_LINE},
    snapped as (select venue_id, point_id, rank, shape_id, metres, t, on_lon, on_lat from (select *, row_number() over (partition by venue_id, point_id order by round(metres, 6), shape_id) as rank from spots) where rank <= case when lost then 1 else 3 end)"""


@query("snap_to_edges", f"with {SNAPPED} select venue_id, point_id, rank, shape_id, round(metres, 5) as metres, round(t, 5) as share from snapped")
def snap_to_edges(spark, folder):
    found = spatial.snap_to_edges(facility_points(spark, folder), edge_segments(spark, folder))
    return found.select("venue_id", "point_id", "rank", "shape_id", F.round("metres", 5).alias("metres"), F.round("share", 5).alias("share"))


@query("nearest_node_of_floor", f"""select venue_id, point_id, node_id, round(metres, 6) as metres from (select *, row_number() over (partition by venue_id, point_id order by metres, node_id) as rank from (
    select f.venue_id, f.facility_id as point_id, n.node_id, {HAV.format(a="f", b="n")} as metres from fx_facilities f join fx_nodes n on n.venue_id = f.venue_id and n.ordinal = f.ordinal)) where rank = 1""")
def nearest_node_of_floor(spark, folder):
    points = fixture(spark, folder, "fx_facilities").select("venue_id", "ordinal", F.col("facility_id").alias("point_id"), "lon", "lat")
    return spatial.nearest_nodes(points, fixture(spark, folder, "fx_nodes")).select("venue_id", "point_id", "node_id", F.round("metres", 6).alias("metres"))


def hubs(spark, folder):
    rings = unit_rings(spark, folder, "category in ('walkway', 'corridor', 'elevator', 'escalator', 'stairs')")
    centre = rings.select("venue_id", "shape_id", ((F.col("points")[0]["lon"] + F.col("points")[2]["lon"]) / 2).alias("centre_lon"), ((F.col("points")[0]["lat"] + F.col("points")[2]["lat"]) / 2).alias("centre_lat"))
    return spatial.ring_segments(rings).join(centre, ["venue_id", "shape_id"])


def middles(spark, folder):
    return fixture(spark, folder, "fx_openings").select("venue_id", "ordinal", F.col("opening_id").alias("point_id"), "lon", F.col("mid_lat").alias("lat"))


HUB = f"""{SEG}, near as (select o.venue_id, o.opening_id, o.lon, o.mid_lat as lat, s.* exclude (venue_id, ordinal) from fx_openings o join segs s on s.venue_id = o.venue_id and s.ordinal = o.ordinal
      where s.category in ('walkway', 'corridor', 'elevator', 'escalator', 'stairs')), {OFFSET},
    hit as (select distinct venue_id, opening_id, shape_id as hub_id, lon, lat from dist where metres <= 3.0e0)"""


@query("opening_hub_links", f"""with {HUB}, c as (select unit_id, (27953200 + i0 + 4) / 200000.0e0 as lon, (7136000 + j0 + 4) / 200000.0e0 as lat from fx_units)
    select h.venue_id, h.opening_id, h.hub_id, round({HAV.format(a="h", b="c")}, 5) as metres from hit h join c on c.unit_id = h.hub_id""")
def opening_hub_links(spark, folder):
    return spatial.opening_hub_links(middles(spark, folder), hubs(spark, folder))[0].withColumn("metres", F.round("metres", 5))


@query("openings_without_walkway", f"with {HUB} select venue_id, 'opening_without_walkway' as code, opening_id as subject from fx_openings o where not exists (select 1 from hit h where h.opening_id = o.opening_id)")
def openings_without_walkway(spark, folder):
    return spatial.opening_hub_links(middles(spark, folder), hubs(spark, folder))[1]


WALKED = "category in ('walkway', 'corridor', 'elevator', 'escalator', 'stairs')"


@query("shared_boundary_links", f"""with u as (select *, (27953200 + i0 + 4) / 200000.0e0 as lon, (7136000 + j0 + 4) / 200000.0e0 as lat from fx_units where {WALKED})
    select * from (select a.venue_id, a.ordinal, least(a.unit_id, b.unit_id) as shape_id, greatest(a.unit_id, b.unit_id) as other_id, cast(2 as bigint) as common, round({HAV.format(a="a", b="b")}, 5) as metres
    from u a join u b on b.level_id = a.level_id and ((b.col = a.col + 1 and b.row_no = a.row_no) or (b.col = a.col and b.row_no = a.row_no + 1)))""")
def shared_boundary_links(spark, folder):
    units = fixture(spark, folder, "fx_units").where(WALKED)
    corner = lambda i, j: F.struct(F.col(i).alias("qx"), F.col(j).alias("qy"))
    corners = units.select("venue_id", "ordinal", F.col("unit_id").alias("shape_id"), F.explode(F.array(corner("i0", "j0"), corner("i1", "j0"), corner("i1", "j1"), corner("i0", "j1"))).alias("p"))
    centres = units.select("venue_id", F.col("unit_id").alias("shape_id"), _at(F.col("i0") + 4, F.col("j0") + 4).alias("c")).select("venue_id", "shape_id", "c.*")
    return spatial.shared_boundary_links(corners.select("venue_id", "ordinal", "shape_id", "p.*"), centres).withColumn("metres", F.round("metres", 5))


TRANSIT = "category in ('elevator', 'escalator', 'stairs')"


@query("transit_touch_links", f"""with {SEG}, u as (select *, (27953200 + i0 + 4) / 200000.0e0 as lon, (7136000 + j0 + 4) / 200000.0e0 as lat from fx_units where {WALKED}),
    near as (select t.unit_id as transit_id, t.lon, t.lat, s.* from u t join segs s on s.venue_id = t.venue_id and s.ordinal = t.ordinal and s.shape_id <> t.unit_id where t.{TRANSIT} and s.{WALKED}), {OFFSET},
    pairs as (select distinct least(transit_id, shape_id) as a_id, greatest(transit_id, shape_id) as b_id from dist where metres <= 3.0e0)
    select * from (select a.venue_id, a.ordinal, a.unit_id as shape_id, b.unit_id as other_id, round({HAV.format(a="a", b="b")}, 5) as metres from pairs p join u a on a.unit_id = p.a_id join u b on b.unit_id = p.b_id
    where not (a.k % 2 = 0 and a.level_id = b.level_id and ((abs(b.col - a.col) = 1 and b.row_no = a.row_no) or (b.col = a.col and abs(b.row_no - a.row_no) = 1)))) where metres <= 30""")
def touching_unlinked(spark, folder):
    """With the shared boundaries of units of odd number left out, so that some touching pairs are not linked yet."""
    return touching(spark, folder, shared_boundary_links(spark, folder).where("cast(substr(shape_id, 2) as bigint) % 2 = 0"))


def touching(spark, folder, linked):
    units = fixture(spark, folder, "fx_units").where(TRANSIT)
    centres = units.select("venue_id", "ordinal", F.col("unit_id").alias("point_id"), _at(F.col("i0") + 4, F.col("j0") + 4).alias("c")).select("venue_id", "ordinal", "point_id", "c.*")
    return spatial.transit_touch_links(centres, hubs(spark, folder), linked).withColumn("metres", F.round("metres", 5))


def transit_touch_links(spark, folder):
    return touching(spark, folder, shared_boundary_links(spark, folder))


@query("vertical_candidates", f"""with u as (select *, (27953200 + i0 + 4) / 200000.0e0 as lon, (7136000 + j0 + 4) / 200000.0e0 as lat from fx_units where category in ('elevator', 'escalator', 'stairs')),
    adj as (select venue_id, ordinal as lower, lead(ordinal) over (partition by venue_id order by ordinal) as upper from (select distinct venue_id, ordinal from fx_levels))
    select * from (select a.venue_id, a.category, a.unit_id as lower_id, b.unit_id as upper_id, round({HAV.format(a="a", b="b")}, 5) as metres
    from u a join adj on adj.venue_id = a.venue_id and adj.lower = a.ordinal join u b on b.venue_id = a.venue_id and b.category = a.category and b.ordinal = adj.upper) where metres <= 5""")
def vertical_candidates(spark, folder):
    units = fixture(spark, folder, "fx_units").where("category in ('elevator', 'escalator', 'stairs')")
    rows = units.select("venue_id", "unit_id", "category", "ordinal", _at(F.col("i0") + 4, F.col("j0") + 4).alias("c")).select("venue_id", "unit_id", "category", "ordinal", "c.*")
    return spatial.vertical_candidates(rows, resolve.adjacent_ordinals(fixture(spark, folder, "fx_levels"))).withColumn("metres", F.round("metres", 5))


@query("opening_review", f"""with p as (select venue_id, opening_id, k, lon, 7136000 + j0 as j from fx_openings),
    a as (select venue_id, opening_id, lon, j / 200000.0e0 as lat from p), b as (select opening_id, lon + 0.00003e0 * (k % 2) as lon, (j + 4) / 200000.0e0 as lat from p), c as (select opening_id, lon, (j + 6 * (k % 3)) / 200000.0e0 as lat from p),
    m as (select a.venue_id, a.opening_id, {HAV.format(a="a", b="b")} + {HAV.format(a="b", b="c")} as arc, {HAV.format(a="a", b="c")} as chord from a join b using (opening_id) join c using (opening_id))
    select venue_id, opening_id, round(arc, 6) as arc, round(chord, 6) as chord, case when arc > 5 then 'too_long' else 'bent' end as reason from m where arc > 5 or (arc >= 2 and chord < 0.8e0 * arc)""")
def opening_review(spark, folder):
    rows = fixture(spark, folder, "fx_openings")
    lat = lambda extra: ((F.col("j0") + 7136000 + extra) / F.lit(200000.0)).alias("lat")
    points = F.array(F.struct("lon", lat(F.lit(0))), F.struct((F.col("lon") + F.lit(0.00003) * (F.col("k") % 2)).alias("lon"), lat(F.lit(4))), F.struct("lon", lat(6 * (F.col("k") % 3))))
    return spatial.opening_review(rows.withColumn("points", points))


@query("polyline_arclength", f"""with v as (select venue_id, level_id as line_id, rn as position, lon, lat from fx_nodes),
    legs as (select a.venue_id, a.line_id, a.position, coalesce((select {HAV.format(a="b", b="a")} from v b where b.line_id = a.line_id and b.position = a.position - 1), 0.0e0) as leg from v a)
    select venue_id, line_id, position, round(sum(leg) over (partition by venue_id, line_id order by position), 4) as along from legs""")
def polyline_arclength(spark, folder):
    vertices = fixture(spark, folder, "fx_nodes").select("venue_id", F.col("level_id").alias("line_id"), F.col("rn").alias("position"), "lon", "lat")
    return spatial.polyline_arclength(vertices).select("venue_id", "line_id", "position", F.round("along", 4).alias("along"))


@query("route_segments", """with r as (select venue_id as route_id, row_number() over (partition by venue_id order by (node_id * 7919) % 1009, node_id) as position, node_id, ordinal from fx_nodes),
    m as (select *, sum(case when o = ordinal then 0 else 1 end) over (partition by route_id order by position) as run from (select *, lag(ordinal) over (partition by route_id order by position) as o from r)),
    j as (select route_id, run, position, node_id, ordinal from m union all select m.route_id, m.run + 1, m.position, m.node_id, null from m where exists (select 1 from m n where n.route_id = m.route_id and n.position = m.position + 1 and n.run = m.run + 1))
    select route_id, run, max(ordinal) as ordinal, string_agg(cast(node_id as varchar), ',' order by position) as nodes from j group by 1, 2 having count(*) > 1""")
def route_segments(spark, folder):
    from pyspark.sql import Window

    order = Window.partitionBy("venue_id").orderBy((F.col("node_id") * 7919) % 1009, "node_id")
    route = fixture(spark, folder, "fx_nodes").select(F.col("venue_id").alias("route_id"), F.row_number().over(order).alias("position"), "node_id", "ordinal")
    return spatial.route_segments(route)


@query("vertical_links")
def vertical_links(spark, folder):
    return synthesis.vertical_links(vertical_candidates(spark, folder))


@query("hub_network")
def hub_network(spark, folder):
    return synthesis.hub_network(opening_hub_links(spark, folder), shared_boundary_links(spark, folder), transit_touch_links(spark, folder), vertical_links(spark, folder))


@query("band_pairs", f"select venue_id, source, target, round(metres, 5) as metres from (select a.venue_id, a.node_id as source, b.node_id as target, {HAV.format(a='a', b='b')} as metres from fx_nodes a join fx_nodes b on b.venue_id = a.venue_id and b.ordinal = a.ordinal and b.node_id > a.node_id) where metres > 10 and metres <= 20")
def band_pairs(spark, folder):
    return synthesis.band_pairs(fixture(spark, folder, "fx_nodes"), 10.0, 20.0).withColumn("metres", F.round("metres", 5))


@query("stretch_pairs", f"""with b as (select venue_id, source, target, metres from (select a.venue_id, a.node_id as source, b.node_id as target, {HAV.format(a='a', b='b')} as metres from fx_nodes a join fx_nodes b on b.venue_id = a.venue_id and b.ordinal = a.ordinal and b.node_id > a.node_id) where metres > 10 and metres <= 40)
    select venue_id, source, target, round(metres, 5) as metres from (select *, row_number() over (partition by venue_id order by source, target) as n from b where (source + target) % 3 <> 0) where n <= 50""")
def stretch_pairs(spark, folder):
    ways = lambda pairs: pairs.select("venue_id", "source", "target", F.when((F.col("source") + F.col("target")) % 3 != 0, F.col("metres")).alias("metres"))
    return synthesis.first_pairs(fixture(spark, folder, "fx_nodes"), 10.0, 40.0, ways).select("venue_id", "source", "target", F.round("metres", 5).alias("metres"))


@query("walkable", f"""with {SEG}, near as (select n.venue_id, n.node_id, n.lon, n.lat, s.* exclude (venue_id, ordinal) from fx_nodes n join segs s on s.venue_id = n.venue_id and s.ordinal = n.ordinal where s.category in ('walkway', 'corridor')), {OFFSET},
    inn as (select n.node_id, u.category from fx_nodes n join fx_units u on u.level_id = n.level_id and n.i > u.i0 and n.i < u.i1 and n.j > u.j0 and n.j < u.j1)
    select n.venue_id, n.node_id as point_id, (exists (select 1 from inn i where i.node_id = n.node_id and i.category in ('walkway', 'corridor')) or exists (select 1 from dist d where d.node_id = n.node_id and d.metres <= 0.3e0))
      and not exists (select 1 from inn i where i.node_id = n.node_id and i.category = 'room') as walkable from fx_nodes n""")
def walkable(spark, folder):
    floors = spatial.ring_segments(unit_rings(spark, folder, "category in ('walkway', 'corridor')"))
    return synthesis.walkable(node_points(spark, folder), floors, spatial.ring_segments(unit_rings(spark, folder, "category = 'room'")))


@query("near_wall", f"""with {SEG}, near as (select n.venue_id, n.node_id, n.lon, n.lat, s.* exclude (venue_id, ordinal) from fx_nodes n join segs s on s.venue_id = n.venue_id and s.ordinal = n.ordinal where s.category = 'room'), {OFFSET}
    select distinct venue_id, node_id as point_id from dist where metres <= 6.0e0 and node_id % 5 <> 0""")
def near_wall(spark, folder):
    locks = fixture(spark, folder, "fx_nodes").where("node_id % 5 = 0").withColumn("point_id", F.col("node_id"))
    return synthesis.near_wall(node_points(spark, folder), spatial.ring_segments(unit_rings(spark, folder, "category = 'room'")), locks, reach_m=6.0)


@query("ring_measures", "select unit_id, round((i1 - i0) * (j1 - j0) / 40000000000.0e0 * 1e9, 6) as area_e9, round((27953200 + (i0 + i1) / 2.0e0) / 200000.0e0, 9) as lon, round((7136000 + (j0 + j1) / 2.0e0) / 200000.0e0, 9) as lat from fx_units")
def ring_measures(spark, folder):
    rings = unit_rings(spark, folder).withColumn("c", geometry.ring_centroid(F.col("points")))
    return rings.select(F.col("shape_id").alias("unit_id"), F.round(geometry.ring_area(F.col("points")) * 1e9, 6).alias("area_e9"), F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


@query("geometry_center", "select unit_id, case when k % 4 <> 0 then round((27953200 + (i0 + i1) / 2.0e0) / 200000.0e0, 9) end as lon, case when k % 4 <> 0 then round((7136000 + (j0 + j1) / 2.0e0) / 200000.0e0, 9) end as lat from fx_units")
def geometry_center(spark, folder):
    odd = F.array(F.struct(F.lit(float("nan")).alias("lon"), F.lit(1.0).alias("lat")))
    rings = unit_rings(spark, folder).join(fixture(spark, folder, "fx_units").select(F.col("unit_id").alias("shape_id"), "k"), "shape_id")
    points = F.when(F.col("k") % 4 == 0, odd).otherwise(F.concat(F.col("points"), odd))
    return rings.withColumn("c", geometry.geometry_center(points)).select(F.col("shape_id").alias("unit_id"), F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


@query("sample_line", f"""with p as (select o.opening_id, o.lon, (7136000 + j0) / 200000.0e0 as lat, (7136000 + j1) / 200000.0e0 as lat2 from fx_openings o), n as (select p.*, cast(ceil({HAV.format(a="p", b="q")} / 0.5e0) as bigint) as n from p join (select opening_id, lon, lat2 as lat from p) q using (opening_id))
    select opening_id, n + 1 as ends_included, n as middles from n""")
def sample_line(spark, folder):
    lat = lambda j: ((F.col(j) + 7136000) / F.lit(200000.0)).alias("lat")
    a, b = F.struct("lon", lat("j0")), F.struct("lon", lat("j1"))
    return fixture(spark, folder, "fx_openings").select("opening_id", F.size(geometry.sample_line(a, b, 0.5)).alias("ends_included"), F.size(geometry.sample_cells(a, b, 0.5)).alias("middles"))
