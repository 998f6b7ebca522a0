"""Registered queries over building-model tiles, wall tables and source layers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.operators import gdbplan, registration
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


def triangles(spark, folder):
    """Two triangles for each order line, 8 m by 8 m together."""
    rows = fixture(spark, folder, "fx_triangles")
    point = lambda dx, dy: F.struct(*[(F.col(c) + d).cast("double").alias(n) for c, d, n in (("x0", dx, "x"), ("y0", dy, "y"))], (F.col("z_mm") / F.lit(1000.0)).alias("z"))
    upper = F.col("half") == 1
    third = F.when(upper, point(0, 8)).otherwise(point(8, 8))
    second = F.when(upper, point(8, 8)).otherwise(point(8, 0))
    return rows.select("venue_id", "member", "level_key", "feature_id", "line_no", "category", point(0, 0).alias("a"), second.alias("b"), third.alias("c"))


PLANE = """bins as (select venue_id, level_key, cast(floor(z_mm / 1000.0e0 / 0.01e0 + 0.5e0) as bigint) as bin, count(*) * 32.0e0 as area from fx_triangles where category in ('Floors') group by 1, 2, 3),
plane as (select venue_id, level_key, round(arg_min(bin, -area * 1000000 + bin) * 0.01e0, 6) as plane_m, max(area) as area from bins group by 1, 2)"""


@query("resolve_tile_planes", f"with {PLANE} select t.venue_id, t.level_key, p.plane_m, p.area from (select distinct venue_id, level_key from fx_triangles) t left join plane p on p.venue_id = t.venue_id and p.level_key = t.level_key")
def resolve_tile_planes(spark, folder):
    return registration.resolve_tile_planes(triangles(spark, folder))


@query("boundary_edges", """with c as (select venue_id, level_key, cast(x0 * 1000 as varchar) as xa, cast((x0 + 8) * 1000 as varchar) as xb, cast(y0 * 1000 as varchar) as ya, cast((y0 + 8) * 1000 as varchar) as yb, ',' || cast(z_mm as varchar) as z, half from fx_triangles),
    p as (select venue_id, level_key, xa || ',' || ya || z as p, case half when 1 then xb || ',' || yb || z else xb || ',' || ya || z end as q, case half when 1 then xa || ',' || yb || z else xb || ',' || yb || z end as r from c),
    e as (select venue_id, level_key, unnest([[least(p, q), greatest(p, q)], [least(q, r), greatest(q, r)], [least(r, p), greatest(r, p)]]) as e from p)
    select venue_id, level_key, e[1] as u, e[2] as v from e group by 1, 2, 3, 4 having count(*) = 1""")
def boundary_edges(spark, folder):
    return registration.boundary_edges(triangles(spark, folder))


def planes(spark, folder):
    return resolve_tile_planes(spark, folder).where("plane_m is not null").select("venue_id", "level_key", "plane_m")


def floor_planes(spark, folder):
    """Venue floors 4.2 m apart, with one more a metre above the ground floor."""
    rows = fixture(spark, folder, "fx_levels").select("venue_id", "ordinal", (F.col("ordinal") * 4.2).alias("plane_m"))
    return rows.union(rows.where("ordinal = 0").select("venue_id", F.lit(0.5).alias("ordinal"), F.lit(1.0).alias("plane_m")))


MATCH = f"""{PLANE}, fl as (select venue_id, ordinal, ordinal * 4.2e0 as floor_m from fx_levels union all select venue_id, 0.5e0, 1.0e0 from fx_levels where ordinal = 0),
near as (select p.venue_id, p.level_key, p.plane_m, f.ordinal, abs(p.plane_m - f.floor_m) as gap from plane p join fl f on f.venue_id = p.venue_id and abs(p.plane_m - f.floor_m) <= 1.5e0),
matched as (select p.venue_id, p.level_key, p.plane_m, case when count(n.gap) = 0 then 'unmapped' when count(n.gap) > 1 then 'ambiguous' else 'mapped' end as state, arg_min(n.ordinal, n.gap * 1000 + n.ordinal / 1000) as ordinal, round(min(n.gap), 6) as gap_m
  from plane p left join near n on n.venue_id = p.venue_id and n.level_key = p.level_key group by 1, 2, 3)"""


@query("match_tile_levels", f"with {MATCH} select venue_id, level_key, state, ordinal, gap_m from matched")
def match_tile_levels(spark, folder):
    return registration.match_tile_levels(planes(spark, folder), floor_planes(spark, folder))


@query("label_corroboration", f"""with {MATCH}, t as (select venue_id, level_key, ordinal, cast(substr(level_key, 2) as int) as n from matched)
    select venue_id, level_key, case when n < 2 then case when ordinal = n - 2 then 'agrees' else 'contradicts' end when n = 4 then 'unknown' when n = 5 then 'unknown'
      else case when ordinal = n - 2 then 'agrees' else 'contradicts' end end as verdict from t""")
def label_corroboration(spark, folder):
    named = F.expr("case level_key when 'T0' then 'b2fl' when 'T1' then 'B1 East' when 'T2' then 'L1' when 'T3' then '2F' when 'T4' then 'roof' else '' end")
    tiles = match_tile_levels(spark, folder).select("venue_id", "level_key", "ordinal", named.alias("label"))
    floors = fixture(spark, folder, "fx_levels").select("venue_id", "ordinal", F.regexp_replace("short_name", "^F([0-9]+)$", "$1F").alias("label"))
    return registration.label_corroboration(tiles, floors)


@query("level_order_check", f"with {MATCH} select venue_id, level_key, b as before, o as ordinal from (select venue_id, level_key, o, lag(o) over (partition by venue_id order by plane_m, level_key) as b from (select *, case level_key when 'T3' then -1e0 else ordinal end as o from matched) where o is not null) where b > o")
def level_order_check(spark, folder):
    rows = match_tile_levels(spark, folder).join(planes(spark, folder), ["venue_id", "level_key"])
    return registration.level_order_check(rows.withColumn("ordinal", F.when(F.col("level_key") == "T3", -1.0).otherwise(F.col("ordinal"))))


SAMPLES = "s as (select venue_id, level_key, (feature_id * 7919 + line_no * 31) % 1000 / 500.0e0 as residual_m, cast(x0 * 10 as double) as x, cast(y0 * 10 as double) as y, ((feature_id % 5) + 1) / 2.0e0 as dx, ((line_no % 3) - 1) / 2.0e0 as dy from fx_triangles where half = 0)"


def samples(spark, folder):
    rows = fixture(spark, folder, "fx_triangles").where("half = 0")
    d = lambda c, by: c / F.lit(by)
    return rows.select(
        "venue_id", "level_key", d((F.col("feature_id") * 7919 + F.col("line_no") * 31) % 1000, 500.0).alias("residual_m"), (F.col("x0") * 10).cast("double").alias("x"), (F.col("y0") * 10).cast("double").alias("y"),
        d(F.col("feature_id") % 5 + 1, 2.0).alias("dx"), d(F.col("line_no") % 3 - 1, 2.0).alias("dy"),
    )


@query("residual_stats", f"""with {SAMPLES}, r as (select *, count(*) over (partition by venue_id, level_key) as c, row_number() over (partition by venue_id, level_key order by residual_m) as k from s)
    select venue_id, level_key, max(c) as n, max(case when k = cast(ceil(c * 0.5e0) as bigint) then residual_m end) as p50, max(case when k = cast(ceil(c * 0.9e0) as bigint) then residual_m end) as p90, max(residual_m) as max from r group by 1, 2""")
def residual_stats(spark, folder):
    return registration.residual_stats(samples(spark, folder), "venue_id", "level_key")


@query("coherent_clusters", f"with {SAMPLES} select * from (select venue_id, level_key, cast(floor(x / 40.0e0) as bigint) as cx, cast(floor(y / 40.0e0) as bigint) as cy, count(*) as n, median(dx) as dx, median(dy) as dy from s group by 1, 2, 3, 4) where n >= 5 and sqrt(dx * dx + dy * dy) > 1")
def coherent_clusters(spark, folder):
    return registration.coherent_clusters(samples(spark, folder))


CORNERS = "[[i0, j0], [i1, j0], [i1, j1], [i0, j1]]"


@query("wall_edges", """with e as (select venue_id, level_id, height, k % 9 = 0 as plat, unnest([[p00, p10], [p10, p11], [p11, p01], [p01, p00]]) as e from
      (select *, cast(i0 as varchar) || ',' || cast(j0 as varchar) as p00, cast(i1 as varchar) || ',' || cast(j0 as varchar) as p10, cast(i1 as varchar) || ',' || cast(j1 as varchar) as p11, cast(i0 as varchar) || ',' || cast(j1 as varchar) as p01 from fx_units))
    select venue_id, level_id, least(e[1], e[2]) as u, greatest(e[1], e[2]) as v, min(coalesce(height, 3.0e0)) as height_m, bool_or(height is null) as assumed, count(*) as owners from e group by 1, 2, 3, 4 having not bool_and(plat)""")
def wall_edges(spark, folder):
    units = fixture(spark, folder, "fx_units")
    p = lambda i, j: F.concat_ws(",", i, j)
    a, b, c, d = p("i0", "j0"), p("i1", "j0"), p("i1", "j1"), p("i0", "j1")
    sides = F.array(*[F.struct(x.alias("u"), y.alias("v")) for x, y in ((a, b), (b, c), (c, d), (d, a))])
    rows = units.select("venue_id", "level_id", F.when(F.col("k") % 9 == 0, "platform").otherwise(F.col("category")).alias("category"), "height", F.explode(sides).alias("s"))
    return registration.wall_edges(rows.select("venue_id", "level_id", "category", "height", "s.*"))


@query("batch_quantize", """with v as (select venue_id, level_key, category as role, feature_id * 100 + line_no * 2 + half as vertex_id, cast(x0 as double) as x, cast(y0 as double) as y, z_mm / 1000.0e0 as z from fx_triangles),
    b as (select venue_id, level_key, role, min(x) as ax, max(x) as bx, min(y) as ay, max(y) as cy, min(z) as az, max(z) as bz from v group by 1, 2, 3)
    select v.venue_id, v.level_key, v.role, vertex_id, cast(round((x - ax) / case when bx > ax then (bx - ax) / 65535.0e0 else 1.0e0 end) as int) as qx, cast(round((y - ay) / case when cy > ay then (cy - ay) / 65535.0e0 else 1.0e0 end) as int) as qy,
           cast(round((z - az) / case when bz > az then (bz - az) / 65535.0e0 else 1.0e0 end) as int) as qz from v join b on b.venue_id = v.venue_id and b.level_key = v.level_key and b.role = v.role""")
def batch_quantize(spark, folder):
    rows = fixture(spark, folder, "fx_triangles")
    return registration.batch_quantize(rows.select("venue_id", "level_key", F.col("category").alias("role"), (F.col("feature_id") * 100 + F.col("line_no") * 2 + F.col("half")).alias("vertex_id"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"), (F.col("z_mm") / F.lit(1000.0)).alias("z")))


@query("project_local_mm", """with c as (select node_id, radians(lon) as l, radians(lat) as p, radians(139.7665e0) as l0, radians(35.6805e0) as p0, (1 / 298.257223563e0) * (2 - 1 / 298.257223563e0) as e2 from fx_nodes),
    n as (select *, 6378137.0e0 / sqrt(1 - e2 * pow(sin(p), 2)) as n, 6378137.0e0 / sqrt(1 - e2 * pow(sin(p0), 2)) as n0 from c),
    d as (select *, n * cos(p) * cos(l) - n0 * cos(p0) * cos(l0) as x, n * cos(p) * sin(l) - n0 * cos(p0) * sin(l0) as y, n * (1 - e2) * sin(p) - n0 * (1 - e2) * sin(p0) as z from n)
    select node_id, cast(round((-sin(l0) * x + cos(l0) * y) * 1000) as bigint) as east_mm, cast(round((-sin(p0) * cos(l0) * x - sin(p0) * sin(l0) * y + cos(p0) * z) * 1000) as bigint) as north_mm from d""")
def project_local_mm(spark, folder):
    east, north = registration.project_local_mm(F.col("lon"), F.col("lat"), F.lit(139.7665), F.lit(35.6805))
    return fixture(spark, folder, "fx_nodes").select("node_id", east.alias("east_mm"), north.alias("north_mm"))


@query("apply_transform", "select node_id, case when node_id % 3 = 0 then cast(i as double) else -j + 10.0e0 end as x, case when node_id % 3 = 0 then cast(j as double) else i + 20.0e0 end as y, case when node_id % 3 = 0 then ordinal else ordinal * 2 + 30.0e0 end as z from fx_nodes")
def apply_transform(spark, folder):
    matrix = F.when(F.col("node_id") % 3 != 0, F.array(*[F.lit(float(v)) for v in (0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 2, 0, 10, 20, 30, 1)]))
    x, y, z = registration.apply_transform(matrix, F.col("i").cast("double"), F.col("j").cast("double"), F.col("ordinal"))
    return fixture(spark, folder, "fx_nodes").select("node_id", x.alias("x"), y.alias("y"), z.alias("z"))


TYPES = """t as (select *, case when contains(lower(layer_name), '_to_') then 'detail' when lower(layer_name) like '%\\_floor' escape '\\' then 'level' when lower(layer_name) like '%\\_space' escape '\\' then 'unit'
      when lower(layer_name) like '%\\_opening' escape '\\' then 'opening' when lower(layer_name) like '%\\_drawing' escape '\\' then 'detail' when lower(layer_name) like '%\\_facility' escape '\\' then 'amenity' end as target_type, contains(lower(layer_name), '_to_') as crosses,
      regexp_extract(layer_name, '^(Station[0-9])_(B1|F2|M2|R|0)_(Floor|Space|Opening|Drawing|Facility)$', 1) as b, regexp_extract(layer_name, '^(Station[0-9])_(B1|F2|M2|R|0)_(Floor|Space|Opening|Drawing|Facility)$', 2) as tok from fx_layers),
   plan as (select *, nullif(b, '') as building, cast(case tok when 'B1' then -1 when 'F2' then 1 when 'M2' then 2 when '0' then 0 end as double) as ordinal,
      case target_type when 'level' then 'polygon' when 'unit' then 'polygon' when 'opening' then 'line' when 'detail' then 'line' when 'amenity' then 'point' end as needs from t)"""


@query("suggest_plan", f"with {TYPES} select layer_name, pos, target_type, building, ordinal, coalesce(needs = family, false) and not crosses and feature_count > 0 as included from plan")
def suggest_plan(spark, folder):
    return gdbplan.suggest_plan(fixture(spark, folder, "fx_layers")).select("layer_name", "pos", "target_type", "building", "ordinal", "included")


@query("plan_issues", f"""with {TYPES}, p as (select * from plan where pos % 3 <> 0)
    select layer_name, 'type_missing' as code from p where target_type is null union all select layer_name, 'geometry_mismatch' from p where target_type is not null and coalesce(needs, '') <> family
    union all select layer_name, 'building_missing' from p where target_type = 'level' and building is null union all select layer_name, 'ordinal_missing' from p where target_type = 'level' and ordinal is null""")
def plan_issues(spark, folder):
    plan = gdbplan.suggest_plan(fixture(spark, folder, "fx_layers")).withColumn("included", F.col("pos") % 3 != 0)
    return gdbplan.plan_issues(plan)


@query("layer_catalog", """select 'L' || cast(p_partkey % 17 as varchar) as layer_name, count(*) as features, case when p_partkey % 17 = 3 then 'none' when count(distinct p_size % 3) = 1 or p_partkey % 17 < 3 then 'polygon' else 'mixed' end as family,
    coalesce(string_agg(distinct case when p_size % 4 <> 0 then 'F' || cast(p_size % 4 as varchar) end, ','  order by case when p_size % 4 <> 0 then 'F' || cast(p_size % 4 as varchar) end), '') as floors from part group by p_partkey % 17""")
def layer_catalog(spark, folder):
    n = F.col("p_partkey") % 17
    geometry = F.when(n == 3, None).when(n < 3, "polygon").otherwise(F.element_at(F.array(F.lit("polygon"), F.lit("line"), F.lit("point")), (F.col("p_size") % 3 + 1).cast("int")))
    floor = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit(" F"), (F.col("p_size") % 4).cast("string"))).otherwise(" ")
    rows = fixture(spark, folder, "part").select(F.concat(F.lit("L"), n.cast("string")).alias("layer_name"), geometry.alias("geometry"), floor.alias("floor"))
    return gdbplan.layer_catalog(rows)


@query("synthetic_rectangles", """with s as (select venue_id, level_id, cast(i0 as double) as west, cast(j0 as double) as south, case when level_id = 'L3' then cast(i0 as double) else cast(i1 as double) end as east, cast(j1 as double) as north from fx_units where level_id <> 'L3' or k = 3),
    l as (select venue_id, level_id, min(west) as west, min(south) as south, max(east) as east, max(north) as north from s group by 1, 2)
    select venue_id, level_id, west, south, case when east = west then east + 1e-6 else east end as east, case when north = south then north + 1e-6 else north end as north from
    (select * from l union all select venue_id, null, min(west), min(south), max(east), max(north) from l group by 1)""")
def synthetic_rectangles(spark, folder):
    units = fixture(spark, folder, "fx_units").where("level_id <> 'L3' or k = 3")
    east = F.when(F.col("level_id") == "L3", F.col("i0")).otherwise(F.col("i1")).cast("double")
    return gdbplan.synthetic_rectangles(units.select("venue_id", "level_id", F.col("i0").cast("double").alias("west"), F.col("j0").cast("double").alias("south"), east.alias("east"), F.col("j1").cast("double").alias("north")))


@query("building_rectangles", """with s as (select venue_id, 'H' || (k % 3) as building_id, level_id, i0, j0, i1, j1 from fx_units) select venue_id, building_id, level_id, min(i0)::double as west, min(j0)::double as south, max(i1)::double as east, max(j1)::double as north from s group by grouping sets ((1, 2, 3), (1, 2), (1))""")
def building_rectangles(spark, folder):
    box = [F.col(c).cast("double").alias(n) for c, n in (("i0", "west"), ("j0", "south"), ("i1", "east"), ("j1", "north"))]
    return gdbplan.synthetic_rectangles(fixture(spark, folder, "fx_units").select("venue_id", F.concat(F.lit("H"), (F.col("k") % 3).cast("string")).alias("building_id"), "level_id", *box))


@query("drop_geometryless", "select 'L' || cast(p_partkey % 5 as varchar) as layer_name, count(*) filter (where p_partkey % 5 = 4 or p_partkey % 3 = 0) as skipped, count(*) filter (where not (p_partkey % 5 = 4 or p_partkey % 3 = 0)) as kept, count(*) filter (where not (p_partkey % 5 = 4 or p_partkey % 3 = 0)) = 0 as failed from part group by p_partkey % 5")
def drop_geometryless(spark, folder):
    p = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.lit(float("nan"))).otherwise(float("inf")).alias("lon"), F.lit(1.0).alias("lat"))
    good = F.struct(F.lit(139.0).alias("lon"), F.lit(35.0).alias("lat"))
    bad = (F.col("p_partkey") % 5 == 4) | (F.col("p_partkey") % 3 == 0)
    positions = F.when(bad & (F.col("p_partkey") % 7 == 0), None).when(bad, F.array(p)).otherwise(F.array(p, good))
    rows = fixture(spark, folder, "part").select(F.concat(F.lit("L"), (F.col("p_partkey") % 5).cast("string")).alias("layer_name"), positions.alias("positions"))
    return gdbplan.drop_geometryless(rows)[1]


@query("uuid_census", """with r as (select doc_id as pos, 'L' || cast(doc_id % 3 as varchar) as layer_name, case when doc_id % 4 = 0 then null else '0f8fad5b-d9cb-469f-a165-' || lpad(cast(doc_id - doc_id % 10 % 3 as varchar), 12, '0') end as own from documents),
    o as (select own from r where own is not null group by 1 having count(*) = 1), d as (select *, sha256(layer_name || ':' || cast(pos as varchar)) as h from r)
    select layer_name, pos, case when o.own is not null then d.own else substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) end as feature_id, o.own is not null as preserved
    from d left join o on o.own = d.own""")
def uuid_census(spark, folder):
    n = F.col("doc_id") - F.col("doc_id") % 10 % 3
    own = F.when(F.col("doc_id") % 4 != 0, F.upper(F.concat(F.lit("0f8fad5bd9cb469fa165"), F.lpad(n.cast("string"), 12, "0"))))
    rows = fixture(spark, folder, "documents").select(F.concat(F.lit("L"), (F.col("doc_id") % 3).cast("string")).alias("layer_name"), F.col("doc_id").alias("pos"), own.alias("source_id"))
    return gdbplan.uuid_census(rows)
