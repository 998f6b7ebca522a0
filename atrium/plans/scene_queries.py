"""Registered scene and serving queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.operators import scene, spatial
from atrium.plans.fixtures import fixture, oracle
from atrium.plans.network_queries import CLEAN, clean
from atrium.plans.spatial_queries import TRANSIT, unit_rings
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


def frames(spark, folder):
    return fixture(spark, folder, "region").select(F.concat(F.lit("V"), F.col("r_regionkey").cast("string")).alias("venue_id"), F.lit(139.7665).alias("lon0"), F.lit(35.6805).alias("lat0"))


@query("conveyance_links", f"""with {CLEAN}, v as (select g.venue_id, g.path_id, a.ordinal as ao, b.ordinal as bo, a.i as ai, a.j as aj, b.i as bi, b.j as bj from good_edges g join good_nodes a on a.venue_id = g.venue_id and a.node_id = g.from_id join good_nodes b on b.venue_id = g.venue_id and b.node_id = g.to_id where a.ordinal <> b.ordinal),
    e as (select venue_id, path_id, ao as o, ai as i, aj as j, bo as far from v union all select venue_id, path_id, bo, bi, bj, ao from v),
    h as (select e.*, u.unit_id, row_number() over (partition by u.unit_id order by abs(far - o), far, path_id) as n from e join fx_units u on u.venue_id = e.venue_id and u.ordinal = e.o and e.i > u.i0 and e.i < u.i1 and e.j > u.j0 and e.j < u.j1 where u.k % 3 <> 1)
    select venue_id, unit_id, path_id, far as far_ordinal, case when far > o then 'up' else 'down' end as arrow from h where n = 1""")
def conveyance_links(spark, folder):
    nodes, edges = clean(spark, folder)
    end = lambda key, name: nodes.select("venue_id", F.col("node_id").alias(key), F.col("ordinal").alias(f"{name}_ordinal"), F.col("lon").alias(f"{name}_lon"), F.col("lat").alias(f"{name}_lat"))
    links = edges.join(end("from_id", "low"), ["venue_id", "from_id"]).join(end("to_id", "high"), ["venue_id", "to_id"]).where("low_ordinal <> high_ordinal")
    units = fixture(spark, folder, "fx_units").where("k % 3 <> 1")
    names = units.select("venue_id", F.col("unit_id").alias("shape_id"))
    segments = spatial.ring_segments(unit_rings(spark, folder).join(names, ["venue_id", "shape_id"], "left_semi"))
    return scene.conveyance_links(units.select("venue_id", "ordinal", "unit_id"), segments, links)


@query("portals", """select o.venue_id, opening_id, min(unit_id) as first, case when count(*) > 1 then max(unit_id) end as second from fx_openings o
    join fx_units u on u.level_id = o.level_id and (u.i0 = o.i or u.i1 = o.i) and u.j0 = o.j0 - 2 group by 1, 2""")
def portals(spark, folder):
    lat = lambda c: (F.col(c) + 7136000) / F.lit(200000.0)
    openings = fixture(spark, folder, "fx_openings").select("venue_id", "ordinal", "opening_id", F.col("lon").alias("ax"), lat("j0").alias("ay"), F.col("lon").alias("bx"), lat("j1").alias("by"))
    return scene.portals(openings, spatial.ring_segments(unit_rings(spark, folder)), frames(spark, folder))


_WALLS = """w as (select venue_id, level_id as level_key, k, e, cast(case e when 0 then i0 when 1 then i1 when 2 then i1 else i0 end as double) as ax, cast(case e when 0 then j0 when 1 then j0 when 2 then j1 else j1 end as double) as ay,
    cast(case e when 0 then i1 when 1 then i1 when 2 then i0 else i0 end as double) as bx, cast(case e when 0 then j0 when 1 then j1 when 2 then j1 else j0 end as double) as b_y from fx_units, range(4) t(e) where category is not null and level_id <> 'L7'),
    n as (select venue_id, level_id as level_key, node_id as sample_id, cast(i as double) + 0.25e0 as x, cast(j as double) - 0.25e0 as y from fx_nodes)"""


@query("residuals", f"""with {_WALLS}, s as (select n.*, w.ax, w.ay, w.bx, w.b_y, case when pow(bx - ax, 2) + pow(b_y - ay, 2) > 0 then greatest(0.0e0, least(1.0e0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) else 0.0e0 end as t from n join w using (venue_id, level_key)),
    d as (select venue_id, level_key, sample_id, min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2))) as r from s group by 1, 2, 3),
    inn as (select n.sample_id, count(*) % 2 = 1 as odd from n join fx_units u on u.level_id = n.level_key and u.category is not null and x > i0 and x < i1 and y > j0 and y < j1 group by 1)
    select n.venue_id, n.level_key, n.sample_id, d.r is null or (d.r > 1 and not coalesce(inn.odd, false)) as carved, case when not (d.r is null or (d.r > 1 and not coalesce(inn.odd, false))) then round(d.r, 6) end as residual_m
    from n left join d using (venue_id, level_key, sample_id) left join inn on inn.sample_id = n.sample_id""")
def residuals(spark, folder):
    units = fixture(spark, folder, "fx_units").where("category is not null and level_id <> 'L7'")
    corner = lambda i, j: F.struct(F.col(i).cast("double").alias("x"), F.col(j).cast("double").alias("y"))
    p = [corner("i0", "j0"), corner("i1", "j0"), corner("i1", "j1"), corner("i0", "j1")]
    sides = F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in zip(p, [*p[1:], p[0]])])).alias("s")
    walls = units.select("venue_id", F.col("level_id").alias("level_key"), sides).select("venue_id", "level_key", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    samples = fixture(spark, folder, "fx_nodes").select("venue_id", F.col("level_id").alias("level_key"), F.col("node_id").alias("sample_id"), (F.col("i") + 0.25).alias("x"), (F.col("j") - 0.25).alias("y"))
    return scene.residuals(samples, walls).select("venue_id", "level_key", "sample_id", "carved", F.round("residual_m", 6).alias("residual_m"))


@query("rank_room_crossings", f"""with {CLEAN}, e as (select p.venue_id, p.path_id, case p.path_id % 8 when 0 then 'doorway' when 2 then 'bridge' when 4 then 'chord' else 'skeleton' end as kind, cast(p.cost as double) as w, a.level_id, (a.i + b.i) / 2.0e0 as i, (a.j + b.j) / 2.0e0 as j
      from good_edges p join good_nodes a on a.venue_id = p.venue_id and a.node_id = p.from_id join good_nodes b on b.venue_id = p.venue_id and b.node_id = p.to_id where p.variant = 0 and a.ordinal = b.ordinal),
    h as (select e.*, kind <> 'doorway' and exists (select 1 from fx_units u where u.level_id = e.level_id and (u.category = 'room' or u.category is null) and e.i > u.i0 and e.i < u.i1 and e.j > u.j0 and e.j < u.j1) as hit from e where i % 8 <> 0 and j % 8 <> 0)
    select venue_id, path_id as edge_id, case when hit then 'secondary' else 'primary' end as rank, case when hit then w * 3 else w end as weight from h""")
def rank_room_crossings(spark, folder):
    """Edges whose middle lies on a grid line are left out: on a shape's boundary both sides are right."""
    nodes, edges = clean(spark, folder)
    end = lambda key, n: nodes.select("venue_id", F.col("node_id").alias(key), F.col("ordinal").alias(f"o{n}"), F.col("lon").alias(f"{n}x"), F.col("lat").alias(f"{n}y"), F.col("i").alias(f"{n}i"), F.col("j").alias(f"{n}j"))
    kind = F.expr("case path_id % 8 when 0 then 'doorway' when 2 then 'bridge' when 4 then 'chord' else 'skeleton' end")
    both = edges.where("variant = 0").join(end("from_id", "a"), ["venue_id", "from_id"]).join(end("to_id", "b"), ["venue_id", "to_id"]).where("oa = ob and ((ai + bi) / 2) % 8 <> 0 and ((aj + bj) / 2) % 8 <> 0")
    rows = both.select("venue_id", F.col("oa").alias("ordinal"), F.col("path_id").alias("edge_id"), kind.alias("kind"), F.col("cost").cast("double").alias("weight"), "ax", "ay", "bx", "by")
    return scene.rank_room_crossings(rows, spatial.ring_segments(unit_rings(spark, folder, "category = 'room' or category is null")))


def tile_features(spark, folder):
    rows = fixture(spark, folder, "fx_triangles").where("half = 0")
    link = F.when(F.col("line_no") % 3 == 0, "").otherwise(F.col("member"))
    return rows.select("venue_id", (F.col("feature_id") * 10 + F.col("line_no")).alias("pos"), "level_key", F.concat(F.lit("name "), "level_key").alias("level_name"), F.when(F.col("line_no") == 1, "").otherwise("doc.rvt").alias("document"), link.alias("link"), (F.col("z_mm") / F.lit(1000.0)).alias("min_z"), "category")


_TILES = "f as (select venue_id, feature_id * 10 + line_no as pos, level_key, case when line_no = 1 then '' else 'doc.rvt' end as document, case when line_no % 3 = 0 then '' else member end as link, z_mm / 1000.0e0 as z, category from fx_triangles where half = 0)"


@query("scene_levels", f"""with {_TILES}, r as (select l.venue_id, 'T' || (pos % 4) as level_key, min(pos) as pos from fx_levels l group by 1, 2),
    a as (select venue_id, level_key, arg_min(z, pos) as z, coalesce(arg_min(document, pos) filter (where document <> ''), '') as document, coalesce(arg_min(link, pos) filter (where link <> ''), '') as link from f group by 1, 2)
    select coalesce(r.venue_id, a.venue_id) as venue_id, coalesce(r.level_key, a.level_key) as level_key, case when r.pos is not null then 'declared' || r.pos else 'name ' || a.level_key end as level_name, case when r.pos is not null then r.pos / 2.0e0 else a.z end as plane_m,
      coalesce(a.document, '') as document, coalesce(a.link, '') as link, r.pos is not null as declared from r full join a on a.venue_id = r.venue_id and a.level_key = r.level_key""")
def scene_levels(spark, folder):
    levels = fixture(spark, folder, "fx_levels").select("venue_id", "pos", F.concat(F.lit("T"), (F.col("pos") % 4).cast("string")).alias("level_key"), F.concat(F.lit("declared"), F.col("pos").cast("string")).alias("level_name"), (F.col("pos") / F.lit(2.0)).alias("plane_m"))
    return scene.scene_levels(levels, tile_features(spark, folder))


@query("assign_tile_scene", f"""with {_TILES}, l as (select distinct venue_id, document, link, level_key from f where level_key <> 'T5' and document <> '')
    select f.venue_id, f.pos as object_id, case when l.venue_id is null then 0 else cast(substr(f.level_key, 2) as int) + 10 end as level_index, case when pos % 5 = 0 then 'C' || pos end as canonical_id,
      pos % 10 = 0 as overridden from f left join l on l.venue_id = f.venue_id and l.document = f.document and l.link = f.link and l.level_key = f.level_key""")
def assign_tile_scene(spark, folder):
    rows = tile_features(spark, folder)
    features = rows.select("venue_id", F.col("pos").alias("object_id"), "document", "link", "level_key", F.lit(1.26).alias("elevation_m"), "category")
    levels = rows.where("level_key <> 'T5' and document <> ''").select("venue_id", "document", "link", "level_key").distinct().withColumns({"elevation_dm": F.lit(13), "level_index": F.substring("level_key", 2, 9).cast("int") + 10})
    told = rows.where("pos % 5 = 0").select("venue_id", F.col("pos").alias("object_id"), F.concat(F.lit("C"), F.col("pos").cast("string")).alias("canonical_id"), F.when(F.col("pos") % 10 == 0, "hidden").alias("occlusion"))
    found = scene.assign_tile_scene(features, levels, told.dropDuplicates(["venue_id", "object_id"]))
    return found.select("venue_id", "object_id", "level_index", "canonical_id", (F.col("occlusion") == "hidden").alias("overridden"))


@query("venue_floor_rings", f"""with {PLANES}, z as (select venue_id, level_id, height_mm from planes where level_id <> 'L7')
    select u.venue_id, u.level_id, z.height_mm / 1000.0e0 as plane_m, count(*) as rings, (select l.short_name || coalesce('|' || coalesce(l.label_en, l.label_ja), '') from fx_levels l where l.level_id = u.level_id) as labels from fx_units u join z on z.level_id = u.level_id group by 1, 2, 3""")
def venue_floor_rings(spark, folder):
    planes = level_planes(spark, folder).where("level_id <> 'L7'")
    ordinals = fixture(spark, folder, "fx_levels").select("venue_id", "level_id", "ordinal")
    rows = planes.select("venue_id", "level_id", "scene_z_mm", (F.col("height_mm") - F.col("scene_z_mm")).alias("offset_mm")).join(ordinals, ["venue_id", "level_id"])
    text = lambda **pairs: F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    labels = fixture(spark, folder, "fx_levels").select("venue_id", "level_id", text(en=F.col("label_en"), ja=F.col("label_ja")).alias("names"), text(en=F.col("short_name"), ja=F.lit(" ")).alias("short_names"))
    found = scene.venue_floor_rings(unit_rings(spark, folder), rows, labels, frames(spark, folder))
    return found.select("venue_id", "level_id", "plane_m", F.size("rings").cast("bigint").alias("rings"), F.array_join("labels", "|").alias("labels"))


@query("conveyance_rows", f"""with {PLANES}, z as (select venue_id, level_id, height_mm - min(height_mm) over (partition by venue_id) as s from planes), p as (select z.*, l.ordinal from z join fx_levels l on l.level_id = z.level_id where z.level_id <> 'L7'), {CLEAN}
    select e.venue_id, 'edge' as source, cast(path_id as varchar) as item, pa.level_id, pa.s as z_from_mm, pb.s as z_to_mm, true as assumed from good_edges e join good_nodes a on a.venue_id = e.venue_id and a.node_id = e.from_id join good_nodes b on b.venue_id = e.venue_id and b.node_id = e.to_id
      join p pa on pa.venue_id = e.venue_id and pa.ordinal = a.ordinal join p pb on pb.venue_id = e.venue_id and pb.ordinal = b.ordinal where a.ordinal <> b.ordinal
    union all select u.venue_id, 'unit', unit_id, u.level_id, p.s, p.s + 3000, true from fx_units u join p on p.level_id = u.level_id where u.{TRANSIT}""")
def conveyance_rows(spark, folder):
    nodes, edges = clean(spark, folder)
    planes = level_planes(spark, folder).where("level_id <> 'L7'").select("venue_id", "level_id", "scene_z_mm").join(fixture(spark, folder, "fx_levels").select("venue_id", "level_id", "ordinal"), ["venue_id", "level_id"])
    return scene.conveyance_rows(edges, nodes, planes, fixture(spark, folder, "fx_units"))


@query("row_shape_violations", """select 'comment_shape' as code, cast(o_orderkey as varchar) as subject from orders where o_orderkey % 7 = 0 union all select 'coordinates', cast(o_orderkey as varchar) from orders where o_orderkey % 3 = 0 and o_orderkey % 11 = 0 union all select 'tombstone', cast(o_orderkey as varchar) from orders where o_orderkey % 13 = 0
    union all select 'attachment_state', cast(event_id as varchar) from events where event_id % 5 = 3 union all select 'attached_without_comment', cast(event_id as varchar) from events where event_id % 5 = 1 and event_id % 3 = 0
    union all select 'activation_version_id', cast(s_suppkey as varchar) from supplier where s_suppkey % 2 = 1 and s_suppkey % 5 = 0 union all select 'activation_activated_by', cast(s_suppkey as varchar) from supplier where s_suppkey % 2 = 0 and s_suppkey % 3 = 0""")
def row_shape_violations(spark, folder):
    k = F.col("o_orderkey")
    root = k % 3 == 0
    own = lambda value: F.when(root, value)
    comments = fixture(spark, folder, "orders").select(
        k.alias("comment_id"), F.when(~root, k - k % 3).alias("parent_id"), own(k).alias("pin_number"), own(F.lit("L1")).alias("level_id"), own(F.when(k % 11 == 0, 181.0).otherwise(139.0)).alias("lon"), own(F.lit(35.0)).alias("lat"),
        F.lit(None).cast("string").alias("feature_id"), F.when((k % 7 == 0) != root, "open").alias("status"), F.lit(None).cast("long").alias("assignee"), F.lit(None).cast("string").alias("due"),
        F.when(k % 4 == 0, k).alias("deleted_at"), F.when((k % 4 == 0) == (k % 13 == 0), "text").alias("body"),
    )
    e = F.col("event_id")
    attachments = fixture(spark, folder, "events").select(e.alias("attachment_id"), F.expr("case event_id % 5 when 0 then 'staged' when 1 then 'attached' when 3 then 'lost' else 'detached' end").alias("state"), F.when(e % 3 != 0, e).alias("comment_id"))
    s = F.col("s_suppkey")
    activations = fixture(spark, folder, "supplier").select(s.alias("activation_id"), F.when(s % 2 == 0, "evaluated").otherwise("activated").alias("state"), F.when((s % 2 == 1) & (s % 5 != 0), s).alias("version_id"), F.when(s % 2 == 1, s).alias("activated_at"), F.when((s % 2 == 1) | (s % 3 == 0), s).alias("activated_by"))
    return scene.row_shape_violations(comments, attachments, activations)


@query("published_lookup", """with r as (select o_orderkey as request_id, o_custkey % 25 as venue_no, case when o_orderkey % 3 = 0 then null else 'p' || (o_orderkey - o_orderkey % 2) end as public_id from orders)
    select request_id, case when r.public_id is null then (select arg_max(version_id, seq) from fx_versions v where v.venue_no = r.venue_no and status = 'published') else (select version_id from fx_versions v where v.venue_no = r.venue_no and status = 'published' and 'p' || version_id = r.public_id) end as version_id from r where version_id is not null""")
def published_lookup(spark, folder):
    k = F.col("o_orderkey")
    requests = fixture(spark, folder, "orders").select(k.alias("request_id"), (F.col("o_custkey") % 25).alias("venue_no"), F.when(k % 3 != 0, F.concat(F.lit("p"), (k - k % 2).cast("string"))).alias("public_id"))
    versions = fixture(spark, folder, "fx_versions").select("venue_no", "version_id", F.concat(F.lit("p"), F.col("version_id").cast("string")).alias("public_id"), "seq", "status")
    return scene.published_lookup(requests, versions)


@query("member_lookup", "select o.o_orderkey as request_id, sha256(cast(l.l_partkey as varchar)) as hash from orders o join lineitem l on l.l_orderkey = o.o_orderkey - o.o_orderkey % 2 and l.l_linenumber = 1 + o.o_orderkey % 3 and l.l_suppkey % 20 = o.o_custkey % 20")
def member_lookup(spark, folder):
    k = F.col("o_orderkey")
    path = lambda a, b: F.concat_ws("/", a, b)
    requests = fixture(spark, folder, "orders").select(k.alias("request_id"), (F.col("o_custkey") % 20).alias("version_id"), path(k - k % 2, 1 + k % 3).alias("path"))
    rows = fixture(spark, folder, "lineitem")
    members = rows.select((F.col("l_suppkey") % 20).alias("package_id"), path("l_orderkey", "l_linenumber").alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"))
    packages = members.select(F.col("package_id").alias("version_id"), "package_id").distinct()
    return scene.member_lookup(requests, packages, members)


@query("scene_lookup", "select version_id, bundle_hash as hash, max(duration_ms) over (partition by bundle_hash) as bytes from fx_versions where status = 'published' and bundle_hash is not null")
def scene_lookup(spark, folder):
    versions = fixture(spark, folder, "fx_versions")
    live = versions.where("status = 'published'")
    activations = versions.select("version_id", F.when(F.col("status") == "published", "activated").otherwise("evaluated").alias("state"), F.col("bundle_hash").alias("scene_hash"))
    blobs = live.where("bundle_hash is not null").groupBy(F.col("bundle_hash").alias("hash")).agg(F.max("duration_ms").alias("bytes"))
    return scene.scene_lookup(versions, activations, blobs)


@query("render_projection", """with f as (select venue_id, feature_id, feature_type, level_ref, pos, pos % 4 <> 0 and feature_type <> 'occupant' as geo, feature_type = 'occupant' and pos % 3 = 0 as centre from fx_features
      union all select distinct venue_id, venue_id, 'venue', null, 0, true, false from fx_levels),
    d as (select *, case when geo then 'own' when feature_type = 'occupant' and centre then 'centre' end as shape from f where feature_type <> 'anchor'),
    x as (select d.*, l.ordinal from d join fx_levels l on l.venue_id = d.venue_id and l.level_id = case when feature_type = 'level' then feature_id when feature_type = 'occupant' then 'L' || (d.pos % 25) else level_ref end where shape is not null
      union all select d.*, l.ordinal from d join (select distinct venue_id, ordinal from fx_levels) l on l.venue_id = d.venue_id where feature_type = 'venue')
    select distinct venue_id, ordinal, feature_id, shape, pos % 5 = 0 as restricted, case when feature_type = 'unit' then case when pos % 2 = 0 then '#ABCDEF' else '#E5E6E6' end end as color from x""")
def render_projection(spark, folder):
    rows = fixture(spark, folder, "fx_features")
    level = F.when(F.col("feature_type") == "occupant", F.concat(F.lit("L"), (F.col("pos") % 25).cast("string"))).otherwise(F.col("level_ref"))
    venues = fixture(spark, folder, "fx_levels").select("venue_id", F.col("venue_id").alias("feature_id"), F.lit("venue").alias("feature_type"), F.lit(None).cast("string").alias("level_ref"), F.lit(0).cast("bigint").alias("pos")).distinct()
    every = rows.select("venue_id", "feature_id", "feature_type", level.alias("level_ref"), "pos").union(venues)
    features = every.select(
        "venue_id", "feature_id", "pos", "feature_type", F.col("level_ref").alias("level_id"), F.when(F.col("feature_type") == "venue", True).otherwise((F.col("pos") % 4 != 0) & (F.col("feature_type") != "occupant")).alias("has_geometry"),
        ((F.col("feature_type") == "occupant") & (F.col("pos") % 3 == 0)).alias("has_center"), F.when(F.col("pos") % 5 == 0, "restricted").alias("restriction"), F.when(F.col("pos") % 2 == 0, "#ABCDEF").otherwise("トイレ").alias("color2"),
    )
    return scene.render_projection(features, fixture(spark, folder, "fx_levels"))
