"""Registered import queries over raw JSON and source layers built from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import scalars
from atrium.operators import importing, spatial
from atrium.plans.fixtures import fixture, oracle
from atrium.plans.spatial_queries import unit_rings
from atrium.sources import collections

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def _pick(key, *options):
    """Options by a key, as a column."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (key % len(options) + 1).cast("int"))


NAMES = ('{"en":"unit","ja":"","fr":5}', "null", '"text"', '{"zz":"z","en-GB":"b","aa":"a"}', '{"ja-JP":"j"}')
ACCESS = ('"wheelchair"', '["a",null,"","b"]', "7", "[]")
SHAPES = ('{"type":"Point","coordinates":[139.5,35.25]}', '{"type":"Point","coordinates":[]}', "null", "[1,2]")


def raw_features(spark, folder):
    rows = fixture(spark, folder, "fx_features")
    k = F.col("pos")
    category = F.when(k % 4 == 0, F.lit("5")).when(k % 4 == 1, F.lit('""')).otherwise(F.lit('"room"'))
    text = F.concat(F.lit('{"name":'), _pick(k, *NAMES), F.lit(',"category":'), category, F.lit(',"accessibility":'), _pick(k, *ACCESS), F.lit(',"level_id":"'), F.coalesce("level_ref", F.lit("")), F.lit('","unit_ids":["'), F.col("feature_id"), F.lit('",1,""]}'))
    return rows.select("venue_id", "feature_type", "feature_id", F.when(k % 13 == 0, F.lit("[1]")).otherwise(text).alias("properties"), _pick(k, *SHAPES).alias("geometry"))


@query("normalize_features", """select venue_id, feature_id, case when pos % 13 = 0 then '' else case pos % 5 when 0 then 'en=unit' when 3 then 'aa=a,en-GB=b,zz=z' when 4 then 'ja-JP=j' else '' end end as labels,
    case when pos % 13 <> 0 and pos % 4 > 1 then 'room' end as category, case when pos % 13 <> 0 then level_ref end as level_ref, case when pos % 13 = 0 then '' else feature_id end as unit_refs,
    case when pos % 13 = 0 then '' else case pos % 4 when 0 then 'wheelchair' when 1 then 'a,b' else '' end end as accessibility, pos % 4 = 0 as usable from fx_features""")
def normalize_features(spark, folder):
    rows = importing.normalize_features(raw_features(spark, folder))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("venue_id", "feature_id", labels.alias("labels"), "category", "level_ref", F.array_join("unit_refs", ",").alias("unit_refs"), F.array_join("accessibility", ",").alias("accessibility"), F.col("geometry").isNotNull().alias("usable"))


@query("pick_label", """select venue_id, feature_id, coalesce(case when pos % 13 = 0 then null else case pos % 5 when 0 then 'unit' when 3 then 'b' when 4 then 'j' end end, feature_id) as label_fr,
    coalesce(case when pos % 13 = 0 then null else case pos % 5 when 0 then 'unit' when 3 then 'z' when 4 then 'j' end end, feature_id) as label_de from fx_features""")
def pick_label(spark, folder):
    rows = importing.normalize_features(raw_features(spark, folder))
    label = lambda locale, manifest: F.coalesce(importing.pick_label(F.col("labels"), locale, manifest), F.col("feature_id"))
    return rows.select("venue_id", "feature_id", label("fr", None).alias("label_fr"), label("de", "zz").alias("label_de"))


@query("read_facilities", """select venue_id, facility_id as pos, lon, ordinal, coalesce(trim(name), '') as name, lower(regexp_extract(image, '([^/]+)\\.png', 1)) as icon from fx_facilities where floor <> 'junk' and facility_id % 6 <> 0""")
def read_facilities(spark, folder):
    rows = fixture(spark, folder, "fx_facilities")
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.lit("null"))
    properties = F.concat(F.lit('{"name":'), name, F.lit(',"floor":"'), "floor", F.lit('","image":"'), "image", F.lit('"}'))
    point = F.concat(F.lit('{"type":"'), F.when(F.col("facility_id") % 6 == 0, "MultiPoint").otherwise("Point"), F.lit('","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
    return importing.facilities(rows.select("venue_id", F.col("facility_id").alias("pos"), properties.alias("properties"), point.alias("geometry")))[0].select("venue_id", "pos", "lon", "ordinal", "name", "icon")


@query("normalize_plan", "select p_partkey, nullif(case when p_partkey % 3 = 0 then '' else p_brand end, '') as building_id, nullif(case when p_partkey % 4 = 0 then '' else p_type end, '') as name_field, coalesce(case p_partkey % 3 when 0 then true when 1 then false end, false) as clip from part")
def normalize_plan(spark, folder):
    k = F.col("p_partkey")
    rows = fixture(spark, folder, "part").select("p_partkey", F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("building_id"), F.when(k % 4 == 0, "").otherwise(F.col("p_type")).alias("name_field"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("clip"))
    return importing.normalize_plan(rows)


@query("coerce_family", """select p_partkey, case p_partkey % 6 when 0 then 'Polygon' when 1 then 'MultiPolygon' when 2 then 'LineString' when 5 then 'Polygon' end as coerced_type, p_partkey % 6 = 4 as failed,
    cast(case p_partkey % 6 when 0 then 1 when 1 then 3 when 2 then 1 when 5 then 1 else 0 end as int) as parts from part""")
def coerce_family(spark, folder):
    """By key: a plain polygon, a collection of two, a plain line, of no finite member, with a foreign member, of one finite member."""
    part = "array(array(named_struct('lon', {0}D, 'lat', 1D)))"
    one, two, lost = part.format("139"), "array(array(named_struct('lon', 1D, 'lat', 1D)), array(named_struct('lon', 2D, 'lat', 1D)))", "array(array(named_struct('lon', double('NaN'), 'lat', 1D)))"
    member = lambda kind, parts: f"named_struct('type', '{kind}', 'parts', {parts})"
    members = [[member("Polygon", one)], [member("Polygon", one), member("MultiPolygon", two)], [member("LineString", one)], [member("Polygon", lost)], [member("Polygon", one), member("Point", one)], [member("Point", lost), member("Polygon", one)]]
    cases = " ".join(f"when {k} then array({', '.join(m)})" for k, m in enumerate(members))
    kind = "case p_partkey % 6 when 0 then 'Polygon' when 2 then 'LineString' else 'GeometryCollection' end"
    rows = fixture(spark, folder, "part").selectExpr("p_partkey", f"{kind} as geometry_type", "'polygon' as family", f"case p_partkey % 6 {cases} end as members")
    return importing.coerce_family(rows).select("p_partkey", "coerced_type", "failed", F.coalesce(F.size("parts"), F.lit(0)).alias("parts"))


@query("assemble_collections", """select l.venue_id, 'level' as feature_type, level_id as feature_id, case when pos % 3 = 0 then 'name=made' else '__source_database=db,__source_layer=floors,__source_level=' || level_id || ',color=red,name=level' end as properties from fx_levels l
    union all select venue_id, 'unit', unit_id, '__source_database=db,__source_layer=spaces,__source_level=' || level_id || case when category is null then ',category=room' else ',category=' || category end || ',k=' || k from fx_units""")
def assemble_collections(spark, folder):
    text = lambda *pairs: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs]), lambda _, v: v.isNotNull())
    made = F.col("pos") % 3 == 0
    levels = fixture(spark, folder, "fx_levels").select(
        "venue_id", F.col("level_id").alias("feature_id"), text("name", F.lit("raw"), "color", F.lit("red")).alias("original"), text("name", F.when(made, "made").otherwise("level")).alias("transient"),
        F.when(~made, "db").alias("database_id"), F.when(~made, "floors").alias("layer_name"),
    )
    units = fixture(spark, folder, "fx_units").select(
        "venue_id", F.lit("unit").alias("feature_type"), F.col("unit_id").alias("feature_id"), text("category", "category", "k", F.col("k").cast("string")).alias("original"), text("category", F.coalesce("category", F.lit("room"))).alias("transient"),
        F.lit("db").alias("database_id"), F.lit("spaces").alias("layer_name"), "level_id",
    )
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return importing.assemble_collections(levels, units).select("venue_id", "feature_type", "feature_id", flat.alias("properties"))


#: Parts as features of source layers. Their layer (by p_size) has a rule; buildings are venues, levels those of the units.
LAYERS = (("A_F1_Space", "fixed"), ("V1_B1_Space", "layer-name"), ("V2_M2_Space", "property"), ("points_2F", "source-reference"), ("misc", "source-reference"))


def source_levels(spark, folder):
    part = fixture(spark, folder, "part")
    k = F.col("p_partkey")
    layer = _pick(F.col("p_size"), *[n for n, _ in LAYERS])
    nodes = fixture(spark, folder, "fx_nodes").select(F.col("node_id").alias("p_partkey"), "lon", "lat", F.col("short_name").alias("_floor") if "short_name" in fixture(spark, folder, "fx_nodes").columns else F.col("floor").alias("_floor"))
    rows = part.join(nodes, part.p_partkey == nodes.p_partkey, "left").drop(nodes.p_partkey)
    features = rows.select(
        layer.alias("layer_name"), k.alias("pos"), (F.col("p_size") % 5 >= 3).alias("is_point"), "lon", "lat",
        F.when(k % 7 == 0, F.concat(F.lit("L"), (k % 30).cast("string"))).alias("level_ref"), F.when(k % 11 == 0, F.concat(F.lit("L"), (k % 25).cast("string"))).alias("floor_ref"),
        F.when(k % 3 != 0, F.col("_floor")).alias("floor"), F.when(k % 2 == 0, "F9").when(k % 5 == 0, "nowhere").alias("rule_value"),
    )
    plan = spark.createDataFrame([(n, r, 0.0 if r == "fixed" else None, "One" if r == "fixed" else None, b, p) for (n, r), b, p in zip(LAYERS, ("V0", "V1", None, "V3", None), (None, None, "V2", None, None))], "layer_name string, rule string, rule_ordinal double, rule_label string, building string, prefix_building string")
    levels = fixture(spark, folder, "fx_levels").select("level_id", F.col("level_id").alias("raw_id"), F.col("venue_id").alias("building"), "ordinal", "pos")
    boxes = unit_rings(spark, folder)
    segments = spatial.ring_segments(boxes.withColumn("shape_id", F.col("level_id")))
    return importing.resolve_source_levels(features, plan, levels, segments)


_SOURCE = """n as (select node_id, i, j, floor from fx_nodes), lv as (select level_id, venue_id, ordinal, pos from fx_levels),
    f0 as (select p_partkey as k, p_size % 5 as s, case when p_partkey % 7 = 0 then 'L' || (p_partkey % 30) end as lr, case when p_partkey % 11 = 0 then 'L' || (p_partkey % 25) end as fr,
      case when p_partkey % 3 <> 0 then n.floor end as fl, case when p_partkey % 2 = 0 then 'F9' when p_partkey % 5 = 0 then 'nowhere' end as rv, n.i, n.j from part left join n on n.node_id = p_partkey),
    f1 as (select f0.*, coalesce((select level_id from lv where level_id = lr), (select level_id from lv where level_id = fr)) as hit,
      case when fl like 'F%' then cast(substr(fl, 2) as int) - 1 when fl like 'B%' then -cast(substr(fl, 2) as int) end as fo from f0),
    held as (select f1.k, min(l.venue_id) as b from f1 join lv l on l.ordinal = f1.fo join fx_units u on u.level_id = l.level_id and f1.i > u.i0 and f1.i < u.i1 and f1.j > u.j0 and f1.j < u.j1 where f1.hit is null and s >= 3 group by 1 having count(distinct l.venue_id) = 1),
    f2 as (select f1.*, case s when 0 then 'V0' when 1 then 'V1' when 2 then 'V2' when 3 then 'V3' else case when fo is not null then (select b from held where held.k = f1.k) end end as b,
      case s when 0 then 0 when 1 then -1 when 2 then case when rv = 'F9' then 8 else 2 end when 3 then coalesce(fo, 1) else fo end as o from f1),
    f3 as (select f2.*, case when hit is null and b is not null then (select arg_min(level_id, pos) from lv where lv.venue_id = f2.b and lv.ordinal = f2.o) end as imp from f2)"""


@query("resolve_source_levels", f"""with {_SOURCE} select k as pos, coalesce((select venue_id from lv where level_id = hit), b) as building, case when hit is not null or imp is not null then coalesce(hit, imp) else 'made' end as level_id, hit is null and s >= 3 as fell_back
    from f3 where hit is not null or b is not null""")
def resolve_source_levels(spark, folder):
    found, _, _ = source_levels(spark, folder)
    return found.select("pos", "building", F.when(F.col("level_id").startswith("made:"), "made").otherwise(F.col("level_id")).alias("level_id"), "fell_back")


@query("made_levels", f"""with {_SOURCE} select distinct b as building, cast(o as double) as ordinal, lower(case s when 0 then 'One' when 1 then 'B1' when 2 then case when rv = 'F9' then 'F9' else 'M2' end when 3 then coalesce(case when fo is not null then fl end, '1') else cast(o as varchar) end) as label
    from f3 where hit is null and b is not null and imp is null""")
def made_levels(spark, folder):
    return source_levels(spark, folder)[1].select("building", "ordinal", F.lower("label").alias("label"))


@query("unresolved_source_levels", f"with {_SOURCE} select k as pos, 'unresolved_level' as code from f3 where hit is null and b is null")
def unresolved_source_levels(spark, folder):
    return source_levels(spark, folder)[2].select("pos", "code")


@query("layer_fallback_counts", f"""with {_SOURCE} select 'unresolved_reference' as code, case s when 3 then 'points_2F' else 'misc' end as subject, count(*) as n from f3 where hit is null and b is not null and s >= 3 group by 1, 2
    union all select 'worker_warning', p_brand, min(p_partkey) from part group by 2""")
def layer_fallback_counts(spark, folder):
    said = fixture(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("message"))
    return importing.layer_fallback_counts(source_levels(spark, folder)[0], said)


def entries(spark, folder):
    """File names of each venue: its feature types, by part of the venue's name one that is unknown or lost."""
    types = fixture(spark, folder, "fx_features").select("venue_id", F.concat("feature_type", F.lit(".geojson")).alias("name")).distinct()
    venues = types.select("venue_id").distinct()
    more = lambda test, name: venues.where(test).select("venue_id", F.lit(name).alias("name"))
    return types.union(more("true", "manifest.json")).union(more("venue_id <> 'V1'", "venue.geojson")).union(more("venue_id < 'V3'", "address.geojson")).union(more("venue_id = 'V2'", "notes.txt"))


@query("missing_files", "select distinct venue_id, 'missing_file' as code, 'venue.geojson' as subject from fx_levels where venue_id = 'V1' union all select distinct venue_id, 'missing_file', 'address.geojson' from fx_levels where venue_id >= 'V3'")
def missing_files(spark, folder):
    return collections.missing_files(entries(spark, folder))


@query("unknown_entries", "select distinct venue_id, 'unknown_archive_entry' as code, 'notes.txt' as subject from fx_levels where venue_id = 'V2'")
def unknown_entries(spark, folder):
    return collections.unknown_entries(entries(spark, folder))


@query("collection_violations", """with f as (select venue_id, feature_type, pos, case when pos % 6 = 0 then 'x' || (pos % 12) else '0f8fad5b-d9cb-469f-a165-' || lpad(cast(pos as varchar), 12, '0') end as id from fx_features where feature_type in ('unit', 'level') and venue_id <> 'V4' or feature_type = 'unit')
    select distinct venue_id, 'venue_count' as code, '' as subject from f union all select distinct venue_id, 'level_missing', '' from f where venue_id = 'V4'
    union all select venue_id, 'duplicate_id', id from f group by 1, 3 having count(*) > 1 union all select venue_id, 'invalid_id', id from f where pos % 6 = 0
    union all select venue_id, 'type_mismatch', id from f where pos % 5 = 1 union all select distinct venue_id, 'manifest', case venue_id when 'V0' then '2.0.0' else '1.0.0' end from f where venue_id in ('V0', 'V3')""")
def collection_violations(spark, folder):
    rows = fixture(spark, folder, "fx_features").where("feature_type = 'unit' or (feature_type = 'level' and venue_id <> 'V4')")
    uuid = F.concat(F.lit("0f8fad5b-d9cb-469f-a165-"), F.lpad(F.col("pos").cast("string"), 12, "0"))
    identity = F.when(F.col("pos") % 6 == 0, F.concat(F.lit("x"), (F.col("pos") % 12).cast("string"))).otherwise(uuid)
    features = rows.select("venue_id", "feature_type", F.when(F.col("pos") % 5 == 1, "other").otherwise(F.col("feature_type")).alias("declared_type"), identity.alias("feature_id"))
    venues = rows.select("venue_id").distinct()
    manifest = venues.select("venue_id", F.when(F.col("venue_id") == "V0", "2.0.0").when(F.col("venue_id") == "V3", "1.0.0").otherwise("1.0.0-rc.1").alias("version"), F.when(F.col("venue_id") != "V3", "ja").alias("language"))
    return collections.collection_violations(features, manifest)


@query("request_hash", """select event_id, sha256('{"event":' || event_id || ',"op":"' || event_type || '","version":' || (user_id % 10) || '}') as hash from events""")
def request_hash(spark, folder):
    rows = fixture(spark, folder, "events")
    return rows.select("event_id", scalars.request_hash(F.col("event_id").alias("event"), F.col("event_type").alias("op"), (F.col("user_id") % 10).alias("version")).alias("hash"))


@query("composite_level_id", "select l_orderkey, l_linenumber, l_suppkey, 'doc' || (l_suppkey % 3) || '|' || case when l_linenumber = 1 then '' else 'link' end || '|T' || (l_suppkey % 6) || '|' || 'name' || '|' || (l_suppkey * 42) as id from lineitem")
def composite_level_id(spark, folder):
    k = F.col("l_suppkey")
    link = F.when(F.col("l_linenumber") != 1, "link")
    made = scalars.composite_level_id(F.concat(F.lit("doc"), (k % 3).cast("string")), link, F.concat(F.lit("T"), (k % 6).cast("string")), F.lit("name"), k * 4.2)
    return fixture(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", made.alias("id"))
