"""Registered queries over venue features, labels and search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import scalars
from atrium.operators import resolve
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


@query("floor_to_ordinal", r"""
    select label_id, cast(case when regexp_matches(u, '^F[0-9]{1,9}F?$') then cast(regexp_extract(u, '([0-9]+)', 1) as int) - 1
      when regexp_matches(u, '^[A-Z]*B[0-9]{1,9}F?$') then -cast(regexp_extract(u, '([0-9]+)', 1) as int)
      when regexp_matches(u, '^M[0-9]{1,9}F?$') then cast(regexp_extract(u, '([0-9]+)', 1) as int) end as double) as ordinal
    from (select label_id, upper(trim(label)) as u from fx_labels)""")
def floor_to_ordinal(spark, folder):
    return fixture(spark, folder, "fx_labels").select("label_id", scalars.floor_to_ordinal(F.col("label")).alias("ordinal"))


SYNONYMS = """storeys as (select n, s.w from range(1, 61) r(n), (select unnest(['f%', '%f', '%階', '%fl', '%floor', 'floor%', '%']) as w) s),
basements as (select n, s.w from range(1, 11) r(n), (select unnest(['b%', 'b%f', 'b%fl', 'b%floor', '%b', 'bf%', '地下%階', '地下%f', '地下%fl', 'basement%']) as w) s),
words as (select replace(w, '%', cast(n as varchar)) as word, n - 1 as ordinal from storeys union all select replace(w, '%', cast(n as varchar)), -n from basements
  union all select unnest(['gf', 'g階', 'ground', '0', 'f0', '0f', '0fl', '0floor', 'floor0']), 0)"""


def _token(expr: str) -> str:
    return (
        f"coalesce((select max(ordinal) from words where word = {expr}), case when regexp_matches({expr}, '^m[0-9]{{1,9}}$') then cast(substr({expr}, 2) as bigint) end, "
        f"case when regexp_matches({expr}, '^[a-z]+b[0-9]{{1,9}}f?$') then -cast(regexp_extract({expr}, '([0-9]+)', 1) as bigint) end)"
    )


@query("extract_floor_ordinal", f"""
    with {SYNONYMS}, t as (select label_id, trim(label) as label from fx_labels),
    lead_token as (select label_id, lower(regexp_split_to_array(label, '[_\\s（(　]+')[1]) as w from t),
    tokens as (select label_id, unnest(regexp_split_to_array(lower(label), '[_\\-\\s.]+')) as w, generate_subscripts(regexp_split_to_array(lower(label), '[_\\-\\s.]+'), 1) as k from t),
    named as (select label_id, w, k, {_token("w")} as o from tokens where w <> ''),
    best as (select label_id, arg_min(o, -length(w) * 1000 + k) as o from named where o is not null group by 1)
    select t.label_id, cast(case when t.label <> '' then coalesce((select {_token("l.w")} from lead_token l where l.label_id = t.label_id and l.w <> ''), b.o) end as double) as ordinal
    from t left join best b on b.label_id = t.label_id""")
def extract_floor_ordinal(spark, folder):
    return fixture(spark, folder, "fx_labels").select("label_id", scalars.extract_floor_ordinal(F.col("label")).alias("ordinal"))


@query("floor_label_candidates", r"""
    with plain as (select label_id, translate(label, 'ｆ１２３４５６７８９０　', 'f1234567890 ') as p from fx_labels),
    forms as (select label_id, p as w from plain union all select label_id, regexp_split_to_array(trim(p), '\s+')[1] from plain),
    kept as (select label_id, regexp_replace(replace(lower(w), '地下', 'b'), '[^\p{L}\p{N}]', '', 'g') as w from forms),
    short as (select label_id, regexp_replace(w, '([0-9])(階|floor|fl|f)$', '\1') as w from kept),
    bare as (select label_id, regexp_replace(w, '^(level|lvl|l)([0-9])', '\2') as w from short)
    select l.label_id, coalesce((select string_agg(w, '|' order by w) from (select distinct w from bare b where b.label_id = l.label_id and w <> '')), '') as candidates from fx_labels l""")
def floor_label_candidates(spark, folder):
    return fixture(spark, folder, "fx_labels").select("label_id", F.array_join(scalars.floor_label_candidates(F.col("label")), "|").alias("candidates"))


@query("ordinal_to_floor_label", "select level_id, ordinal, short_name as label from fx_levels")
def ordinal_to_floor_label(spark, folder):
    return fixture(spark, folder, "fx_levels").select("level_id", "ordinal", scalars.ordinal_to_floor_label(F.col("ordinal")).alias("label"))


@query("normalize_uuid", r"""
    select doc_id, case when v then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) end as uuid
    from (select doc_id, h, h[13] = '4' and h[17] in ('8', '9', 'a', 'b') as v from (select doc_id, substr(h0, 1, 12) || (case when doc_id % 3 = 0 then '4' else h0[13] end) || substr(h0, 14, 19) as h
          from (select doc_id, substr(sha256(cast(doc_id as varchar)), 1, 32) as h0 from documents)))""")
def normalize_uuid(spark, folder):
    raw = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32)
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(raw, 1, 12), F.lit("4"), F.substring(raw, 14, 19))).otherwise(raw)
    given = F.when(F.col("doc_id") % 2 == 0, F.upper(raw)).otherwise(F.concat(F.lit(" "), F.regexp_replace(raw, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))
    return fixture(spark, folder, "documents").select("doc_id", scalars.normalize_uuid(given).alias("uuid"))


@query("haversine_m", """
    select a.node_id, round(2 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 4) as metres
    from fx_nodes a join fx_nodes b on b.level_id = a.level_id and b.rn = a.rn + 1""")
def haversine_m(spark, folder):
    a = fixture(spark, folder, "fx_nodes")
    b = a.select("level_id", (F.col("rn") - 1).alias("rn"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, ["level_id", "rn"]).select("node_id", F.round(scalars.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("metres"))


@query("reproject_3857_to_4326", "select c_custkey, round(degrees((15550000 + c_custkey) / 6378137.0e0), 9) as lon, round(degrees(2 * atan(exp((4250000 + c_custkey * 3) / 6378137.0e0)) - pi() / 2), 9) as lat from customer")
def reproject(spark, folder):
    x, y = scalars.reproject_3857_to_4326((F.col("c_custkey") + 15550000).cast("double"), (F.col("c_custkey") * 3 + 4250000).cast("double"))
    return fixture(spark, folder, "customer").select("c_custkey", F.round(x, 9).alias("lon"), F.round(y, 9).alias("lat"))


@query("vertical_cost", """
    select unit_id, case category when 'elevator' then 15.0e0 + row_no when 'escalator' then 4.0e0 * row_no when 'stairs' then 10.0e0 * row_no end as metres,
           case category when 'elevator' then 15.0e0 + row_no when 'escalator' then 4.0e0 * row_no when 'stairs' then 10.0e0 * row_no end * 1000 as cost from fx_units""")
def vertical_cost(spark, folder):
    metres = scalars.vertical_cost_m(F.col("category"), F.col("row_no"))
    return fixture(spark, folder, "fx_units").select("unit_id", metres.alias("metres"), scalars.meters_to_cost(metres).alias("cost"))


@query("unit_color", """
    select k, case when v = '' or v is null then null when v = '橙' then '#FFC090' when v = '濃鼠' then '#C8C9CA' when v = 'トイレ' then '#E5E6E6' when regexp_matches(v, '^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$') then v else '#808080' end as fill
    from (select k, case k % 8 when 0 then '橙' when 1 then '濃鼠' when 2 then 'トイレ' when 3 then '#a1B' when 4 then '#12345' when 5 then '' when 6 then '#0f0f0F' else null end as v from fx_units)""")
def unit_color(spark, folder):
    values = ["橙", "濃鼠", "トイレ", "#a1B", "#12345", "", "#0f0f0F"]
    v = F.expr("case " + " ".join(f"when k % 8 = {n} then '{x}'" for n, x in enumerate(values)) + " end")
    return fixture(spark, folder, "fx_units").select("k", scalars.unit_color(v).alias("fill"))


ROLE_SQL = "case " + " ".join(f"when contains(c, '{n}') then '{r}'" for n, r in scalars.ROLE_RULES) + " else 'context' end"


@query("semantic_role", f"""
    select k, {ROLE_SQL} as role, case {ROLE_SQL} when 'ceiling' then 'protected_corridor' when 'structure' then 'context' when 'context' then 'context' else 'never' end as occlusion
    from (select k, lower((['Floors', 'Walls', 'Ceilings', 'Doors', 'Stairs', 'Site', 'Revit Ramps', 'Stair Rail', 'Runs', 'Office Room'])[k % 10 + 1]) as c from fx_units)""")
def semantic_role(spark, folder):
    names = F.array(*[F.lit(x) for x in ["Floors", "Walls", "Ceilings", "Doors", "Stairs", "Site", "Revit Ramps", "Stair Rail", "Runs", "Office Room"]])
    role = scalars.semantic_role(F.element_at(names, (F.col("k") % 10 + 1).cast("int")))
    return fixture(spark, folder, "fx_units").select("k", role.alias("role"), scalars.occlusion_class(role).alias("occlusion"))


@query("walkway_class", "select unit_id, case when category in ('walkway', 'corridor') then 'walkway' when category in ('elevator', 'escalator', 'stairs') then 'transit' else 'obstacle' end as class from fx_units")
def walkway_class(spark, folder):
    return fixture(spark, folder, "fx_units").select("unit_id", scalars.walkway_class(F.col("category")).alias("class"))


@query("accessibility_flags", "select opening_id, accessibility <> 'other' as wheelchair from fx_openings")
def accessibility_flags(spark, folder):
    listed = F.when(F.col("accessibility") == "", F.array().cast("array<string>")).otherwise(F.array("accessibility"))
    return fixture(spark, folder, "fx_openings").select("opening_id", scalars.wheelchair_access(listed).alias("wheelchair"))


@query("level_rows", "select venue_id, level_id, ordinal, row_number() over (partition by venue_id order by ordinal desc, pos) as display_order from (select venue_id, level_id, pos, case when pos % 6 = 0 then 0e0 else ordinal end as ordinal from fx_levels)")
def level_rows(spark, folder):
    levels = fixture(spark, folder, "fx_levels").withColumn("ordinal", F.when(F.col("pos") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("ordinal")))
    return resolve.level_rows(levels).select("venue_id", "level_id", "ordinal", "display_order")


@query("feature_warnings", "select venue_id, level_id, case when label_en is null then 'missing_en_label' else 'missing_ja_label' end as code from fx_levels where pos % 9 <> 0")
def feature_warnings(spark, folder):
    levels = fixture(spark, folder, "fx_levels")
    labels = F.when(F.col("pos") % 9 == 0, F.create_map().cast("map<string,string>")).when(F.col("label_en").isNotNull(), F.create_map(F.lit("en-US"), "label_en")).otherwise(F.create_map(F.lit("JA"), "label_ja"))
    return resolve.feature_warnings(levels.withColumn("labels", labels))


PRIMITIVE_COLUMNS = (
    "case k % 7 when 0 then 'wall' when 1 then 'ceiling' when 2 then 'portal' when 3 then 'conveyance' when 6 then 'other' else 'surface' end as kind",
    "case when k % 11 = 0 then null when k % 13 = 0 then 'level' else 'unit' end as feature_type",
    "case k % 9 when 0 then 'steps' when 1 then 'kitchen' when 2 then 'parking' when 3 then 'kiosk' when 4 then 'movingwalkway' when 5 then 'walkwayisland' else category end as named",
)
PRIMITIVES = ", ".join(PRIMITIVE_COLUMNS)


@query("primitive_roles", f"""
    select unit_id, case when kind = 'wall' then 'structure' when kind = 'ceiling' then 'ceiling' when kind = 'portal' then 'opening' when kind = 'other' then null
      when kind = 'conveyance' then case when feature_type is null then 'conveyance' when named in ('elevator', 'escalator', 'stairs') then named when named = 'steps' then 'stairs' when named = 'movingwalkway' then 'ramp' else 'conveyance' end
      when feature_type is null or feature_type = 'level' or named is null then 'context'
      when named in ('elevator', 'escalator', 'stairs') then named when named = 'steps' then 'stairs' when named = 'movingwalkway' then 'ramp'
      when named in ('walkway', 'corridor', 'walkwayisland') then 'walkable' when named = 'kitchen' then 'service' when named = 'parking' then 'restricted' else 'public' end as role
    from (select unit_id, {PRIMITIVES} from fx_units)""")
def primitive_roles(spark, folder):
    rows = fixture(spark, folder, "fx_units").selectExpr("unit_id", *PRIMITIVE_COLUMNS)
    return rows.select("unit_id", scalars.primitive_role(F.col("kind"), F.col("feature_type"), F.col("named")).alias("role"))


@query("shape_warnings", """
    select venue_id, feature_id, case when feature_type = 'level' then 'missing_level_geometry' else 'missing_display_point' end as code from fx_features f
    where (feature_type = 'level' and not exists (select 1 from fx_units u where u.venue_id = f.venue_id and u.level_id = f.feature_id and u.category = 'elevator'))
       or (feature_type in ('unit', 'occupant', 'amenity') and (lon is null or pos % 17 = 0))""")
def shape_warnings(spark, folder):
    """Levels count as drawn where they have a lift; every seventeenth point is not a number."""
    drawn = fixture(spark, folder, "fx_units").where("category = 'elevator'").select("venue_id", F.col("level_id").alias("feature_id")).distinct().withColumn("has_geometry", F.lit(True))
    rows = fixture(spark, folder, "fx_features").join(drawn, ["venue_id", "feature_id"], "left")
    return resolve.shape_warnings(rows.select("venue_id", "feature_id", "feature_type", "has_geometry", F.when(F.col("pos") % 17 == 0, float("nan")).otherwise(F.col("lon")).alias("point_lon"), F.col("lat").alias("point_lat")))


def features(spark, folder):
    return fixture(spark, folder, "fx_features").withColumn("unit_refs", F.when(F.col("unit_refs").isNotNull(), F.split("unit_refs", ",")))


LISTED = """f as (select * from fx_features), listed as (select venue_id, feature_id, unnest(string_split(unit_refs, ',')) as ref, generate_subscripts(string_split(unit_refs, ','), 1) as p from f where unit_refs is not null),
l as (select x.*, u.feature_id as known, u.level_ref as level_ref, u.lon, u.lat from listed x left join f u on u.venue_id = x.venue_id and u.feature_id = x.ref),
r as (select f.*, u.feature_id as u_known, u.level_ref as u_level, u.lon as u_lon, u.lat as u_lat, a.feature_id as a_known, a.unit_ref as a_unit, a.lon as a_lon, a.lat as a_lat, au.feature_id as au_known, au.level_ref as au_level, au.lon as au_lon, au.lat as au_lat
  from f left join f u on u.venue_id = f.venue_id and u.feature_id = f.unit_ref left join f a on a.venue_id = f.venue_id and a.feature_id = f.anchor_ref left join f au on au.venue_id = f.venue_id and au.feature_id = a.unit_ref)"""


@query("resolve_levels", f"""with {LISTED}
    select venue_id, feature_id, coalesce(level_ref, u_level, au_level, (select arg_min(l.level_ref, l.p) from l where l.venue_id = r.venue_id and l.feature_id = r.feature_id and l.level_ref is not null)) as level_id from r""")
def resolve_levels(spark, folder):
    return resolve.resolve_levels(features(spark, folder))[0]


@query("unresolved_references", f"""with {LISTED}
    select venue_id, feature_id, unit_ref as reference from r where level_ref is null and unit_ref is not null and u_known is null
    union all select venue_id, feature_id, anchor_ref from r where coalesce(level_ref, u_level) is null and anchor_ref is not null and a_known is null
    union all select venue_id, feature_id, a_unit from r where coalesce(level_ref, u_level) is null and a_unit is not null and au_known is null
    union all select l.venue_id, l.feature_id, l.ref from l join r on r.venue_id = l.venue_id and r.feature_id = l.feature_id
      where l.known is null and coalesce(r.level_ref, r.u_level, r.au_level) is null
        and l.p < coalesce((select min(x.p) from l x where x.venue_id = l.venue_id and x.feature_id = l.feature_id and x.level_ref is not null), 999)""")
def unresolved_references(spark, folder):
    return resolve.resolve_levels(features(spark, folder))[1]


@query("resolve_centers", f"""with {LISTED}, c as (select venue_id, feature_id, arg_min(lon, p) as lon, arg_min(lat, p) as lat from l where lon is not null group by 1, 2)
    select r.venue_id, r.feature_id, coalesce(r.lon, a_lon, u_lon, au_lon, c.lon) as lon, coalesce(r.lat, a_lat, u_lat, au_lat, c.lat) as lat
    from r left join c on c.venue_id = r.venue_id and c.feature_id = r.feature_id""")
def resolve_centers(spark, folder):
    return resolve.resolve_centers(features(spark, folder))


@query("reference_integrity", """
    select venue_id, 'duplicate_id' as code, feature_id as subject from (select venue_id, feature_id from fx_features union all select venue_id, feature_id from fx_features where pos % 13 = 0 and feature_type = 'unit') group by 1, 3 having count(*) > 1
    union all select f.venue_id, 'unknown_level', f.feature_id from (select * from fx_features union all select * from fx_features where pos % 13 = 0 and feature_type = 'unit') f
    where level_ref is not null and not exists (select 1 from fx_levels l where l.venue_id = f.venue_id and l.level_id = f.level_ref and l.pos <> 7)""")
def reference_integrity(spark, folder):
    rows = fixture(spark, folder, "fx_features")
    rows = rows.union(rows.where("pos % 13 = 0 and feature_type = 'unit'"))
    return resolve.reference_integrity(rows, fixture(spark, folder, "fx_levels").where("pos <> 7"))


@query("venue_integrity", """
    with v as (select distinct venue_id from fx_levels),
    f as (select venue_id, feature_type, feature_id from fx_features where not (feature_type = 'level' and pos % 9 = 4) union all select venue_id, 'venue', venue_id from v where venue_id not in ('V2', 'V3') union all select venue_id, 'venue', venue_id || 'x' from v where venue_id in ('V1', 'V2')),
    l as (select venue_id, level_id from fx_levels where pos <> 7 union all select venue_id, level_id from fx_levels where pos % 11 = 0),
    n as (select v.venue_id, count(f.venue_id) as n, count(case when f.feature_id = v.venue_id then 1 end) as own from v left join f on f.venue_id = v.venue_id and f.feature_type = 'venue' group by 1)
    select venue_id, 'venue_count' as code, venue_id as subject from n where n <> 1
    union all select venue_id, 'venue_unnamed', venue_id from n where own = 0
    union all select venue_id, 'duplicate_level', level_id from l group by 1, 3 having count(*) > 1
    union all select distinct venue_id, 'level_without_feature', level_id from l where not exists (select 1 from f where f.venue_id = l.venue_id and f.feature_type = 'level' and f.feature_id = l.level_id)
    union all select venue_id, 'unlisted_level', feature_id from f where feature_type = 'level' and not exists (select 1 from l where l.venue_id = f.venue_id and l.level_id = f.feature_id)""")
def venue_integrity(spark, folder):
    """Some level features and list entries are left out or doubled, and three venues have no feature of their name or two features."""
    levels = fixture(spark, folder, "fx_levels")
    venues = levels.select("venue_id").distinct()
    made = venues.where("venue_id not in ('V2', 'V3')").selectExpr("venue_id", "'venue' as feature_type", "venue_id as feature_id").union(venues.where("venue_id in ('V1', 'V2')").selectExpr("venue_id", "'venue'", "concat(venue_id, 'x')"))
    rows = fixture(spark, folder, "fx_features").where("not (feature_type = 'level' and pos % 9 = 4)").select("venue_id", "feature_type", "feature_id").union(made)
    listed = levels.where("pos <> 7").union(levels.where("pos % 11 = 0")).select("venue_id", "level_id")
    return resolve.venue_integrity(venues, rows, listed)


def shapes(spark, folder):
    units = fixture(spark, folder, "fx_units")
    edge = lambda base, c: (F.lit(base) + F.col(c)) / F.lit(200000.0)
    return units.select("venue_id", "level_id", edge(27953200, "i0").alias("west"), edge(7136000, "j0").alias("south"), edge(27953200, "i1").alias("east"), edge(7136000, "j1").alias("north"))


BOXES = "boxes as (select venue_id, level_id, min(27953200 + i0) / 200000.0e0 as west, min(7136000 + j0) / 200000.0e0 as south, max(27953200 + i1) / 200000.0e0 as east, max(7136000 + j1) / 200000.0e0 as north from fx_units group by 1, 2)"


@query("bounds_by_level", f"with {BOXES} select * from boxes")
def bounds_by_level(spark, folder):
    return resolve.bounds_by_level(shapes(spark, folder))


@query("venue_bounds", f"""with {BOXES}
    select v.venue_id, case when v.venue_id = 'V1' then 1e0 else min(west) end as west, case when v.venue_id = 'V1' then 2e0 else min(south) end as south,
           case when v.venue_id = 'V1' then 3e0 else max(east) end as east, case when v.venue_id = 'V1' then 4e0 else max(north) end as north
    from (select distinct venue_id from fx_levels) v left join boxes b on b.venue_id = v.venue_id and b.venue_id <> 'V2' group by v.venue_id""")
def venue_bounds(spark, folder):
    venues = fixture(spark, folder, "fx_levels").select("venue_id").distinct()
    own = [F.when(F.col("venue_id") == "V1", F.lit(float(k))).alias(s) for k, s in enumerate(("west", "south", "east", "north"), 1)]
    return resolve.venue_bounds(venues.select("venue_id", *own), resolve.bounds_by_level(shapes(spark, folder)).where("venue_id <> 'V2'"))


@query("floor_groups", """
    with l as (select venue_id, floor(ordinal / 2) as ordinal, level_id, pos, case pos % 3 when 0 then 'Hall' when 1 then 'Deck' end as label from fx_levels),
    n as (select venue_id, ordinal, label, count(*) as n, min(pos) as p from l where label is not null group by 1, 2, 3),
    t as (select venue_id, ordinal, arg_min(label, -n * 1000 + p) as label from n group by 1, 2)
    select l.venue_id, l.ordinal, arg_min(level_id, pos) as representative, string_agg(level_id, ',' order by pos) as level_ids, max(t.label) as label
    from l left join t on t.venue_id = l.venue_id and t.ordinal = l.ordinal group by 1, 2""")
def floor_groups(spark, folder):
    levels = fixture(spark, folder, "fx_levels").select("venue_id", F.floor(F.col("ordinal") / 2).cast("double").alias("ordinal"), "level_id", "pos", F.expr("case pos % 3 when 0 then 'Hall' when 1 then 'Deck' end").alias("label"))
    return resolve.floor_groups(levels)


ALTITUDES = "alts as (select venue_id, ordinal, case when count(altitude) >= 3 and max(altitude) - min(altitude) <= 1.0e0 then round(median(altitude), 6) end as altitude from fx_nodes where node_id % 3 = 0 group by 1, 2)"


@query("network_altitudes", f"with {ALTITUDES} select * from alts")
def network_altitudes(spark, folder):
    return resolve.network_altitudes(fixture(spark, folder, "fx_nodes").where("node_id % 3 = 0"))


PLANES = f"""{ALTITUDES}, known as (select l.*, a.altitude, coalesce(l.elevation, a.altitude) as height from fx_levels l left join alts a on a.venue_id = l.venue_id and a.ordinal = l.ordinal),
low as (select venue_id, arg_min(height, ordinal) as h, min(ordinal) as o from known where height is not null group by 1),
planes as (select k.venue_id, level_id, ordinal, case when elevation is not null then 'imported' when altitude is not null then 'network' else 'nominal' end as method,
  cast(round(coalesce(height, coalesce(h, 0) + (ordinal - coalesce(o, 0)) * 4.0e0) * 1000) as bigint) as height_mm, elevation, altitude from known k left join low on low.venue_id = k.venue_id)"""


@query("resolve_level_planes", f"""with {PLANES}
    select venue_id, level_id, ordinal, method, height_mm, height_mm - min(height_mm) over (partition by venue_id) as scene_z_mm,
           case method when 'imported' then 1.0e0 when 'network' then 0.7e0 else 0.3e0 end as confidence,
           case when elevation is not null and altitude is not null then abs(cast(round(elevation * 1000) as bigint) - cast(round(altitude * 1000) as bigint)) end as disagreement_mm from planes""")
def resolve_level_planes(spark, folder):
    return resolve.resolve_level_planes(fixture(spark, folder, "fx_levels"), network_altitudes(spark, folder))


@query("plane_answers", f"with {PLANES} select l.venue_id, l.level_id, p.height_mm, p.height_mm is not null as known from fx_levels l left join planes p on p.level_id = l.level_id and p.method <> 'nominal'")
def plane_answers(spark, folder):
    return resolve.plane_answers(fixture(spark, folder, "fx_levels"), resolve_level_planes(spark, folder).where("method <> 'nominal'"))


@query("initial_level", "select venue_id, level_id, ordinal from (select *, row_number() over (partition by venue_id order by abs(ordinal), ordinal desc, pos) as n from fx_levels where ordinal <> 0) where n = 1")
def initial_level(spark, folder):
    return resolve.initial_level(fixture(spark, folder, "fx_levels").where("ordinal <> 0"))


@query("adjacent_ordinals", "select * from (select venue_id, ordinal as lower, lead(ordinal) over (partition by venue_id order by ordinal) as upper from (select distinct venue_id, ordinal from fx_levels where pos % 4 <> 1)) where upper is not null")
def adjacent_ordinals(spark, folder):
    return resolve.adjacent_ordinals(fixture(spark, folder, "fx_levels").where("pos % 4 <> 1"))


@query("facility_anchors", """
    select f.venue_id, f.facility_id, coalesce(trim(f.name), '') as name, lower(s.s_name) as icon, l.ordinal, case when exists (select 1 from fx_nodes n where n.venue_id = f.venue_id and n.ordinal = l.ordinal and n.node_id % 4 = 0) then f.lon end as anchor_lon
    from fx_facilities f join fx_levels l on l.level_id = f.level_id join supplier s on s.s_suppkey = f.facility_id where f.floor <> 'junk'""")
def facility_anchors(spark, folder):
    kept, _ = resolve.facility_anchors(fixture(spark, folder, "fx_facilities"), fixture(spark, folder, "fx_nodes").where("node_id % 4 = 0"))
    return kept.select("venue_id", "facility_id", "name", "icon", "ordinal", "anchor_lon")


@query("doorway_directions", "select venue_id, opening_id, min(origin) as origin, min(destination) as destination from fx_relationships where direction = 'directed' group by 1, 2 having count(distinct origin || '>' || destination) = 1")
def doorway_directions(spark, folder):
    return resolve.doorway_directions(fixture(spark, folder, "fx_relationships"))
