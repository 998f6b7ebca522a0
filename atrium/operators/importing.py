"""Imports: features from raw JSON, facilities, source geometry and properties, and the floors of source-layer features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.functions import scalars
from atrium.operators import gdbplan, spatial


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _text(value: Column) -> Column:
    """A JSON string that is not empty; null for anything else."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(_is(value, "STRING") & (text != ""), text)


def _member(root: Column, key: str) -> Column:
    return F.try_variant_get(root, f"$.{key}", "variant")


def _texts(value: Column) -> Column:
    """The non-empty strings of a JSON array; an empty array for anything else."""
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), _text)
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _record(value: Column) -> Column:
    """The non-empty strings of a JSON object by key; an empty map for anything else."""
    entries = F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, x: _text(x))
    return F.coalesce(F.map_filter(entries, lambda _, x: x.isNotNull()), F.create_map().cast("map<string,string>"))


def normalize_features(raw: DataFrame) -> DataFrame:
    """Typed columns of raw features (``venue_id, feature_type, feature_id, properties, geometry`` as JSON text).

    Adds ``labels, alt_labels`` (maps of the non-empty strings), ``category, restriction, level_ref, unit_ref, anchor_ref`` (null unless a
    non-empty string), ``unit_refs, accessibility`` (arrays; a single string is an array of one for the latter only) and keeps a geometry only
    if it is an object with a type and holds a finite position. Text that is no JSON object counts as one without members.
    """
    root = F.try_parse_json(F.col("properties"))
    shape = F.try_parse_json(F.col("geometry"))
    one = _text(_member(root, "accessibility"))
    numbers = F.regexp_like("geometry", F.lit("\\[\\s*-?[0-9][0-9.eE+-]*\\s*,\\s*-?[0-9]"))
    usable = _text(_member(shape, "type")).isNotNull() & numbers
    return raw.select(
        "venue_id", "feature_type", "feature_id", _record(_member(root, "name")).alias("labels"), _record(_member(root, "alt_name")).alias("alt_labels"),
        *[_text(_member(root, key)).alias(name) for key, name in (("category", "category"), ("restriction", "restriction"), ("level_id", "level_ref"), ("unit_id", "unit_ref"), ("anchor_id", "anchor_ref"))],
        _texts(_member(root, "unit_ids")).alias("unit_refs"), F.when(one.isNotNull(), F.array(one)).otherwise(_texts(_member(root, "accessibility"))).alias("accessibility"),
        F.when(F.coalesce(usable, F.lit(False)), F.col("geometry")).alias("geometry"),
    )


def pick_label(labels: Column, locale: str, manifest: str | None = None) -> Column:
    """The label of a map for a locale: by the exact key, the locale's language, the manifest's language, Japanese, English, the first key.

    Keys are tried in their order; empty labels count as none. Null where there is none.
    """
    entries = F.array_sort(F.map_entries(F.map_filter(labels, lambda _, x: F.coalesce(x != "", F.lit(False)))))
    first = lambda test: F.try_element_at(F.filter(entries, test), F.lit(1))["value"]
    primary = lambda key: F.lower(F.split_part(key, F.lit("-"), F.lit(1)))
    tries = [first(lambda e: e["key"] == locale), first(lambda e: primary(e["key"]) == locale.lower())]

    def add(language: str) -> None:
        tries.append(first(lambda e: F.lower(e["key"]) == language.lower()))
        tries.append(first(lambda e: primary(e["key"]) == language.split("-")[0].lower()))

    for language in [*([manifest] if manifest else []), "ja", "en"]:
        add(language)
    return F.coalesce(*tries, F.try_element_at(entries, F.lit(1))["value"])


def facilities(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point facilities of raw features (``venue_id, pos, properties, geometry`` as JSON text), and warnings of floors without an ordinal.

    Returns ``venue_id, pos, lon, lat, ordinal, name (trimmed, empty without one), icon``; other geometry than a point with two numbers is left out.
    """
    root, shape = F.try_parse_json(F.col("properties")), F.try_parse_json(F.col("geometry"))
    at = F.try_variant_get(shape, "$.coordinates", "array<double>")
    text = lambda key: F.when(_is(_member(root, key), "STRING"), F.try_variant_get(root, f"$.{key}", "string"))
    rows = features.withColumns({"_kind": _text(_member(shape, "type")), "_at": at}).where("_kind = 'Point' and size(_at) >= 2 and _at[0] is not null and _at[1] is not null")
    named = rows.select("venue_id", "pos", F.col("_at")[0].alias("lon"), F.col("_at")[1].alias("lat"), F.coalesce(F.trim(text("name")), F.lit("")).alias("name"), F.coalesce(text("floor"), F.lit("")).alias("floor"), F.coalesce(scalars.icon_of(text("image")), F.lit("")).alias("icon"))
    named = named.withColumn("ordinal", scalars.floor_to_ordinal(F.col("floor")))
    warned = named.where("ordinal is null").select("venue_id", F.lit("unmapped_floor").alias("code"), F.concat_ws(":", "name", "floor").alias("subject"))
    return named.where("ordinal is not null").select("venue_id", "pos", "lon", "lat", "ordinal", "name", "icon"), warned


def normalize_plan(plan: DataFrame) -> DataFrame:
    """A source-layer plan whose empty choices are null and whose clip flag is false unless it is set."""
    blank = [c for c in ("building_id", "id_field", "ordinal_field", "short_name_field", "name_field", "category_field") if c in plan.columns]
    out = plan.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in blank})
    return out.withColumn("clip", F.coalesce(F.col("clip"), F.lit(False))) if "clip" in plan.columns else out


def coerce_family(features: DataFrame) -> DataFrame:
    """Collections of geometries as one geometry of the family that the layer needs.

    ``geometry_type``, ``family`` and ``members`` (array of structs ``type, parts``; a part is an array of positions). Adds ``coerced_type`` and
    ``parts``: another type than a collection stays as it is. Of a collection the members with a finite position count: none gives null, one
    stays itself, several become the family's multi-geometry; a member of another family is ``failed``.
    """
    finite = lambda p: (F.abs(p["lon"]) < float("inf")) & (F.abs(p["lat"]) < float("inf")) & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"])
    fine = F.filter("members", lambda m: F.coalesce(F.exists(F.flatten(m["parts"]), finite), F.lit(False)))
    of = lambda kind: F.when(kind.endswith("Point"), "point").when(kind.endswith("LineString"), "line").when(kind.endswith("Polygon"), "polygon")
    multi = F.when(F.col("family") == "polygon", "MultiPolygon").when(F.col("family") == "line", "MultiLineString").otherwise("MultiPoint")
    rows = features.withColumn("_fine", fine)
    is_set = F.col("geometry_type") == "GeometryCollection"
    kind = F.when(~is_set, F.col("geometry_type")).when(F.size("_fine") == 1, F.col("_fine")[0]["type"]).when(F.size("_fine") > 1, multi)
    parts = F.when(~is_set, F.flatten(F.transform("members", lambda m: m["parts"]))).when(F.size("_fine") > 0, F.flatten(F.transform("_fine", lambda m: m["parts"])))
    failed = is_set & F.exists("_fine", lambda m: F.coalesce(of(m["type"]) != F.col("family"), F.lit(True)))
    return rows.withColumns({"coerced_type": F.when(~failed, kind), "parts": F.when(~failed, parts), "failed": failed}).drop("_fine")


def merged_properties(original: Column, transient: Column, provenance: Column) -> Column:
    """One property map: the source's, then those of the import, then where they came from; later ones win. A null map is empty."""
    none = F.create_map().cast("map<string,string>")

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)

    return over(over(F.coalesce(original, none), F.coalesce(transient, none)), F.coalesce(provenance, none))


def assemble_collections(levels: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of all collections in one form: ``venue_id, feature_type, feature_id, properties``.

    Both have ``venue_id, feature_id, original, transient`` (string maps), ``database_id, layer_name, level_id``, features a
    ``feature_type`` as well. A level without a layer was made by the import and keeps the import's properties only.
    """
    both = levels.withColumn("feature_type", F.lit("level")).withColumn("level_id", F.col("feature_id")).unionByName(features, allowMissingColumns=True)
    source = F.create_map(F.lit("__source_level"), F.col("level_id"), F.lit("__source_database"), F.col("database_id"), F.lit("__source_layer"), F.col("layer_name"))
    whole = merged_properties(F.col("original"), F.col("transient"), F.map_filter(source, lambda _, v: v.isNotNull()))
    made = (F.col("feature_type") == "level") & F.col("layer_name").isNull()
    return both.select("venue_id", "feature_type", "feature_id", F.when(made, F.col("transient")).otherwise(whole).alias("properties"))


def resolve_source_levels(features: DataFrame, plan: DataFrame, levels: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The level of every feature of a source layer, levels to make for it, and features without one.

    ``features``: ``layer_name, pos, is_point, lon, lat, level_ref, floor_ref, floor, rule_value`` (raw texts or null); ``plan``: ``layer_name, rule
    (fixed, layer-name, property, source-reference), rule_ordinal, rule_label, building, prefix_building``; ``levels``: imported ones as
    ``level_id, raw_id, building, ordinal, pos``; ``segments``: their rings.

    A raw level reference counts first, in either spelling of an identifier (a source-reference rule tries its own field before
    the others). Then, by rule: a fixed ordinal; the layer name's; the property's, else the layer name's; for source references a
    level named by ``floor``, the ordinal of ``floor``, the layer name's, or for points the one building whose level of that ordinal holds
    it. An ordinal means the building's first imported level of it, else a level to make, one for each building, ordinal and label.

    Returns ``layer_name, pos, level_id, building, fell_back``, new levels ``level_id, building, ordinal, label`` and failures.
    """
    key = lambda c: F.coalesce(scalars.normalize_uuid(c), c)
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    raw = levels.where("raw_id is not null").withColumn("_k", key(F.col("raw_id"))).groupBy("_k").agg(F.max_by(F.struct("level_id", "building"), "pos").alias("_hit"))
    first = levels.groupBy("building", "ordinal").agg(F.min_by("level_id", "pos").alias("imported"))
    rows = features.join(plan, "layer_name")
    for name, source in (("own", F.when(F.col("rule") == "source-reference", F.col("rule_value"))), ("level", F.col("level_ref")), ("area", F.col("floor_ref")), ("named", F.col("floor"))):
        rows = rows.withColumn("_k", key(blank(source))).join(raw.withColumnRenamed("_hit", f"_{name}"), "_k", "left").drop("_k")
    _, token, _ = gdbplan.structured_name(F.col("layer_name"))
    rows = rows.withColumns({"_token": token, "_token_ordinal": scalars.extract_floor_ordinal(F.coalesce(token, F.col("layer_name"))), "_either": F.coalesce("building", "prefix_building")})
    rows = rows.withColumns({"_value_ordinal": scalars.extract_floor_ordinal(F.col("rule_value")), "_floor_ordinal": scalars.extract_floor_ordinal(blank(F.col("floor")))})
    # points that no name places: the one building whose level of that ordinal holds them
    points = rows.where("rule = 'source-reference' and is_point and _floor_ordinal is not null").select(F.concat_ws(":", "layer_name", "pos").alias("point_id"), F.lit("all").alias("venue_id"), F.col("_floor_ordinal").alias("ordinal"), "lon", "lat")
    rings = segments.withColumn("venue_id", F.lit("all"))
    owners = levels.select(F.lit("all").alias("venue_id"), F.col("level_id").alias("shape_id"), F.col("building").alias("building_id"))
    held = spatial.building_by_containment(points, rings, owners).select(F.col("point_id").alias("_point"), F.col("building_id").alias("_held"))
    rows = rows.withColumn("_point", F.concat_ws(":", "layer_name", "pos")).join(held, "_point", "left")
    rule = lambda kind: F.col("rule") == kind
    hit = F.coalesce("_own", "_level", "_area", F.when(rule("source-reference"), F.col("_named")))
    place = lambda building, ordinal, label, fell: F.struct(building.alias("building"), ordinal.cast("double").alias("ordinal"), label.alias("label"), F.lit(fell).alias("fell"))
    known = lambda building, ordinal: building.isNotNull() & ordinal.isNotNull()
    either, none = F.col("_either"), F.lit(None).cast("string")
    value_label = F.when(F.col("_value_ordinal").isNotNull(), blank(F.col("rule_value"))).otherwise(F.coalesce(F.col("_token"), blank(F.col("rule_value"))))
    value = F.coalesce("_value_ordinal", "_token_ordinal")
    by_rule = (
        F.when(rule("fixed") & known(F.col("building"), F.col("rule_ordinal")), place(F.col("building"), F.col("rule_ordinal"), F.col("rule_label"), False))
        .when(rule("layer-name") & known(F.col("building"), F.col("_token_ordinal")), place(F.col("building"), F.col("_token_ordinal"), F.col("_token"), False))
        .when(rule("property") & known(either, value), place(either, value, value_label, False))
        .when(rule("source-reference") & known(either, F.col("_floor_ordinal")), place(either, F.col("_floor_ordinal"), blank(F.col("floor")), True))
        .when(rule("source-reference") & known(either, F.col("_token_ordinal")), place(either, F.col("_token_ordinal"), F.col("_token"), True))
        .when(rule("source-reference") & known(F.col("_held"), F.col("_floor_ordinal")), place(F.col("_held"), F.col("_floor_ordinal"), none, True))
    )
    rows = rows.withColumns({"_hit": hit, "_place": F.when(hit.isNull(), by_rule)})
    rows = rows.withColumns({"_b": F.col("_place.building"), "_o": F.col("_place.ordinal")}).join(first.select(F.col("building").alias("_b"), F.col("ordinal").alias("_o"), "imported"), ["_b", "_o"], "left")
    label = F.coalesce(F.col("_place.label"), F.format_string("%s", F.col("_o").cast("bigint").cast("string")))
    made = F.concat(F.lit("made:"), F.sha2(F.concat_ws("\x00", "_b", F.col("_o").cast("string"), F.lower(F.trim(label))), 256))
    rows = rows.withColumns({"_label": label, "level": F.coalesce(F.col("_hit.level_id"), F.col("imported"), F.when(F.col("_place").isNotNull(), made))})
    found = rows.where("level is not null").select("layer_name", "pos", F.col("level").alias("level_id"), F.coalesce("_hit.building", "_b").alias("building"), (F.col("_hit").isNull() & F.coalesce("_place.fell", F.lit(False))).alias("fell_back"))
    fresh = rows.where("_hit is null and imported is null and _place is not null")
    order = Window.partitionBy("level").orderBy("layer_name", "pos")
    new = fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("level").alias("level_id"), F.col("_b").alias("building"), F.col("_o").alias("ordinal"), F.col("_label").alias("label"))
    return found, new, rows.where("level is null").select("layer_name", "pos", F.lit("unresolved_level").alias("code"))


def layer_fallback_counts(found: DataFrame, worker_warnings: DataFrame) -> DataFrame:
    """Warnings of an import: layers whose features fell back to a floor, with their number, and each worker message once, where it came first.

    ``found`` as from ``resolve_source_levels``; ``worker_warnings``: ``pos, message``. Returns ``code, subject, n``.
    """
    fell = found.where("fell_back").groupBy("layer_name").agg(F.count("*").alias("n")).select(F.lit("unresolved_reference").alias("code"), F.col("layer_name").alias("subject"), "n")
    said = worker_warnings.groupBy("message").agg(F.min("pos").alias("n")).select(F.lit("worker_warning").alias("code"), F.col("message").alias("subject"), F.col("n").cast("bigint"))
    return fell.union(said)
