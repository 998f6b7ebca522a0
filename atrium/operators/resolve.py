"""Reference resolution and per-floor aggregates of venue features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def level_rows(levels: DataFrame) -> DataFrame:
    """Levels in display order: ordinal descending (a missing or non-finite one is 0), then source order."""
    ordinal = F.col("ordinal")
    finite = F.when(ordinal.isNull() | F.isnan(ordinal) | (F.abs(ordinal) == float("inf")), F.lit(0.0)).otherwise(ordinal)
    order = Window.partitionBy("venue_id").orderBy(F.col("ordinal").desc(), "pos")
    return levels.withColumn("ordinal", finite).withColumn("display_order", F.row_number().over(order))


def feature_warnings(levels: DataFrame) -> DataFrame:
    """Missing-language warnings of rows with a ``labels`` map: only where there is some label, by key or its prefix."""

    def lacks(language: str):
        return ~F.exists(F.map_keys("labels"), lambda k: (F.lower(k) == language) | F.lower(k).startswith(f"{language}-"))

    codes = F.array(*[F.when((F.size("labels") > 0) & lacks(x), F.lit(f"missing_{x}_label")) for x in ("en", "ja")])
    return levels.select("venue_id", "level_id", F.explode(F.array_compact(codes)).alias("code"))


#: Feature types that should have a display point.
POINTED = ("unit", "opening", "amenity", "kiosk", "occupant")


def shape_warnings(features: DataFrame) -> DataFrame:
    """Levels without a geometry and features of ``POINTED`` types without a display point: ``venue_id, feature_id, code``.

    ``features``: ``venue_id, feature_id, feature_type, has_geometry, point_lon, point_lat``. A null ``has_geometry`` is false; a point with a
    coordinate that is null or not finite is none. Repeated rows are warned of each.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    level = F.when((F.col("feature_type") == "level") & ~F.coalesce("has_geometry", F.lit(False)), F.lit("missing_level_geometry"))
    point = F.when(F.col("feature_type").isin(*POINTED) & ~(fine("point_lon") & fine("point_lat")), F.lit("missing_display_point"))
    return features.select("venue_id", "feature_id", F.coalesce(level, point).alias("code")).where("code is not null")


def resolve_levels(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level of every feature by its own reference, its unit, its anchor's unit, then its first usable unit.

    ``features``: ``venue_id, feature_id, level_ref, unit_ref, anchor_ref, unit_refs (array)``. A hop
    reads the source reference of the feature it leads to. Later hops are tried only where earlier ones gave
    nothing; each tried reference without a target is a warning. Returns (feature, level) and warnings.
    """
    known = features.select("venue_id", F.col("feature_id").alias("_id"), F.col("level_ref").alias("_level"), F.col("unit_ref").alias("_unit"))
    at = lambda name, key: known.select("venue_id", F.col("_id").alias(key), F.col("_level").alias(f"{name}_level"), F.col("_unit").alias(f"{name}_unit"), F.lit(True).alias(f"{name}_known"))
    rows = features.join(at("u", "unit_ref"), ["venue_id", "unit_ref"], "left").join(at("a", "anchor_ref"), ["venue_id", "anchor_ref"], "left")
    rows = rows.join(at("au", "a_unit"), ["venue_id", "a_unit"], "left")
    listed = features.where(F.size("unit_refs") > 0).select("venue_id", "feature_id", F.posexplode("unit_refs").alias("p", "l_ref"))
    listed = listed.join(at("l", "l_ref"), ["venue_id", "l_ref"], "left")
    first = listed.groupBy("venue_id", "feature_id").agg(F.min_by("l_level", F.when(F.col("l_level").isNotNull(), F.col("p"))).alias("list_level"), F.min(F.when(F.col("l_level").isNotNull(), F.col("p"))).alias("list_at"))
    rows = rows.join(first, ["venue_id", "feature_id"], "left")
    by_unit, by_anchor = F.coalesce("level_ref", "u_level"), F.coalesce("level_ref", "u_level", "au_level")
    resolved = rows.select("venue_id", "feature_id", F.coalesce(by_anchor, F.col("list_level")).alias("level_id"))
    missed = F.array(
        F.when(F.col("level_ref").isNull() & F.col("unit_ref").isNotNull() & F.col("u_known").isNull(), F.col("unit_ref")),
        F.when(by_unit.isNull() & F.col("anchor_ref").isNotNull() & F.col("a_known").isNull(), F.col("anchor_ref")),
        F.when(by_unit.isNull() & F.col("a_unit").isNotNull() & F.col("au_known").isNull(), F.col("a_unit")),
    )
    warned = rows.select("venue_id", "feature_id", F.explode(F.array_compact(missed)).alias("reference"))
    open_lists = rows.where(by_anchor.isNull()).select("venue_id", "feature_id", "list_at")
    passed = listed.where("l_known is null").join(open_lists, ["venue_id", "feature_id"]).where("list_at is null or p < list_at")
    return resolved, warned.union(passed.select("venue_id", "feature_id", F.col("l_ref").alias("reference")))


def resolve_centers(features: DataFrame) -> DataFrame:
    """Centre of every feature: its own, else its unit's, its anchor's unit's, or the first listed unit's."""
    known = features.select("venue_id", F.col("feature_id").alias("_id"), F.when(F.col("lon").isNotNull(), F.struct("lon", "lat")).alias("_at"), F.col("unit_ref").alias("_unit"))
    hop = lambda name, key: known.select("venue_id", F.col("_id").alias(key), F.col("_at").alias(f"{name}_at"), F.col("_unit").alias(f"{name}_unit"))
    rows = features.join(hop("u", "unit_ref"), ["venue_id", "unit_ref"], "left").join(hop("a", "anchor_ref"), ["venue_id", "anchor_ref"], "left").join(hop("au", "a_unit"), ["venue_id", "a_unit"], "left")
    listed = features.where(F.size("unit_refs") > 0).select("venue_id", "feature_id", F.posexplode("unit_refs").alias("p", "l_ref")).join(hop("l", "l_ref"), ["venue_id", "l_ref"])
    first = listed.where("l_at is not null").groupBy("venue_id", "feature_id").agg(F.min_by("l_at", "p").alias("list_at"))
    own = F.when(F.col("lon").isNotNull(), F.struct("lon", "lat"))
    found = rows.join(first, ["venue_id", "feature_id"], "left").withColumn("at", F.coalesce(own, "a_at", "u_at", "au_at", "list_at"))
    return found.select("venue_id", "feature_id", F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"))


def bounds_by_level(shapes: DataFrame) -> DataFrame:
    """Box of each level from rows of ``venue_id, level_id, west, south, east, north``."""
    return shapes.groupBy("venue_id", "level_id").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def venue_bounds(venues: DataFrame, level_bounds: DataFrame) -> DataFrame:
    """The venue's own box, else the union of its levels' boxes, else nulls."""
    sides = ("west", "south", "east", "north")
    joined = level_bounds.groupBy("venue_id").agg(*[(F.min if s in sides[:2] else F.max)(s).alias(f"_{s}") for s in sides])
    return venues.join(joined, "venue_id", "left").select("venue_id", *[F.when(F.col("west").isNotNull(), F.col(s)).otherwise(F.col(f"_{s}")).alias(s) for s in sides])


def floor_groups(levels: DataFrame) -> DataFrame:
    """One row for each ordinal: first level, level ids in order, and the most frequent label (ties: first seen)."""
    key = ["venue_id", "ordinal"]
    ids = levels.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "level_id"))).alias("l"))
    counts = levels.where("label is not null").groupBy(*key, "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = counts.groupBy(*key).agg(F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("label"))
    return ids.join(top, key, "left").select(*key, F.col("l")[0]["level_id"].alias("representative"), F.array_join(F.col("l.level_id"), ",").alias("level_ids"), "label")


def network_altitudes(nodes: DataFrame, least: int = 3, spread_m: float = 1.0) -> DataFrame:
    """Median altitude of each ordinal with at least three values within a metre, else null."""
    known = nodes.groupBy("venue_id", "ordinal").agg(F.count("altitude").alias("n"), F.percentile("altitude", F.lit(0.5)).alias("m"), (F.max("altitude") - F.min("altitude")).alias("spread"))
    return known.select("venue_id", "ordinal", F.when((F.col("n") >= least) & (F.col("spread") <= spread_m), F.round("m", 6)).alias("altitude"))


def resolve_level_planes(levels: DataFrame, altitudes: DataFrame, spacing_m: float = 4.0) -> DataFrame:
    """Height of each level in millimetres above the lowest: imported elevation, network altitude, else nominal.

    Nominal heights are measured from the venue's lowest level with a real one, or from ordinal 0.
    ``confidence`` is 1.0, 0.7 or 0.3; an imported height that disagrees with the network records by how much.
    """
    mm = lambda c: F.round(c * 1000).cast("bigint")
    rows = levels.join(altitudes, ["venue_id", "ordinal"], "left").withColumn("real", F.coalesce("elevation", "altitude"))
    venue = Window.partitionBy("venue_id")
    low = F.min(F.when(F.col("real").isNotNull(), F.struct("ordinal", "real"))).over(venue)
    nominal = F.coalesce(low["real"], F.lit(0.0)) + (F.col("ordinal") - F.coalesce(low["ordinal"], F.lit(0.0))) * spacing_m
    method = F.when(F.col("elevation").isNotNull(), "imported").when(F.col("altitude").isNotNull(), "network").otherwise("nominal")
    rows = rows.withColumns({"method": method, "height_mm": mm(F.coalesce("real", nominal))})
    return rows.select(
        "venue_id", "level_id", "ordinal", "method", "height_mm", (F.col("height_mm") - F.min("height_mm").over(venue)).alias("scene_z_mm"),
        F.when(F.col("method") == "imported", 1.0).when(F.col("method") == "network", 0.7).otherwise(0.3).alias("confidence"),
        F.when(F.col("elevation").isNotNull() & F.col("altitude").isNotNull(), F.abs(mm(F.col("elevation")) - mm(F.col("altitude")))).alias("disagreement_mm"),
    )


def initial_level(levels: DataFrame) -> DataFrame:
    """The level whose ordinal is nearest to 0; of two, the higher; then source order."""
    order = Window.partitionBy("venue_id").orderBy(F.abs("ordinal"), F.col("ordinal").desc(), "pos")
    return levels.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("venue_id", "level_id", "ordinal")


def adjacent_ordinals(levels: DataFrame) -> DataFrame:
    """Consecutive distinct ordinals of each venue."""
    step = Window.partitionBy("venue_id").orderBy("ordinal")
    return levels.select("venue_id", "ordinal").distinct().withColumn("upper", F.lead("ordinal").over(step)).where("upper is not null").select("venue_id", F.col("ordinal").alias("lower"), "upper")


def reference_integrity(features: DataFrame, levels: DataFrame) -> DataFrame:
    """Duplicate feature ids, and level references that no level row answers."""
    twice = features.groupBy("venue_id", "feature_id").agg(F.count("*").alias("n")).where("n > 1").select("venue_id", F.lit("duplicate_id").alias("code"), F.col("feature_id").alias("subject"))
    known = levels.select("venue_id", F.col("level_id").alias("level_ref")).distinct()
    lost = features.where("level_ref is not null").join(known, ["venue_id", "level_ref"], "left_anti").select("venue_id", F.lit("unknown_level").alias("code"), F.col("feature_id").alias("subject"))
    return twice.union(lost)


def venue_integrity(venues: DataFrame, features: DataFrame, levels: DataFrame) -> DataFrame:
    """What keeps a venue from being whole, beside ``reference_integrity``: ``venue_id, code, subject``.

    ``venues``: ``venue_id``, the id that names the venue's feature; ``features``: ``venue_id, feature_type, feature_id``; ``levels``: the listed ``venue_id, level_id``.
    Codes: ``venue_count`` (not exactly one venue feature), ``venue_unnamed`` (none has the venue's id), ``duplicate_level`` (listed twice),
    ``level_without_feature`` (listed only) and ``unlisted_level`` (a level feature that is not listed). Null ids have no row.
    """
    row = lambda rows, code, subject: rows.select("venue_id", F.lit(code).alias("code"), F.col(subject).alias("subject"))
    own = features.where("feature_type = 'venue'").select("venue_id", "feature_id")
    count = venues.select("venue_id").distinct().join(own.groupBy("venue_id").agg(F.count("*").alias("n")), "venue_id", "left").where(F.coalesce("n", F.lit(0)) != 1)
    unnamed = venues.select("venue_id").distinct().join(own.where("feature_id = venue_id"), "venue_id", "left_anti")
    listed = levels.where("level_id is not null").groupBy("venue_id", "level_id").agg(F.count("*").alias("n"))
    drawn = features.where("feature_type = 'level' and feature_id is not null").select("venue_id", F.col("feature_id").alias("level_id")).distinct()
    found = [
        row(count, "venue_count", "venue_id"),
        row(unnamed, "venue_unnamed", "venue_id"),
        row(listed.where("n > 1"), "duplicate_level", "level_id"),
        row(listed.join(drawn, ["venue_id", "level_id"], "left_anti"), "level_without_feature", "level_id"),
        row(drawn.join(listed, ["venue_id", "level_id"], "left_anti"), "unlisted_level", "level_id"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def plane_answers(levels: DataFrame, planes: DataFrame) -> DataFrame:
    """Resolved plane of every level, or an explicit unknown row."""
    found = levels.select("venue_id", "level_id").join(planes.select("venue_id", "level_id", "height_mm"), ["venue_id", "level_id"], "left")
    return found.withColumn("known", F.col("height_mm").isNotNull())


def facility_anchors(facilities: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A facility is its own anchor if its floor has a node; an unnamed floor is a warning."""
    from atrium.functions import scalars

    rows = facilities.select("venue_id", "facility_id", "lon", "lat", F.coalesce(F.trim("name"), F.lit("")).alias("name"), scalars.icon_of(F.col("image")).alias("icon"), scalars.floor_to_ordinal(F.col("floor")).alias("ordinal"))
    floors = nodes.select("venue_id", "ordinal", F.lit(True).alias("_walked")).distinct()
    kept = rows.where("ordinal is not null").join(floors, ["venue_id", "ordinal"], "left")
    anchored = kept.withColumns({"anchor_lon": F.when(F.col("_walked"), F.col("lon")), "anchor_lat": F.when(F.col("_walked"), F.col("lat"))}).drop("_walked")
    warned = rows.where("ordinal is null").select("venue_id", F.lit("unmapped_floor").alias("code"), F.col("facility_id").cast("string").alias("subject"))
    return anchored, warned


def doorway_directions(relationships: DataFrame) -> DataFrame:
    """One-way openings: directed relationships that agree; an opening with two different ones has none."""
    rows = relationships.where("direction = 'directed' and opening_id is not null and origin is not null and destination is not null")
    pairs = rows.groupBy("venue_id", "opening_id").agg(F.count_distinct("origin", "destination").alias("n"), F.min("origin").alias("origin"), F.min("destination").alias("destination"))
    return pairs.where("n = 1").drop("n")
