"""Source layers to venue collections: catalogues, type guesses, plan checks and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from atrium.functions import scalars

#: Endings of layer names by the type that they stand for.
ENDINGS = {
    "level": ("_floor", "_level"),
    "unit": ("_space", "_unit"),
    "opening": ("_opening",),
    "detail": ("_drawing", "_detail", "_nw", "_link"),
    "fixture": ("_fixture",),
    "amenity": ("_facility", "_amenity"),
    "occupant": ("_occupant",),
}
#: Geometry that a type needs.
FAMILIES = {"level": "polygon", "unit": "polygon", "fixture": "polygon", "kiosk": "polygon", "opening": "line", "detail": "line", "amenity": "point", "occupant": "point"}
_STRUCTURED = "(?i)^(.*)_(B[0-9]+|M[0-9]+|F?[0-9]+|R|RF|0)_(Drawing|Fixture|Floor|Space|Opening|Facility|Occupant|detail|level|unit|amenity)$"


def infer_target_type(layer: Column) -> tuple[Column, Column]:
    """Type that a layer's name stands for, and whether it crosses floors (then it is a detail)."""
    low = F.lower(layer)
    crosses = low.contains("_to_")
    guess = F.when(crosses, "detail")
    for kind, ends in ENDINGS.items():
        for end in ends:
            guess = guess.when(low.endswith(end), kind)
    named = low.isin("facility_merge", "wifi", "beacon", "net_junction") | low.startswith("point_facility")
    return guess.when(named, "amenity").when(low == "net_path", "detail"), crosses


def structured_name(layer: Column) -> tuple[Column, Column, Column]:
    """Building prefix, floor token and kind of a structured layer name; nulls for another."""
    parts = [F.regexp_extract(layer, _STRUCTURED, k) for k in (1, 2, 3)]
    return tuple(F.when(F.length(parts[2]) > 0, p) for p in parts)


def needs_family(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[kind]


def suggest_plan(layers: DataFrame) -> DataFrame:
    """One plan row for each layer: type, whether included, building prefix and floor ordinal from the name's token.

    Patterns are most of the work, so each distinct name is matched once; names are dealt to all tasks by number, as a small table of them would be one task.
    """
    kind, crosses = infer_target_type(F.col("layer_name"))
    prefix, token, _ = structured_name(F.col("layer_name"))
    names = layers.select("layer_name").distinct().repartition(layers.sparkSession.sparkContext.defaultParallelism)
    names = names.select(F.col("layer_name").alias("_name"), kind.alias("target_type"), prefix.alias("building"), scalars.extract_floor_ordinal(token).alias("ordinal"), needs_family(kind).alias("_needs"), crosses.alias("_crosses"))
    fits = F.coalesce(F.col("_needs") == F.col("family"), F.lit(False))
    rows = layers.join(names, F.col("layer_name").eqNullSafe(F.col("_name")))
    return rows.withColumn("included", fits & ~F.col("_crosses") & (F.col("feature_count") > 0)).drop("_name", "_needs", "_crosses")


def plan_issues(plan: DataFrame) -> DataFrame:
    """Blocking findings of included plan rows, and of a plan without any level source."""
    fits = F.coalesce(needs_family(F.col("target_type")) == F.col("family"), F.lit(False))
    codes = F.array(
        F.when(F.col("target_type").isNull(), F.lit("type_missing")),
        F.when(F.col("target_type").isNotNull() & ~fits, F.lit("geometry_mismatch")),
        F.when((F.col("target_type") == "level") & F.col("building").isNull(), F.lit("building_missing")),
        F.when((F.col("target_type") == "level") & F.col("ordinal").isNull(), F.lit("ordinal_missing")),
    )
    return plan.where("included").select("layer_name", F.explode(F.array_compact(codes)).alias("code"))


def layer_catalog(features: DataFrame) -> DataFrame:
    """Features, geometry family (one kind, ``mixed`` or ``none``) and distinct floors of each layer."""
    kinds = F.array_sort(F.collect_set("geometry"))
    rows = features.groupBy("layer_name").agg(F.count("*").alias("features"), kinds.alias("k"), F.array_sort(F.collect_set(F.when(F.length(F.trim("floor")) > 0, F.trim("floor")))).alias("f"))
    family = F.when(F.size("k") == 0, "none").when(F.size("k") == 1, F.col("k")[0]).otherwise("mixed")
    return rows.select("layer_name", "features", family.alias("family"), F.array_join("f", ",").alias("floors"))


def uuid_census(features: DataFrame) -> DataFrame:
    """Identifier of each feature: its normalised own id if no other row has it, else one made from its key."""
    rows = features.withColumn("own", scalars.normalize_uuid(F.col("source_id")))
    once = rows.where("own is not null").groupBy("own").agg(F.count("*").alias("n")).where("n = 1").select("own", F.lit(True).alias("_once"))
    digest = F.sha2(F.concat_ws(":", "layer_name", "pos"), 256)
    made = F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3), F.lit("-8"), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))
    return rows.join(once, "own", "left").select("layer_name", "pos", F.when(F.col("_once"), F.col("own")).otherwise(made).alias("feature_id"), F.coalesce("_once", F.lit(False)).alias("preserved"))


def synthetic_rectangles(shapes: DataFrame, pad: float = 1e-6) -> DataFrame:
    """Boxes of levels from their shapes, of buildings from their levels (where shapes name one), and of venues from these; a side of no length is padded.

    ``shapes``: ``venue_id, level_id, west, south, east, north`` and, if known, ``building_id``.
    """
    box = lambda rows, key: rows.groupBy(*key).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    none = F.lit(None).cast("string")
    named = shapes if "building_id" in shapes.columns else shapes.withColumn("building_id", none)
    levels = box(named, ["venue_id", "building_id", "level_id"])
    buildings = box(levels.where("building_id is not null"), ["venue_id", "building_id"]).withColumn("level_id", none)
    venues = box(levels, ["venue_id"]).withColumns({"level_id": none, "building_id": none})
    wide = lambda a, b: F.when(F.col(a) == F.col(b), F.col(b) + pad).otherwise(F.col(b))
    every = levels.unionByName(buildings).unionByName(venues).withColumns({"east": wide("west", "east"), "north": wide("south", "north")})
    return every if "building_id" in shapes.columns else every.drop("building_id")


def drop_geometryless(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features with a finite position, and per layer how many were left out (``failed`` if none is left)."""
    fine = F.coalesce(F.exists("positions", lambda p: (F.abs(p["lon"]) < float("inf")) & (F.abs(p["lat"]) < float("inf")) & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"])), F.lit(False))
    report = features.groupBy("layer_name").agg(F.count_if(~fine).alias("skipped"), F.count_if(fine).alias("kept")).withColumn("failed", F.col("kept") == 0)
    return features.where(fine), report
