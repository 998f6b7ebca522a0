"""Feature collections from files: one row for each feature, and checks of the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The feature types in their order.
TYPES = ("address", "amenity", "anchor", "building", "detail", "fixture", "footprint", "geofence", "kiosk", "level", "occupant", "opening", "relationship", "section", "unit", "venue")

_FILE = "struct<type:string,features:array<struct<id:string,type:string,feature_type:string,geometry:string,properties:string>>>"


def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """Features of all ``*.geojson`` files under ``path/<venue_id>/``.

    Returns ``venue_id, feature_type, declared_type, feature_id, geometry, properties, type_order, pos``. The type comes from the file's
    name; the id from the feature or its properties. A geometry that is no object is null, properties that are none
    are ``{}``. ``pos`` is the place in the file. A file is one record, so files should stay under a partition's size.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.geojson", recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = files.select(
        F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("venue_id"), F.regexp_extract("file", "([^/]+)\\.geojson$", 1).alias("feature_type"), F.from_json("value", _FILE)["features"].alias("features")
    )
    rows = parsed.select("venue_id", "feature_type", F.posexplode("features").alias("pos", "f"))
    object_or = lambda c, other: F.when(F.col(c).startswith("{"), F.col(c)).otherwise(other)
    order = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("feature_type"))
    rows = rows.withColumn("props", object_or("f.properties", F.lit("{}")))
    return rows.select(
        "venue_id", "feature_type", F.coalesce("f.feature_type", F.get_json_object("props", "$.feature_type")).alias("declared_type"),
        F.coalesce("f.id", F.get_json_object("props", "$.id")).alias("feature_id"), object_or("f.geometry", F.lit(None)).alias("geometry"), F.col("props").alias("properties"),
        order.cast("int").alias("type_order"), "pos",
    )


#: Files that every collection has.
REQUIRED = ("manifest.json", "venue.geojson", "address.geojson")


def missing_files(files: DataFrame) -> DataFrame:
    """Required files that a venue (``venue_id, name``) does not have."""
    wanted = files.select("venue_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(x) for x in REQUIRED])))
    return wanted.join(files.select("venue_id", "name").distinct(), ["venue_id", "name"], "left_anti").select("venue_id", F.lit("missing_file").alias("code"), F.col("name").alias("subject"))


def collection_violations(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Findings of each venue: not exactly one venue feature, no level, repeated ids, ids that are no version-4
    identifiers, declared types that differ from the file's, and manifests of another version or without a language."""
    counts = features.groupBy("venue_id").agg(F.count_if(F.col("feature_type") == "venue").alias("venues"), F.count_if(F.col("feature_type") == "level").alias("levels"))
    whole = counts.select("venue_id", F.explode(F.array_compact(F.array(F.when(F.col("venues") != 1, F.lit("venue_count")), F.when(F.col("levels") == 0, F.lit("level_missing"))))).alias("code"), F.lit("").alias("subject"))
    twice = features.groupBy("venue_id", "feature_id").agg(F.count("*").alias("n")).where("n > 1").select("venue_id", F.lit("duplicate_id").alias("code"), F.col("feature_id").alias("subject"))
    shaped = F.lower("feature_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    shape = features.where(~F.coalesce(shaped, F.lit(False))).select("venue_id", F.lit("invalid_id").alias("code"), F.col("feature_id").alias("subject"))
    kind = features.where("declared_type <> feature_type").select("venue_id", F.lit("type_mismatch").alias("code"), F.col("feature_id").alias("subject"))
    fine = F.coalesce(F.col("version").rlike("^1\\.0\\.0([.-].+)?$") & (F.length("language") > 0), F.lit(False))
    wrong = manifest.where(~fine).select("venue_id", F.lit("manifest").alias("code"), F.coalesce("version", F.lit("")).alias("subject"))
    return whole.union(twice).union(shape).union(kind).union(wrong)


def unknown_entries(files: DataFrame) -> DataFrame:
    """File names of a venue that are neither the manifest nor one of the feature types."""
    known = [*(f"{t}.geojson" for t in TYPES), "manifest.json"]
    return files.where(~F.col("name").isin(*known)).select("venue_id", F.lit("unknown_archive_entry").alias("code"), F.col("name").alias("subject"))


def write_collections(features: DataFrame, path: str) -> None:
    """One table by venue and feature type."""
    features.write.mode("overwrite").partitionBy("venue_id", "feature_type").parquet(path)


def read_network(spark: SparkSession, junctions: str, paths: str) -> tuple[DataFrame, DataFrame]:
    """Junction and path features of line-delimited JSON: the last of a repeated junction counts, rows without keys are left out.

    Paths keep the vertices between their two ends as ``interior``.
    """
    from atrium.operators.network import latest_nodes

    point = "venue_id string, pos long, NODEID long, FLOOR string, coordinates array<double>"
    line = "venue_id string, FNODEID long, TNODEID long, cost double, PATHID long, RPATHID long, FLOOR string, coordinates array<array<array<double>>>"
    nodes = spark.read.schema(point).json(junctions).select("venue_id", "pos", F.col("NODEID").alias("node_id"), F.col("FLOOR").alias("floor"), F.col("coordinates")[0].alias("lon"), F.col("coordinates")[1].alias("lat"))
    rows = spark.read.schema(line).json(paths).where("FNODEID is not null and TNODEID is not null")
    flat = F.flatten("coordinates")
    inner = F.when(F.size(flat) > 2, F.slice(flat, F.lit(2), F.size(flat) - 2)).otherwise(F.array().cast("array<array<double>>"))
    edges = rows.select("venue_id", F.col("FNODEID").alias("from_id"), F.col("TNODEID").alias("to_id"), "cost", F.col("PATHID").alias("path_id"), F.col("RPATHID").alias("rpath_id"), F.col("FLOOR").alias("floor"), inner.alias("interior"))
    return latest_nodes(nodes), edges
