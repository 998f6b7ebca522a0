"""Search index and ranked search over many venues and queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from atrium.functions import scalars


def search_index(features: DataFrame) -> DataFrame:
    """Normalised distinct labels and other names of each feature: arrays ``labels`` and ``alt_labels``.

    ``features``: ``venue_id, feature_id, feature_type, category, ordinal, labels (map), alt_labels (map)``.
    """

    def forms(name: str):
        # the normaliser is a pandas function, so it sees one string; U+001F keeps the values apart
        joined = scalars.normalize_search_text(F.array_join(F.map_values(name), "\u001f"))
        return F.array_distinct(F.filter(F.transform(F.split(joined, "\u001f"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))

    # a small file holds many features: they are dealt to all tasks by number, and such a shuffle is not coalesced
    features = features.repartition(features.sparkSession.sparkContext.defaultParallelism, "feature_id")
    return features.select("venue_id", "feature_id", "feature_type", F.lower(F.coalesce("category", F.lit(""))).alias("category"), "ordinal", forms("labels").alias("labels"), forms("alt_labels").alias("alt_labels"))


def search(entries: DataFrame, queries: DataFrame, most: int = 50, level_boost: int = 20) -> DataFrame:
    """Best entries of each query in its venue: ``query_id, rank, feature_id, score``.

    Exact, leading and inner matches of labels score 500, 400 and 300, of other names 450, 350 and 250, a category
    or type that holds the text 200; an entry on the query's floor gets a boost. Ties go by first label, then
    id. An empty text lists a category (nothing for ``all``), entries on the floor first.
    ``queries``: ``query_id, venue_id, text, category, level_ordinal``. Queries that ask the same are looked up once.
    """
    ask = ["venue_id", "text", "category", "level_ordinal"]
    both = queries.select(*ask, F.col("text").alias("_asked")).distinct().withColumn("text", scalars.normalize_search_text(F.col("text"))).join(entries.withColumnRenamed("category", "own_category"), "venue_id")
    wanted, kind = F.col("category"), F.col("feature_type")
    in_category = (
        F.when(wanted == "gates", (kind == "opening") & F.col("own_category").startswith("pedestrian"))
        .when(wanted == "shops", kind == "occupant")
        .when(wanted == "facilities", kind.isin("amenity", "kiosk"))
        .otherwise(True)
    )
    text = F.col("text")
    hit = lambda name, test: F.exists(name, test)
    score = (
        F.when(hit("labels", lambda x: x == text), 500)
        .when(hit("alt_labels", lambda x: x == text), 450)
        .when(hit("labels", lambda x: x.startswith(text)), 400)
        .when(hit("alt_labels", lambda x: x.startswith(text)), 350)
        .when(hit("labels", lambda x: x.contains(text)), 300)
        .when(hit("alt_labels", lambda x: x.contains(text)), 250)
        .when(F.col("own_category").contains(text) | kind.contains(text), 200)
        .otherwise(0)
    )
    on_level = F.coalesce(F.col("ordinal") == F.col("level_ordinal"), F.lit(False))
    rows = both.where(in_category).withColumn("listed", F.length(text) == 0)
    rows = rows.withColumn("base", F.when(F.col("listed"), 0).otherwise(score))
    rows = rows.where((F.col("listed") & (wanted != "all")) | (F.col("base") > 0))
    rows = rows.withColumn("score", F.when(F.col("listed"), 0).otherwise(F.col("base") + F.when(on_level, level_boost).otherwise(0)))
    first = F.try_element_at("labels", F.lit(1))
    order = Window.partitionBy("venue_id", "_asked", "category", "level_ordinal").orderBy(F.col("score").desc(), F.when(F.col("listed") & ~on_level, 1).otherwise(0), first, "feature_id")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    best = best.select(F.col("venue_id").alias("_venue"), F.col("_asked").alias("_text"), F.col("category").alias("_category"), F.col("level_ordinal").alias("_level"), "rank", "feature_id", "score")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(ask, ("_venue", "_text", "_category", "_level"))]
    return queries.join(best, same).select("query_id", "rank", "feature_id", "score")
