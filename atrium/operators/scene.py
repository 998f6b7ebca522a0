"""Scene tables: portals, conveyances, floor rings, tile levels and features, residuals, and what is served or rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.functions import scalars
from atrium.operators import spatial
from atrium.operators.registration import project_local_mm
from atrium.scratch import Scratch


def conveyance_links(units: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """The vertical link that each conveyance unit speaks for: ``venue_id, unit_id, path_id, far_ordinal, arrow``.

    ``units``: ``venue_id, ordinal, unit_id``; ``segments``: their rings (``shape_id`` is the unit); ``links``: ``venue_id, path_id`` with
    ``low_ordinal, low_lon, low_lat`` and the same of ``high``. A link counts if its end on the unit's floor lies in the unit; the nearest far
    floor wins, then the lower one, then the smaller path id. The arrow is ``up`` or ``down``.
    """
    # few links join two floors: they are found once and read for each end and its place
    sides = [f"{side}_{c}" for side in ("low", "high") for c in ("ordinal", "lon", "lat")]
    links = Scratch(links.sparkSession, "conveyances").keep("links", links.where("low_ordinal <> high_ordinal").select("venue_id", "path_id", *sides))
    end = lambda near, far: links.select("venue_id", "path_id", F.col(f"{near}_ordinal").alias("ordinal"), F.col(f"{near}_lon").alias("lon"), F.col(f"{near}_lat").alias("lat"), F.col(f"{far}_ordinal").alias("far_ordinal"))
    ends = end("low", "high").union(end("high", "low")).withColumn("point_id", F.concat_ws(":", "path_id", "ordinal"))
    held = spatial.inside_shapes(ends.select("venue_id", "ordinal", "point_id", "lon", "lat"), segments).select("venue_id", "point_id", F.col("shape_id").alias("unit_id"))
    rows = held.join(ends, ["venue_id", "point_id"]).join(units.select("venue_id", "unit_id", "ordinal"), ["venue_id", "unit_id", "ordinal"], "left_semi")
    best = rows.groupBy("venue_id", "unit_id", "ordinal").agg(F.min(F.struct(F.abs(F.col("far_ordinal") - F.col("ordinal")).alias("gap"), "far_ordinal", "path_id")).alias("b"))
    return best.select("venue_id", "unit_id", "b.path_id", "b.far_ordinal", F.when(F.col("b.far_ordinal") > F.col("ordinal"), "up").otherwise("down").alias("arrow"))


def _in_mm(rows: DataFrame, frames: DataFrame, **points: tuple[str, str]) -> DataFrame:
    """Points (name: columns of longitude and latitude) in local millimetres as ``name_x`` and ``name_y``."""
    local = rows.join(F.broadcast(frames), "venue_id")  # one row for each venue, like its floors
    out = {}
    for name, (lon, lat) in points.items():
        out[f"{name}_x"], out[f"{name}_y"] = project_local_mm(F.col(lon), F.col(lat), F.col("lon0"), F.col("lat0"))
    return local.withColumns(out).drop("lon0", "lat0")


def _near(p: str, tolerance_mm: int) -> Column:
    """Whether the point ``p`` is within the tolerance of the segment from ``a`` to ``b``, all in millimetres."""
    dx, dy = (F.col("b_x") - F.col("a_x")).cast("double"), (F.col("b_y") - F.col("a_y")).cast("double")
    px, py = F.col(f"{p}_x") - F.col("a_x"), F.col(f"{p}_y") - F.col("a_y")
    size = dx * dx + dy * dy
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / size))).otherwise(F.lit(0.0))
    return F.pow(px - share * dx, 2) + F.pow(py - share * dy, 2) <= float(tolerance_mm) ** 2


def portals(openings: DataFrame, segments: DataFrame, frames: DataFrame, tolerance_mm: int = 200) -> DataFrame:
    """What each opening connects: ``venue_id, opening_id, first, second`` (a null second is the floor's slab).

    ``openings``: ``venue_id, ordinal, opening_id, ax, ay, bx, by`` (its end points); ``segments``: unit rings; ``frames``: ``venue_id, lon0,
    lat0``. A unit counts if both ends lie within the tolerance of one of its edges; of several the two smallest ids count. An opening on no
    edge is left out.
    """
    reach = tolerance_mm / 1000 * 1.5 + 0.05
    ends = openings.select("venue_id", "ordinal", "opening_id", F.col("ax").alias("lon"), F.col("ay").alias("lat"), F.col("bx").alias("_lon"), F.col("by").alias("_lat"))
    ends = _in_mm(ends, frames, p=("lon", "lat"), q=("_lon", "_lat"))
    # openings at one place meet the same units, so each place is looked at once
    spot = ["venue_id", "ordinal", "lon", "lat", "_lon", "_lat"]
    near = spatial.near_segments(ends.drop("opening_id").dropDuplicates(spot), segments, reach)
    on = _in_mm(near, frames, a=("ax", "ay"), b=("bx", "by")).where(_near("p", tolerance_mm) & _near("q", tolerance_mm))
    lists = on.groupBy(*spot).agg(F.array_sort(F.collect_set("shape_id")).alias("s"))
    found = ends.select(*spot, "opening_id").distinct().join(lists, spot)
    return found.select("venue_id", "opening_id", F.col("s")[0].alias("first"), F.try_element_at("s", F.lit(2)).alias("second"))


def residuals(samples: DataFrame, segments: DataFrame, carve_m: float = 1.0, cell_m: float = 4.0) -> DataFrame:
    """Distance and offset of wall samples to the nearest edge of their floor's rings: ``venue_id, level_key, sample_id, residual_m, dx, dy, carved``.

    Both are in local metres (``x, y``; segments ``ax, ay, bx, by``) keyed by ``venue_id, level_key``. A sample more than ``carve_m`` from every
    edge and outside the rings, or of a level without rings, is carved out: its figures are null. The search grows by
    cells until it has an edge.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = dx * dx + dy * dy
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / size))).otherwise(F.lit(0.0))
    key = ["venue_id", "level_key"]

    def nearest(rest: DataFrame, reach: float | None) -> DataFrame:
        if reach is None:
            both = rest.join(segments, key)
        else:
            grid = lambda low, high: F.sequence(F.floor((low - reach) / reach).cast("bigint"), F.floor((high + reach) / reach).cast("bigint"))
            dealt = segments.withColumn("cx", F.explode(grid(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn("cy", F.explode(grid(F.least("ay", "by"), F.greatest("ay", "by"))))
            both = rest.withColumns({"cx": F.floor(F.col("x") / reach).cast("bigint"), "cy": F.floor(F.col("y") / reach).cast("bigint")}).join(dealt, [*key, "cx", "cy"])
        at = both.withColumn("_t", share).withColumns({"dx": F.col("x") - F.col("ax") - F.col("_t") * dx, "dy": F.col("y") - F.col("ay") - F.col("_t") * dy})
        at = at.withColumn("residual_m", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
        if reach is not None:
            at = at.where(F.col("residual_m") <= reach)
        return at.groupBy(*key, "sample_id").agg(F.min(F.struct("residual_m", "dx", "dy")).alias("b")).select(*key, "sample_id", "b.*")

    # the reach grows for the samples that have no edge yet; a level without any has nothing to find
    scratch = Scratch(samples.sparkSession, "residuals")
    rest = scratch.keep("rest-0", samples.join(segments.select(*key).distinct(), key, "left_semi"))
    reach, turn, done = cell_m, 0, []
    while True:
        done.append(scratch.keep(f"found-{turn}", nearest(rest, reach)))
        if reach is None:
            break
        turn += 1
        rest = scratch.keep(f"rest-{turn}", rest.join(done[-1].select(*key, "sample_id"), [*key, "sample_id"], "left_anti"))
        if not rest.limit(1).count():
            break
        reach = reach * spatial.GROWTH if reach * spatial.GROWTH <= spatial.FLOOR_M else None
    measured = done[0]
    for found in done[1:]:
        measured = measured.unionByName(found)
    rows = samples.join(measured, [*key, "sample_id"], "left")
    # a ray to the east from the samples that only the rings can save
    open_rows = rows.where(F.col("residual_m") > carve_m).select(*key, "sample_id", "x", "y", F.floor(F.col("y") / cell_m).cast("bigint").alias("cy"))
    crossing = segments.where("ay <> by").withColumn("cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / cell_m).cast("bigint"), F.floor(F.greatest("ay", "by") / cell_m).cast("bigint"))))
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    east = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    inside = open_rows.join(crossing, [*key, "cy"]).where(spans & east).groupBy(*key, "sample_id").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(*key, "sample_id", F.lit(True).alias("_in"))
    rows = rows.join(inside, [*key, "sample_id"], "left").withColumn("carved", F.col("residual_m").isNull() | ((F.col("residual_m") > carve_m) & F.col("_in").isNull()))
    kept = lambda c: F.when(~F.col("carved"), F.col(c)).alias(c)
    return rows.select(*key, "sample_id", kept("residual_m"), kept("dx"), kept("dy"), "carved")


def rank_room_crossings(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """Edges whose middle lies in a room are secondary and cost three times as much, if they follow no door, lift or stair.

    ``edges``: ``venue_id, ordinal, edge_id, kind, weight`` and end points; ``rooms``: segments of units that are neither walked on nor
    change floors. Returns ``venue_id, edge_id, rank, weight``.
    """
    middle = edges.where(F.col("kind").isin("skeleton", "bridge", "chord")).select("venue_id", "ordinal", F.col("edge_id").alias("point_id"), ((F.col("ax") + F.col("bx")) / 2).alias("lon"), ((F.col("ay") + F.col("by")) / 2).alias("lat"))
    held = spatial.inside_shapes(middle, rooms).select("venue_id", F.col("point_id").alias("edge_id"), F.lit(True).alias("_in")).distinct()
    rows = edges.join(held, ["venue_id", "edge_id"], "left")
    return rows.select("venue_id", "edge_id", F.when(F.col("_in"), "secondary").otherwise("primary").alias("rank"), F.when(F.col("_in"), F.col("weight") * 3.0).otherwise(F.col("weight")).alias("weight"))


def scene_levels(records: DataFrame, features: DataFrame) -> DataFrame:
    """Levels of a tile package: ``venue_id, level_key, level_name, plane_m, document, link, declared``.

    Of declared ``records`` (``venue_id, pos, level_key, level_name, plane_m``) the first of a key counts; a key that only ``features``
    (``venue_id, pos, level_key, level_name, document, link, min_z``) name makes a level from the first of them. Documents and links come
    from the first feature that has one.
    """
    key = ["venue_id", "level_key"]
    first = lambda rows, *columns: rows.groupBy(*key).agg(*[F.min_by(c, "pos").alias(c) for c in columns])
    told = first(records.where("level_key is not null"), "level_name", "plane_m").withColumn("declared", F.lit(True))
    filled = lambda c: F.min_by(c, F.when(F.length(c) > 0, F.col("pos"))).alias(c)
    seen = features.where("level_key is not null").groupBy(*key).agg(F.min_by("level_name", "pos").alias("_name"), F.min_by("min_z", "pos").alias("_z"), filled("document"), filled("link"))
    both = told.join(seen, key, "full_outer")
    known = F.coalesce("declared", F.lit(False))
    return both.select(*key, F.when(known, F.col("level_name")).otherwise(F.col("_name")).alias("level_name"), F.when(known, F.col("plane_m")).otherwise(F.col("_z")).alias("plane_m"), F.coalesce("document", F.lit("")).alias("document"), F.coalesce("link", F.lit("")).alias("link"), known.alias("declared"))


def assign_tile_scene(features: DataFrame, levels: DataFrame, associations: DataFrame) -> DataFrame:
    """Level index, canonical feature, role and occlusion of every tile feature.

    ``features``: ``venue_id, object_id, document, link, level_key, elevation_m, category``; ``levels``: the first four of these with ``elevation_dm``
    and ``level_index``; ``associations``: ``venue_id, object_id, canonical_id, occlusion`` (null: by role). An unknown level is index 0.
    """
    key = ["venue_id", "document", "link", "level_key", "elevation_dm"]
    named = features.withColumn("elevation_dm", F.round(F.col("elevation_m") * 10).cast("int"))
    known = levels.groupBy(*key).agg(F.max("level_index").alias("level_index"))
    told = associations.select("venue_id", "object_id", "canonical_id", F.col("occlusion").alias("_occlusion"))
    rows = named.join(known, key, "left").join(told, ["venue_id", "object_id"], "left").withColumn("role", scalars.semantic_role(F.col("category")))
    return rows.select("venue_id", "object_id", F.coalesce("level_index", F.lit(0)).alias("level_index"), "canonical_id", "role", F.coalesce("_occlusion", scalars.occlusion_class(F.col("role"))).alias("occlusion"))


def venue_floor_rings(rings: DataFrame, planes: DataFrame, labels: DataFrame, frames: DataFrame) -> DataFrame:
    """Unit rings of every level in local metres: ``venue_id, level_id, ordinal, plane_m, rings, labels``.

    ``rings``: ``venue_id, level_id, shape_id, points``; ``planes``: ``venue_id, level_id, ordinal, scene_z_mm, offset_mm`` (the plane is their
    sum); ``labels``: ``venue_id, level_id, names (map), short_names (map)``; ``frames``: ``venue_id, lon0, lat0``. Levels without a ring or a
    plane are left out; labels are the short names, then the names, without blank ones.
    """
    local = rings.join(F.broadcast(frames), "venue_id")  # one row for each venue
    metres = F.transform("points", lambda p: F.transform(F.array(*project_local_mm(p["lon"], p["lat"], F.col("lon0"), F.col("lat0"))), lambda v: v / 1000.0))
    grouped = local.select("venue_id", "level_id", "shape_id", metres.alias("ring")).groupBy("venue_id", "level_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shape_id", "ring"))), lambda s: s["ring"]).alias("rings"))
    values = lambda c: F.transform(F.array_sort(F.map_entries(c)), lambda e: e["value"])
    said = labels.select("venue_id", "level_id", F.filter(F.concat(values("short_names"), values("names")), lambda x: F.trim(x) != "").alias("labels"))
    rows = grouped.join(planes, ["venue_id", "level_id"]).join(said, ["venue_id", "level_id"], "left")
    return rows.select("venue_id", "level_id", "ordinal", ((F.col("scene_z_mm") + F.col("offset_mm")) / 1000.0).alias("plane_m"), "rings", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def conveyance_rows(edges: DataFrame, nodes: DataFrame, planes: DataFrame, units: DataFrame, height_mm: int = 3000) -> DataFrame:
    """Neutral conveyances: ``venue_id, source, item, level_id, z_from_mm, z_to_mm, assumed``.

    One for each edge between nodes on two ordinals that both have a plane (at the level of its first node), and one for each transit
    unit on a level with a plane, as high as nominal. Of levels on one ordinal the first by id stands for it.
    """
    by_ordinal = planes.groupBy("venue_id", "ordinal").agg(F.min(F.struct("level_id", "scene_z_mm")).alias("p"))
    at = lambda end, name: nodes.select("venue_id", F.col("node_id").alias(end), "ordinal").join(by_ordinal, ["venue_id", "ordinal"]).select("venue_id", end, F.col("ordinal").alias(f"{name}_o"), F.col("p").alias(name))
    moved = edges.join(at("from_id", "a"), ["venue_id", "from_id"]).join(at("to_id", "b"), ["venue_id", "to_id"]).where("a_o <> b_o")
    links = moved.select("venue_id", F.lit("edge").alias("source"), F.col("path_id").cast("string").alias("item"), F.col("a.level_id").alias("level_id"), F.col("a.scene_z_mm").alias("z_from_mm"), F.col("b.scene_z_mm").alias("z_to_mm"))
    transit = units.where(F.col("category").isin("elevator", "escalator", "stairs")).join(planes.select("venue_id", "level_id", "scene_z_mm"), ["venue_id", "level_id"])
    boxes = transit.select("venue_id", F.lit("unit").alias("source"), F.col("unit_id").alias("item"), "level_id", F.col("scene_z_mm").alias("z_from_mm"), (F.col("scene_z_mm") + height_mm).alias("z_to_mm"))
    return links.union(boxes).withColumn("assumed", F.lit(True))


def row_shape_violations(comments: DataFrame, attachments: DataFrame, activations: DataFrame) -> DataFrame:
    """Rows that no store may hold: ``code, subject``.

    A comment is a root with a pin, a place and a status, or a reply with none of these; it is live with a body, or deleted without one; its
    coordinates are on the globe. An attachment's state is known, and an attached one has a comment. An
    activation names its version, time and author exactly if it is activated. A check whose outcome is unknown passes.
    """
    root, reply = F.col("parent_id").isNull(), F.col("parent_id").isNotNull()
    every = lambda present, *columns: [F.col(c).isNotNull() if present else F.col(c).isNull() for c in columns]

    def both(first: Column, tests: list[Column]) -> Column:
        for t in tests:
            first = first & t
        return first

    shape = both(root, every(True, "pin_number", "level_id", "lon", "lat", "status")) | both(reply, every(False, "pin_number", "level_id", "lon", "lat", "feature_id", "status", "assignee", "due"))
    place = (F.col("lon").isNull() | F.col("lon").between(-180, 180)) & (F.col("lat").isNull() | F.col("lat").between(-90, 90))
    tomb = (F.col("deleted_at").isNull() & F.col("body").isNotNull() & (F.length("body") > 0)) | (F.col("deleted_at").isNotNull() & F.col("body").isNull())
    bad = lambda rows, subject, *checks: rows.select(F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(code)) for code, test in checks]))).alias("code"), F.col(subject).cast("string").alias("subject"))
    active = F.col("state") == "activated"
    return (
        bad(comments, "comment_id", ("comment_shape", shape), ("coordinates", place), ("tombstone", tomb))
        .union(bad(attachments, "attachment_id", ("attachment_state", F.col("state").isin("staged", "attached", "detached")), ("attached_without_comment", (F.col("state") != "attached") | F.col("comment_id").isNotNull())))
        .union(bad(activations, "activation_id", *[(f"activation_{c}", active == F.col(c).isNotNull()) for c in ("version_id", "activated_at", "activated_by")]))
    )


def published_lookup(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """The published version that each request means: ``request_id, version_id``; the pinned one, else the newest. Others are never found.

    ``requests``: ``request_id, venue_no, public_id`` (null: the newest); ``versions``: ``venue_no, version_id, public_id, seq, status``.
    """
    live = versions.where("status = 'published'").select("venue_no", "version_id", F.col("public_id").alias("_public"), "seq")
    newest = live.groupBy("venue_no").agg(F.max_by("version_id", "seq").alias("_newest"))
    pinned = live.groupBy("venue_no", F.col("_public").alias("public_id")).agg(F.max_by("version_id", "seq").alias("_pinned"))
    rows = requests.join(newest, "venue_no", "left").join(pinned, ["venue_no", "public_id"], "left")
    return rows.select("request_id", F.when(F.col("public_id").isNull(), F.col("_newest")).otherwise(F.col("_pinned")).alias("version_id")).where("version_id is not null")


def member_lookup(requests: DataFrame, packages: DataFrame, members: DataFrame) -> DataFrame:
    """The stored member of a version's own package at a path: ``request_id, hash``; another package's members are never found."""
    return requests.select("request_id", "version_id", "path").join(packages.select("version_id", "package_id"), "version_id").join(members.select("package_id", "path", "hash"), ["package_id", "path"]).select("request_id", "hash")


def scene_lookup(versions: DataFrame, activations: DataFrame, blobs: DataFrame) -> DataFrame:
    """The scene document of each version by the activation that made it: ``version_id, hash, bytes``."""
    made = activations.where("state = 'activated' and scene_hash is not null").select("version_id", F.col("scene_hash").alias("hash"))
    return versions.select("version_id").join(made, "version_id").join(blobs.select("hash", "bytes"), "hash").select("version_id", "hash", "bytes")


def render_projection(features: DataFrame, levels: DataFrame) -> DataFrame:
    """What is drawn on each floor: ``venue_id, ordinal, feature_id, shape (own, centre), restricted, color``.

    ``features``: ``venue_id, feature_id, pos, feature_type, level_id, has_geometry, has_center, restriction, color2``; ``levels``: ``venue_id, level_id,
    ordinal, pos``. A floor shows the venue, buildings and footprints, then all levels of its ordinal with their features: anchors never,
    an occupant without geometry as its centre, others only with geometry. A feature is drawn once; colours are for units.
    """
    shape = F.when(F.col("has_geometry"), "own").when((F.col("feature_type") == "occupant") & F.col("has_center"), "centre")
    drawn = features.withColumn("shape", shape).where("shape is not null and feature_type <> 'anchor'")
    drawn = drawn.withColumns({"restricted": F.col("restriction").isNotNull(), "color": F.when(F.col("feature_type") == "unit", scalars.unit_color(F.col("color2")))})
    floors = levels.select("venue_id", "ordinal").distinct()
    context = drawn.where("shape = 'own' and feature_type in ('venue', 'building', 'footprint')").join(floors, "venue_id").withColumn("_rank", F.lit(0)).withColumn("_level", F.lit(0))
    home = F.when(F.col("feature_type") == "level", F.col("feature_id")).otherwise(F.col("level_id"))
    here = drawn.withColumn("_home", home).join(levels.select("venue_id", F.col("level_id").alias("_home"), "ordinal", F.col("pos").alias("_level")), ["venue_id", "_home"]).drop("_home").withColumn("_rank", F.lit(1))
    order = Window.partitionBy("venue_id", "ordinal", "feature_id").orderBy("_rank", "_level", "pos")
    once = context.unionByName(here).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return once.select("venue_id", "ordinal", "feature_id", "shape", "restricted", "color")


def project_primitives(primitives: DataFrame, confidence: DataFrame, locators: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primitives with what their references name, and the references that name nothing.

    ``primitives``: ``scene_id, primitive_id, role, level_id, occlusion, feature_id, conveyance, confidence_ref, locator_refs, evidence_refs`` (arrays of
    places in the scene's registries); the registries: ``scene_id, ref`` with ``kind, value``, ``value``, and ``method, detail``. Lists
    keep the order of the references; one that names nothing is left out and is a row ``scene_id, primitive_id, registry, place, ref`` (place from 0).
    """
    key = ["scene_id", "primitive_id"]

    def follow(refs: str, registry: DataFrame, name: str, *values: str) -> tuple[DataFrame, DataFrame]:
        spread = primitives.select(*key, F.posexplode(refs).alias("place", "ref"))
        met = spread.join(registry.select("scene_id", "ref", F.struct(*values).alias("_v")), ["scene_id", "ref"], "left")
        lists = met.where("_v is not null").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_v"))), lambda x: x["_v"]).alias(name))
        return lists, met.where("_v is null").select(*key, F.lit(name).alias("registry"), "place", F.col("ref").cast("long").alias("ref"))

    named = confidence.select("scene_id", F.col("ref").alias("confidence_ref"), F.struct("kind", "value").alias("confidence"))
    rows = primitives.join(named, ["scene_id", "confidence_ref"], "left")
    lost = rows.where("confidence is null").select(*key, F.lit("confidence").alias("registry"), F.lit(0).alias("place"), F.col("confidence_ref").cast("long").alias("ref"))
    for refs, registry, name, values in (("locator_refs", locators, "source_object_ids", ("value",)), ("evidence_refs", evidence, "evidence", ("method", "detail"))):
        lists, missing = follow(refs, registry, name, *values)
        rows, lost = rows.join(lists, key, "left"), lost.unionByName(missing)
    objects = F.transform(F.coalesce("source_object_ids", F.expr("cast(array() as array<struct<value:string>>)")), lambda x: x["value"])
    proof = F.coalesce("evidence", F.expr("cast(array() as array<struct<method:string,detail:string>>)"))
    return rows.select(*key, "role", "level_id", "occlusion", "confidence", "feature_id", "conveyance", objects.alias("source_object_ids"), proof.alias("evidence")), lost
