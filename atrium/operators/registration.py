"""How building-model geometry registers against floor plans, and scene tables drawn from units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.functions import scalars
from atrium.operators import numbering


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Area of a triangle of three (x, y, z) structs."""
    u = [b[k] - a[k] for k in "xyz"]
    v = [c[k] - a[k] for k in "xyz"]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return 0.5 * F.sqrt(sum((w * w for w in cross), F.lit(0.0)))


def resolve_tile_planes(triangles: DataFrame, bin_m: float = 0.01) -> DataFrame:
    """Height of each level: the bin of walkable triangles with the most area; of equal bins the lower.

    ``triangles``: ``venue_id, level_key, category, a, b, c``. Levels without a walkable triangle get null.
    """
    walkable = scalars.semantic_role(F.col("category")) == "walkable"
    height = (F.col("a.z") + F.col("b.z") + F.col("c.z")) / 3
    binned = triangles.where(walkable).withColumns({"bin": F.floor(height / bin_m + 0.5).cast("bigint"), "area": triangle_area(F.col("a"), F.col("b"), F.col("c"))})
    weights = binned.groupBy("venue_id", "level_key", "bin").agg(F.sum("area").alias("area"))
    best = weights.groupBy("venue_id", "level_key").agg(F.max(F.struct("area", (-F.col("bin")).alias("low"))).alias("m"))
    levels = triangles.select("venue_id", "level_key").distinct()
    return levels.join(best, ["venue_id", "level_key"], "left").select("venue_id", "level_key", F.round(-F.col("m.low") * bin_m, 6).alias("plane_m"), F.round("m.area", 6).alias("area"))


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """Edges that belong to one triangle of a level only, with corners welded to the millimetre."""
    mm = lambda p: F.concat_ws(",", *[F.round(F.col(f"{p}.{k}") * 1000).cast("bigint") for k in "xyz"])
    corners = triangles.select("venue_id", "level_key", mm("a").alias("p"), mm("b").alias("q"), mm("c").alias("r"))
    sides = F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("p", "q"), ("q", "r"), ("r", "p"))])
    edges = corners.select("venue_id", "level_key", F.explode(sides).alias("e")).where("e.u <> e.v")
    return edges.groupBy("venue_id", "level_key", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def match_tile_levels(tiles: DataFrame, floors: DataFrame, tolerance_m: float = 1.5) -> DataFrame:
    """Floor whose plane is nearest to a tile level's within the tolerance; ``ambiguous`` if several are, ``unmapped`` if none.

    The join is on venue and height cell, so it stays an equi-join however many levels there are.
    """
    dealt = tiles.withColumn("cell", F.explode(F.sequence(F.floor((F.col("plane_m") - tolerance_m) / tolerance_m).cast("bigint"), F.floor((F.col("plane_m") + tolerance_m) / tolerance_m).cast("bigint"))))
    placed = floors.select("venue_id", "ordinal", F.col("plane_m").alias("floor_m"), F.floor(F.col("plane_m") / tolerance_m).cast("bigint").alias("cell"))
    gap = F.abs(F.col("plane_m") - F.col("floor_m"))
    near = dealt.join(placed, ["venue_id", "cell"]).withColumn("gap", gap).where(F.col("gap") <= tolerance_m)
    best = near.groupBy("venue_id", "level_key").agg(F.count("*").alias("n"), F.min(F.struct("gap", "ordinal")).alias("b"))
    state = F.when(F.col("n").isNull(), "unmapped").when(F.col("n") > 1, "ambiguous").otherwise("mapped")
    return tiles.join(best, ["venue_id", "level_key"], "left").select("venue_id", "level_key", state.alias("state"), F.col("b.ordinal").alias("ordinal"), F.round("b.gap", 6).alias("gap_m"))


def label_corroboration(tiles: DataFrame, floors: DataFrame) -> DataFrame:
    """Whether a mapped level's label names its floor: ``agrees``, ``contradicts`` (names exactly one other) or ``unknown``.

    ``tiles``: ``venue_id, level_key, label, ordinal``; ``floors``: ``venue_id, ordinal, label``.
    """
    forms = lambda rows: rows.withColumn("form", F.explode(scalars.floor_label_candidates(F.col("label"))))
    named = forms(tiles).select("venue_id", "level_key", F.col("ordinal").alias("own"), "form").join(forms(floors).select("venue_id", "ordinal", "form").distinct(), ["venue_id", "form"])
    found = named.groupBy("venue_id", "level_key").agg(F.max(F.col("ordinal") == F.col("own")).alias("same"), F.countDistinct("ordinal").alias("n"))
    verdict = F.when(F.col("same"), "agrees").when((F.col("n") == 1) & ~F.col("same"), "contradicts").otherwise("unknown")
    return tiles.join(found, ["venue_id", "level_key"], "left").select("venue_id", "level_key", verdict.alias("verdict"))


def residual_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """Count, nearest-rank p50 and p90, and maximum of ``residual_m`` for each key; absent where there is no sample."""
    known = samples.where("residual_m is not null")
    n, r = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy("residual_m"))
    ranked = known.withColumns({"_n": n, "_r": r})
    at = lambda p: F.max(F.when(F.col("_r") == F.ceil(F.col("_n") * p), F.col("residual_m")))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("residual_m").alias("max"))


def coherent_clusters(samples: DataFrame, cell_m: float = 40.0, least: int = 5, shift_m: float = 1.0) -> DataFrame:
    """Cells of out-of-band samples whose median offset is longer than ``shift_m`` (``x, y, dx, dy`` in metres)."""
    cell = lambda c: F.floor(F.col(c) / cell_m).cast("bigint")
    middle = samples.groupBy("venue_id", "level_key", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.percentile("dx", F.lit(0.5)).alias("dx"), F.percentile("dy", F.lit(0.5)).alias("dy"))
    return middle.where((F.col("n") >= least) & (F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) > shift_m))


def level_order_check(matches: DataFrame) -> DataFrame:
    """Consecutive tile levels, by plane, that map to a lower floor than the one before."""
    order = Window.partitionBy("venue_id").orderBy("plane_m", "level_key")
    return matches.where("ordinal is not null").withColumn("before", F.lag("ordinal").over(order)).where("before > ordinal").select("venue_id", "level_key", "before", "ordinal")


def wall_edges(edges: DataFrame, nominal_m: float = 3.0) -> DataFrame:
    """Distinct boundary edges of each level with the least height of the units that own them.

    ``edges``: ``venue_id, level_id, u, v, category, height``. An owner without a height counts with the nominal
    one and marks the edge as assumed; an edge that only platforms own is no wall.
    """
    rows = edges.withColumns({"h": F.coalesce("height", F.lit(nominal_m)), "guess": F.col("height").isNull(), "plat": F.coalesce(F.col("category") == "platform", F.lit(False))})
    grouped = rows.groupBy("venue_id", "level_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("h").alias("height_m"), F.max("guess").alias("assumed"), F.min("plat").alias("_all"), F.count("*").alias("owners"))
    return grouped.where("not _all").drop("_all")


def batch_quantize(vertices: DataFrame) -> DataFrame:
    """Unsigned 16-bit coordinates of each (venue, level, role) batch within its own box; a flat axis has scale 1."""
    key = ["venue_id", "level_key", "role"]
    box = vertices.groupBy(*key).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])
    scale = lambda c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(f"max_{c}") - F.col(f"min_{c}")) / 65535.0).otherwise(1.0)
    q = lambda c: F.round((F.col(c) - F.col(f"min_{c}")) / scale(c)).cast("int").alias(f"q{c}")
    return vertices.join(box, key).select(*key, "vertex_id", *[q(c) for c in "xyz"])


#: The WGS 84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def wgs84_ecef(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres of a point on the ellipsoid."""
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(F.radians(lat)) ** 2)
    return n * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), n * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), n * (1 - e2) * F.sin(F.radians(lat))


def project_local_mm(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north millimetres in the tangent plane at the origin."""
    x, y, z = (p - q for p, q in zip(wgs84_ecef(lon, lat), wgs84_ecef(lon0, lat0)))
    sl, cl, sp, cp = F.sin(F.radians(lon0)), F.cos(F.radians(lon0)), F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    mm = lambda v: F.round(v * 1000).cast("bigint")
    return mm(-sl * x + cl * y), mm(-sp * cl * x - sp * sl * y + cp * z)


def apply_transform(matrix: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point through a 4 by 4 matrix in column order; a null matrix is the identity."""
    m = lambda k: F.element_at(matrix, k + 1)
    out = [m(r) * x + m(4 + r) * y + m(8 + r) * z + m(12 + r) for r in range(3)]
    return tuple(F.when(matrix.isNull(), same).otherwise(new) for same, new in zip((x, y, z), out))


def octahedral(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """A direction folded on the octahedron: two signed 16-bit numbers. The lower half is folded over the diagonals."""
    size = F.greatest(F.abs(x) + F.abs(y) + F.abs(z), F.lit(1.1920928955078125e-07))
    u, v = x / size, y / size
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    folded = [F.when(z < 0, (1 - F.abs(b)) * sign(a)).otherwise(a) for a, b in ((u, v), (v, u))]
    return tuple(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) * 32767).cast("int") for c in folded)


def from_octahedral(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The unit direction of two folded numbers."""
    u, v = a / F.lit(32767.0), b / F.lit(32767.0)
    z = 1 - F.abs(u) - F.abs(v)
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    x, y = (F.when(z < 0, (1 - F.abs(q)) * sign(p)).otherwise(p) for p, q in ((u, v), (v, u)))
    size = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1.1920928955078125e-07))
    return x / size, y / size, z / size


def activation_gates(packages: DataFrame, levels: DataFrame, objects: DataFrame, context: DataFrame, floors: DataFrame, clusters: DataFrame, tolerance_m: float = 1.5, shift_m: float = 1.0, coherent_m: float = 1.0) -> DataFrame:
    """What blocks a package from becoming a venue's view: ``venue_id, gate_order, code, subject, measured, band``.

    ``packages``: ``venue_id, asset_version, integrity_verified, capability_profile``; ``levels``: ``venue_id, composite_id, level_key`` (empty: no
    floor), ``plane_m, floor_id, floor_plane_m, ambiguous, verdict``; ``objects``: ``venue_id, composite_id, object_id, opaque``; ``context``:
    ``venue_id, object_id`` of what the producer called contextual; ``floors``: ``venue_id, floor_id, p90_m, band_m, median_shift_m``; ``clusters``: ``venue_id,
    floor_id, east_m, north_m, distance_m``. Package-wide gates come first, then those of levels, of the mapping, and of floors. A level
    all of whose objects are contextual needs no floor; one without a plane is asked nothing more. A row's order within its venue
    is fixed, so the same package gives the same list.
    """
    none = F.lit(None).cast("double")
    blank = F.lit("")

    def gate(rows: DataFrame, stage: int, within: int, code: str, subject, key, measured=none, band=none) -> DataFrame:
        cast = lambda c: (c if not isinstance(c, float) else F.lit(c)).cast("double")
        return rows.select("venue_id", F.lit(stage).alias("_s"), key.cast("string").alias("_k"), F.lit(within).alias("_w"), subject.cast("string").alias("subject"), F.lit(code).alias("code"), cast(measured).alias("measured"), cast(band).alias("band"))

    marked = objects.join(context.distinct().withColumn("_known", F.lit(True)), ["venue_id", "object_id"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    about = marked.groupBy("venue_id", "composite_id").agg(F.bool_and("_known").alias("_context"))
    keyed = levels.where("level_key <> ''").join(about, ["venue_id", "composite_id"], "left").where("not coalesce(_context, true)")
    loose = marked.where("opaque and not _known").join(levels.where("level_key = ''").select("venue_id", "composite_id"), ["venue_id", "composite_id"], "left_semi")
    level, flat = F.col("composite_id"), keyed.where("plane_m is not null")
    order = Window.partitionBy("venue_id").orderBy("plane_m", "composite_id")
    placed = levels.where("plane_m is not null and floor_plane_m is not null").withColumn("_below", F.lag("floor_plane_m").over(order))
    spread = levels.where("plane_m is not null and floor_id is not null").groupBy("venue_id", "floor_id").agg((F.max("plane_m") - F.min("plane_m")).alias("spread"))
    asset, floor = F.col("asset_version"), F.col("floor_id")
    place = F.concat(floor, F.lit(" @ "), F.round("east_m").cast("bigint").cast("string"), F.lit(","), F.round("north_m").cast("bigint").cast("string"))
    found = [
        gate(packages.where("not integrity_verified"), 0, 0, "integrityUnresolved", asset, blank),
        gate(packages.where("capability_profile is null"), 0, 1, "capabilityProfileMissing", asset, blank),
        gate(loose, 1, 0, "unclassifiedOpaqueContent", F.col("object_id"), level),
        gate(keyed.where("plane_m is null"), 1, 1, "levelPlaneUnresolved", level, level),
        gate(flat.where("floor_id is null"), 1, 2, "levelNotMapped", level, level),
        gate(flat.where("verdict = 'contradicts'"), 1, 3, "levelLabelContradiction", level, level),
        gate(levels.where("ambiguous"), 2, 0, "levelMappingAmbiguous", level, level, band=tolerance_m),
        gate(placed.where("floor_plane_m < _below"), 3, 0, "levelMappingScrambled", level, F.format_string("%020.6f", F.col("plane_m") + 1e9), F.col("floor_plane_m"), F.col("_below")),
        gate(spread.where(F.col("spread") > tolerance_m), 4, 0, "levelMappingCollapsed", floor, floor, F.col("spread"), tolerance_m),
        gate(floors.where("p90_m > band_m"), 5, 0, "registrationOutOfBand", floor, floor, F.col("p90_m"), F.col("band_m")),
        gate(floors.where(F.col("median_shift_m") > shift_m), 5, 1, "coherentShiftOutOfBand", floor, floor, F.col("median_shift_m"), shift_m),
        gate(clusters, 5, 2, "coherentResidual", place, floor, F.col("distance_m"), coherent_m),
    ]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return numbering.numbered(every, ["venue_id"], ["_s", "_k", "_w", "subject", "measured"], "gate_order").select("venue_id", "gate_order", "code", "subject", "measured", "band")
