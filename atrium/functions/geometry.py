"""Column builders over rings and positions (arrays of structs ``lon, lat``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from atrium.functions import scalars


def _turns(ring: Column) -> Column:
    """Cross products of consecutive vertices relative to the first one, with the sums that a centroid needs."""
    origin = ring[0]
    local = F.transform(ring, lambda p: F.struct((p["lon"] - origin["lon"]).alias("x"), (p["lat"] - origin["lat"]).alias("y")))
    pairs = F.zip_with(F.slice(local, F.lit(1), F.size(ring) - 1), F.slice(local, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda s: F.struct((s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]).alias("c"), (s["a"]["x"] + s["b"]["x"]).alias("x"), (s["a"]["y"] + s["b"]["y"]).alias("y")))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, t: s + value(t))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring in square degrees."""
    return _total(_turns(ring), lambda t: t["c"]) / 2


def ring_centroid(ring: Column) -> Column:
    """Centroid of a closed ring; of a ring without area the mean of its vertices."""
    turns = _turns(ring)
    twice = _total(turns, lambda t: t["c"])
    open_ring = F.slice(ring, F.lit(1), F.size(ring) - 1)
    mean = lambda k: F.aggregate(open_ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(open_ring)
    flat = F.abs(twice / 2) < 1e-14
    at = lambda k, c: F.when(flat, mean(c)).otherwise(ring[0][c] + _total(turns, lambda t: t["c"] * t[k]) / (3 * twice))
    return F.struct(at("x", "lon").alias("lon"), at("y", "lat").alias("lat"))


def geometry_center(positions: Column) -> Column:
    """Centre of the box of the finite positions; null without any."""
    fine = F.filter(positions, lambda p: F.coalesce((F.abs(p["lon"]) < float("inf")) & (F.abs(p["lat"]) < float("inf")) & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]), F.lit(False)))
    middle = lambda c: (F.array_min(F.transform(fine, lambda p: p[c])) + F.array_max(F.transform(fine, lambda p: p[c]))) / 2
    return F.when(F.size(fine) > 0, F.struct(middle("lon").alias("lon"), middle("lat").alias("lat")))


def sample_line(a: Column, b: Column, step_m: float) -> Column:
    """Positions from one end to the other, both included, at most ``step_m`` apart."""
    n = F.greatest(F.lit(1), F.ceil(scalars.haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]) / step_m).cast("int"))
    at = lambda k, c: a[c] + (b[c] - a[c]) * (k / n)
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(at(k, "lon").alias("lon"), at(k, "lat").alias("lat")))


def sample_cells(a: Column, b: Column, step_m: float) -> Column:
    """Middles of equal parts of at most ``step_m``, the ends left out."""
    n = F.greatest(F.lit(1), F.ceil(scalars.haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]) / step_m).cast("int"))
    at = lambda k, c: a[c] + (b[c] - a[c]) * ((k + 0.5) / n)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(k, "lon").alias("lon"), at(k, "lat").alias("lat")))
