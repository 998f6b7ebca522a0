"""Spurs, bridges and shortcuts on small floors, against plain loops and by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from atrium.functions import scalars
from atrium.operators import skeleton
from atrium.scratch import Scratch

LON0, LAT0 = 139.75, 35.68
MX = scalars.DEGREE_M * math.cos(math.radians(LAT0))


def lonlat(x, y):
    return LON0 + x / MX, LAT0 + y / scalars.DEGREE_M


def nodes_frame(spark, points):
    return spark.createDataFrame([("V", 0.0, k, *lonlat(x, y)) for k, (x, y) in points.items()], "venue_id string, ordinal double, node_id long, lon double, lat double")


def edges_frame(spark, edges):
    return spark.createDataFrame([("V", a, b) for a, b in edges], "venue_id string, a long, b long")


def boundary_frame(spark, *rings):
    rows = []
    for k, ring in enumerate(rings):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            rows.append(("V", 0.0, f"s{k}", *lonlat(ax, ay), *lonlat(bx, by)))
    return spark.createDataFrame(rows, "venue_id string, ordinal double, shape_id string, ax double, ay double, bx double, by double")


HALL = [(-100, -100), (200, -100), (200, 200), (-100, 200)]


def kept(spark, points, edges, *rings):
    return {(r.a, r.b) for r in skeleton.prune_spurs(nodes_frame(spark, points), edges_frame(spark, edges), boundary_frame(spark, *(rings or (HALL,)))).collect()}


def test_short_leaf_chains_go_and_the_rest_stays(spark):
    points = {0: (0, 0), 1: (20, 0), 2: (40, 0), 3: (20, 1), 4: (20, 2.5), 5: (20, -9), 6: (90, 90), 7: (91, 91), 8: (60, 0), 9: (60, 20), 10: (70, 10)}
    edges = [(0, 1), (1, 2), (1, 3), (3, 4), (1, 5), (6, 7), (8, 9), (9, 10), (10, 8), (8, 8), (2, 1)]
    # 3-4 is a chain of 2.5 m, 5 is 9 m away, 6-7 a free piece of 1.4 m, 8-9-10 a ring without leaves
    assert kept(spark, points, edges) == {(0, 1), (1, 2), (1, 5), (8, 9), (9, 10), (8, 10)}


def test_narrowing_wedges_go_but_square_ends_stay(spark):
    # a wide hall with a wedge to the right and a corridor of even width to the left
    ring = [(0, 0), (20, 0), (20, 8), (27, 10), (20, 12), (20, 20), (0, 20), (0, 11), (-6, 11), (-6, 9), (0, 9)]
    points = {0: (10, 10), 1: (10, 3), 2: (10, 17), 3: (18, 10), 4: (25, 10), 5: (2, 10), 6: (-5, 10)}
    edges = [(0, 1), (0, 2), (0, 3), (3, 4), (0, 5), (5, 6), (3, 1), (5, 2)]
    left = kept(spark, points, edges, ring)
    assert (3, 4) not in left and (5, 6) in left


def test_a_long_chain_takes_a_logarithmic_number_of_rounds(spark, monkeypatch):
    n = 3000
    edges = spark.createDataFrame([("V", k, k + 1, 1.0) for k in range(n)], "venue_id string, a long, b long, metres double")
    degree = spark.createDataFrame([("V", k, 2 if 0 < k < n else 1) for k in range(n + 1)], "venue_id string, node_id long, n int")
    kept_names = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, name, frame: kept_names.append(name) or keep(self, name, frame))
    ends = {(r.a, r.b): (r.end, r.metres) for r in skeleton.chain_ends(edges, degree, Scratch(spark, "t")).collect()}
    assert ends[0, 1] == (n, float(n)) and ends[7, 6] == (0, 7.0) and len(ends) == 2 * n
    assert len(kept_names) <= math.ceil(math.log2(n)) + 2


def test_bridges_equal_a_plain_pass(spark):
    rng = random.Random(4)
    points = {k: (rng.uniform(0, 14), rng.uniform(0, 14)) for k in range(70)}
    edges = [(a, b) for a in points for b in points if a < b and math.dist(points[a], points[b]) < 1.0]
    wall = [(6.9, 2), (7.1, 2), (7.1, 12), (6.9, 12)]  # a hole that no bridge may cross
    root = {k: k for k in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for a, b in edges:
        join(a, b)
    best = {}
    for a in points:
        for b in points:
            if a < b and find(a) != find(b) and math.dist(points[a], points[b]) <= 2.0:
                key = tuple(sorted((find(a), find(b))))
                best[key] = min(best.get(key, (9e9,)), (math.dist(points[a], points[b]), a, b))

    def clear(a, b):
        for k in range(1, 10):
            x, y = (points[a][i] + (points[b][i] - points[a][i]) * k / 10 for i in (0, 1))
            dx, dy = max(6.9 - x, 0, x - 7.1), max(2 - y, 0, y - 12)
            if math.hypot(dx, dy) < 0.4:
                return False
        return True

    want = set()
    for key in sorted(best):
        _, a, b = best[key]
        if find(a) != find(b) and clear(a, b):
            join(a, b)
            want.add((a, b))
    got = skeleton.bridge_components(nodes_frame(spark, points), edges_frame(spark, edges), boundary_frame(spark, HALL, wall)).collect()
    assert {(r.a, r.b) for r in got} == want and len(want) > 3


def test_shortcuts_over_open_space(spark):
    # a network in the form of a U through a hall: 0-1-2-3, its ends 20 m apart and 80 m by the network; 4 and 5 stand near a wall
    points = {0: (0, 0), 1: (0, 30), 2: (20, 30), 3: (20, 0), 4: (-97, 0), 5: (-97, 30), 6: (-60, 30), 7: (-60, 0)}
    edges = [(0, 1), (1, 2), (2, 3), (4, 7), (7, 6), (6, 5)]
    find = lambda *rings: {(r.a, r.b): round(r.metres) for r in skeleton.shortcut_candidates(nodes_frame(spark, points), edges_frame(spark, edges), boundary_frame(spark, *rings)).collect()}
    assert find(HALL) == {(0, 3): 20}
    # a kiosk between them, and one beside the way that leaves less than five metres
    assert find(HALL, [(8, -1), (12, -1), (12, 1), (8, 1)]) == {} and find(HALL, [(8, 4), (12, 4), (12, 6), (8, 6)]) == {}


def test_a_node_has_two_shortcuts_at_most(spark):
    # a star of teeth: a comb whose tips are 12 m apart and 72 m by the network
    points = {k: (12.0 * (k % 7), 30.0 * (k // 7)) for k in range(14)}
    edges = [(k, k + 7) for k in range(7)] + [(7 + k, 8 + k) for k in range(6)]
    got = [(r.a, r.b) for r in skeleton.shortcut_candidates(nodes_frame(spark, points), edges_frame(spark, edges), boundary_frame(spark, HALL)).collect()]
    pairs = [(a, b) for a in points for b in points if a < b and 10 <= math.dist(points[a], points[b]) <= 40]
    walk = lambda a, b: (math.dist(points[a], points[b]) if (a < 7) == (b < 7) and a >= 7 else abs(points[a][0] - points[b][0]) + 30.0 * ((a < 7) + (b < 7)) if a != b and (a % 7 != b % 7) else math.dist(points[a], points[b]))
    used, want = dict.fromkeys(points, 0), []
    for a, b in sorted(pairs):
        d = math.dist(points[a], points[b])
        if walk(a, b) > max(d / 0.7, d + 15) and used[a] < 2 and used[b] < 2:
            used[a] += 1
            used[b] += 1
            want.append((a, b))
    assert sorted(got) == want and max(used.values()) == 2


@pytest.mark.parametrize("operator", [skeleton.prune_spurs, skeleton.bridge_components, skeleton.shortcut_candidates])
def test_empty_tables(spark, operator):
    nodes, edges, boundary = nodes_frame(spark, {0: (0, 0)}), edges_frame(spark, [(0, 0)]), boundary_frame(spark, HALL)
    assert operator(nodes.limit(0), edges.limit(0), boundary).count() == 0
    assert operator(nodes, edges, boundary.where(F.lit(False))).count() == 0
