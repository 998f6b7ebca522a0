"""Results and growth on copies of the given tables with shifted keys, where places repeat and keys fill up."""

import duckdb
import pytest

from atrium.plans import fixtures, registry

SOURCE = "/root/testdata/sf0.01"
SHIFTED = {
    "customer": {"c_custkey": 1500}, "supplier": {"s_suppkey": 100}, "part": {"p_partkey": 2000}, "orders": {"o_orderkey": 15000, "o_custkey": 1500},
    "lineitem": {"l_orderkey": 15000, "l_partkey": 2000, "l_suppkey": 100}, "events": {"event_id": 10000, "user_id": 150},
}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Tables of 1/100 with customers and parts repeated until many nodes and units share their places, and few orders."""
    folder = str(tmp_path_factory.mktemp("copies"))
    con = duckdb.connect()
    times = {"customer": 30, "part": 5, "supplier": 10}
    for name in fixtures.BASE:
        keys = SHIFTED.get(name, {})
        moved = ", ".join(f"({c} + n.i * {step})::bigint as {c}" for c, step in keys.items())
        rows = f"select * replace ({moved}) from '{SOURCE}/{name}.parquet', range({times.get(name, 1)}) n(i)" if keys else f"select * from '{SOURCE}/{name}.parquet'"
        con.execute(f"copy ({rows}) to '{folder}/{name}.parquet' (format parquet)")
    return folder


def rows_of(folder, sql):
    con = duckdb.connect()
    for name in fixtures.BASE:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str(tuple(r[k] for k in order)) for r in relation.fetchall())


def same_as_sql(spark, folder, name):
    frame = registry.QUERIES[name](spark, folder)
    got = sorted(str(tuple(r)) for r in frame.select(*sorted(frame.columns)).collect())
    assert got and got == rows_of(folder, registry.ORACLES[name])


def test_near_wall_keeps_vertices_at_the_place_of_a_lock(spark, copies):
    same_as_sql(spark, copies, "near_wall")


def test_paths_join_by_place_in_their_venue(spark):
    """The join that finds a path's end has all its keys: its plan meets no node but the one looked for."""
    plan = fixtures.fixture(spark, SOURCE, "fx_paths")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "rn#" in line]
    assert joins and not any(" OR " in line or "||" in line for line in joins)


def test_residuals_far_from_walls_search_by_cells(spark):
    """No join of samples and segments by level alone, and the distance is right however far the wall is."""
    from atrium.operators import scene

    samples = spark.createDataFrame([("v", "a", 1, 0.5, 0.0), ("v", "a", 2, 0.0, 90.0), ("v", "a", 3, 70000.0, 0.0), ("v", "a", 4, 250000.0, 0.0), ("v", "b", 5, 0.0, 0.0)], "venue_id string, level_key string, sample_id long, x double, y double")
    walls = spark.createDataFrame([("v", "a", -1.0, 0.0, 0.0, 0.0), ("v", "a", 0.0, 0.0, 0.0, -1.0)], "venue_id string, level_key string, ax double, ay double, bx double, by double")
    found = scene.residuals(samples, walls, carve_m=1e9)
    assert {r.sample_id: r.residual_m for r in found.collect()} == {1: 0.5, 2: 90.0, 3: 70000.0, 4: 250000.0, 5: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and line.count("level_key#") and not any(c in line for c in ("cx#", "cy#", "sample_id#"))]


def test_nearest_nodes_search_once_from_a_place(spark, monkeypatch):
    """A hundred points and a thousand nodes at two places: no more than ``k`` nodes of a place meet one point of a place."""
    from atrium.operators import spatial

    real, sizes = spatial._node_pairs, []

    def spied(points, nodes, reach_m):
        sizes.append(points.count() * nodes.count())
        return real(points, nodes, reach_m)

    monkeypatch.setattr(spatial, "_node_pairs", spied)
    points = spark.range(100).selectExpr("'v' as venue_id", "0d as ordinal", "id as point_id", "139.7d as lon", "35.6d as lat")
    nodes = spark.range(1000).selectExpr("'v' as venue_id", "0d as ordinal", "1000 - id as node_id", "139.7d + (id % 2) * 0.00001d as lon", "35.6d as lat")
    for reach in (8.0, None):
        got = spatial.nearest_nodes(points, nodes, reach, 3).groupBy("point_id").agg({"node_id": "collect_list"}).collect()
        assert len(got) == 100 and all(sorted(r[1]) == [2, 4, 6] for r in got)
    assert sizes and max(sizes) <= 6


def test_stream_dedupe_over_batches(spark, tmp_path):
    """Batches of one file each give the same outcomes as one window over all, and no group of rows goes to Python."""
    from atrium.streaming import feeds

    kind = "author long, request_id string, request_hash string, ts timestamp, event_id long"
    rows = [(1, "r1", "a", 1), (1, "r1", "a", 2), (1, "r1", "b", 3), (2, "r1", "b", 4), (1, "r2", None, 5), (1, "r2", "x", 6), (1, "r2", None, 7), (None, "r1", "a", 8), (None, "r1", "a", 9)]
    for n, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        frame = spark.createDataFrame([(a, r, h, None, e) for a, r, h, e in part], kind).selectExpr("author", "request_id", "request_hash", "timestamp_seconds(event_id) as ts", "event_id")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = feeds.dedupe_requests(feeds.read_stream(spark, str(tmp_path / "in")))
    assert not found.isStreaming
    want = {1: "accepted", 2: "replayed", 3: "conflict", 4: "accepted", 5: "accepted", 6: "conflict", 7: "conflict", 8: "accepted", 9: "replayed"}
    assert {r.event_id: r.outcome for r in found.collect()} == want


def test_bridges_between_crowded_places(spark, monkeypatch):
    """300 nodes at 25 places with a wall between some: as a plain pass over all pairs, and chords are those of places."""
    import random

    from pyspark.sql import functions as F

    from atrium.functions import scalars
    from atrium.operators import skeleton
    from tests.test_skeleton import HALL, boundary_frame, edges_frame, lonlat, nodes_frame

    rng = random.Random(7)
    spots = [(1.5 * i, 1.5 * j) for i in range(5) for j in range(5)]
    points = {k: rng.choice(spots) for k in rng.sample(range(1000), 300)}
    edges = [tuple(rng.sample(sorted(points), 2)) for _ in range(150)]
    wall = [(2.2, -1), (2.3, -1), (2.3, 3.4), (2.2, 3.4)]  # blocks some places from some, not all
    root = {k: k for k in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    def clear(a, b):
        (ax, ay), (bx, by) = points[a], points[b]
        inner = [(ax + (bx - ax) * k / 10, ay + (by - ay) * k / 10) for k in range(1, 10)]
        return all(((max(2.2 - x, 0, x - 2.3)) ** 2 + (max(-1 - y, 0, y - 3.4)) ** 2) ** 0.5 >= 0.4 for x, y in inner)

    for a, b in edges:
        join(a, b)
    place = nodes_frame(spark, points).withColumnsRenamed({"lon": "x", "lat": "y"})
    both = place.crossJoin(place.selectExpr("node_id as b", "x as bx", "y as by")).where("node_id < b")
    far = both.select("node_id", "b", scalars.haversine_m(*[F.col(c) for c in ("x", "y", "bx", "by")]).alias("m")).where("m <= 2")
    best = {}
    for a, b, m in far.collect():
        if find(a) != find(b):
            key = tuple(sorted((find(a), find(b))))
            best[key] = min(best.get(key, (9e9,)), (m, a, b))
    want = set()
    for key in sorted(best):
        _, a, b = best[key]
        if find(a) != find(b) and clear(a, b):
            join(a, b)
            want.add((a, b))
    real, sizes = skeleton.clear_segments, []

    def spied(chords, *rest):
        sizes.append(chords.count())
        return real(chords, *rest)

    monkeypatch.setattr(skeleton, "clear_segments", spied)
    got = skeleton.bridge_components(nodes_frame(spark, points), edges_frame(spark, edges), boundary_frame(spark, HALL, wall)).collect()
    assert {(r.a, r.b) for r in got} == want and len(want) > 50
    assert sum(sizes) <= 25 * 9


def test_plan_matches_each_name_once(spark):
    """Patterns read distinct names, dealt to all tasks, and a null name keeps its row."""
    from atrium.operators import gdbplan

    layers = spark.range(0, 1000, 1, 1).selectExpr("case id % 4 when 0 then 'Station1_B1_Floor' when 1 then null else 'a_to_b_Floor' end as layer_name", "id as pos", "'polygon' as family", "1 as feature_count")
    plan = gdbplan.suggest_plan(layers)
    found = {(r.layer_name, r.building, r.ordinal, r.included): r["count"] for r in plan.groupBy("layer_name", "building", "ordinal", "included").count().collect()}
    assert found == {("Station1_B1_Floor", "Station1", -1.0, True): 250, (None, None, None, False): 250, ("a_to_b_Floor", None, None, False): 500}
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "regexp_extract" in line)
    assert "Repartition" in lines[at + 1] and "Aggregate [layer_name" in lines[at + 2]


def test_portals_look_once_at_a_place(spark, copies, monkeypatch):
    """Openings at one place are one search, and have the rows of SQL."""
    from atrium.operators import spatial

    real, sizes = spatial.near_segments, []

    def spied(points, *rest):
        sizes.append((points.count(), points.select("ordinal", "venue_id", "lon", "lat", "_lon", "_lat").distinct().count()))
        return real(points, *rest)

    monkeypatch.setattr(spatial, "near_segments", spied)
    same_as_sql(spark, copies, "portals")
    assert sizes and all(a == b for a, b in sizes)


def test_touching_hubs_are_looked_for_close_by(spark, monkeypatch):
    """A lift among 400 small units meets the walls around it only, and has the rows of a look at all walls."""
    from pyspark.sql import functions as F

    from atrium.functions import scalars
    from atrium.operators import spatial

    real, sizes = spatial._near_lines, []

    def spied(points, segments, reach_m):
        out = real(points, segments, reach_m)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(spatial, "_near_lines", spied)
    edge, corner = 0.00004, lambda i, j: F.struct((139.7 + 0.00004 * (F.col("id") % 20 + i)).alias("lon"), (35.6 + 0.00004 * (F.floor(F.col("id") / 20) + j)).alias("lat"))
    units = spark.range(400).select(F.lit("v").alias("venue_id"), F.lit(0.0).alias("ordinal"), F.format_string("u%03d", "id").alias("shape_id"), F.array(*[corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]).alias("points"))
    middle = units.select("venue_id", "shape_id", (F.col("points")[0]["lon"] + edge / 2).alias("centre_lon"), (F.col("points")[0]["lat"] + edge / 2).alias("centre_lat"))
    hubs = spatial.ring_segments(units).join(middle, ["venue_id", "shape_id"])
    lifts = middle.where("shape_id in ('u000', 'u210')").select("venue_id", F.lit(0.0).alias("ordinal"), F.col("shape_id").alias("point_id"), F.col("centre_lon").alias("lon"), F.col("centre_lat").alias("lat"))
    none = spark.createDataFrame([], "venue_id string, shape_id string, other_id string")
    got = {(r.shape_id, r.other_id) for r in spatial.transit_touch_links(lifts, hubs, none).collect()}
    metres, _ = scalars.segment_offset(*[F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by")])
    every = lifts.join(hubs, ["venue_id", "ordinal"]).where("point_id <> shape_id").where(metres <= 3.0).select(F.least("point_id", "shape_id"), F.greatest("point_id", "shape_id")).distinct()
    assert got == {tuple(r) for r in every.collect()} and len(got) > 5
    assert sizes and max(sizes) < 300
