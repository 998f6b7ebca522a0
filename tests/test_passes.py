"""What makes the paths runs once, however often an operator reads them."""

from atrium.operators import network, scene
from atrium.plans import network_queries


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_network_qa_makes_its_edges_once(spark):
    nodes = spark.createDataFrame([("v", n, 0.0) for n in range(1, 8)], "venue_id string, node_id long, ordinal double")
    edges = spark.range(1, 8).selectExpr("'v' as venue_id", "id as from_id", "case when id in (3, 6, 7) then id else id + 1 end as to_id").where("from_id <> 7")
    found = network.network_qa(nodes, edges)
    assert sorted(tuple(r) for r in found.collect()) == [("v", "disconnected_component", "3"), ("v", "isolated_node", "7")]
    assert "Range (" not in plan_of(found)
    report = network.connectivity_report(nodes, edges)
    assert tuple(report.collect()[0])[:4] == ("v", 7, 6, 3) and "Range (" not in plan_of(report)


def test_path_warnings_are_those_of_both_checks(spark):
    nodes = spark.createDataFrame([("v", 1), ("v", 2), ("w", 3)], "venue_id string, node_id long")
    rows = [("v", 1, 1, 2, 5.0), ("v", 2, 1, 3, 5.0), ("v", 3, 9, 2, -1.0), ("v", 4, None, 2, 0.0), ("w", 5, 3, 3, float("nan")), ("w", 6, 3, 3, None), ("w", 7, 3, 3, float("inf")), ("v", 1, 1, 3, 1.0)]
    paths = spark.createDataFrame(rows, "venue_id string, path_id long, from_id long, to_id long, cost double")
    fine, invalid = network.invalid_costs(paths)
    both = invalid.union(network.dangling_edges(fine, nodes)[1])
    assert sorted(map(tuple, network.path_warnings(paths, nodes).collect())) == sorted(map(tuple, both.collect()))


def test_network_warnings_read_the_paths_once(spark):
    plan = plan_of(network_queries.network_warnings(spark, "/root/testdata/sf0.001"))
    assert sum("o_orderkey" in line and "Relation" in line for line in plan.splitlines()) == 2  # fx_paths itself reads them twice


def test_conveyance_links_are_found_once(spark):
    units = spark.createDataFrame([("v", 0.0, "a")], "venue_id string, ordinal double, unit_id string")
    corners = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001)]
    sides = [("v", 0.0, "a", *p, *q) for p, q in zip(corners, corners[1:] + corners[:1])]
    segments = spark.createDataFrame(sides, "venue_id string, ordinal double, shape_id string, ax double, ay double, bx double, by double")
    links = spark.range(1, 4).selectExpr("'v' as venue_id", "id as path_id", "0d as low_ordinal", "0.0005d as low_lon", "0.0005d as low_lat", "cast(3 - id as double) as high_ordinal", "0.0005d as high_lon", "0.0005d as high_lat")
    found = scene.conveyance_links(units, segments, links)
    assert [tuple(r) for r in found.collect()] == [("v", "a", 2, 1.0, "up")]
    assert "Range (" not in plan_of(found)
