"""Bulk edits of a network that the given tables do not hold."""

from atrium.operators import network

KIND = "venue_id string, request_id long, op string, node_id long, ordinal double, lon double, lat double, from_id long, to_id long, path_id long, rpath_id long"


def edit(request, op, node=None, at=(None, None), ends=(None, None), ids=(None, None), floor=0.0):
    return ("v", request, op, node, floor, *at, *ends, *ids)


def test_edits_of_junctions_and_connections(spark):
    nodes = spark.createDataFrame([("v", n, float(n == 5), 0.001 * n, 0.0) for n in range(1, 6)], "venue_id string, node_id long, ordinal double, lon double, lat double")
    line = lambda a, b: [(0.001 * a, 0.0), (0.5, 0.5), (0.001 * b, 0.0)]
    rows = [("v", 1, 2, 10, 11, line(1, 2)), ("v", 2, 1, 11, 10, line(2, 1)), ("v", 2, 3, 12, 13, line(2, 3)), ("v", 3, 4, 14, 15, line(3, 4)), ("v", 4, 5, None, None, line(4, 5)), ("v", 5, 4, None, None, line(5, 4))]
    edges = spark.createDataFrame([(*r, 7, 1) for r in rows], "venue_id string, from_id long, to_id long, path_id long, rpath_id long, points array<struct<lon double, lat double>>, cost long, gate int")
    edits = [
        edit(1, "move", 1, (0.01, 0.02)), edit(2, "move", 2, (0.0, 95.0)), edit(3, "delete", 3), edit(4, "delete", 9), edit(5, "add", at=(0.2, 0.1)), edit(6, "connect", ends=(2, 4)), edit(7, "connect", ends=(4, 2)),
        edit(8, "connect", ends=(2, 3)), edit(9, "connect", ends=(1, 1)), edit(10, "connect", ends=(1, 5)), edit(11, "connect", ends=(1, 2)), edit(12, "disconnect", ids=(15, 14)), edit(13, "disconnect", ids=(15, 16)), edit(14, "connect", ends=(6, 4)),
    ]
    junctions, paths, refused = network.apply_network_edits(nodes, edges, spark.createDataFrame(edits, KIND))
    assert {r.node_id: (r.lon, r.lat, r.path_count) for r in junctions.collect()} == {1: (0.01, 0.02, 1), 2: (0.002, 0.0, 2), 4: (0.004, 0.0, 3), 5: (0.005, 0.0, 1), 6: (0.2, 0.1, 1)}
    got = sorted((r.from_id, r.to_id, r.path_id, r.rpath_id, r.gate) for r in paths.where("path_id is not null").collect())
    assert got == [(1, 2, 10, 11, 1), (2, 1, 11, 10, 1), (2, 4, 12, 13, 0), (4, 2, 13, 12, 0), (4, 6, 15, 14, 0), (6, 4, 14, 15, 0)] and paths.count() == 8
    lines = {r.path_id: (r.cost, [tuple(p) for p in r.points]) for r in paths.where("path_id is not null").collect()}
    assert lines[10] == (7, [(0.01, 0.02), (0.5, 0.5), (0.002, 0.0)]) and lines[11] == (7, [(0.002, 0.0), (0.5, 0.5), (0.01, 0.02)])
    assert lines[13] == (222390, [(0.004, 0.0), (0.002, 0.0)])
    assert {r.request_id: r.reason for r in refused.collect()} == {2: "off_the_globe", 4: "unknown_junction", 7: "exists", 8: "unknown_junction", 9: "same_junction", 10: "other_floor", 11: "exists", 13: "unknown_connection"}
