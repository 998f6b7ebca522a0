import json

from atrium.sources import collections

A, B = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"


def write(folder, name, features):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def test_collections_and_their_findings(spark, tmp_path):
    write(tmp_path / "v1", "venue", [{"id": A, "type": "Feature", "feature_type": "venue", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": {"en": "x"}}}])
    write(tmp_path / "v1", "level", [{"id": B, "type": "Feature", "geometry": None, "properties": None}, {"type": "Feature", "geometry": 5, "properties": {"id": "bad", "feature_type": "unit"}}])
    write(tmp_path / "v2", "level", [])
    write(tmp_path / "v2", "unit", [{"id": A, "type": "Feature", "geometry": None, "properties": {}}, {"id": A, "type": "Feature", "geometry": None, "properties": {}}])
    rows = collections.read_feature_collections(spark, str(tmp_path))
    got = {(r.venue_id, r.feature_type, r.pos): r for r in rows.collect()}
    assert len(got) == 5
    assert got["v1", "venue", 0].geometry == '{"type":"Point","coordinates":[1,2]}' and got["v1", "venue", 0].feature_id == A
    assert got["v1", "level", 0].properties == "{}" and got["v1", "level", 0].geometry is None
    assert (got["v1", "level", 1].feature_id, got["v1", "level", 1].declared_type, got["v1", "level", 1].geometry) == ("bad", "unit", None)
    manifest = spark.createDataFrame([("v1", "1.0.0", "en"), ("v2", "2.0", "en")], "venue_id string, version string, language string")
    found = sorted((r.venue_id, r.code, r.subject) for r in collections.collection_violations(rows, manifest).collect())
    assert found == [
        ("v1", "invalid_id", "bad"), ("v1", "type_mismatch", "bad"), ("v2", "duplicate_id", A), ("v2", "level_missing", ""), ("v2", "manifest", "2.0"), ("v2", "venue_count", ""),
    ]
    names = spark.createDataFrame([("v1", "level.geojson"), ("v1", "notes.txt"), ("v1", "manifest.json")], "venue_id string, name string")
    assert [r.subject for r in collections.unknown_entries(names).collect()] == ["notes.txt"]


def test_network_files(spark, tmp_path):
    nodes = [{"venue_id": "v", "pos": 0, "NODEID": 1, "FLOOR": "F1", "coordinates": [1.0, 2.0]}, {"venue_id": "v", "pos": 1, "NODEID": 1, "FLOOR": "F2", "coordinates": [3.0, 4.0]}, {"venue_id": "v", "pos": 2}]
    paths = [{"venue_id": "v", "FNODEID": 1, "TNODEID": 2, "cost": 5.0, "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0]]]}, {"venue_id": "v", "FNODEID": 1, "cost": 5.0}]
    for name, rows in (("nodes", nodes), ("paths", paths)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    junctions, edges = collections.read_network(spark, str(tmp_path / "nodes.json"), str(tmp_path / "paths.json"))
    assert [(r.node_id, r.floor, r.lon) for r in junctions.collect()] == [(1, "F2", 3.0)]
    assert [(r.from_id, r.to_id, r.interior) for r in edges.collect()] == [(1, 2, [[1.0, 1.0]])]
