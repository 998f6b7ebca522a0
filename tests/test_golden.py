"""Literal cases of single operators."""

import math
import random

import pytest
from pyspark.sql import Row, functions as F

from atrium.functions import scalars
from atrium.operators import graph, network, records, registration, resolve, spatial
from atrium.scratch import Scratch
from atrium.streaming import feeds


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in rows.select("k", build(F.col("v")).alias("out")).orderBy("k").collect()]


def test_floor_labels(spark):
    labels = ["F1", "F36", "B1", "M2", "KB3", "SB4F", "R", "", None, "rf", " f2f ", "F", "1F", "F1x"]
    assert column(spark, labels, "string", scalars.floor_to_ordinal) == [0, 35, -1, 2, -3, -4, None, None, None, None, 1, None, None, None]


def test_free_text_floors(spark):
    texts = ["B2FL(1FL)_x(TP-5.11)", "地下1階", "GF", "0", "Station_2_B1_level", "roof", "ground floor", "floor12", "61", "b11", "  ", None]
    assert column(spark, texts, "string", scalars.extract_floor_ordinal) == [-2, -1, 0, 0, -1, None, 0, 11, None, None, None, None]


def test_both_floor_parsers_agree_on_the_common_grammar(spark):
    labels = [f"{p}{n}" for p in ("F", "B", "M", "KB") for n in range(1, 11)]
    assert column(spark, labels, "string", scalars.floor_to_ordinal) == column(spark, labels, "string", scalars.extract_floor_ordinal)


def test_label_forms_agree(spark):
    pairs = [("L1", "1F"), ("b1fl", "B1F"), ("B1", "B1F"), ("LEVEL 2", "2F"), ("地下1階", "B1F"), ("Ｂ１Ｆ", "B1F")]
    forms = column(spark, [x for p in pairs for x in p], "string", scalars.floor_label_candidates)
    assert all(set(a) & set(b) for a, b in zip(forms[::2], forms[1::2]))
    assert column(spark, ["roof", "half", "lobby"], "string", scalars.floor_label_candidates) == [["roof"], ["half"], ["lobby"]]


def test_haversine_of_a_null_is_null(spark):
    assert column(spark, [None, 1.0], "double", lambda v: F.round(scalars.haversine_m(v, F.lit(0.0), F.lit(0.0), F.lit(0.0)))) == [None, 111195.0]


def test_search_text_is_compatibility_form(spark):
    assert column(spark, ["Ｃafé  ﬁ\t X", None, ""], "string", scalars.normalize_search_text) == ["café fi x", None, ""]


def stars(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.component for r in graph.component_stars(frame, Scratch(spark, "test")).collect()}


def test_components_of_chains_hubs_and_noise(spark):
    rng = random.Random(4)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000), (6000, None), (6001, 6002), (6002, 6001)]
    got = stars(spark, edges)
    assert got == {**{k: 0 for k in range(300)}, **{k: 1000 for k in range(1000, 1400)}, 6001: 6001, 6002: 6001}
    assert stars(spark, []) == {}


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert stars(spark, edges) == {x: root(x) for x in touched}


PATH = "venue_id string, from_id long, to_id long, path_id long, rpath_id long, cost double"


def test_reverse_pairs_collapse(spark):
    rows = [("v", 1, 2, 1, 2, 100.0), ("v", 2, 1, 2, 1, 100.0), ("v", 1, 2, 3, 4, 200.0), ("v", 2, 1, 4, 3, 200.0)]
    got = network.collapse_reciprocal(spark.createDataFrame(rows, PATH)).collect()
    assert sorted((r.path_id, r.cost) for r in got) == [(1, 100.0), (3, 200.0)] and not any(r.conflict for r in got)


def test_shared_ids_that_are_no_reverse_are_kept_and_marked(spark):
    rows = [("v", 1, 2, 1, 2, 1.0), ("v", 1, 3, 2, 1, 1.0), ("v", 4, 5, None, None, 1.0)]
    got = {(r.from_id, r.to_id): r.conflict for r in network.collapse_reciprocal(spark.createDataFrame(rows, PATH)).collect()}
    assert got == {(1, 2): True, (1, 3): True, (4, 5): False}


def test_dangling_and_unmapped(spark):
    nodes = spark.createDataFrame([("v", 1, "F1"), ("v", 2, "F1"), ("v", 3, "garbage")], "venue_id string, node_id long, floor string")
    paths = spark.createDataFrame([("v", 1, 2, 1, 2, 5.0), ("v", 1, 3, 3, 4, 5.0), ("v", 2, 99, 5, 6, 5.0), ("v", 1, 2, 7, 8, float("nan"))], PATH)
    kept, unmapped = network.mapped_nodes(nodes)
    fine, invalid = network.invalid_costs(paths)
    edges, lost = network.dangling_edges(fine, kept)
    assert [r.path_id for r in edges.collect()] == [1]
    assert [(r.code, r.subject) for r in unmapped.union(invalid).collect()] == [("unmapped_floor", "3"), ("invalid_cost", "7")]
    assert sorted(r.subject for r in lost.collect()) == ["3", "5"]


def test_paths_are_least_costs(spark):
    rng = random.Random(2)
    edges = [("v", rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 50))) for _ in range(90)]
    far = [[0.0 if a == b else math.inf for b in range(30)] for a in range(30)]
    for _, a, b, c in edges:
        far[a][b] = min(far[a][b], c) if a != b else 0.0
    for k in range(30):
        for a in range(30):
            for b in range(30):
                far[a][b] = min(far[a][b], far[a][k] + far[k][b])
    pairs = [(a * 30 + b, "v", a, b) for a in range(0, 30, 7) for b in range(0, 30, 3)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "venue_id string, from_id long, to_id long, cost double"), spark.createDataFrame(pairs, "od_id long, venue_id string, source long, target long"))
    assert {r.od_id: r.cost for r in got.collect()} == {o: None if math.isinf(far[a][b]) else far[a][b] for o, _, a, b in pairs}


def test_time_windows_may_span_midnight(spark):
    rows = spark.createDataFrame([(1320, 300), (540, 1320), (-1, 300)], "start_minute int, end_minute int").selectExpr("*", "null as vertical", "null as clearance", "0 as barrier", "0 as gate")
    at = lambda m: [r[0] for r in rows.select(network.edge_allowed(network.RouteProfile(minute=m))).collect()]
    assert at(1350) == [True, False, True] and at(299) == [True, False, True] and at(300) == [False, False, True] and at(540) == [False, True, True]


def test_points_on_shapes_with_a_hole(spark):
    ring = lambda *xy: [Row(lon=139.0 + x / 1e4, lat=35.0 + y / 1e4) for x, y in xy]
    outer, hole = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))
    rings = spark.createDataFrame([("v", 0.0, "s", outer), ("v", 0.0, "s", hole)], "venue_id string, ordinal double, shape_id string, points array<struct<lon:double,lat:double>>")
    at = [(1, 1.5, 1.7), (2, 5.1, 5.2), (3, 11.0, 5.0), (4, 8.3, 5.1)]
    points = spark.createDataFrame([("v", 0.0, k, 139.0 + x / 1e4, 35.0 + y / 1e4) for k, x, y in at], "venue_id string, ordinal double, point_id long, lon double, lat double")
    segments = spatial.ring_segments(rings)
    assert sorted(r.point_id for r in spatial.inside_shapes(points, segments).collect()) == [1, 4]
    assert sorted(r.point_id for r in spatial.clip_to_venue(points, segments, 12.0).collect()) == [1, 2, 3, 4]


def test_nearest_rank_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", None)], "k string, residual_m double")
    assert [tuple(r) for r in registration.residual_stats(rows, "k").collect()] == [("a", 3, 2.0, 3.0, 3.0)]


def test_bounds_fall_back_to_levels(spark):
    levels = spark.createDataFrame([("v", "a", 0.0, 1.0, 2.0, 3.0), ("v", "b", -1.0, 2.0, 1.0, 9.0)], "venue_id string, level_id string, west double, south double, east double, north double")
    venue = spark.createDataFrame([("v", None, None, None, None)], "venue_id string, west double, south double, east double, north double")
    assert tuple(resolve.venue_bounds(venue, levels).collect()[0])[1:] == (-1.0, 1.0, 2.0, 9.0)


def test_rate_limit_ignores_rejections_in_batch_and_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(1, k, start + timedelta(seconds=s)) for k, s in enumerate([0, 10, 20, 30, 61, 62, 75, 200])]
    frame = spark.createDataFrame(rows, "author long, event_id long, ts timestamp")
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True}
    assert {r.event_id: r.accepted for r in records.upload_rate_limit(frame, 2, 60).collect()} == want
    frame.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "hits"))
    stream = feeds.upload_rate_limit(feeds.read_stream(spark, str(tmp_path / "hits"), 10), 2, 60)
    assert {r.event_id: r.accepted for r in stream.collect()} == want


def test_scratch_follows_the_shared_folder(spark):
    scratch = Scratch(spark, "x")
    assert scratch.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = scratch.keep("t", spark.range(5))
    assert kept.count() == 5
    scratch.drop("t")
    with pytest.raises(Exception):
        kept.count()


def test_matching_is_one_to_one_and_global():
    from atrium.operators.synthesis import best_matching

    pairs = lambda *rows: [(a, b) for a, b, _ in best_matching([(str(x), str(y), d) for x, y, d in rows])]
    assert pairs((1, 10, 1.0), (2, 10, 1.1), (2, 11, 2.0)) == [("1", "10"), ("2", "11")]
    assert pairs((1, 10, 1), (1, 11, 2), (2, 10, 1.1), (2, 11, 100)) == [("1", "11"), ("2", "10")]
    assert pairs((1, 10, 1), (1, 11, 0), (2, 10, 2), (2, 11, 1)) == [("1", "10"), ("2", "11")]


def test_large_matching_equals_all_assignments():
    from itertools import permutations

    from atrium.operators.synthesis import best_matching

    rng = random.Random(6)
    lows, highs = [f"a{k}" for k in range(7)], [f"b{k}" for k in range(7)]
    rows = [(a, b, rng.random()) for a in lows for b in highs]
    cost = {(a, b): round(d * 1e6) for a, b, d in rows}
    least = min(sum(cost[a, b] for a, b in zip(lows, order)) for order in permutations(highs))
    got = best_matching(rows)
    assert len(got) == 7 and sum(cost[a, b] for a, b, _ in got) == least


def test_transit_units_join_the_hubs_that_they_touch(spark):
    from atrium.operators import synthesis

    metre = 1 / scalars.DEGREE_M
    box = lambda v, s, x, y, w, h: [(v, 0, s, x * metre, y * metre, (x + w) * metre, y * metre, (x + w / 2) * metre, (y + h / 2) * metre), (v, 0, s, x * metre, (y + h) * metre, x * metre, y * metre, (x + w / 2) * metre, (y + h / 2) * metre)]
    boxes = [("near", 3, 0, 4, 4), ("linked", 0, 3, 4, 4), ("off", 6, 6, 4, 4), ("long", 2.5, -50, 0.5, 200)]
    rows = [r for s, *b in boxes for r in box("v", s, *b)] + box("v", "lift", -1, -1, 2, 2) + box("w", "other", 1, 0, 4, 4)
    hubs = spark.createDataFrame(rows, "venue_id string, ordinal int, shape_id string, ax double, ay double, bx double, by double, centre_lon double, centre_lat double")
    lift = spark.createDataFrame([("v", 0, "lift", 0.0, 0.0)], "venue_id string, ordinal int, point_id string, lon double, lat double")
    walls = spark.createDataFrame([("v", "lift", "linked", 5.4)], "venue_id string, shape_id string, other_id string, metres double")
    touching = spatial.transit_touch_links(lift, hubs, walls)
    assert [(r.venue_id, r.shape_id, r.other_id, round(r.metres, 1)) for r in touching.collect()] == [("v", "lift", "near", 5.4)]
    none = spark.createDataFrame([], "venue_id string, opening_id string, hub_id string, metres double, category string, lower_id string, upper_id string")
    edges = synthesis.hub_network(none, walls, touching, none).collect()
    assert sorted((r.kind, r.a, r.b) for r in edges) == [("shared", "lift", "linked"), ("touch", "lift", "near")]


def test_streams_over_many_batches(spark, tmp_path):
    """Batches that follow one another give what one batch over everything gives; late beats go to their own table."""
    import datetime
    import random

    from atrium.operators import records
    from atrium.streaming import feeds

    rng = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    rows = sorted((k, rng.randint(0, 3), day + datetime.timedelta(seconds=rng.randint(0, 4000))) for k in range(240))
    rows.sort(key=lambda r: r[2])
    rows = [(k, who, ts) for k, (_, who, ts) in enumerate(rows)]
    kind = "event_id long, author long, ts timestamp"
    for n in range(6):
        spark.createDataFrame(rows[40 * n : 40 * n + 40], kind).coalesce(1).write.parquet(str(tmp_path / "hits" / f"part-{n}"))
    whole = spark.createDataFrame(rows, kind)
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "hits"))
    want = {(r.author, r.event_id, r.accepted) for r in records.upload_rate_limit(whole, 3, 200).collect()}
    assert {(r.author, r.event_id, r.accepted) for r in feeds.upload_rate_limit(source(), 3, 200).collect()} == want
    versions = lambda f: f.withColumnRenamed("author", "version_id")
    numbered = {(r.version_id, r.event_id): r.revision for r in feeds.revision_feed(versions(source())).collect()}
    assert numbered == {(r.version_id, r.event_id): r.revision for r in records.revision_numbers(versions(whole).selectExpr("*", "'accepted' as outcome")).collect()}
    beats = lambda f: f.withColumnRenamed("author", "job_id").select("job_id", "ts")
    closed, still, late = feeds.lease_monitor(beats(source()), 60, 100)
    got = sorted(map(tuple, closed.union(still).collect()))
    assert got == sorted((r.job_id, r.started, r.last_beat, r.beats) for r in records.lease_expiries(beats(whole), 60).collect()) and late.count() == 0
    assert closed.count() > 20 and still.count() >= 1
    spark.createDataFrame([(999, 1, day)], kind).coalesce(1).write.parquet(str(tmp_path / "hits" / "part-late"))
    assert [tuple(r) for r in feeds.lease_monitor(beats(source()), 60, 100)[2].collect()] == [(1, day)]
