"""Row numbers, venue names, row versions, folded normals and references against plain loops."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.operators import numbering, records, registration
from atrium.plans import gate_queries
from atrium.streaming import feeds


def test_numbers_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if k % 9 == 0 else "hot" if k % 3 else f"k{k % 11}", rng.randint(0, 50), k) for k in range(3000)]
    got = numbering.numbered(spark.createDataFrame(rows, "key string, t int, id long").repartition(5), ["key"], ["t", "id"], "n").collect()
    want = {}
    for key, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = want.get(("last", key), 0) + 1
        want["last", key] = want[i]
    assert {r.id: r.n for r in got} == {i: want[i] for _, _, i in rows}


def plain_slugs(rows):
    taken, out = set(), {}
    for tenant, venue, base in rows:
        n = 1
        while (tenant, base if n == 1 else f"{base}-{n}") in taken:
            n += 1
        slug = base if n == 1 else f"{base}-{n}"
        taken.add((tenant, slug))
        out[tenant, venue] = slug
    return out


@pytest.mark.parametrize("seed", range(6))
def test_names_equal_a_sequential_loop(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-02", "a-1", "b", "b-4", "venue", "venue-3", "a-2-2-2", "a-12"]
    rows = [(rng.randint(0, 1), k, rng.choice(bases[: rng.randint(1, len(bases))]), rng.randint(0, 40)) for k in range(160)]
    frame = spark.createDataFrame(rows, "tenant_id long, venue_id long, name string, created long").repartition(3)
    got = {(r.tenant_id, r.venue_id): r.slug for r in records.unique_slugs(frame).collect()}
    assert got == plain_slugs([(t, v, b) for t, v, b, _ in sorted(rows, key=lambda r: (r[3], r[1]))])


def test_names_of_the_whole_table_are_unique(spark):
    rows = gate_queries.unique_slugs(spark, "/root/testdata/sf0.001").collect()
    assert len({(r.tenant_id, r.slug) for r in rows}) == len(rows) > 100


def plain_versions(rows):
    held, out = {}, {}
    for _, event, comment, op, expected in sorted(rows):
        version, gone = held.get(comment, (0, False))
        if op == "create":
            outcome, version = ("exists", version) if version else ("accepted", 1)
        elif not version:
            outcome = "not_found"
        elif gone:
            outcome = "deleted"
        elif expected != version:
            outcome = "stale"
        else:
            outcome, version, gone = "accepted", version + 1, op == "delete"
        held[comment] = version, gone
        out[event] = outcome, version, gone
    return out, {c: v for c, v in held.items() if v[0]}


def test_row_versions_in_a_stream_that_is_restarted(spark):
    """Files arrive between two runs; the second goes on from the first one's state and repeats nothing."""
    rng = random.Random(3)
    rows = [(float(k), k, rng.randint(0, 9), rng.choice(["create", "patch", "patch", "patch", "delete"]), rng.randint(1, 4)) for k in range(400)]
    schema = "at double, event_id long, comment_id long, op string, expected int"
    folder, at = tempfile.mkdtemp(prefix="spark-feed-"), "file://" + tempfile.mkdtemp(prefix="spark-feed-")
    write = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    outcomes, state = plain_versions(rows)
    write(rows[:150])
    first = feeds.version_checks(feeds.read_stream(spark, folder), at)
    assert first["out"].count() == 150
    write(rows[150:170])
    write(rows[170:])
    found = feeds.version_checks(feeds.read_stream(spark, folder), at)
    got = found["out"].collect()
    assert len(got) == 400 and {r.event_id: (r.outcome, r.row_version, r.deleted) for r in got} == outcomes
    assert {r.comment_id: (r.row_version, r.deleted) for r in found["state"].collect()} == state
    again = feeds.version_checks(feeds.read_stream(spark, folder), at)
    assert again["out"].count() == 400 and again["state"].count() == len(state)
    assert {o for o, _, _ in outcomes.values()} == {"accepted", "exists", "deleted", "stale", "not_found"} or "not_found" not in {o for o, _, _ in outcomes.values()}


def test_directions_come_back_within_a_degree(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, v)) for v in np.vstack([rng.normal(size=(500, 3)), np.eye(3), -np.eye(3), [[1, 1, -1], [-1, 0, -1e-9]]])]
    frame = spark.createDataFrame(rows, "x double, y double, z double")
    nu, nv = registration.octahedral(F.col("x"), F.col("y"), F.col("z"))
    back = frame.withColumns({"nu": nu, "nv": nv})
    back = back.select("x", "y", "z", *[c.alias(n) for c, n in zip(registration.from_octahedral(F.col("nu"), F.col("nv")), "abc")]).collect()
    a, b = np.array([r[:3] for r in back]), np.array([r[3:] for r in back])
    cosine = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    assert np.degrees(np.arccos(np.clip(cosine, -1, 1))).max() < 0.01


def test_references_with_any_number_of_parents(spark):
    deep = "/".join(f"d{k}" for k in range(20))
    rows = [(f"{deep}/t.json", "../" * 20 + "a.glb", "a.glb", None), (f"{deep}/t.json", "../" * 21 + "a.glb", None, "escaping_reference"), ("a/b/t.json", "../c/.././../x.glb", "x.glb", None), ("t.json", "../x.glb", None, "escaping_reference"), ("a/t.json", "b/../../..", None, "escaping_reference")]
    frame = spark.createDataFrame([(k, p, t) for k, (p, t, _, _) in enumerate(rows)], "k int, path string, target string")
    clean, wrong = records._resolved(F.col("path"), F.col("target"))
    for r in frame.select("k", clean.alias("clean"), wrong.alias("wrong")).collect():
        assert r.wrong == rows[r.k][3] and (r.wrong or r.clean == rows[r.k][2])
