import numpy as np
import pytest

from atrium.llm import ball_tree, metric_join, registry
from pyspark.sql import functions as F

NAN = float("nan")
ODD = [
    (0, [1.0, 0.0, 0.0], "a"),
    (0, [1.0, 0.0, 0.0], "a"),
    (1, [2.0, 0.0, 0.0], "b"),
    (2, [0.99, 0.1, 0.0], "c"),
    (3, None, "d"),
    (4, [0.0, 0.0, 0.0], "e"),
    (5, [NAN, 1.0, 0.0], "f"),
    (6, [float("inf"), 1.0, 0.0], "g"),
    (7, [], "h"),
    (8, [1.0, None, 0.0], "i"),
    (None, [1.0, 0.0, 0.0], "j"),
    (9, [1.0, 0.0], "k"),
    (10, [-0.0, 1.0, 0.0], "l"),
    (11, [0.0, 1.0, 0.0], "m"),
]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<float>, key string").withColumn("score", F.lit(1))


def vectors_of(spark, folder):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_top(rows, k=10, step=100):
    grid = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, a in grid:
        if q % step == 0:
            scores = sorted((-int(a @ b), i) for i, b in grid if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, folder):
    got = registry.op2_ball_tree_top_k(spark, folder).collect()
    assert sorted(tuple(r) for r in got) == brute_top(vectors_of(spark, folder))


def test_top_k_over_shards_blocks_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(900)]
    rows += [(i, [0.5] * 6) for i in range(900, 1300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    config = ball_tree.TopKConfig(shard=150, block=9, leaf=8)
    got = ball_tree.top_k(frame, F.col("vec_id") % 50 == 0, config).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, step=50)


def test_branch_and_bound_skips_leaves():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 900
    rows = np.floor(centres.repeat(100, axis=0) + rng.normal(size=(4000, 16)) * 20)
    tree = ball_tree.BallTree(rows, np.arange(4000), 32)
    found, scored = tree.search(rows[7], 7, 10, None)
    scores = rows @ rows[7]
    order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != 7][:10]
    assert [i for _, i in found] == order and scored < 40
    floor = (int(scores[order[4]]), order[4])
    assert [i for _, i in tree.search(rows[7], 7, 10, floor)[0]] == order[:4]


def test_top_k_of_odd_vectors(spark, odd_vectors):
    got = ball_tree.top_k(odd_vectors, F.col("vec_id") % 100 == 0).collect()
    assert [(r.rank, r.vec_id) for r in got][:3] == [(1, 1), (2, 9), (3, 2)]
    assert {r.vec_id for r in got} == {1, 2, 4, 7, 9, 10, 11} and {r.query_id for r in got} == {0}
    assert ball_tree.top_k(odd_vectors.limit(0), F.lit(True)).count() == 0
    assert ball_tree.top_k(odd_vectors, F.lit(False)).count() == 0


def brute_links(rows, least=0.95):
    fine = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v) and len(v) and any(v)]
    links, up = [0] * len(rows), {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(fine):
        for b in fine[:n]:
            x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[a] += 1
                links[b] += 1
                p, q = root(rows[a][0]), root(rows[b][0])
                if p != q:
                    up[max(p, q)] = min(p, q)
    return sorted(((i, links[k], root(i)) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_links_equal_brute_force(spark, scale):
    folder = f"/root/testdata/{scale}"
    got = registry.op10_metric_range_join(spark, folder).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(vectors_of(spark, folder))


SMALL = {
    "cells": metric_join.MetricJoinConfig(cell=30, pivots=5, copies=9.0, block=11),
    "blocks": metric_join.MetricJoinConfig(cell=30, pivots=5, copies=0.5, block=11),
    "both": metric_join.MetricJoinConfig(cell=25, pivots=4, copies=1.6, rounds=2, block=40),
}


@pytest.mark.parametrize("way", sorted(SMALL))
def test_links_over_cells_and_blocks(spark, way):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 5))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=5) * 0.25]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = metric_join.join_embeddings(frame, SMALL[way]).collect()
    as_floats = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(as_floats)


def test_only_rows_near_another_cell_are_copied():
    """Every pair within reach meets in one cell; most rows of separate clusters go nowhere."""
    rng = np.random.default_rng(9)
    rows = metric_join._unit(rng.normal(size=(6, 8)).repeat(200, axis=0) + rng.normal(size=(1200, 8)) * 0.03)
    pivots = rows[::100]
    reach = float(np.sqrt(2 - 2 * 0.95))
    product = rows @ pivots.T
    homes = product.argmax(axis=1)
    far = np.sqrt(2 - 2 * product[np.arange(1200), homes].clip(max=1))
    extents = np.array([far[homes == k].max(initial=-1) for k in range(12)])
    goes = metric_join.targets(rows, homes, pivots, extents, reach)
    linked = rows @ rows.T >= 0.95
    low = np.minimum(homes[:, None], homes[None, :])
    assert goes[np.arange(1200)[:, None], low][linked].all()
    assert goes.sum() < 3 * 1200


def test_links_of_many_vector_lengths(spark):
    rows = [(i, [1.0] * (1 + i % 5000)) for i in range(5003)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.join_embeddings(frame).collect()}
    assert got == {i: (int(i % 5000 < 3), i % 5000) for i in range(5003)}


def test_links_of_odd_vectors(odd_vectors):
    got = metric_join.join_embeddings(odd_vectors).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in ODD]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert metric_join.join_embeddings(odd_vectors.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [8, 64])
def test_thousands_of_links_by_the_registered_sizes(spark, dim):
    """Clusters around many centres, with the default sizes: cells and shards follow the table."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(150, dim))
    rows = [(i, [float(x) for x in np.float32(centres[i % 150] + rng.normal(size=dim) * 0.2 * (i % 3))]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in metric_join.join_embeddings(frame).collect()), key=str)
    assert got == brute_links(rows) and sum(x[1] for x in got) > 4_000
