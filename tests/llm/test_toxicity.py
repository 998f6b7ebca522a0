import math
import zlib

import numpy as np
import pyarrow as pa

from atrium.llm import registry, toxicity


def plain_segments(scores):
    """Maximal segments by their definition: the best segment first, then the same on either side of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and (a, b) < (best[0], best[1]) and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    right = [(x + b, y + b, z) for x, y, z in plain_segments(scores[b:])]
    return plain_segments(scores[:a]) + [best] + right


def test_one_scan_finds_what_repeated_search_finds():
    rng = np.random.default_rng(4)
    for n in list(range(12)) * 40:
        scores = [float(x) for x in rng.normal(-0.3, 2.0, n)]
        got, want = toxicity.maximal_segments(scores), plain_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_a_scan_is_linear():
    import time

    rng = np.random.default_rng(1)
    scores = rng.normal(-0.1, 1.0, 400_000).tolist()
    began = time.time()
    assert toxicity.maximal_segments(scores)
    assert time.time() - began < 10


def test_segments_of_a_batch_are_those_of_all_its_tokens():
    rng = np.random.default_rng(6)
    bounds = np.array([0, 0, 30, 31, 90, 90])
    scores = rng.normal(-0.5, 1.5, 90)
    found = dict(toxicity._segments(scores, bounds))
    for k in range(5):
        alone = toxicity.maximal_segments(scores[bounds[k] : bounds[k + 1]].tolist())
        got = found.get(k, [])
        assert [x[:2] for x in got] == [x[:2] for x in alone] and np.allclose([x[2] for x in got], [x[2] for x in alone])


def test_odds_shrink_towards_the_level_before():
    config = toxicity.ToxicityConfig()
    keys = np.array([10, 20, 30, 40], np.uint64)
    parents = np.array([0, 10, 10, 20], np.uint64)
    odds = toxicity.feature_odds(keys, parents, np.array([0, 1, 1, 2]), np.array([900, 1, 0, 0]), np.array([100, 0, 3, 0]), config)
    base = 100 / 1000
    first = (100 + config.root * base) / (1000 + config.root)
    second = config.child * first / (1 + config.child)
    want = [math.log(s / (1 - s)) - math.log(base / (1 - base)) for s in (first, second, (3 + config.child * first) / (3 + config.child), second)]
    assert np.allclose(odds, want)


def test_rate_solves_its_equation():
    values, counts = np.array([-1.0, -0.5, 3.0]), np.array([900.0, 95.0, 5.0])
    rate = toxicity._tail_rate(values, counts)
    assert abs((counts / counts.sum() * np.exp(rate * values)).sum() - 1) < 1e-6


def held_rates(spark, folder):
    rows = registry.op13_toxic_segments(spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([r for k, r in held if k == x] for x in (1, 0))
    return np.mean([r.predicted for r in toxic]), np.mean([r.predicted for r in clean]), toxic, clean


def test_held_out_labels(spark):
    caught, blamed, toxic, clean = held_rates(spark, "/root/testdata/sf0.1")
    assert caught > 0.9 and blamed < 0.01
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean]
    assert np.mean(pairs) > 0.95


def test_passages_and_odd_texts(spark, odd, empty, folder):
    words = "plain words of a quiet text that goes on and on about nothing at all in the end"
    toxic = [(k, f"{words} {k} vileness and foulness {words}") for k in range(60)]
    clean = [(100 + k, f"{words} {k} {words} item{k}") for k in range(300)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    text = "é " + words + ". VILENESS, and foulness " + words
    seen = spark.createDataFrame([(1, text, 9), (2, words, 9)], "doc_id long, text string, score int")
    rows = toxicity.score_toxicity(seen, model).orderBy("doc.doc_id").collect()
    assert [r.predicted for r in rows] == [1, 0] and rows[0].doc.score == 9
    assert any("VILENESS" in text[p.start : p.end] for p in rows[0].passages) and not rows[1].passages
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.score_toxicity(empty, model).count() == 0
    for bare in (toxicity.fit_toxicity(docs.limit(0), labels), toxicity.fit_toxicity(docs, labels.where("toxic = 0")), toxicity.fit_toxicity(docs, labels.limit(0))):
        assert {r.predicted for r in toxicity.score_toxicity(seen, bare).collect()} == {0}


def test_scores_do_not_depend_on_neighbours(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    some = docs.limit(40).select("doc_id", "text")
    together = {r.doc.doc_id: r.score for r in toxicity.score_toxicity(some.coalesce(1), model).collect()}
    apart = {r.doc.doc_id: r.score for r in toxicity.score_toxicity(some.repartition(20), model).collect()}
    assert all(math.isclose(together[i], apart[i], rel_tol=1e-6) for i in together)


def test_repeats_in_a_text_count_once():
    assert len(toxicity._tokens(pa.array(["a b, a; B"]))[2]) == 4
    model = toxicity.ToxicityModel(np.full(1, -1, np.int32), np.zeros(1, np.uint32), np.zeros(1), 1.0, 1.0, 1.0, 0.0, toxicity.ToxicityConfig())
    data, _, starts, ends, bounds = toxicity._tokens(pa.array(["a a", "a"]))
    assert toxicity.token_scores(model, data, starts, ends, bounds).tolist() == [-1.0] * 3
