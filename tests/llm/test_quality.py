import numpy as np
import pyarrow as pa

from atrium.llm import quality, registry, textbuf


def test_scores_follow_the_held_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in registry.op5_weak_label_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    good = [found[i] for i, q in labels.items() if q == 1]
    bad = [found[i] for i, q in labels.items() if q == 0]
    assert np.mean([r.kept for r in good]) > 0.98
    assert np.mean([not r.kept for r in bad]) > 0.85
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in found.values())


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.6, 0.8, 0.85, 0.9])
    votes = np.where(rng.random((20_000, 11)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    distinct, counts = np.unique(votes, axis=0, return_counts=True)
    posteriors, accuracy = quality.fit_labellers([(tuple(v), int(n)) for v, n in zip(distinct.tolist(), counts)], quality.QualityConfig(anchor=0.001))
    assert np.abs(accuracy - right).max() < 0.04
    guess = np.array([posteriors[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (guess == truth).mean() > 0.95
    assert quality.fit_labellers([], quality.QualityConfig())[0] == {}


def test_figures_do_not_depend_on_neighbours():
    texts = ["A normal sentence, as it were. And one more of them.", "", None, "!!?? ## ##", "x | y | z " * 30, "CAPS LOCK!! " * 20]
    data, offsets = textbuf.text_buffer(pa.array(texts, pa.string()))
    votes, rows = quality.votes(data, offsets), quality.shape_features(data, offsets, 256)
    for k, t in enumerate(texts):
        alone = textbuf.text_buffer(pa.array([t], pa.string()))
        assert np.array_equal(quality.votes(*alone)[0], votes[k])
        assert np.allclose(quality.shape_features(*alone, 256)[0], rows[k])


def test_odd_texts(spark, odd, empty, folder):
    model = quality.fit_quality(spark.read.parquet(f"{folder}/documents.parquet"))
    scored = quality.score_quality(odd, model)
    rows = scored.select("doc.*", scored.score.alias("s"), scored.kept.alias("k")).collect()
    assert len(rows) == odd.count()
    assert all(not r.k and r.s == 0 for r in rows if r.doc_id in (2, 3, 4, 14))
    assert quality.score_quality(empty, model).count() == 0
    bare = quality.fit_quality(empty)
    assert bare.weights is None and quality.score_quality(odd, bare).count() == len(rows)


def test_a_class_of_copies_trains_on_all_its_texts(spark, monkeypatch):
    good = [f"This is sentence number {k} of a plain text. It goes on for a while, as most of them do, and then it ends here." for k in range(300)]
    bad = [f"!!## {k} $$ ## !! ** && || %% !! ## $$" for k in range(150)]
    docs = spark.createDataFrame([(t,) for t in good + bad + bad[:1] * 20_000], "text string").repartition(4)
    seen = []
    train = quality._train
    monkeypatch.setattr(quality, "_train", lambda rows, target, config: seen.append((rows, target)) or train(rows, target, config))
    for sample, want in ((40, 40), (1000, 150)):
        quality.fit_quality(docs, quality.QualityConfig(sample=sample))
        rows, target = seen.pop()
        assert (target == 0).sum() == want and (target == 1).sum() == min(sample, 300)


def plain_em(patterns, start, prior, held, rounds):
    """The same estimate with loops over documents, labellers and votes."""
    labellers = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    chances = [[{0: start[c][0], -1: start[c][1], 1: start[c][2]} for _ in range(labellers)] for c in (0, 1)]
    posterior = {}
    for _ in range(rounds):
        for votes, _ in patterns:
            weigh = [1 - prior, prior]
            for c in (0, 1):
                for k, v in enumerate(votes):
                    weigh[c] *= chances[c][k][v]
            posterior[votes] = weigh[1] / (weigh[0] + weigh[1])
        new = [[{v: held * x for v, x in zip((0, -1, 1), start[c])} for _ in range(labellers)] for c in (0, 1)]
        for votes, n in patterns:
            for c in (0, 1):
                for k, v in enumerate(votes):
                    new[c][k][v] += n * (posterior[votes] if c else 1 - posterior[votes])
        chances = [[{v: x / sum(d.values()) for v, x in d.items()} for d in row] for row in new]
        prior = min(max(sum(n * posterior[v] for v, n in patterns) / total, 0.05), 0.98)
    return posterior


def test_em_equals_plain_loops():
    rng = np.random.default_rng(8)
    distinct, counts = np.unique(rng.integers(-1, 2, (300, 11)), axis=0, return_counts=True)
    patterns = [(tuple(v), int(n)) for v, n in zip(distinct.tolist(), counts)]
    config = quality.QualityConfig(em_rounds=6)
    got, _ = quality.fit_labellers(patterns, config)
    want = plain_em(patterns, quality._START, config.prior, config.anchor * sum(counts) + 1.0, 6)
    assert max(abs(got[v] - want[v]) for v in want) < 1e-9


def test_many_short_texts_take_little_memory():
    """One Arrow batch of ten thousand short texts, in a process of its own."""
    import os
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa, numpy as np
from atrium.llm import quality, textbuf
batch = pa.RecordBatch.from_arrays([pa.array([f"text number {k:06d} ." for k in range(10_000)])], ["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for part in textbuf.slices(batch, "text", rows=quality._ROWS):
    n += len(quality.shape_features(*textbuf.text_buffer(part.column(0)), 4096))
assert n == 10_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": here})
    assert int(said.stdout) < 200, said


def test_scores_carry_columns_of_any_name(spark, folder):
    model = quality.fit_quality(spark.read.parquet(f"{folder}/documents.parquet"))
    docs = spark.createDataFrame([(1, "Some text, as it were.", 3, "x")], "doc_id long, text string, score int, `a.b` string")
    assert [tuple(r) for r in quality.score_quality(docs, model).select("doc.*").collect()] == [(1, "Some text, as it were.", 3, "x")]
