import numpy as np
import pyarrow as pa

from atrium.llm import language_id, registry, textbuf


def test_held_out_accuracy_and_range(spark, folder):
    found = registry.op1_language_mixture(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert len(held) > 150 and all(0 <= r.score <= 1 for r in found)
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97


def test_held_out_texts_teach_nothing(spark):
    rows = [(k, f"{w} {w} {w}", lang) for k in range(60) for w, lang in [("alpha", "xx"), ("omega", "yy")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.id_remainder("doc_id", 4) == 2)
    model = language_id.fit_language_model(docs.where("not held_out"))
    assert model.languages == ("xx", "yy")
    one = language_id.fit_language_model(docs.where("not held_out and lang = 'xx'"))
    assert one.languages == ("xx",)


def test_mixtures_are_found(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_language_model(docs)
    de = " ".join(r.text for r in docs.where("lang = 'de'").limit(4).collect())[:6000]
    es = " ".join(r.text for r in docs.where("lang = 'es'").limit(4).collect())[:3000]
    rows = spark.createDataFrame([(1, de + " " + es), (2, de)], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.identify_languages(rows, model).collect()}
    assert found[1].lang_pred == "de" and set(found[1].lang_shares) == {"de", "es"}
    assert 0.55 < found[1].score < 0.78
    assert found[2].lang_shares == {"de": 1.0}


def test_odd_texts(spark, odd, empty, folder):
    model = language_id.fit_language_model(spark.read.parquet(f"{folder}/documents.parquet"))
    found = language_id.identify_languages(odd, model, columns=("doc_id", "key"))
    rows = found.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 8, 14)), r
        assert (r.score == 0.0) == (r.lang_pred == "und")
    assert language_id.identify_languages(empty, model).count() == 0
    nothing = language_id.fit_language_model(empty)
    assert {r.lang_pred for r in language_id.identify_languages(odd, nothing).collect()} == {"und"}


def test_buckets_do_not_depend_on_neighbours():
    config = language_id.LanguageConfig()
    texts = ["Hello, wörld", "", "ab", "  x 12 y  ", None, "Ende."]
    hashed, bounds = language_id.ngram_buckets(*textbuf.text_buffer(pa.array(texts)), config)
    for k, t in enumerate(texts):
        alone, b = language_id.ngram_buckets(*textbuf.text_buffer(pa.array([t], pa.string())), config)
        assert np.array_equal(hashed[bounds[k] : bounds[k + 1]], alone) and b[-1] == len(alone)
    assert bounds[-1] == len(hashed)


def test_em_only_raises_the_likelihood():
    rng = np.random.default_rng(1)
    ratio, weights = rng.uniform(0.1, 3, (40, 3)), rng.integers(1, 9, 40).astype(float)
    share, last = np.array([0.2, 0.3, 0.5]), -np.inf
    for _ in range(20):
        share, value = language_id._fit(weights, ratio, share, 1)
        assert value >= last - 1e-9 and abs(share.sum() - 1) < 1e-9
        last = value


def test_shares_equal_the_best_of_a_grid():
    """Likelihoods of all mixtures on a grid, all language sets, against the fitted ones."""
    rng = np.random.default_rng(6)
    config = language_id.LanguageConfig(buckets=60, margin=3.0, rounds=60)
    for case in range(12):
        table = rng.dirichlet(np.full(60, 0.3), 3).T
        model = language_id.LanguageModel(("x", "y", "z"), np.log(table))
        true = ((1.0, 0.0, 0.0), (0.7, 0.3, 0.0), (0.5, 0.3, 0.2))[case % 3]
        weights = rng.multinomial(400, table @ np.array(true)).astype(float)
        at = np.flatnonzero(weights)
        share = language_id.infer((at, weights[at]), model, config)
        likelihood = lambda p: weights[at] @ np.log(table[at] @ p)
        penalty = 0.5 * np.log(weights.sum() + 1) + config.margin
        steps = np.arange(0, 101) / 100
        grid = [np.array([a, b, 1 - a - b]) for a in steps for b in steps if a + b <= 1 + 1e-9]
        best = max(grid, key=lambda p: likelihood(p.clip(0)) - penalty * (p > 1e-9).sum())
        assert set(np.flatnonzero(share)) == set(np.flatnonzero(best > 1e-9)), case
        assert np.abs(share - best).max() < 0.02
