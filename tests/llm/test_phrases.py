import re
from collections import Counter

import numpy as np
import pytest

from atrium.llm import phrases

from tests.llm.conftest import ODD_TEXTS

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, config):
    """The same list from plain dictionaries: rows of (lang, text)."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, config.longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: c for p, c in counts.items() if c >= config.support}
    out = []
    for (lang, words), a in found.items():
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        longer = [c for (x, w), c in found.items() if x == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * c >= config.inside * a for c in longer):
            out.append((lang, score, a, " ".join(words), l, r, total[lang]))
    out.sort(key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    place, ranked = Counter(), []
    for lang, score, a, phrase, l, r, n in out:
        place[lang] += 1
        if place[lang] <= config.top:
            ranked.append((lang, place[lang], phrase, len(phrase.split(" ")), a, l, r, n, score))
    return ranked


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def random_texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "en", "es", "a", "b", "été", "x.y", "no;", "stop.", "\tq", "line\nfeed"]
    return [(["en", "es", "de", None][rng.integers(4)], " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("config", [phrases.PhraseConfig(support=4), phrases.PhraseConfig(support=3, flush=500, inside=70), phrases.PhraseConfig(support=9, longest=3, top=5), phrases.PhraseConfig(support=6, longest=2)])
def test_equals_dictionaries(spark, config):
    rows = random_texts(7, 250)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert rows_of(phrases.collocations(docs, config)) == sorted(brute(rows, config))


def test_whole_table_equals_dictionaries(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    config = phrases.PhraseConfig(support=12)
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], config)
    assert len(want) > 100 and rows_of(phrases.collocations(docs.repartition(6), config)) == sorted(want)


def test_odd_texts(spark, odd, empty):
    config = phrases.PhraseConfig(support=2)
    want = brute([("en", t) for _, t in ODD_TEXTS], config)
    assert rows_of(phrases.collocations(odd, config)) == sorted(want)
    assert phrases.collocations(empty, config).count() == 0
    silent = spark.createDataFrame([("en", None), (None, ""), ("und", " .\n")], "lang string, text string")
    assert phrases.collocations(silent, config).count() == 0


def test_a_word_that_names_a_language(spark):
    """The word "en" of one language and the word "es" of another count apart."""
    rows = [("es", "en en x")] * 3 + [("en", "es es x")] * 2
    got = rows_of(phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), phrases.PhraseConfig(support=1)).where("size = 1"))
    assert got == [("en", "es", 1, 4), ("en", "x", 1, 2), ("es", "en", 1, 6), ("es", "x", 1, 3)]


def test_scores_past_64_bits(spark):
    """1000 * a * n passes 2^63 for figures that a large corpus has."""
    row = spark.createDataFrame([(3 * 10**9, 10**13, 7 * 10**9, 5 * 10**9)], "a long, n long, l long, r long")
    got = row.selectExpr(phrases.SCORE).collect()[0][0]
    assert got == 1000 * 3 * 10**9 * 10**13 // (7 * 10**9 * 5 * 10**9)


def test_filter_refuses_no_key(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 200_000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(4)
    filled = phrases._filter_of(frame, 1 << 27)
    assert filled.passes(keys.view(np.uint64)).all()
    assert filled.passes(rng.integers(0, (1 << 63) - 1, 100_000).view(np.uint64)).mean() < 0.01


def test_shards_bound_a_phrase_by_what_they_know(spark, monkeypatch):
    """Forty shards, each with words of its own that reach its lowered support of one: only what may reach the support over all texts is looked for."""
    real, sizes = phrases._filter_of, []

    def spied(keys, most):
        sizes.append(keys.count())
        return real(keys, most)

    monkeypatch.setattr(phrases, "_filter_of", spied)
    rows = [("en", f"own{i} own{i} of shard{i} in all") for i in range(40)]
    config = phrases.PhraseConfig(support=30, flush=1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(40)
    assert rows_of(phrases.collocations(docs, config)) == sorted(brute(rows, config)) and len(brute(rows, config)) == 1
    assert sizes[0] == 4  # of, in, all, in all
