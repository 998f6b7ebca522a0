import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from atrium.llm import kneser_ney, registry

from tests.llm.conftest import ODD_TEXTS


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


START = object()


class Brute:
    """The same model from plain dictionaries."""

    def __init__(self, texts, order=3):
        self.order = order
        self.words = Counter(t for text in texts for t in tokens(text))
        counts = Counter(g for text in texts for g in self.windows(text))
        self.levels = {}
        for k in range(order, 0, -1):
            context, after = Counter(), defaultdict(lambda: [0, 0, 0])
            for g, c in counts.items():
                context[g[:-1]] += c
                after[g[:-1]][min(c, 3) - 1] += 1
            tops = [sum(x == c for x in counts.values()) for c in (1, 2, 3, 4)]
            self.levels[k] = counts, context, after, (0.0, *kneser_ney.discounts(tops))
            counts = Counter(g[1:] for g in counts)  # the next order counts different words on the left

    def windows(self, text):
        ts = [START] * (self.order - 1) + tokens(text)
        return [tuple(ts[i : i + self.order]) for i in range(len(ts) - self.order + 1)]

    def chance(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        counts, context, after, cut = self.levels[len(gram)]
        total, c = context[gram[:-1]], counts[gram]
        if not total:
            return self.chance(gram[1:])
        spare = sum(d * n for d, n in zip(cut[1:], after[gram[:-1]]))
        return (c - cut[min(c, 3)]) / total + spare / total * self.chance(gram[1:])

    def score(self, text):
        ts = tokens(text)
        n, v = sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        return len(ts), sum(self.words[t] > 0 for t in ts), base, sum(math.log10(self.chance(g)) for g in self.windows(text))


def agree(got, want):
    assert got[:2] == want[:2]
    assert got[2] == pytest.approx(want[2], rel=1e-9) and got[3] == pytest.approx(want[3], rel=1e-7)


def test_scores_equal_plain_dictionaries(spark, folder, documents):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in documents}
    model = Brute([t for i, t in documents if not held[i]])
    got = {r.doc_id: r for r in registry.op9_kneser_ney_scores(spark, folder).collect()}
    assert len(got) == len(documents)
    for i, t in documents:
        r = got[i]
        assert r.held_out == held[i] and r.train_tokens == sum(model.words.values())
        agree((r.n_tokens, r.n_known, r.base_score, r.score), model.score(t))
    kept = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_shards_spread_words_and_rounds_of_sums(spark, documents, order):
    texts = [t for _, t in documents[:60]] + ["the the of the " * 50] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    config = kneser_ney.LanguageModelConfig(order=order, flush=700, shard_tokens=1500, span=100, fan=2, open_files=40)
    model = kneser_ney.fit(docs, config)
    assert model.shards > 5 and len(model.word_sizes) > 1 and model.order == order
    brute = Brute(texts, order)
    for r in kneser_ney.score_texts(docs, model, config).collect():
        agree((r.n_tokens, r.n_known, r.base_score, r.score), brute.score(texts[r.doc_id]))


def test_model_folder_that_is_not_mounted(spark, documents, monkeypatch):
    """Files of such a folder go through a file system of their own and are read, not mapped."""
    from pyarrow.fs import LocalFileSystem

    def remote(self, address):
        self.files, self.path = LocalFileSystem(), address.removeprefix("file://")

    monkeypatch.setattr(kneser_ney.ModelFolder, "__init__", remote)
    folder = kneser_ney.ModelFolder("file:///" + __import__("tempfile").mkdtemp(prefix="spark-") + "/sub")
    folder.save("x", {"a": np.arange(5), "b": np.zeros((0, 3), np.uint8)})
    back = folder.open("x")
    assert back["a"].tolist() == [0, 1, 2, 3, 4] and back["b"].shape == (0, 3) and folder.open("y") is None


def test_probabilities_add_up(documents):
    model = Brute([t for _, t in documents[:20]])
    words = list(model.words)
    for h in [(START, START), (START, words[3]), *list(model.levels[3][1])[5:9], ("never", "seen")]:
        total = sum(model.chance((*h, w)) for w in words) + model.chance((*h, "never seen"))
        assert total == pytest.approx(1.0, abs=1e-9)


def test_tables_of_hashes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        values = np.stack([rng.integers(0, 3000, len(keys)), rng.integers(0, 3, len(keys))], axis=1)
        table = kneser_ney.hash_table(keys, values)
        shuffled = rng.permutation(len(keys))
        assert np.array_equal(kneser_ney.table_rows(table, "", keys[shuffled]), values[shuffled])
        assert not kneser_ney.table_rows(table, "", rng.integers(0, 2**64, 100, dtype=np.uint64)).any()


def test_odd_texts(spark, odd, empty):
    model = kneser_ney.fit(odd)
    brute = Brute([t for _, t in ODD_TEXTS])
    got = kneser_ney.score_texts(odd, model).collect()
    assert len(got) == len(ODD_TEXTS)
    want = dict(ODD_TEXTS)
    for r in got:
        agree((r.n_tokens, r.n_known, r.base_score, r.score), brute.score(want[r.doc_id]))
    assert kneser_ney.score_texts(empty, model).count() == 0
    nothing = kneser_ney.fit(empty)
    r = kneser_ney.score_texts(odd.where("doc_id = 5"), nothing).collect()[0]
    assert (r.n_tokens, r.n_known) == (2, 0) and r.score == pytest.approx(0.0)


def test_blocks_pack_and_unpack():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    assert np.array_equal(kneser_ney.unpack_keys(kneser_ney.pack_keys(keys)), keys)
    assert len(kneser_ney.unpack_keys(kneser_ney.pack_keys(keys[:0]))) == 0
    columns, counts = kneser_ney.merge_rows([rng.integers(0, 300, 2000).astype(np.uint32) for _ in range(3)], None)
    back = kneser_ney.unpack_rows(kneser_ney.pack_rows(columns, 2), 3, 2)
    assert all(np.array_equal(a, b) for a, b in zip(columns, back)) and counts.sum() == 2000
    assert all(len(c) == 0 for c in kneser_ney.unpack_rows(kneser_ney.pack_rows([c[:0] for c in columns], 2), 3, 2))
