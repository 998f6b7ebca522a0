import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from atrium.llm import near_dup, registry

from tests.llm.conftest import ODD_TEXTS


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(texts, width):
    sets = {i: shingles(t, width) for i, t in texts}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_components_equal_brute_force(spark, scale):
    folder = f"/root/testdata/{scale}"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(texts, 2)
    got = registry.op6_minhash_near_dedup(spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


@pytest.mark.parametrize("block", [16, 1024])
def test_chains_of_edits_are_connected_over_blocks(spark, block):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 14)), replace=False):
            words[k] = f"v{rng.integers(1_000_000)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    config = near_dup.NearDupConfig(width=2, block=block, block_bytes=block * 512)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, config).collect()}
    assert got == brute(texts, 2)
    assert len({c for _, c in got.values()}) > 1


def test_odd_texts(odd, empty):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD_TEXTS)
    named = {r.doc_id: r for r in got}
    want = brute([(i, t) for i, t in ODD_TEXTS if i is not None], 5)
    for i, (n, component) in want.items():
        assert (named[i].n_shingles, named[i].component_id) == (n, component)
    assert named[None].kept and named[None].component_id is None
    assert near_dup.near_duplicates(empty).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    texts = [(5, "a b c d e f g"), (1, "h i j k l m n"), (5, "h i j k l m n"), (2, "a b c d e f g")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(5, 1), (1, 1), (2, 1)}


def test_pairs_in_bands_equal_all_pairs():
    rng = np.random.default_rng(5)
    config = near_dup.NearDupConfig(percent=0, slack=2.0)
    bands, groups = np.sort(rng.integers(0, 9, 60)), rng.integers(0, 4, 60)
    sides = np.where(bands == 3, rng.integers(0, 2, 60), -1)
    i, j, _ = near_dup.possible_pairs(bands, sides, groups, np.ones(60, int), rng.integers(0, 2**63, (60, 16), dtype=np.uint64), config)
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if bands[a] == bands[b] and groups[a] != groups[b] and (sides[a] < 0 or sides[a] != sides[b])]
    assert sorted(zip(i.tolist(), j.tolist())) == want


def test_stage_passes_on_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g h i j", 1, 2, 3, "x"), (2, "a b c d e f g h i j", 4, 5, 6, "y"), (3, None, 7, 8, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rows int, _id int, _k int, `a.b` string")
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_stage_keeps_one_of_each_with_all_columns(odd):
    kept = near_dup.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert sum(r.doc_id is None for r in rows) == 1


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    config = near_dup.NearDupConfig()
    for similarity in (0.75, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(20):
            total = 2000
            common = int(similarity * total)
            values = rng.integers(0, 2**63, total, dtype=np.uint64)
            half = (total - common) // 2
            a, b = values[: common + half], np.concatenate([values[:common], values[common + half :]])
            sketches = near_dup.odd_sketches(near_dup.minhashes([np.sort(a), np.sort(b)], config.samples), config.sketch_bits)
            differing = np.bitwise_count(sketches[0] ^ sketches[1]).sum()
            errors.append(float(near_dup.sketch_similarity(differing, config.sketch_bits, config.samples)) - similarity)
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < config.slack


def test_short_texts_and_widths():
    sets = near_dup.shingle_sets(pa.array(["a b c", "A B", "a b", "a", "", None, "b a"]), 3)
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 0, 1]
    assert np.array_equal(sets[1], sets[2]) and not np.array_equal(sets[2], sets[6])


def test_ids_at_the_ends_of_their_range(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "a b c d e f g"), (high, "a b c d e f g"), (0, "h i j k l m n"), (5, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(low, low), (high, low), (5, low), (0, 0)}
    assert sorted(r.doc_id for r in near_dup.keep_one_of_each(docs).collect()) == [low, 0]


def test_recall_of_linked_pairs(spark):
    """Every pair that links by the rule shares a component, at both widths."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for width in (2, 5):
        want = brute(list(texts.items()), width)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, near_dup.NearDupConfig(width=width)).collect()}
        assert got == want and sum(i != c for i, (_, c) in want.items()) > 50
