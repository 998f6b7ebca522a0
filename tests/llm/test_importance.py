import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from atrium.llm import importance

from tests.llm.conftest import ODD_TEXTS

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    return words, [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, config):
    """(id, features, weight, score, rank) of each row by plain loops."""
    bucket = lambda f: zlib.crc32(f.encode()) % config.buckets
    s, t = Counter(), Counter()
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            into.update(map(bucket, features(text, config.runs)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + config.buckets) / ((s[b] + 1.0) * (n_t + config.buckets))))
    out = []
    for i, text in docs:
        words, found = features(text, config.runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{config.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= config.least_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, r in enumerate(able[: config.percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("config", [importance.ImportanceConfig(), importance.ImportanceConfig(runs=3, buckets=500, percent=37, ways=2), importance.ImportanceConfig(percent=100, least_words=1), importance.ImportanceConfig(percent=0)])
def test_whole_table_equals_plain_loops(spark, folder, documents, config):
    docs, target = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute(documents, [(None, r.text) for r in target.collect()], config)
    assert rows_of(importance.resample(docs.repartition(3), target, config)) == sorted(want, key=repr)


def test_odd_texts(spark, odd, empty):
    config = importance.ImportanceConfig(percent=60, least_words=2)
    target = spark.createDataFrame([("the cat sat",), (None,), ("",)], "text string")
    want = brute(ODD_TEXTS, [(None, "the cat sat")], config)
    assert rows_of(importance.resample(odd, target, config)) == sorted(want, key=repr)
    assert importance.resample(empty, target).count() == 0
    assert rows_of(importance.resample(odd, target.limit(0), config)) == sorted(brute(ODD_TEXTS, [], config), key=repr)
    named = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, `rank` int, `a.b` int")
    assert importance.resample(named, target).select("doc.*").columns == ["doc_id", "rank", "a.b"]


def test_repeated_rows_and_null_ids_at_the_cutoff(spark):
    rows = [(None, "w " * 30)] * 400 + [(7, "w " * 30)] * 300 + [(-(1 << 63), "v " * 25), ((1 << 63) - 1, "u " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("u v",)], "text string")
    for percent in (10, 50, 90):
        config = importance.ImportanceConfig(percent=percent)
        got = rows_of(importance.resample(docs, target, config))
        assert got == sorted(brute(rows, [(None, "u v")], config), key=repr)


def test_bisection_ends_at_the_cutoff(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(-50, 50, 500)] + [(1 << 63) - 1, -(1 << 63)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for falling in (True, False):
        ordered = sorted(values, reverse=falling)
        for wanted in (1, 2, 77, 500, 502):
            cut = ordered[wanted - 1]
            before = sum(v > cut if falling else v < cut for v in values)
            assert importance._bisect(frame, "v", wanted, falling, 3) == (cut, before)


def test_hashes_of_long_and_short_words():
    words = ["x", "é" * 30, "y" * 47, "z" * 48, "q" * 49, "0" * 100_000, "A1"]
    got, _, _ = importance.feature_buckets(pa.array([" ".join(words)]), importance.ImportanceConfig(buckets=1 << 31))
    assert got.tolist() == [zlib.crc32(w.translate(FOLD).encode()) % (1 << 31) for w in words]
