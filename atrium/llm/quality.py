"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over
the counts of vote patterns estimates how often each labeller is right in either class, and
so a posterior for every pattern. Documents with a clear posterior train a linear scorer over
hashed character-shape n-grams, which then scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from atrium.llm import textbuf
from atrium.scratch import Scratch

_U = np.uint64
#: Texts whose dense features are held at once.
_ROWS = 256
LABELLERS = ("words", "symbols", "capitals", "doubled_marks", "bars", "sentences", "word_length", "repetition", "letters", "lone_marks", "runs")


@dataclass(frozen=True)
class QualityConfig:
    """``sample`` bounds the training documents of either class, ``dimensions`` the scorer's weights.

    Documents whose pattern's posterior is at least ``clear`` (or at most one minus it) are
    training material; ``prior`` is the expected share of good documents before any is seen; ``anchor``
    is the weight of the first guess of the labellers' chances, as a share of all documents.
    """

    sample: int = 1000
    dimensions: int = 1 << 12
    clear: float = 0.9
    prior: float = 0.8
    anchor: float = 0.05
    em_rounds: int = 200
    steps: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    threshold: float = 0.3


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_LOWER[0xC3:0xF8] = True  # the first byte of a letter of several bytes, most often a small one
_DIGIT = _table("0123456789")
_SYMBOL = _table("#$%&*<>{}[]~^\\=_+@")
_MARK = _table("!?$%&*#")
_STOP = _table(".!?")


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes (texts, labellers) of 1 good, 0 bad, -1 none, from figures of the whole texts."""
    n = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    starts, ends, bounds = textbuf.word_bounds(data, offsets)
    words = np.diff(bounds).astype(np.float64)
    upper, letters = total(_UPPER[data]), total(_UPPER[data] | _LOWER[data])
    symbols, bars, stops = total(_SYMBOL[data]), total(data == 0x7C), total(_STOP[data])
    doubled = np.zeros(len(data), bool)
    if len(data):
        doubled[1:] = _MARK[data[1:]] & (data[1:] == data[:-1])
    doubled = total(doubled)
    size = np.diff(offsets).astype(np.float64)
    hashes = textbuf.word_hashes(data, starts, ends)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.float64)
    some = np.maximum(words, 1.0)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][bounds[:-1] < len(hashes)]] = False
    lone = (ends - starts == 1) & ~(_LOWER | _UPPER | _DIGIT)[data[starts]] if len(starts) else np.zeros(0, bool)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)

    runs, lone = per_text(same), per_text(lone)
    mean_length = (letters + symbols) / some

    out = np.full((n, len(LABELLERS)), -1, np.int8)

    def judge(k: int, good: np.ndarray, bad: np.ndarray) -> None:
        out[good, k] = 1
        out[bad, k] = 0

    none = np.zeros(n, bool)
    judge(0, words >= 20, words < 3)
    judge(1, none, symbols >= 0.04 * np.maximum(size, 1))
    judge(2, none, (upper >= 0.35 * np.maximum(letters, 1)) & (letters >= 20))
    judge(3, none, (doubled >= 0.1 * some) & (words >= 5))
    judge(4, none, (bars >= 0.08 * some) & (words >= 5))
    judge(5, stops * 60 >= words, (stops * 150 < words) & (words >= 20))
    judge(6, (mean_length >= 2.5) & (mean_length <= 12), (mean_length < 1.5) | (mean_length > 20))
    judge(7, none, (distinct < 0.15 * some) & (words >= 50))
    judge(9, none, (lone >= 0.08 * some) & (words >= 5))
    judge(10, none, (runs >= 0.1 * some) & (words >= 10))
    judge(8, letters >= 0.7 * size, letters < 0.5 * size)
    return out


def shape_features(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> np.ndarray:
    """Unit-length rows of damped counts of hashed character-shape trigrams and word-shape pairs."""
    n = len(offsets) - 1
    shape = _SHAPE[data].astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * dimensions, np.float64)
    for width in (2, 3, 4):
        if len(data) < width:
            continue
        code = np.zeros(len(data) - width + 1, np.int64)
        for k in range(width):
            code = code * 41 + shape[k : len(data) - width + 1 + k]
        whole = owner[: len(code)] == owner[width - 1 :]
        bucket = (textbuf.mix64(_U(width) + code.astype(_U) * _U(8)) % _U(dimensions)).astype(np.int64)
        out += np.bincount((owner[: len(code)] * dimensions + bucket)[whole], minlength=n * dimensions)
    rows = np.log1p(out.reshape(n, dimensions))
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, 1e-12)


def _shape_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[_UPPER], table[_LOWER] = 1, 2
    table[128:] = 2
    table[list(b"0123456789")] = 3
    table[list(b" \t\r\x0b\x0c")] = 4
    table[10] = 5
    for k, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        table[c] = 6 + k
    return table


_SHAPE = _shape_table()


def fit_labellers(patterns: list[tuple[tuple[int, ...], int]], config: QualityConfig) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of "good" for each vote pattern, and the labellers' accuracies (2, labellers).

    Either class has for each labeller its own chances of a bad vote, of none and of a good vote.
    They start from ``_START`` (a defect is rarely seen on a good document; good votes say
    little), which goes on as a small prior so that the classes cannot change places.
    Row 0 of the accuracies has the chance that a vote on a bad document is bad, row 1 that a
    vote on a good one is good.
    """
    if not patterns:
        return {}, np.full((2, len(LABELLERS)), 0.5)
    grid = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([n for _, n in patterns], np.float64)
    outcomes = np.stack([grid == 0, grid == -1, grid == 1]).astype(np.float64)  # (votes, patterns, labellers)
    start = np.repeat(_START[:, :, None], grid.shape[1], axis=2)  # (classes, votes, labellers)
    chances, prior, held = start, config.prior, config.anchor * weight.sum() + 1.0
    for _ in range(config.em_rounds):
        logs = np.einsum("vpl,cvl->cp", outcomes, np.log(chances))
        margin = logs[1] - logs[0] + np.log(prior / (1 - prior))
        posterior = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
        mass = np.stack([weight * (1 - posterior), weight * posterior])
        counts = np.einsum("cp,vpl->cvl", mass, outcomes) + held * start
        new = counts / counts.sum(axis=1, keepdims=True)
        prior = float(np.clip(mass[1].sum() / weight.sum(), 0.05, 0.98))
        done = np.abs(new - chances).max() < 1e-7
        chances = new
        if done:
            break
    accuracy = np.stack([chances[0, 0] / (chances[0, 0] + chances[0, 2]), chances[1, 2] / (chances[1, 0] + chances[1, 2])])
    return {tuple(p): float(x) for (p, _), x in zip(patterns, posterior)}, accuracy


#: First chances of a bad vote, no vote and a good vote, on a bad document and on a good one.
_START = np.array([[0.4, 0.35, 0.25], [0.01, 0.44, 0.55]])


def _train(rows: np.ndarray, target: np.ndarray, config: QualityConfig) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch gradient steps; both classes weigh the same."""
    rows, target = rows.astype(np.float32, copy=False), target.astype(np.float32)
    weights, speed, bias = np.zeros(rows.shape[1], np.float32), np.zeros(rows.shape[1], np.float32), np.float32(0)
    share = np.where(target > 0.5, 0.5 / max((target > 0.5).sum(), 1), 0.5 / max((target <= 0.5).sum(), 1)).astype(np.float32)
    rate, decay, one = np.float32(config.rate), np.float32(config.decay), np.float32(1)
    for _ in range(config.steps):
        error = share * (one / (one + np.exp(-np.clip(rows @ weights + bias, -60, 60))) - target)
        speed = np.float32(0.9) * speed + (error @ rows + decay * weights)
        weights -= 10 * rate * speed
        bias -= rate * error.sum()
    return weights.astype(np.float64), float(bias)


@dataclass(frozen=True)
class QualityModel:
    posteriors: dict[tuple[int, ...], float]
    accuracies: np.ndarray
    weights: np.ndarray | None
    bias: float


def fit_quality(docs: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Estimate the labellers on all texts and train the scorer on a bounded sample of clear ones.

    All documents are voted on once and their patterns kept by the hash of the text; at most three to the power of the
    labellers counts reach the driver. The sample is the first ``sample`` different clear texts of either class by hash, or
    all of them where there are fewer. Hashes far above the last one wanted are left out before any sort, by
    the estimated number of different texts; if too few are found, the bound is widened. Copies of a
    text count once. If a class has none, the model has no weights and the posterior is the score.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    hashed = texts.withColumns({"_h": F.xxhash64("text"), "_i": F.xxhash64("text", F.lit(1))})

    def vote(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                codes = ((votes(*textbuf.text_buffer(batch.column(0))).astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(codes)], ["_h", "_i", "pattern"])

    voted = Scratch(docs.sparkSession, "quality").keep("votes", hashed.mapInArrow(vote, "_h long, _i long, pattern long"))
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("_h").alias("different")).orderBy("pattern").collect()
    patterns = [(tuple(int(r.pattern // 3**k % 3) - 1 for k in range(len(LABELLERS))), r.n) for r in counted]
    posteriors, accuracies = fit_labellers(patterns, config)
    place = F.pmod("_h", F.lit(1 << 40))
    drawn, target = [], []
    for good in (0, 1):
        clear = [r.pattern for r, (p, _) in zip(counted, patterns) if (posteriors[p] >= config.clear if good else posteriors[p] <= 1 - config.clear)]
        if not clear:
            return QualityModel(posteriors, accuracies, None, 0.0)
        # equal texts have equal patterns, so the patterns' different texts add up
        share = min(1.0, 2.0 * config.sample / max(1, sum(r.different for r in counted if r.pattern in clear)))
        while True:
            few = voted.where(F.col("pattern").isin(clear) & (place < F.lit(int(share * (1 << 40)))))
            keys = few.select("_h", "_i").distinct().orderBy(place, "_h", "_i").limit(config.sample).collect()
            if share == 1.0 or len(keys) == config.sample:
                break
            share = min(1.0, 4.0 * share)
        drawn += [(r._h, r._i) for r in keys]
        target += [float(good)] * len(keys)

    def features(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text", rows=_ROWS):
                found = shape_features(*textbuf.text_buffer(batch.column(0)), config.dimensions)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), textbuf.binaries([x.tobytes() for x in found.astype(np.float32)])], ["_h", "_i", "features"])

    # at most two samples of keys
    wanted = F.broadcast(docs.sparkSession.createDataFrame(drawn, "_h long, _i long"))
    once = hashed.join(wanted, ["_h", "_i"], "left_semi").groupBy("_h", "_i").agg(F.first("text").alias("text"))
    found = once.select("text", "_h", "_i").mapInArrow(features, "_h long, _i long, features binary").toArrow()
    at = {key: k for k, key in enumerate(zip(found.column("_h").to_pylist(), found.column("_i").to_pylist()))}
    column = found.column("features")
    rows = [np.vstack([np.frombuffer(column[at[key]].as_buffer(), np.float32) for key in drawn])]  # views of the table, not copies
    del found, column
    textbuf.release_memory()
    weights, bias = _train(np.vstack(rows), np.array(target), config)
    del rows
    textbuf.release_memory()
    return QualityModel(posteriors, accuracies, weights, bias)


def score_quality(docs: DataFrame, model: QualityModel, config: QualityConfig = QualityConfig()) -> DataFrame:
    """All columns of ``docs``, whatever their names, in a struct ``doc``, with ``weak_label``, ``score`` and ``kept``.

    ``weak_label`` is the labellers' posterior of the whole text, ``score`` the scorer's probability that
    it is good (0 to 1), ``kept`` whether the score reaches the threshold. A null or wordless text has
    score 0 and is not kept. Rows do not depend on one another; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("doc"))  # the text goes to the worker once

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, "doc", "text", rows=_ROWS):
                data, offsets = textbuf.text_buffer(textbuf.member(batch, ("doc", "text")))
                given = votes(data, offsets)
                weak = np.array([known.posteriors.get(tuple(v), 0.5) for v in given.tolist()])
                if known.weights is None:
                    score = weak.copy()
                else:
                    margin = shape_features(data, offsets, config.dimensions) @ known.weights + known.bias
                    score = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
                words = np.diff(textbuf.word_bounds(data, offsets)[2])
                score[words == 0] = weak[words == 0] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score), pa.array((score >= config.threshold) & (words > 0))], ["doc", "weak_label", "score", "kept"])

    kind = StructType([packed.schema["doc"], *StructType.fromDDL("weak_label double, score double, kept boolean")])
    return packed.mapInArrow(run, kind)
