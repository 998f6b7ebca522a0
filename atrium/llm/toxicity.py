"""Toxic passages by maximum-scoring segments.

Every token has a log-odds of standing in a toxic text rather than a clean one. Its Dirichlet prior comes
from its first bytes: prefixes of growing length, then the whole word, each shrink towards the one before, so a word
never seen in training is judged by its stem. Less a fixed drift, clean text sums to ever lower values, and one
linear scan over a text finds all its maximal segments of positive score. By extreme-value statistics a segment's
score becomes the number of such segments that clean texts of that length show by chance; the significant
ones of a text are summed, and a logistic curve over that evidence is the score.
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
#: Bytes that are no part of a token: all of ASCII but digits and letters.
_GAPS = np.ones(256, bool)
_GAPS[0x30:0x3A] = _GAPS[0x41:0x5B] = _GAPS[0x61:0x7B] = False
_GAPS[0x80:] = False
#: Leading bytes of a token that are features of their own, before the whole token.
PREFIXES = (4, 5, 6)
_LEVELS = len(PREFIXES) + 1
#: Evidence is histogrammed in steps of a tenth up to this value.
_TOP = 100.0
_STEP = 0.1


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample`` bounds the training documents of either class: the first by a hash of their ids, all where there are fewer.

    ``features`` bounds the weights (those most often seen in the sample are kept, from ``least`` times on). ``root`` and
    ``child`` are the strengths of the priors of the shortest prefix and of what follows, in observations. ``drift`` is taken from
    every token, ``significant`` is the expected number of chance segments below which one counts.
    """

    sample: int = 20_000
    features: int = 1 << 20
    least: int = 3
    root: float = 20.0
    child: float = 5.0
    drift: float = 1.0
    significant: float = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted slots of features with their log-odds, and the constants of the extreme-value law and of the curve."""

    slots: np.ndarray
    prints: np.ndarray
    odds: np.ndarray
    rate: float
    scale: float
    slope: float
    middle: float
    config: ToxicityConfig


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Keys of each token's prefixes, shortest first, and of the token."""
    spans = [np.minimum(ends, starts + n) for n in PREFIXES] + [ends]
    return [textbuf.mix64(textbuf.word_hashes(data, starts, e) + _U(k)) for k, e in enumerate(spans)]


def _tokens(column: pa.Array):
    data, offsets = textbuf.text_buffer(column)
    starts, ends, bounds = textbuf.word_bounds(data, offsets, _GAPS)
    return data, offsets, starts, ends, bounds


def _place(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & _U(slots - 1)).astype(np.int64), (keys >> _U(32)).astype(np.uint32)


def token_scores(model: ToxicityModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each token's log-odds by its longest known feature (none, or the same token as before: 0), less the drift."""
    out = np.zeros(len(starts))
    keys = np.zeros(0, _U)
    for keys in _keys(data, starts, ends):
        slot, mark = _place(keys, len(model.slots))
        at = model.slots[slot]
        known = (at >= 0) & (model.prints[slot] == mark)
        out = np.where(known, model.odds[at], out)
    same = np.zeros(len(starts), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[bounds[:-1][bounds[:-1] < len(starts)]] = False
    out[same] = 0.0
    return out - model.config.drift


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past the last, sum) in one pass.

    These are the segments of positive sum whose every prefix and suffix has a positive sum and that lie in no longer one of the kind.
    """
    held: list[list] = []  # start, end, the sum before the segment and the sum after it, the last one with a lower sum before
    total = 0.0
    for place, value in enumerate(scores):
        before, total = total, total + value
        if value <= 0:
            continue
        new = [place, place + 1, before, total, -1]
        while True:
            at = len(held) - 1
            while at >= 0 and held[at][2] >= new[2]:
                at = held[at][4]  # what lies between has no lower sum before
            if at < 0 or held[at][3] >= new[3]:
                new[4] = at
                held.append(new)
                break
            new = [held[at][0], new[1], held[at][2], new[3], held[at][4]]
            del held[at:]
    return [(first, end, after - before) for first, end, before, after, _ in held]


def _segments(scores: np.ndarray, bounds: np.ndarray):
    """For each text with a positive token: its number and its segments, by token numbers within the text."""
    good = np.flatnonzero(scores > 0)
    cuts = np.searchsorted(good, bounds)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for text in np.flatnonzero(np.diff(cuts)).tolist():
        at = good[cuts[text] : cuts[text + 1]]
        # positive tokens and the stretches between them are all that a scan has to see
        first = int(bounds[text])
        before = np.concatenate([[first], at[:-1] + 1])
        values = np.empty(2 * len(at))
        values[0::2], values[1::2] = sums[at] - sums[before], scores[at]
        yield text, [(int(at[a // 2]) - first, int(at[(b - 1) // 2]) + 1 - first, s) for a, b, s in maximal_segments(values.tolist())]


def evidence(found: list[float], n_tokens: int, rate: float, scale: float, significant: float) -> float:
    """How unlikely a clean text of that length shows the segments: minus the log of a chance.

    A score s is expected ``scale * n * exp(-rate * s)`` times. Of r significant segments with normalised scores
    adding up to x the chance is about exp(-x) x^(r-1) / (r! (r-1)!); without one the best segment's expectation counts.
    """
    base = np.log(scale * max(n_tokens, 1))
    x = sorted((rate * s - base for s in found), reverse=True)
    least = -np.log(significant)
    good = [v for v in x if v >= least]
    if not good:
        return float(x[0] if x else min(-base, 0.0))
    # the strongest run of segments: adding a weak one may raise the chance
    best, total, logs = good[0], 0.0, 0.0
    for r, v in enumerate(good, 1):
        total += v
        logs += np.log(r) + (np.log(r - 1) if r > 1 else 0.0)
        best = max(best, total - (r - 1) * np.log(total) + logs)
    return float(best)


def _sample(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> tuple[DataFrame, dict[int, float]]:
    """The training texts with their class, and the number of labelled ids that one of each class stands for."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where("toxic in (0, 1)")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = []
    for kind in (0, 1):
        drawn += known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample).collect()
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in drawn], "_id long, toxic int")  # at most two samples
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(ids), "_id").groupBy(F.xxhash64("text"), F.xxhash64("text", F.lit(1)), "toxic").agg(F.first("text").alias("text"))
    return texts.select("text", "toxic"), {k: n / min(n, config.sample) for k, n in sizes.items()}


def _count_features(train: DataFrame, config: ToxicityConfig) -> pa.Table:
    """Counts in either class of the sample's features: ``key``, ``parent``, ``level``, ``clean``, ``toxic``; at most ``features``."""

    def run(batches):
        held = []
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                data, _, starts, ends, bounds = _tokens(batch.column(0))
                text = np.repeat(np.arange(batch.num_rows, dtype=_U), np.diff(bounds))
                kind = batch.column(1).to_numpy().astype(np.int64)[text.astype(np.int64)]
                found = _keys(data, starts, ends)
                for level, keys in enumerate(found):
                    # once a text, however often it repeats the feature
                    once = np.unique(textbuf.mix64(keys + text * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
                    above = found[level - 1][once] if level else np.zeros(len(once), _U)
                    distinct, at, back = np.unique(keys[once], return_index=True, return_inverse=True)
                    toxic = np.bincount(back, weights=kind[once], minlength=len(distinct)).astype(np.int64)
                    held.append((distinct, above[at], np.full(len(distinct), level), np.bincount(back, minlength=len(distinct)) - toxic, toxic))
                yield pa.RecordBatch.from_arrays(_merged(held), _NAMES)
                held = []

    counted = train.mapInArrow(run, "key long, parent long, level int, clean long, toxic long")
    summed = counted.groupBy("key").agg(F.min("parent").alias("parent"), F.min("level").alias("level"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    frequent = summed.where(F.col("clean") + F.col("toxic") >= config.least)
    return frequent.orderBy((F.col("clean") + F.col("toxic")).desc(), "key").limit(config.features).toArrow()


_NAMES = ["key", "parent", "level", "clean", "toxic"]


def _merged(held: list[tuple]) -> list[pa.Array]:
    columns = [np.concatenate(x) for x in zip(*held)]
    return [pa.array(textbuf.as_signed(columns[0])), pa.array(textbuf.as_signed(columns[1])), pa.array(columns[2].astype(np.int32)), textbuf.int64s(columns[3]), textbuf.int64s(columns[4])]


def feature_odds(keys: np.ndarray, parents: np.ndarray, levels: np.ndarray, clean: np.ndarray, toxic: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Log-odds of each feature against the classes' sizes, every level's prior being the share of the level before."""
    first = levels == 0
    n_clean, n_toxic = max(1.0, float(clean[first].sum())), max(1.0, float(toxic[first].sum()))
    base = n_toxic / (n_clean + n_toxic)
    order = np.argsort(keys)
    share = np.full(len(keys), base)
    for level in range(_LEVELS):
        mine = np.flatnonzero(levels == level)
        prior = np.full(len(mine), base)
        if level and len(keys):
            at = order[np.minimum(np.searchsorted(keys[order], parents[mine]), len(keys) - 1)]
            prior = np.where(keys[at] == parents[mine], share[at], base)
        strength = config.child if level else config.root
        share[mine] = (toxic[mine] + strength * prior) / (clean[mine] + toxic[mine] + strength)
    return np.log(share / (1 - share)) - np.log(base / (1 - base))


def _stored(keys: np.ndarray, odds: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of slots, four for each feature; where two meet the one with more weight stays."""
    slots = 1 << max(10, (4 * len(keys)).bit_length())
    place, mark = _place(keys, slots)
    table, prints = np.full(slots, -1, np.int32), np.zeros(slots, np.uint32)
    order = np.argsort(weight, kind="stable")  # the last one written stays
    table[place[order]], prints[place[order]] = order, mark[order]
    return table, prints, odds.astype(np.float32).astype(np.float64) if len(odds) else np.zeros(1)


def _tail_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over clean tokens; scores have a negative mean."""
    share = counts / counts.sum()
    if values.max() <= 0:
        return 1.0
    low, high = 1e-3, 1.0
    while (share * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * values, 700))).sum() < 1 else (low, middle)
    return high


def _curve(values: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve through histogrammed evidence, by damped Newton steps."""
    x = np.clip(values, -10.0, 30.0) / 10
    weight = clean + toxic
    a, b = 0.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        error, bend = weight * p - toxic, weight * p * (1 - p)
        gradient = np.array([(error * x).sum() + 1e-2 * a, error.sum()])
        hessian = np.array([[(bend * x * x).sum() + 1e-2, (bend * x).sum()], [(bend * x).sum(), bend.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    a = max(a, 1e-3)
    return a / 10, -10 * b / a


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on the labelled documents (``labels``: ``doc_id``, ``toxic`` 0 or 1; of several labels of an id the highest counts).

    Each class gives at most ``sample`` ids; copies of a text train once. Three passes read their texts: feature counts (once a text), the clean tokens' scores with every
    text's segments, and, over those figures only, the histogram of evidence. What reaches the driver is bounded by
    ``features`` and the histograms. Without a text of both classes the model scores every document 0.
    """
    train, share = _sample(docs, labels, config)
    found = _count_features(train, config)
    keys, parents = (found.column(k).to_numpy().view(_U) for k in ("key", "parent"))
    levels, clean, toxic = (found.column(k).to_numpy() for k in ("level", "clean", "toxic"))
    if not (toxic.sum() and clean.sum()):
        return ToxicityModel(np.full(1, -1, np.int32), np.zeros(1, np.uint32), np.zeros(1), 1.0, 1.0, 1.0, 1e9, config)
    odds = feature_odds(keys, parents, levels, clean, toxic, config)
    table, prints, odds = _stored(keys, odds, np.abs(odds) * (clean + toxic))
    bare = ToxicityModel(table, prints, odds, 1.0, 1.0, 1.0, 0.0, config)
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    def measure(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                data, _, starts, ends, bounds = _tokens(batch.column(0))
                scores = token_scores(known, data, starts, ends, bounds)
                kind = batch.column(1).to_numpy()
                n = np.diff(bounds)
                per_text: list[list[float]] = [[] for _ in range(batch.num_rows)]
                for text, segments in _segments(scores, bounds):
                    per_text[text] = [s for _, _, s in segments]
                binned, counts = np.unique(np.round(scores[np.repeat(kind, n) == 0] / 0.01).astype(np.int64), return_counts=True)
                rows = len(kind) + len(binned)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([kind, np.full(len(binned), -1)]).astype(np.int32)), textbuf.int64s(np.concatenate([n, counts])),
                        textbuf.int64s(np.concatenate([np.zeros(len(kind)), binned])), pa.array([*per_text, *[None] * (rows - len(kind))], pa.list_(pa.float64())),
                    ],
                    ["kind", "n", "bin", "segments"],
                )

    measured = Scratch(docs.sparkSession, "toxicity").keep("measured", train.mapInArrow(measure, "kind int, n long, bin long, segments array<double>"))
    bins = measured.where("kind = -1").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    rate = _tail_rate(np.array([r.bin * 0.01 for r in bins]), np.array([float(r.n) for r in bins])) if bins else 1.0
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    sums = measured.where("kind = 0").agg(F.count("*").alias("texts"), F.sum(F.greatest("n", F.lit(1)) * F.exp(F.lit(-rate) * best)).alias("mass")).collect()[0]
    scale = sums.texts / sums.mass if sums.texts else 1.0
    limit = config.significant

    def gather(batches):
        for batch in batches:
            values = [evidence(s or [], n, rate, scale, limit) for s, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), textbuf.int64s(np.floor(np.clip(values, -_TOP, _TOP) / _STEP))], ["kind", "bin"])

    told = measured.where("kind >= 0").select("kind", "n", "segments").mapInArrow(gather, "kind int, bin long").groupBy("bin", "kind").count().collect()
    places = sorted({r.bin for r in told})
    weights = np.zeros((2, len(places)))
    for r in told:
        weights[r.kind, places.index(r.bin)] = r["count"] * share[r.kind]
    slope, middle = _curve((np.array(places) + 0.5) * _STEP, weights[0], weights[1])
    return ToxicityModel(table, prints, odds, rate, scale, slope, middle, config)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with ``score``, ``predicted``, ``evidence`` and the toxic ``passages``.

    A passage has its first and last character's places (the end exclusive), its segment's ``score`` and ``chance``, the expected
    number of such segments in a clean text of that length. A null, empty or tokenless text has no passage and the lowest evidence of
    its length. Texts of any length are scanned whole; rows do not depend on one another, so repeated ones agree; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` weights
    packed = docs.select(F.struct("*").alias("doc"))
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())])

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, "doc", "text"):
                data, offsets, starts, ends, bounds = _tokens(textbuf.member(batch, ("doc", "text")))
                scores = token_scores(known, data, starts, ends, bounds)
                n = np.diff(bounds)
                spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                proof = np.minimum(-np.log(known.scale * np.maximum(n, 1)), 0.0)
                for text, segments in _segments(scores, bounds):
                    proof[text] = evidence([s for _, _, s in segments], int(n[text]), known.rate, known.scale, known.config.significant)
                    for first, end, s in segments:
                        chance = known.scale * n[text] * np.exp(-known.rate * s)
                        if chance <= known.config.significant:
                            spans[text].append((int(starts[bounds[text] + first]), int(ends[bounds[text] + end - 1]), s, float(chance)))
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
                listed = [[{"start": int(lead[a] - lead[offsets[k]]), "end": int(lead[b] - lead[offsets[k]]), "score": s, "chance": c} for a, b, s, c in row] for k, row in enumerate(spans)]
                score = 1 / (1 + np.exp(-np.clip(known.slope * (np.clip(proof, -10.0, 30.0) - known.middle), -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(proof), pa.array(listed, pa.list_(passage))], ["doc", "score", "predicted", "evidence", "passages"]
                )

    added = "score double, predicted int, evidence double, passages array<struct<start: long, end: long, score: double, chance: double>>"
    return packed.mapInArrow(run, StructType([packed.schema["doc"], *StructType.fromDDL(added)]))
