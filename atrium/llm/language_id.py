"""Language identification by mixture inference over character n-grams.

Each language is a smoothed distribution over hashed n-grams of letters. A document is a
mixture of languages; expectation-maximisation estimates its proportions. The language set
grows from the single best one: the candidate with the steepest likelihood gain joins if the
fitted gain beats a penalty of ``0.5 * log(n)`` for each further language and ``margin``. The
gradient at a fitted mixture bounds that gain, so most documents stop without another fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from atrium.llm import textbuf

_U = np.uint64


@dataclass(frozen=True)
class LanguageConfig:
    """``buckets`` and ``max_languages`` bound the model that every task holds (8 bytes for each pair)."""

    order: int = 3
    buckets: int = 1 << 14
    smoothing: float = 0.2
    margin: float = 6.0
    rounds: int = 12
    max_languages: int = 256


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_likelihood: np.ndarray  # (buckets, languages)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, config: LanguageConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams that touch a letter, with runs of anything else read as one gap.

    Returns the buckets, text after text, and their n + 1 bounds. Bytes over 0x7F count as
    letters, A-Z are lower-cased.
    """
    folded = _FOLD[data]
    gap = folded == 0
    # of a run of gaps only the first stays; every text starts with one
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    kept = folded[keep].astype(_U)
    bounds = before[offsets]
    n = config.order
    # each text is framed by gaps, so that short texts have n-grams as well
    sizes = np.diff(bounds)
    frame = n - 1
    total = len(kept) + frame * len(sizes)
    framed = np.zeros(total, _U)
    at = np.arange(len(kept)) + np.repeat(np.arange(len(sizes)) * frame + 1, sizes)
    framed[at] = kept
    ends = bounds + np.arange(len(sizes) + 1) * frame
    span = max(total - n + 1, 0)
    code = np.zeros(span, _U)
    some = np.zeros(span, bool)
    for k in range(n):
        code = code * _U(257) + framed[k : k + span]
        some |= framed[k : k + span] != 0
    inside = np.zeros(span + 1, np.int64)
    inside[1:] = np.cumsum(some)
    # n-grams that start in the last n - 1 places of a text reach into the next one
    reach = np.zeros(total + 1, bool)
    for k in range(1, n):
        tails = ends[1:] - k
        reach[tails[tails >= ends[:-1]]] = True
    some &= ~reach[:span]
    inside[1:] = np.cumsum(some)
    hashed = (textbuf.mix64(code[some]) % _U(config.buckets)).astype(np.int64)
    return hashed, inside[np.minimum(ends, span)]


def _fold_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    return table


_FOLD = _fold_table()


def fit_language_model(labelled: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Count n-grams by language over all rows of ``text, lang``; rows with a null in either are left out.

    Tasks count into a table of fixed size and Spark adds the counts up; the driver gets one
    count for each language and bucket. More than ``max_languages`` labels are refused.
    """

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                hashed, bounds = ngram_buckets(*textbuf.text_buffer(batch.column(0)), config)
                langs = batch.column(1).to_pylist()
                names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
                row = np.repeat([names[x] for x in langs], np.diff(bounds))
                both = np.bincount(row * config.buckets + hashed, minlength=len(names) * config.buckets).reshape(len(names), -1)
                for x, k in names.items():
                    if x not in totals:
                        totals[x] = np.zeros(config.buckets, np.int64)
                        if len(totals) > config.max_languages:
                            raise ValueError(f"more than {config.max_languages} languages")
                    totals[x] += both[k]
        for x, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some.astype(np.int32)), textbuf.int64s(counts[some])], ["lang", "bucket", "n"])

    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most max_languages * buckets rows
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) > config.max_languages:
        raise ValueError(f"more than {config.max_languages} languages")
    place = {x: k for k, x in enumerate(languages)}
    table = np.full((config.buckets, max(len(languages), 1)), config.smoothing)
    np.add.at(table, (found.column("bucket").to_numpy(), np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)), found.column("n").to_numpy())
    return LanguageModel(tuple(languages), np.log(table / table.sum(axis=0)))


def _fit(weights: np.ndarray, ratio: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM for the proportions of one document; ``ratio`` holds likelihoods up to a factor for each row."""
    share, total = start, weights.sum()
    for _ in range(rounds):
        mass = ratio @ share
        share = share * (ratio.T @ (weights / mass)) / total
    return share, float(weights @ np.log(ratio @ share))


def infer(counts: tuple[np.ndarray, np.ndarray], model: LanguageModel, config: LanguageConfig) -> np.ndarray:
    """Language proportions of one document from its distinct buckets and their counts."""
    at, weights = counts
    logs = model.log_likelihood[at]
    best = int(np.argmax(weights @ logs))
    share = np.zeros(logs.shape[1])
    share[best] = 1.0
    if logs.shape[1] == 1:
        return share
    ratio = np.exp(logs - logs[:, best : best + 1])
    chosen, fitted, total = [best], 0.0, weights.sum()
    penalty = 0.5 * np.log(total + 1.0) + config.margin
    mass = np.ones(len(at))
    while len(chosen) < logs.shape[1]:
        slope = (weights / mass) @ ratio - total
        slope[chosen] = -np.inf
        candidate = int(np.argmax(slope))
        if slope[candidate] <= penalty:  # the likelihood is concave: no mixture gains more
            break
        trial = [*chosen, candidate]
        start = np.append(share[chosen] * 0.8, 0.2)
        fit, value = _fit(weights, ratio[:, trial], start, config.rounds)
        if value - fitted <= penalty:
            break
        chosen, fitted = trial, value
        share[chosen] = fit
        mass = ratio[:, chosen] @ fit
    return share


def identify_languages(docs: DataFrame, model: LanguageModel, config: LanguageConfig = LanguageConfig(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add to the given columns ``lang_pred``, ``score`` and ``lang_shares``; without columns, to all of them in a struct ``doc``.

    ``lang_pred`` is the language with the largest estimated share of the whole text (ties: first by
    name), ``score`` that share (0 to 1), ``lang_shares`` the shares of all languages of the
    selected set. A text that is null or has no letter, or a model without languages, gives
    ``und`` with score 0 and no shares. Rows do not depend on one another; nulls and clashing
    names in other columns are passed on as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    # the text goes to the worker once
    carried = docs.select(F.col("text"), F.struct(*[F.col(c) for c in columns]).alias("carried")) if columns else docs.select(F.struct("*").alias("carried"))
    path = ("text",) if columns else ("carried", "text")
    kind = StructType([carried.schema["carried"], *StructType.fromDDL("lang_pred string, score double, lang_shares map<string,double>")])

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, *path):
                texts = textbuf.member(batch, path)
                data, offsets = textbuf.text_buffer(texts)
                hashed, bounds = ngram_buckets(data, offsets, config)
                plain = np.concatenate([[0], np.cumsum((_FOLD[data] > 0) & (data < 128))])
                plain = plain[offsets[1:]] > plain[offsets[:-1]]
                names, scores, shares = [], [], []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    # bytes over 0x7F need not be letters; where there are no others, the text tells
                    if a == b or not known.languages or not (plain[k] or any(c.isalpha() for c in texts[k].as_py())):
                        names.append("und")
                        scores.append(0.0)
                        shares.append([])
                        continue
                    weights = np.bincount(hashed[a:b], minlength=config.buckets)
                    at = np.flatnonzero(weights)
                    share = infer((at, weights[at].astype(np.float64)), known, config)
                    top = int(np.argmax(share))
                    names.append(known.languages[top])
                    scores.append(min(1.0, float(share[top])))
                    shares.append([(known.languages[j], float(share[j])) for j in np.flatnonzero(share)])
                yield pa.RecordBatch.from_arrays(
                    [textbuf.member(batch, ("carried",)), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                    ["carried", "lang_pred", "score", "lang_shares"],
                )

    found = carried.mapInArrow(run, kind)
    kept = [F.col("carried").getField(c).alias(c) for c in columns] if columns else [F.col("carried").alias("doc")]
    return found.select(*kept, "lang_pred", "score", "lang_shares")


def id_remainder(column: str, modulus: int) -> Column:
    """CRC-32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
