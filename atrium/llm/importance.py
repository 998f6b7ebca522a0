"""Importance resampling towards a target corpus.

Hashed word features of all documents and of all target texts give each bucket a log-ratio, the
gain. A document's weight is the mean gain of its features; a Gumbel number drawn from its id is added, so that the
highest sums are a sample without replacement in proportion to the importance. The cutoff of the
sum is found by numeric bisection: each job counts exactly, over the persisted scores, how many rows
lie above a few thresholds. Rows of the cutoff's score are cut by doc_id in the same way. Only the rows at or
above the cutoff are sorted, by range partitions, for their ranks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from atrium.llm import textbuf
from atrium.scratch import Scratch

#: Bytes that are no part of a word: all of ASCII but digits and letters.
_GAPS = np.ones(256, bool)
_GAPS[0x30:0x3A] = _GAPS[0x41:0x5B] = _GAPS[0x61:0x7B] = False
_GAPS[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Words up to this many bytes are hashed side by side, longer ones one by one.
_SHORT = 48


@dataclass(frozen=True)
class ImportanceConfig:
    """``runs`` is the longest run of words that is a feature, ``percent`` the share that is drawn.

    ``ways`` thresholds are counted by one job of the bisection. Documents under ``least_words`` words are never drawn.
    """

    runs: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    ways: int = 15


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what each state has seen followed by a word of ``data``."""
    out = state.copy()
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    sizes = length[order]
    long = int(np.searchsorted(-sizes, -_SHORT, "left"))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(out[k]))
    order, sizes = order[long:], sizes[long:]
    live, at = ~out[order], starts[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # the words with more than k bytes
        live[:n] = _CRC[(live[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (live[:n] >> np.uint32(8))
    out[order] = ~live
    return out


def feature_buckets(column: pa.Array, config: ImportanceConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature of a string column, and the number of words of each text."""
    data, offsets = textbuf.text_buffer(column)
    data = _LOWER[data]
    starts, ends, bounds = textbuf.word_bounds(data, offsets, _GAPS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    found, owners, state = [], [], np.zeros(len(starts), np.uint32)
    space = np.frombuffer(b" ", np.uint8)
    for run in range(config.runs):
        n = max(0, len(starts) - run)
        if run:
            state = _crc_on(state[:n], space, np.zeros(n, np.int64), np.ones(n, np.int64))
        state = _crc_on(state[:n], data, starts[run:], ends[run:])
        whole = text[:n] == text[run:]
        found.append((state % np.uint32(config.buckets)).astype(np.int64)[whole])
        owners.append(text[:n][whole])
    return np.concatenate(found), np.concatenate(owners), np.diff(bounds)


def bucket_counts(texts: DataFrame, config: ImportanceConfig = ImportanceConfig()) -> np.ndarray:
    """Features in each bucket over all texts; tasks add up their own, and at most ``buckets`` sums reach the driver."""

    def run(batches):
        total = np.zeros(config.buckets, np.int64)
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                total += np.bincount(feature_buckets(batch.column(0), config)[0], minlength=config.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([textbuf.int64s(some), textbuf.int64s(total[some])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(config.buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(docs: DataFrame, target: DataFrame, config: ImportanceConfig = ImportanceConfig()) -> np.ndarray:
    """Floored thousandths of the log-ratio of target to corpus for each bucket, with add-one smoothing."""
    s, t = bucket_counts(docs, config).astype(np.float64), bucket_counts(target, config).astype(np.float64)
    ratio = (t + 1.0) * (s.sum() + config.buckets) / ((s + 1.0) * (t.sum() + config.buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _gumbel(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a standard Gumbel number that the id alone decides."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, config: ImportanceConfig = ImportanceConfig()) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                bucket, owner, words = feature_buckets(batch.column(1), config)
                features = np.bincount(owner, minlength=batch.num_rows)
                sums = np.zeros(batch.num_rows, np.int64)
                np.add.at(sums, owner, known[bucket])
                weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), textbuf.int64s(words), textbuf.int64s(features), textbuf.int64s(weight)], ["doc", "n_words", "n_features", "weight"])

    light = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    packed = docs.select(light, F.col("text").cast("string").alias("text"))
    kind = StructType([packed.schema["doc"], *StructType.fromDDL("n_words long, n_features long, weight long")])
    return packed.mapInArrow(run, kind).withColumn("score", F.col("weight") + _gumbel(F.col("doc.doc_id"), config.seed))


def _bisect(rows: DataFrame, key: str, wanted: int, falling: bool, ways: int) -> tuple[int, int]:
    """The least extreme value of ``key`` that ``wanted`` rows reach, and the number of rows beyond it.

    With ``falling`` the highest values come first, otherwise the lowest. Every job counts ``ways`` thresholds exactly.
    """
    low, high = rows.agg(F.min(key), F.max(key)).collect()[0]
    sign = -1 if falling else 1
    low, high = (sign * high, sign * low) if falling else (low, high)  # now the lowest come first
    value = sign * F.col(key).cast("decimal(20,0)")  # the lowest long has no opposite
    beyond = 0
    while low < high:
        cuts = sorted({low + (high - low) * k // (ways + 1) for k in range(1, ways + 1)} | {low})
        cuts = [c for c in cuts if c < high]
        counts = rows.agg(*[F.count(F.when(value <= F.lit(str(c)).cast("decimal(20,0)"), 1)).alias(f"c{k}") for k, c in enumerate(cuts)]).collect()[0]
        enough = [k for k in range(len(cuts)) if counts[k] >= wanted]
        first = enough[0] if enough else len(cuts)
        if first:
            low, beyond = cuts[first - 1] + 1, counts[first - 1]
        if first < len(cuts):
            high = cuts[first]
    return sign * low, beyond


def draw(scored: DataFrame, config: ImportanceConfig = ImportanceConfig()) -> DataFrame:
    """The rows of ``weigh`` with their ``rank`` among the drawn ones, null for the others.

    Of equal scores the smaller ``doc_id`` goes first, null ones last; rows that agree in both go by features and weight, and
    rows that are alike in all in any order. Nothing is drawn where a tenth of the rows is less than one row.
    """
    spark = scored.sparkSession
    scratch = Scratch(spark, "importance")
    kept = scratch.keep("scores", scored.withColumns({"_row": F.monotonically_increasing_id(), "_null": F.col("doc.doc_id").isNull()}))
    able = kept.where(F.col("n_words") >= config.least_words)
    wanted = config.percent * able.count() // 100
    if not wanted:
        return kept.drop("_row", "_null").withColumn("rank", F.lit(None).cast("long"))
    cut, beyond = _bisect(able, "score", wanted, True, config.ways)
    tied, left = able.where(F.col("score") == cut), wanted - beyond
    named = tied.where("not _null").withColumn("_id", F.col("doc.doc_id").cast("long"))
    id_cut = None
    if left < tied.count() and left <= named.count():
        id_cut = _bisect(named, "_id", left, False, config.ways)[0]
    upper = F.col("score") > cut
    edge = (F.col("score") == cut) & (F.lit(True) if id_cut is None else ~F.col("_null") & (F.col("doc.doc_id").cast("long") <= F.lit(id_cut)))
    chosen = F.coalesce((F.col("n_words") >= config.least_words) & (upper | edge), F.lit(False))

    order = [F.col("score").desc(), F.col("doc.doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("_row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = kept.where(chosen).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number within a partition is the low part of this id, the partition its high part
    ranked = scratch.keep("ranked", sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(ranked.groupBy(part.alias("p")).count().collect())  # one row for each partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts, "_p long, _before long"))
    rank = F.col("_before") + place + 1
    first = ranked.join(before, part == F.col("_p")).withColumn("rank", F.when(rank <= wanted, rank))
    names = [*kept.columns, "rank"]
    rest = kept.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return first.select(*names).unionByName(rest.select(*names)).drop("_row", "_null")


def resample(docs: DataFrame, target: DataFrame, config: ImportanceConfig = ImportanceConfig()) -> DataFrame:
    """Weigh all ``docs`` towards all texts of ``target`` and draw a share of them.

    A null, empty or wordless text has no feature, weight 0 and is never drawn; texts of any length count whole; repeated rows are
    weighed and drawn each. A null ``doc_id`` draws the number of an empty id. An empty table gives an empty
    result, an empty target even gains of its smoothing. Columns of any name travel in ``doc``, without the text.
    """
    return draw(weigh(docs, gains(docs, target, config), config), config)
