"""Phrase collocation mining by partitioning (SON).

A phrase that reaches a support over all texts reaches, in some shard, the support lowered in proportion to
the shard's part of its language. The first pass mines every shard completely at that lowered support, level by
level: a phrase of k words is looked at only where both of its parts of k - 1 words are
frequent in the shard. What the shards find is added up by hash: a phrase that a shard leaves out occurs there at most one time less than the
lowered support, so the known counts and these remainders bound its count over all texts, and only where this bound reaches the support the
hash goes into a Bloom filter of bounded size. A second pass counts
every phrase that the filter lets through over all texts, by the phrase itself, so hashes decide nothing but what is looked
at: the filter never refuses a candidate, and what it lets through by chance falls short of the support.

Scores, the choice of the weakest cut and the comparison with longer phrases are joins over the frequent
phrases. Where shards outnumber the support, the lowered support is one and the bound is the count itself; the result
stays exact and the work stays proportional to the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.llm import textbuf
from atrium.scratch import Scratch

_U = np.uint64
#: Bytes between words (space, tab) and bytes that also end a piece.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
#: A-Z are lower-cased, and a tab between words reads as a space.
_PLAIN = bytes(c + 0x20 if 0x41 <= c <= 0x5A else 0x20 if c == 0x09 else c for c in range(256))
#: The floored score in whole numbers of up to 38 digits.
SCORE = "cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
#: Bits of a block of the filter.
_BLOCK = 1 << 20
_PROBES = 4
#: Languages up to which their totals are broadcast; more are joined.
_LANGS = 10_000


@dataclass(frozen=True)
class PhraseConfig:
    """Phrases of 2 to ``longest`` words that occur ``support`` times; the first ``top`` of each language.

    A candidate inside a longer one is dropped if the longer one occurs at least ``inside`` percent as often. ``flush`` is
    about the bytes of a shard, ``filter_bits`` (a power of two) bounds the broadcast filter.
    """

    longest: int = 5
    support: int = 100
    inside: int = 100
    top: int = 2000
    flush: int = 24 << 20
    filter_bits: int = 1 << 27


class _Shard:
    """Words of many texts: hashes that depend on the language, where they stand, and which follow one another."""

    def __init__(self):
        self.parts, self.data, self.langs, self.bytes = [], [], [], 0

    def add(self, lang: pa.Array, text: pa.Array) -> None:
        coded = lang.dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = []
        for name in names:
            if name not in self.langs:
                self.langs.append(name)
            place.append(self.langs.index(name))
        code = np.array(place, np.int64)[code]
        data, offsets = textbuf.text_buffer(text)
        starts, ends, bounds = textbuf.word_bounds(data, offsets, _GAPS)
        of_text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])[starts] if len(starts) else starts
        joined = np.zeros(len(starts), bool)  # with the next word
        joined[:-1] = (breaks[1:] == breaks[:-1]) & (of_text[1:] == of_text[:-1])
        salt = np.array([_lang_hash(x) for x in names], _U)[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, _U)
        hashes = textbuf.mix64(textbuf.word_hashes(data, starts, ends) ^ salt[of_text])
        self.parts.append((hashes, joined, code[of_text].astype(np.int32), (starts + self.bytes).astype(np.int32), (ends + self.bytes).astype(np.int32)))
        self.data.append(data)
        self.bytes += len(data)

    def close(self) -> None:
        """Join the parts."""
        self.hashes, self.joined, self.code, self.starts, self.ends = (np.concatenate(x) for x in zip(*self.parts))
        self.buffer = b"".join(x.tobytes() for x in self.data)
        self.parts, self.data = [], []

    def levels(self, longest: int, choose):
        """For each language and length, the places, hashes and counts of the phrases that ``choose`` lets through.

        ``choose(lang, k, keys, counts)`` gets the language's number and the distinct hashes of windows of k words
        with their counts, and returns which of them pass. One language is looked at after the other.
        """
        live = np.zeros(len(self.hashes) + 1, bool)
        for lang in range(len(self.langs)):
            at = np.flatnonzero(self.code == lang)
            keys = self.hashes[at]
            for k in range(1, longest + 1):
                if not len(at):
                    break
                distinct, counts = np.unique(keys, return_counts=True)
                passes = choose(lang, k, distinct, counts)
                distinct, counts = distinct[passes], counts[passes]
                if not len(distinct):
                    break
                which = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
                good = distinct[which] == keys
                at, keys, which = at[good], keys[good], which[good]
                first = np.empty(len(distinct), np.int64)
                first[which[::-1]] = at[::-1]
                del which, good
                yield lang, k, first, distinct, counts
                live[:] = False
                live[at] = True
                on = live[at + 1] & self.joined[at + k - 1]
                at, keys = at[on], keys[on]
                keys = _longer(keys, self.hashes[at + k])

    def phrases(self, firsts: np.ndarray, words: int) -> list[str]:
        """The phrases that start at the given words: lower-cased, with one space between words."""
        out = []
        for low, high in zip(self.starts[firsts].tolist(), self.ends[firsts + words - 1].tolist()):
            raw = self.buffer[low:high].translate(_PLAIN)
            out.append((b" ".join(filter(None, raw.split(b" "))) if b"  " in raw else raw).decode())
        return out


def _longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of windows with one more word."""
    return textbuf.mix64(keys * _U(0x9E3779B97F4A7C15) + words)


def _lang_hash(lang: str) -> int:
    raw = np.frombuffer(lang.encode() or b"\0", np.uint8)
    # mixed once more: a language's name may be a word as well
    return int(textbuf.mix64(textbuf.word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])) + _U(1))[0])


def _shards(batches, flush: int):
    """Closed shards of about ``flush`` bytes from a task's batches, with each language's bytes in all texts and in the shard.

    A cut waits for a second ``flush`` and the rest is halved, so that no small shard, whose support would be one, is left over.
    """
    held: list[pa.RecordBatch] = []
    sizes: list[int] = []

    def build(n: int):
        shard, weights = _Shard(), {}
        for batch in held[:n]:
            for lang, total, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                weights.setdefault(lang, [total, 0])[1] += size
            shard.add(batch.column(0), batch.column(1))
        del held[:n], sizes[:n]
        shard.close()
        textbuf.release_memory()
        return shard, weights

    def first(most: float) -> int:
        return max(1, int(np.searchsorted(np.cumsum(sizes), most, "right")))

    for whole in batches:
        for batch in textbuf.slices(whole, "text"):
            held.append(batch)
            sizes.append(sum(batch.column(3).to_pylist()))
            if sum(sizes) >= 2 * flush:
                yield build(first(flush))
    if sum(sizes) > 1.4 * flush and len(held) > 1:
        yield build(first(sum(sizes) / 2))
    if held:
        yield build(len(held))


class _Filter:
    """A Bloom filter in blocks: a key's leading bits choose its block, its probes stay inside."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks  # (blocks, bytes)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        count, width = self.blocks.shape
        block, out = _block(keys, count), np.ones(len(keys), bool)
        for bit in _probes(keys, 8 * width):
            out &= (self.blocks[block, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out


def _block(keys: np.ndarray, count: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(count) >> _U(32)).astype(np.int64)


def _probes(keys: np.ndarray, bits: int):
    step = textbuf.mix64(keys ^ _U(0xC0FFEE)) | _U(1)
    for k in range(_PROBES):
        yield ((keys + _U(k) * step) & _U(bits - 1)).astype(np.int64)


def _filter_of(keys: DataFrame, most: int) -> _Filter:
    """A filter of the column ``key``; blocks are filled apart, and together take 16 bits a key, at most ``most`` bits."""
    bits = min(most, 1 << max(21, (16 * max(keys.count(), 1) - 1).bit_length()))
    count, width = bits // _BLOCK, _BLOCK

    def deal(batches):
        for batch in batches:
            found = np.unique(batch.column(0).to_numpy().view(_U))
            yield pa.RecordBatch.from_arrays([textbuf.int64s(_block(found, count)), pa.array(textbuf.as_signed(found))], ["block", "key"])

    def fill(batches):
        filled: dict[int, np.ndarray] = {}
        for batch in batches:
            block, found = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U)
            for b in np.unique(block).tolist():
                bit = filled.setdefault(b, np.zeros(width, bool))
                for probe in _probes(found[block == b], width):
                    bit[probe] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in filled.values()]
        yield pa.RecordBatch.from_arrays([textbuf.int64s(list(filled)), textbuf.binaries(packed)], ["block", "bits"])

    pieces = keys.mapInArrow(deal, "block long, key long").repartition(count, "block").mapInArrow(fill, "block long, bits binary").collect()
    out = np.zeros((count, width // 8), np.uint8)
    for row in pieces:  # together at most the filter's size
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return _Filter(out)


def _weighed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``lang``, ``text``, all bytes of the language and the text's own; and whether languages are few enough to broadcast."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("size", F.octet_length("text").cast("long"))
    totals = scratch.keep("totals", texts.groupBy("lang").agg(F.sum("size").alias("total")))
    few = totals.count() <= _LANGS
    return texts.join(F.broadcast(totals) if few else totals, "lang").select("lang", "text", "total", "size"), few


def frequent_phrases(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """Exact counts of all phrases of 1 to ``longest`` words that reach the support: ``lang``, ``phrase``, ``size``, ``f``.

    A row with ``size`` 0 for each language holds all its words' occurrences. Words and pairs are mined and counted first; longer
    phrases are then mined and counted only where all their pairs reach the support over all texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts, few = _weighed(docs, scratch)
    support, longest, flush = config.support, config.longest, config.flush

    def mined(name: str, low: int, high: int, frequent):
        """A filter of the phrases of ``low`` to ``high`` words whose count may reach the support, by what the shards know of it.

        A shard tells of each phrase above its remainder (the lowered support less one) how far it is above, and of each language the remainder.
        """

        def mine(batches):
            for shard, weights in _shards(batches, flush):
                total, size = (np.array([weights[x][k] for x in shard.langs], np.float64) for k in (0, 1))
                # a hair below the exact bound, so that rounding loses no phrase
                least = np.maximum(1, np.ceil(support * size / np.maximum(total, 1) - 1e-6)).astype(np.int64)

                # languages of one part would share their remainders, which only lets more through
                part = np.array([_lang_hash(x) >> 33 for x in shard.langs], np.int32)
                yield _above(part, pa.nulls(len(part), pa.int64()), least - 1)
                for lang, k, _, keys, times in shard.levels(high, lambda lang, k, keys, counts: counts >= least[lang] if k >= low else frequent.value.passes(keys)):
                    if k >= low:
                        yield _above(np.full(len(keys), part[lang]), pa.array(textbuf.as_signed(keys)), times - (least[lang] - 1))
            textbuf.release_memory()

        sums = texts.mapInArrow(mine, "part int, key long, above long").groupBy("part", "key").agg(F.sum("above").alias("above"))
        sums = scratch.keep(f"candidates-{name}", sums)
        held = sums.where("key is null").select("part", F.col("above").alias("held"))  # one row for each language
        found = sums.where("key is not null").join(F.broadcast(held) if few else held, "part").where(F.col("above") + F.col("held") >= support)
        return spark.sparkContext.broadcast(_filter_of(found.select("key"), config.filter_bits))

    def counts(name: str, low: int, high: int, frequent) -> DataFrame:
        """Phrases of ``low`` to ``high`` words; ``frequent`` holds those of fewer words that reach the support."""
        candidates = mined(name, low, high, frequent)

        def count(batches):
            # counting adds up over any parts, so smaller ones do here
            for shard, _ in _shards(batches, flush // 3):
                if low == 1:
                    words = np.bincount(shard.code, minlength=len(shard.langs))
                    yield _counted(shard.langs, [""] * len(words), [0] * len(words), words)
                for lang, k, at, _, times in shard.levels(high, lambda lang, k, keys, counts: (candidates if k >= low else frequent).value.passes(keys)):
                    for i in range(0, len(at) if k >= low else 0, 1 << 16):
                        some = at[i : i + (1 << 16)]
                        yield _counted([shard.langs[lang]] * len(some), shard.phrases(some, k), [k] * len(some), times[i : i + (1 << 16)])
            textbuf.release_memory()

        counted = texts.mapInArrow(count, "lang string, phrase string, size int, f long")
        summed = counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
        return scratch.keep(name, summed.where((F.col("size") == 0) | (F.col("f") >= support)))

    short = counts("short", 1, min(2, longest), None)
    if longest <= 2:
        return short
    keys = short.where("size > 0").select("lang", "phrase", "size").mapInArrow(_phrase_keys, "key long")
    frequent = spark.sparkContext.broadcast(_filter_of(scratch.keep("keys", keys), config.filter_bits))
    return short.unionByName(counts("long", 3, longest, frequent))


def _phrase_keys(batches):
    """The windows' hashes of phrases of one or two words."""
    for batch in batches:
        shard, size = _Shard(), batch.column(2).to_numpy()
        shard.add(batch.column(0), batch.column(1))
        shard.close()
        first = np.cumsum(size) - size
        keys = shard.hashes[first]
        pairs = np.flatnonzero(size == 2)
        keys[pairs] = _longer(keys[pairs], shard.hashes[first[pairs] + 1])
        yield pa.RecordBatch.from_arrays([pa.array(textbuf.as_signed(keys))], ["key"])


def _above(part: np.ndarray, keys: pa.Array, above: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), keys, textbuf.int64s(above)], ["part", "key", "above"])


def _counted(langs: list, phrases: list, sizes: list, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), textbuf.int64s(counts)], ["lang", "phrase", "size", "f"])


def _words(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, n), " ")


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """The first phrases of each language by how much more often they occur than their parts would by chance.

    Columns ``lang``, ``rank``, ``phrase``, ``size``, ``a``, ``l``, ``r``, ``n``, ``score``. A null ``lang`` is ``und``, a null text empty; repeated rows
    count each; texts of any length count whole. Of equal cuts the first counts, equal scores go by ``a``, then by the phrase's
    bytes. An empty table, or one without a phrase at the support, gives an empty result. Other columns are ignored.
    """
    rows = frequent_phrases(docs, config)
    named = rows.where("size > 0").select("lang", "phrase", "size", "f")
    totals = rows.where("size = 0").select("lang", F.col("f").alias("n"))
    if totals.count() <= _LANGS:  # one row for each language
        totals = F.broadcast(totals)
    long = named.where("size > 1").withColumns({"words": F.split("phrase", " "), "a": F.col("f")})

    cut = long.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", _words(F.lit(1), F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left, right = (named.select("lang", F.col("phrase").alias(part), F.col("f").alias(c)) for part, c in (("first", "l"), ("rest", "r")))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = cut.withColumn("score", F.expr(SCORE))
    weakest = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # what a phrase is inside of occurs at most as often, so the phrases longer by one word decide
    shorter = long.select("lang", F.explode(F.array(_words(F.lit(1), F.col("size") - 1), _words(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    inside = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < config.inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "size", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
