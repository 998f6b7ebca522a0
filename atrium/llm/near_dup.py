"""Near-duplicate documents by banded MinHash, odd sketches and full-set confirmation.

1. One pass over the texts gives each document its shingle count, a fingerprint of its
   shingle set, its band keys and its odd sketch (a parity bitmap of its MinHash samples).
2. Documents with equal sets form a class; only the class's smallest id goes on.
3. Every document that meets others in a band picks, of the smallest and largest ids of its bands, the one whose
   sketch is nearest; the pair is confirmed on its full sets. The components of these links gather clusters of copies,
   however large, with one pair for each document.
4. A band whose documents are then in one component is settled. In the others, sketches meet (128 bytes a document; a
   large band in pairs of blocks): two sketches' XOR population count estimates the similarity, and pairs from
   different components that may reach the threshold mark their documents.
5. Only marked documents send their texts to the band, where such pairs are confirmed on full sets unless
   links found before already connect them. A task returns at most one edge for each document.
6. Components of the confirmed edges are the result.

With 35 bands of 5 samples a pair at similarity 0.8 escapes all bands with a probability
below 1e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from atrium.llm import textbuf
from atrium.operators.graph import component_stars
from atrium.scratch import Scratch

_U = np.uint64


@dataclass(frozen=True)
class NearDupConfig:
    """``width`` words a shingle; a link needs ``100 * intersection >= percent * union``.

    ``slack`` is how far below the threshold a sketch's estimate may lie for the pair to be
    confirmed exactly (about five standard deviations at 175 samples). ``block`` bounds the
    documents, and ``block_bytes`` the shingles, of one side of a task.
    """

    width: int = 5
    percent: int = 80
    bands: int = 35
    rows: int = 5
    sketch_bits: int = 1024
    slack: float = 0.17
    block: int = 1024
    block_bytes: int = 16 << 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words than ``width`` has its whole word sequence as one shingle; a
    text without words, or a null, has none.
    """
    words, bounds = textbuf.batch_words(column)
    sizes = np.diff(bounds)
    step = _U(0xD6E8FEB86659FD93)
    span = max(len(words) - width + 1, 0)
    rolled = np.zeros(span, _U)
    for k in range(width):
        rolled = rolled * step + words[k : k + span]
    rolled = textbuf.mix64(rolled + _U(width))
    out = []
    for start, size in zip(bounds[:-1].tolist(), sizes.tolist()):
        if size >= width:
            out.append(np.unique(rolled[start : start + size - width + 1]))
        elif size:
            whole = _U(0)
            with np.errstate(over="ignore"):
                for word in words[start : start + size]:
                    whole = whole * step + word
                out.append(textbuf.mix64(np.array([whole + _U(size)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def _coefficients(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = textbuf.mix64(np.arange(2 * samples, dtype=_U) + _U(20_011))
    return (seeds[:samples] >> _U(32)).astype(np.uint32) | np.uint32(1), (seeds[samples:] >> _U(32)).astype(np.uint32)


def minhashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """Array (documents, samples) of 32-bit minima; every set must have an element."""
    if not sets:
        return np.zeros((0, samples), np.uint32)
    flat = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    factors, terms = _coefficients(samples)
    out = np.empty((samples, len(sets)), np.uint32)
    work = np.empty_like(flat)
    for i in range(samples):
        np.multiply(flat, factors[i], out=work)
        np.add(work, terms[i], out=work)
        out[i] = np.minimum.reduceat(work, starts)
    return out.T


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band."""
    keys = np.zeros((len(minima), bands), _U)
    shaped = minima.reshape(len(minima), bands, rows)
    for r in range(rows):
        keys = textbuf.mix64(keys * _U(31) + shaped[:, :, r].astype(_U) + _U(1))
    return textbuf.mix64(keys + np.arange(bands, dtype=_U)[None, :])


def odd_sketches(minima: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (documents, bits / 8): each sample toggles one bit."""
    n, samples = minima.shape
    parity = np.zeros((n, bits), np.uint8)
    at = np.arange(n)
    for i in range(samples):
        where = textbuf.mix64(minima[:, i].astype(_U) + (_U(i) << _U(32))) % _U(bits)
        parity[at, where.astype(np.int64)] ^= 1
    return np.packbits(parity, axis=1)


def sketch_similarity(differing: np.ndarray, bits: int, samples: int) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches."""
    left = np.clip(1.0 - 2.0 * differing / bits, 1e-9, None)
    return np.clip(1.0 + bits / (4.0 * samples) * np.log(left), 0.0, 1.0)


def _signatures(config: NearDupConfig):
    def run(batches):
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                sets = shingle_sets(batch.column(1), config.width)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                minima = minhashes([sets[i] for i in some], config.samples)
                first, second = np.zeros(len(sets), _U), np.zeros(len(sets), _U)
                for i in some:
                    first[i] = textbuf.mix64(sets[i] ^ _U(0x1234567)).sum(dtype=_U)
                    second[i] = textbuf.mix64(sets[i] + _U(0x7654321)).sum(dtype=_U)
                keys = band_keys(minima, config.bands, config.rows)
                sketches: list[bytes | None] = [None] * len(sets)
                for i, x in zip(some.tolist(), odd_sketches(minima, config.sketch_bits)):
                    sketches[i] = x.tobytes()
                lengths = np.zeros(len(sets), np.int32)
                lengths[some] = config.bands
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        textbuf.int64s(sizes),
                        textbuf.int64s(textbuf.as_signed(first)),
                        textbuf.int64s(textbuf.as_signed(second)),
                        pa.ListArray.from_arrays(pa.array(offsets), textbuf.int64s(textbuf.as_signed(keys.ravel()))),
                        textbuf.binaries(sketches),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return run


def _bitmaps(column) -> np.ndarray:
    """Rows of 64-bit words of the sketches of a column."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), _U).reshape(len(raw), -1)


def _similarity(a: np.ndarray, b: np.ndarray, config: NearDupConfig) -> np.ndarray:
    differing = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return sketch_similarity(differing, config.sketch_bits, config.samples)


def _near_hubs(config: NearDupConfig):
    """Pairs whose sketches and sizes allow a link, with the estimated similarity."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            near = _similarity(_bitmaps(batch.column(3)), _bitmaps(batch.column(5)), config) if len(n) else np.zeros(0)
            fine = (near >= config.percent / 100 - config.slack) & (100 * np.minimum(n, m) >= config.percent * np.maximum(n, m))
            fine = pa.array(fine)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine), pa.array(near).filter(fine)], ["doc", "hub", "near"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, config: NearDupConfig) -> bool:
    if 100 * min(len(a), len(b)) < config.percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= config.percent * (len(a) + len(b) - common)


def _free(table: pa.Table) -> None:
    """After a large group, give memory back: a worker lives on between groups and tasks."""
    if table.nbytes > 4 << 20:
        textbuf.release_memory()


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm_hub(config: NearDupConfig):
    """Links between a hub and those that picked it."""

    def run(table: pa.Table) -> pa.Table:
        hub, docs = table.column("hub")[0].as_py(), table.column("doc").to_pylist()
        sets = shingle_sets(table.column("text").combine_chunks(), config.width)
        own = [s for d, s in zip(docs, sets) if d == hub]
        found = sorted({d for d, s in zip(docs, sets) if d != hub and any(_linked(s, x, config) for x in own)})
        del sets, own
        _free(table)
        return pa.table([textbuf.int64s(np.array(found, np.int64)), textbuf.int64s(np.full(len(found), hub))], schema=_EDGES)

    return run


def possible_pairs(bands: np.ndarray, sides: np.ndarray, groups: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, config: NearDupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, estimate) of rows of one band, of different groups, that may reach the threshold.

    Rows are sorted by band. ``sides`` marks the two blocks of a large band, of which only pairs across count; it is -1 for others.
    """
    left, right, estimates = [], [], []
    at, step = np.arange(len(bands) - 1), 1
    floor = config.percent / 100 - config.slack
    while len(at):
        at = at[bands[at] == bands[at + step]]
        i, j = at, at + step
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        fine = (groups[i] != groups[j]) & ((sides[i] < 0) | (sides[i] != sides[j])) & (100 * small >= config.percent * large)
        i, j = i[fine], j[fine]
        if len(i):
            near = _similarity(bitmaps[i], bitmaps[j], config)
            fine = near >= floor
            left.append(i[fine])
            right.append(j[fine])
            estimates.append(near[fine])
        step += 1
        at = at[at + step < len(bands)]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(left), np.concatenate(right), np.concatenate(estimates)


def _of_bands(table: pa.Table) -> tuple[pa.Table, tuple[np.ndarray, ...]]:
    """The rows sorted by band and document, and the arguments of ``possible_pairs``."""
    table = table.take(pa.array(np.lexsort((table.column("doc").to_numpy(), table.column("band").to_numpy()))))
    return table, (*(table.column(c).to_numpy() for c in ("band", "side", "component", "n")), _bitmaps(table.column("sketch")))


_BANDED = "chunk long, low int, high int, side int, band long, doc long, component long, n long, sketch binary"


def _mark(config: NearDupConfig):
    """The documents of a chunk of bands that stand in a possible pair."""

    def run(table: pa.Table) -> pa.Table:
        table, rows = _of_bands(table)
        i, j, _ = possible_pairs(*rows, config)
        return table.take(pa.array(np.union1d(i, j)))

    return run


class _Union:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def confirmed(sets: list[np.ndarray], joined: _Union, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], config: NearDupConfig) -> list[tuple[int, int]]:
    """Edges among the pairs that link on full sets and connect what ``joined`` does not; the likeliest pairs first."""
    i, j, near = pairs
    order = np.argsort(-near, kind="stable")
    i, j = i[order], j[order]
    n = len(sets)
    if len(i) > 4 * n:
        # many pairs of few sets: count what they share by a product of membership rows
        distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
        if n * len(distinct) <= 16_000_000:
            sizes = np.array([len(s) for s in sets], np.int64)
            table = np.zeros((n, len(distinct)), np.float32)
            table[np.repeat(np.arange(n), sizes), at] = 1.0
            linked = np.zeros(len(i), bool)
            for k in np.unique(i).tolist():
                mine = np.flatnonzero(i == k)
                common = (table[j[mine]] @ table[k]).astype(np.int64)
                linked[mine] = 100 * common >= config.percent * (sizes[j[mine]] + sizes[k] - common)
            return [(a, b) for a, b in zip(i[linked].tolist(), j[linked].tolist()) if joined.join(a, b)]
    return [(a, b) for a, b in zip(i.tolist(), j.tolist()) if joined.root(a) != joined.root(b) and _linked(sets[a], sets[b], config) and joined.join(a, b)]


def _confirm(config: NearDupConfig):
    """Edges between the marked documents of a chunk of bands; a document's sets are made once."""

    def run(table: pa.Table) -> pa.Table:
        table, rows = _of_bands(table)
        docs, _, components = table.column("doc").to_numpy(), None, rows[2]
        texts = table.column("text").combine_chunks().dictionary_encode()
        made = shingle_sets(texts.dictionary, config.width)
        sets = [made[k] for k in texts.indices.to_pylist()]
        joined, seen = _Union(len(docs)), {}
        for k, c in enumerate(components.tolist()):
            joined.join(seen.setdefault(c, k), k)
        edges = confirmed(sets, joined, possible_pairs(*rows, config), config)
        del sets, made
        _free(table)
        return pa.table([textbuf.int64s(docs[[a for a, _ in edges]] if edges else []), textbuf.int64s(docs[[b for _, b in edges]] if edges else [])], schema=_EDGES)

    return run


def _flipped(frame: DataFrame, column: str, *others: str) -> DataFrame:
    """The frame keyed by the complement of ``column`` as ``_k`` (any long has one): a join on it has plain exchanges on both sides, which may be split."""
    return frame.select((F.bitwise_not(F.col(column))).alias("_k"), *others)


def _hub_links(texts: DataFrame, items: DataFrame, met: DataFrame, scratch: Scratch, config: NearDupConfig) -> DataFrame:
    """Confirmed edges between documents and the nearest of the first and last documents of their bands."""
    hubs = met.select("doc", F.explode(F.array("first", "last")).alias("hub")).where("doc <> hub").distinct()
    sides = hubs.join(items.select("doc", "n", "sketch"), "doc")
    sides = _flipped(sides, "hub", "doc", "n", "sketch").join(_flipped(items, "doc", F.col("n").alias("m"), F.col("sketch").alias("other")), "_k")
    sides = sides.select("doc", (F.bitwise_not(F.col("_k"))).alias("hub"), "n", "sketch", "m", "other")
    near = sides.mapInArrow(_near_hubs(config), "doc long, hub long, near double")
    picked = near.groupBy("doc").agg(F.max_by("hub", F.struct("near", (F.bitwise_not(F.col("hub"))).alias("_h"))).alias("hub"))
    picked = scratch.keep("picked", picked)
    slots = picked.groupBy("hub").agg(F.ceil(F.count("*") / 256).cast("int").alias("slots"))
    members = _flipped(picked, "hub", "doc").join(_flipped(slots, "hub", "slots"), "_k")
    members = members.select((F.bitwise_not(F.col("_k"))).alias("hub"), F.pmod(F.xxhash64("doc"), F.col("slots")).cast("int").alias("slot"), "doc")
    each = slots.select("hub", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("hub").alias("doc"))
    wanted = _flipped(members.union(each), "doc", "hub", "slot").join(_flipped(texts, "doc_id", "text"), "_k")
    wanted = wanted.select("hub", "slot", (F.bitwise_not(F.col("_k"))).alias("doc"), "text")
    return scratch.keep("hub-links", wanted.groupBy("hub", "slot").applyInArrow(_confirm_hub(config), "a long, b long"))


def _band_links(texts: DataFrame, items: DataFrame, met: DataFrame, components: DataFrame, scratch: Scratch, config: NearDupConfig) -> DataFrame:
    """Confirmed edges between documents of one band that are in different components."""
    named = met.join(components, met.doc == components.node, "left").select("doc", "band", "docs", "shingles", F.coalesce("component", "doc").alias("component"))
    open_bands = named.groupBy("band", "docs", "shingles").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.greatest(F.col("docs") / config.block, 8 * F.col("shingles") / config.block_bytes)).cast("int")
    open_bands = scratch.keep("open-bands", open_bands.select("band", "docs", blocks.alias("blocks")))
    chunks = max(1, (open_bands.agg(F.sum("docs")).collect()[0][0] or 0) // (8 * config.block))
    # sketches join only the documents of bands that are still open
    rows = _flipped(named, "band", "doc", "component").join(_flipped(open_bands, "band", "blocks"), "_k").select("doc", "component", "blocks", (F.bitwise_not(F.col("_k"))).alias("band"))
    rows = _flipped(rows, "doc", "component", "blocks", "band").join(_flipped(items, "doc", "n", "sketch"), "_k").withColumn("doc", F.bitwise_not(F.col("_k")))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    # bands of one block share a task; of a larger one each pair of blocks has its own
    alone = F.col("blocks") > 1
    side = F.when(alone & (F.col("low") < F.col("high")), F.col("own")).otherwise(-1)
    few = lambda n: F.when(alone, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(n)))
    turn = lambda c: F.when(alone, F.col(c)).otherwise(F.lit(-1))
    dealt = rows.select(few(chunks).alias("chunk"), turn("low").alias("low"), turn("high").alias("high"), side.alias("side"), "band", "doc", "component", "n", "sketch")
    marked = scratch.keep("marked", dealt.groupBy("chunk", "low", "high").applyInArrow(_mark(config), _BANDED))
    weight = (marked.agg(F.sum("n")).collect()[0][0] or 0) * 8
    chunks = F.lit(max(1, weight // config.block_bytes))
    wanted = _flipped(marked, "doc", "low", "high", "side", "band", "component", "n", "sketch").join(_flipped(texts, "doc_id", "text"), "_k")
    chunk = F.when(F.col("low") >= 0, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), chunks))
    wanted = wanted.select(chunk.alias("chunk"), "low", "high", "side", "band", (F.bitwise_not(F.col("_k"))).alias("doc"), "component", "n", "sketch", "text")
    return scratch.keep("band-links", wanted.groupBy("chunk", "low", "high").applyInArrow(_confirm(config), "a long, b long"))


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Link near-duplicate documents and return their components.

    Reads ``doc_id`` (integer) and ``text``; other columns are ignored. Returns one row for
    each input row: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the
    smallest doc_id reachable over links, the document's own included.

    Null or wordless texts have no shingles and link with nothing. Rows that share a doc_id
    are one node of the link graph. A row with a null doc_id takes no part: its component is
    null and it is kept. Equal texts are one class and always share a component. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.mapInArrow(_signatures(config), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary")
    signed = scratch.keep("signatures", signed)
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep("classes", some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    # the smallest id of each class carries its bands
    chosen = classes.select("rep").distinct()
    items = some.join(chosen, some.doc_id == chosen.rep, "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    items = scratch.keep("items", items.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch", "bands"))
    banded = items.select("doc", "n", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("first < last")
    met = _flipped(banded, "band", "doc").join(_flipped(met, "band", "first", "last", "docs", "shingles"), "_k")
    met = scratch.keep("met", met.select((F.bitwise_not(F.col("_k"))).alias("band"), "doc", "first", "last", "docs", "shingles"))
    # only documents that meet another send their texts on
    meeting = _flipped(met.select("doc").distinct(), "doc")
    near = scratch.keep("texts", _flipped(texts, "doc_id", "text").join(meeting, "_k", "left_semi").select((F.bitwise_not(F.col("_k"))).alias("doc_id"), "text"))
    by_hub = _hub_links(near, items, met, scratch, config)
    by_band = _band_links(near, items, met, component_stars(by_hub, scratch, "clusters"), scratch, config)
    # rows of one id with different sets are one node
    split = some.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select(F.col("doc_id").alias("_d"))
    split = some.select("doc_id", "h1", "h2").join(split, F.col("doc_id") == F.col("_d"), "left_semi").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = component_stars(by_hub.union(by_band).union(split), scratch, "links")
    named = classes.join(linked, classes.rep == linked.node, "left").select(
        (F.bitwise_not(F.col("h1"))).alias("_k1"), (F.bitwise_not(F.col("h2"))).alias("_k2"), F.coalesce("component", "rep").alias("component_id")
    )
    by_class = some.select("doc_id", "n_shingles", (F.bitwise_not(F.col("h1"))).alias("_k1"), (F.bitwise_not(F.col("h2"))).alias("_k2")).join(named, ["_k1", "_k2"])
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = by_class.select("doc_id", "n_shingles", "component_id").union(alone)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one document of each component stays.

    All columns are returned as they were, whatever their names. Where rows repeat a doc_id that stays, the first by
    text is kept; rows with a null doc_id all stay. An empty table gives an empty result.
    """
    found = near_duplicates(docs, config).where("kept and doc_id is not null")
    found = found.groupBy((F.bitwise_not(F.col("doc_id"))).alias("_k")).agg(F.count("*").alias("n"))
    # the document's columns stay inside a struct, so that no name of theirs meets one of ours
    packed = docs.select(F.struct("*").alias("doc"), F.bitwise_not(F.col("doc_id").cast("long")).alias("_k"), F.col("text").alias("_text"))
    kept = packed.join(found, "_k")
    first = Window.partitionBy("_k").orderBy("_text", F.xxhash64("_text"))
    again = kept.where("n > 1").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = kept.where("n = 1").select("doc").union(again.select("doc")).union(packed.where("_k is null").select("doc"))
    return rows.select("doc.*")
