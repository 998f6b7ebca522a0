"""Interpolated modified Kneser-Ney word model of any order, counted in Spark and read through memory maps.

The first pass over the texts counts words; their sorted 64-bit hashes are the vocabulary and a
word's id is its rank. The second counts windows of ``order`` ids, every text led by start ids. A
task counts its own part first and sends sorted, packed blocks for each shard. The task of a shard
merges them exactly, by ids, and writes two hash tables: the counts of n-grams, and the
totals of their contexts. The third pass maps those files into memory and scores the
texts by search, without a shuffle.

A shard holds all windows with the same second word, so that it sees every extension of its
contexts (all but the last word) and every left extension of its suffixes (all but the first), whose
numbers are the counts of the next order. A second word that would outweigh a shard is spread by context; its
suffixes' partial numbers are then dealt by suffix, and their context totals added up from parts. Orders below
are dealt by their first word in the same way, down to single words, which are kept in ranges of ids. Sums
over shards are taken in rounds of at most ``fan`` parts, so no task reads more than that.

A hash table keeps, of each 64-bit hash, the leading bits as a bucket and the next 32 as an entry; an n-gram
that was never seen is taken for another with a chance below 1e-8.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from atrium.llm import textbuf
from atrium.scratch import Scratch

_U = np.uint64
#: The hash of the token that ends every text; no word has it but by a 64-bit coincidence.
END = textbuf.mix64(np.array([0xE0F], _U))[0]
_BLOCK = "shard int, keys binary, counts binary"


@dataclass(frozen=True)
class LanguageModelConfig:
    """``flush`` tokens are counted at once in a task; a shard holds about ``shard_tokens`` tokens.

    Single words' counts are kept in files of ``span`` ids, so their number follows the vocabulary. ``fan`` bounds
    the parts that one task adds up, ``open_files`` the maps that a worker holds.
    """

    order: int = 3
    flush: int = 3 << 20
    shard_tokens: int = 3 << 20
    span: int = 1 << 16
    fan: int = 64
    open_files: int = 4096
    base_alpha: float = 0.1


@dataclass(frozen=True)
class KneserNeyModel:
    """Where the arrays are, and the figures that every task needs (a few numbers for each shard of words).

    ``cuts`` holds, for orders 1 to ``order``, the discounts of counts 1, 2 and over 2.
    """

    folder: str
    order: int
    word_sizes: tuple[int, ...]
    shards: int
    heavy: int
    span: int
    texts: int
    train_tokens: int
    cuts: tuple[tuple[float, float, float], ...]
    single_total: int
    single_types: tuple[int, int, int]

    @property
    def vocabulary(self) -> int:
        return sum(self.word_sizes)


class ModelFolder:
    """Files of a model under the shared folder, on any file system that Spark's workers can name.

    Under a mounted (``file:``) folder arrays are memory-mapped; elsewhere a file is read whole when it is first used.
    """

    def __init__(self, address: str):
        remote = re.match(r"^[a-z][a-z0-9+.-]*:", address) and not address.startswith("file:")
        self.files = None
        if remote:
            from pyarrow.fs import FileSystem

            self.files, self.path = FileSystem.from_uri(address)
        else:
            self.path = re.sub(r"^file:/*", "/", address)

    def save(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Write a file whole or not at all; repeated attempts write the same bytes."""
        heads, at = {}, 0
        for key, x in arrays.items():
            heads[key] = (str(x.dtype), list(x.shape), at)
            at += -(-x.nbytes // 64) * 64
        head = json.dumps(heads).encode()
        temporary, target = f"{self.path}/.{name}.{uuid.uuid4().hex}", f"{self.path}/{name}"
        if self.files is None:
            os.makedirs(self.path, exist_ok=True)
            out = open(temporary, "wb")
        else:
            self.files.create_dir(self.path, recursive=True)
            out = self.files.open_output_stream(temporary)
        with out:
            out.write(len(head).to_bytes(8, "little") + head + b"\0" * (-(8 + len(head)) % 64))
            for x in arrays.values():
                out.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 64))
        if self.files is None:
            os.replace(temporary, target)
        else:
            self.files.move(temporary, target)

    def open(self, name: str) -> dict[str, np.ndarray] | None:
        """The file's arrays, or nothing where there is no such file."""
        path = f"{self.path}/{name}"
        if self.files is None:
            if not os.path.exists(path):
                return None
            raw = np.memmap(path, np.uint8, "r")
        else:
            from pyarrow.fs import FileType

            if self.files.get_file_info(path).type == FileType.NotFound:
                return None
            with self.files.open_input_stream(path) as stream:
                raw = np.frombuffer(stream.read(), np.uint8)
        size = int.from_bytes(raw[:8].tobytes(), "little")
        base = -(-(8 + size) // 64) * 64
        out = {}
        for key, (kind, shape, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            out[key] = raw[base + at : base + at + n].view(kind).reshape(shape)
        return out


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end token last, and the n + 1 bounds."""
    words, bounds = textbuf.batch_words(column)
    n = len(bounds) - 1
    out = np.empty(len(words) + n, _U)
    ends = bounds[1:] + np.arange(n)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words
    out[ends] = END
    return out, np.append(0, ends + 1)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Bytes of integers plane by plane, so that compression finds the equal high ones."""
    rows = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(rows[:, :width].T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _expanded(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True) if raw else b""


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as planes of their differences."""
    return _squeezed(_planes(np.diff(keys, prepend=_U(0)), 8))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(_expanded(raw), 8), dtype=_U)


def pack_counts(counts: np.ndarray) -> bytes:
    return _squeezed(_planes(counts, 8))


def unpack_counts(raw: bytes) -> np.ndarray:
    return _from_planes(_expanded(raw), 8).astype(np.int64)


def id_width(ids: int) -> int:
    """Bytes of an id below ``ids``."""
    return max(1, -(-int(ids).bit_length() // 8))


def pack_rows(columns: list[np.ndarray], width: int) -> bytes:
    """Rows of ids, sorted by their columns in order; of the first two the differences are kept."""
    top = (1 << 8 * width) - 1
    parts = [np.diff(c.astype(_U), prepend=_U(0)) & _U(top) if k < 2 else c for k, c in enumerate(columns)]
    return _squeezed(b"".join(_planes(p, width) for p in parts))


def unpack_rows(raw: bytes, n: int, width: int) -> list[np.ndarray]:
    raw = _expanded(raw)
    size = len(raw) // n
    kind = np.uint32 if width <= 4 else _U
    columns = [_from_planes(raw[k * size : (k + 1) * size], width) for k in range(n)]
    mask = _U((1 << 8 * width) - 1)
    return [(np.cumsum(c, dtype=_U) & mask if k < 2 else c).astype(kind) for k, c in enumerate(columns)]


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts (or rows of counts)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _firsts([keys])
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(keys) else counts


def _firsts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merge_rows(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order of their columns, with summed counts (without counts: how many rows)."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = _firsts(columns)
    if counts is None:
        return [c[first] for c in columns], np.diff(np.append(first, len(order)))
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(order) else counts


def hash_rows(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of ids; that of a row's leading part is a step on the way."""
    out = np.full(len(columns[0]), 0x2545F491, _U)
    for c in columns:
        out = _hash_step(out, c)
    return out


def _hash_step(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return textbuf.mix64(before * _U(0x9E3779B97F4A7C15) + ids.astype(_U))


def hash_table(keys: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a table from distinct hashes to rows of counts.

    Sorted hashes are cut into buckets by their leading bits and keep the next 32. Distinct rows of counts are numbered
    by frequency; a number takes one byte, or four in a second array where it is 255 or more.
    """
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    bits = max(0, len(keys).bit_length() - 4)
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    mixed = values[:, 0].astype(_U) if values.shape[1] == 1 else hash_rows(list(values.T))
    _, place, back, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    ranked = np.argsort(-times, kind="stable")
    number = np.empty(len(ranked), np.int64)
    number[ranked] = np.arange(len(ranked))
    number = number[back]
    rare = np.flatnonzero(number >= 255)
    return {
        "index": np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.uint32 if len(keys) < 1 << 32 else np.int64),
        "entry": (keys << _U(bits) >> _U(32)).astype(np.uint32),
        "number": np.minimum(number, 255).astype(np.uint8),
        "rare": rare.astype(np.int64),
        "rare_number": number[rare].astype(np.uint32),
        "rows": values[place[ranked]].astype(np.int64),
    }


def table_rows(table: dict[str, np.ndarray], prefix: str, keys: np.ndarray) -> np.ndarray:
    """The rows of counts of the given hashes; zeros for a hash that is not there."""
    index, entry, rows = table[prefix + "index"], table[prefix + "entry"], table[prefix + "rows"]
    out = np.zeros((len(keys), rows.shape[1]), np.int64)
    if not len(entry) or not len(keys):
        return out
    bits = (len(index) - 1).bit_length() - 1
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    wanted = (keys << _U(bits) >> _U(32)).astype(np.uint32)
    low, end = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
    high, last = end.copy(), len(entry) - 1
    for _ in range(int((end - low).max()).bit_length()):
        middle = (low + high) >> 1
        less = (entry[np.minimum(middle, last)] < wanted) & (middle < high)
        low = np.where(less, middle + 1, low)
        high = np.where(less, high, middle)
    at = np.flatnonzero(low < end)
    at = at[entry[low[at]] == wanted[at]]
    number = table[prefix + "number"][low[at]].astype(np.int64)
    rare = np.flatnonzero(number == 255)
    if len(rare):
        number[rare] = table[prefix + "rare_number"][np.searchsorted(table[prefix + "rare"], low[at[rare]])]
    out[at] = rows[number]
    return out


def _named(prefix: str, table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {prefix + k: x for k, x in table.items()}


def _blocks(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """One packed row for each shard; keys are sorted and distinct."""
    order = np.argsort(shards, kind="stable")
    shards, keys, counts = shards[order], keys[order], counts[order]
    cuts = _firsts([shards])
    rows = [(int(shards[a]), pack_keys(keys[a:b]), pack_counts(counts[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(shards)))]
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["shard", "keys", "counts"])


def _gathered(batches, values_of, flush: int):
    """Lists of arrays, about ``flush`` rows in all, from the texts of a task."""
    held, n = [], 0
    for whole in batches:
        for batch in textbuf.slices(whole, "text"):
            values = values_of(batch.column(batch.schema.get_field_index("text")))
            held.append(values)
            n += values.shape[-1]
            if n >= flush:
                yield _joined(held)
                n = 0
    if held:
        yield _joined(held)


def _joined(held: list[np.ndarray]) -> np.ndarray:
    """One array of the parts, which are let go."""
    out = np.concatenate(held, axis=-1)
    held.clear()
    return out


class _Words:
    """The vocabulary's maps: ids and counts of token hashes."""

    def __init__(self, folder: ModelFolder, sizes: tuple[int, ...]):
        self.folder, self.sizes = folder, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parts: dict[int, dict[str, np.ndarray]] = {}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shards = word_shard(hashes, len(self.sizes))
        cuts = _firsts([shards])
        for a, b in zip(cuts, np.append(cuts[1:], len(shards))):
            k = int(shards[a])
            if not self.sizes[k]:
                continue
            if k not in self.parts:
                self.parts[k] = self.folder.open(f"word-{k}")
            stored, part = self.parts[k]["hash"], hashes[a:b]
            at = np.minimum(np.searchsorted(stored, part), len(stored) - 1)
            hit = stored[at] == part
            ids[a:b] = np.where(hit, at + self.base[k], -1)
            counts[a:b] = np.where(hit, self.parts[k]["count"][at], 0)
        return ids, counts

    def of_tokens(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(tokens, return_inverse=True)
        ids, counts = self.find(distinct)
        return ids[back], counts[back]


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The range of the hash space, so that shards in order are sorted as a whole."""
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """A shard by bits that the tables' buckets do not use first."""
    return (textbuf.mix64(hashes ^ _U(0xA5A5A5A5)) % _U(shards)).astype(np.int64)


def padded(values: np.ndarray, bounds: np.ndarray, lead: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's values behind ``lead`` fillers, and the places of the values."""
    at = np.arange(len(values)) + np.repeat(np.arange(1, len(bounds)), np.diff(bounds)) * lead
    out = np.full(len(values) + (len(bounds) - 1) * lead, fill, values.dtype)
    out[at] = values
    return out, at


#: Parts of a shard: dealt by a word; windows of a heavy word dealt by context; n-grams below of a heavy word by all words.
_PLAIN, _CONTEXTS, _SUFFIXES = 0, 1, 2
#: Rows that a merging task returns: numbers of types by count, parts of sums, and n-grams of the order below.
_TOPS, _SUMS, _ROWS = 0, 1, 2
_MERGED = "what int, level int, place int, part int, keys binary, values binary, tops array<long>"
_ROW_BLOCK = "part int, shard int, rows binary, counts binary"


class _Rows:
    """Collects the rows that a merging task returns."""

    def __init__(self):
        self.rows: list[tuple] = []

    def tops(self, level: int, counts: np.ndarray) -> None:
        self.rows.append((_TOPS, level, 0, 0, b"", b"", [int((counts == c).sum()) for c in (1, 2, 3, 4)] + [len(counts), int(counts.sum())]))

    def sums(self, level: int, places: np.ndarray, part: int, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((keys, places))
        places, keys, values = places[order], keys[order], values[order]
        cuts = _firsts([places])
        for a, b in zip(cuts, np.append(cuts[1:], len(places))):
            self.rows.append((_SUMS, level, int(places[a]), part, pack_keys(keys[a:b]), pack_counts(values[a:b].ravel()), None))

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows)) if self.rows else [[]] * 7
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["what", "level", "place", "part", "keys", "values", "tops"])


def _row_blocks(columns: list[np.ndarray], counts: np.ndarray, parts: np.ndarray, shards: np.ndarray, width: int) -> list[tuple]:
    """Packed rows for each part and shard; the columns are sorted."""
    order = np.lexsort((shards, parts))
    parts, shards, counts = parts[order], shards[order], counts[order]
    columns = [c[order] for c in columns]
    cuts = _firsts([parts, shards])
    return [(int(parts[a]), int(shards[a]), pack_rows([c[a:b] for c in columns], width), pack_counts(counts[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(parts)))]


def _dealt(columns: list[np.ndarray], loud: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and shard of n-grams below the highest order: by the first word, heavy ones by all words."""
    part = np.where(loud, _SUFFIXES, _PLAIN)
    shard = np.where(loud, hash_shard(hash_rows(columns), shards), hash_shard(hash_rows(columns[:1]), shards))
    return part, shard


def _context_totals(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each distinct row without its last column (columns sorted): total, types seen once, twice, more often."""
    first = _firsts(columns[:-1]) if len(columns) > 1 else _firsts([np.zeros(len(counts), np.int8)])
    figures = np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)
    totals = np.add.reduceat(figures, first, axis=0) if len(counts) else np.zeros((0, 4), np.int64)
    return [c[first] for c in columns[:-1]], totals


def fit(train: DataFrame, config: LanguageModelConfig = LanguageModelConfig()) -> KneserNeyModel:
    """Count the words and n-grams of all texts of ``train`` and write the model's arrays.

    Null texts are empty ones (an end token alone); an empty table gives a model without words,
    under which every text has the uniform law's probability over one unseen token. Repeated rows count each time;
    other columns are ignored.
    """
    spark, order = train.sparkSession, config.order
    if order < 1:
        raise ValueError("the order is at least 1")
    scratch = Scratch(spark, "kneser-ney")
    address = scratch.root
    texts = train.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).collect()[0]
    n_texts, about = size[0], (size[1] or 0) // 5 + size[0]  # texts, and about so many tokens
    word_shards = max(1, -(-about // (8 * config.shard_tokens)))
    shards = max(1, -(-about // config.shard_tokens))

    def count_words(batches):
        for tokens in _gathered(batches, lambda c: token_hashes(c)[0], config.flush):
            keys, counts = np.unique(tokens, return_counts=True)
            yield _blocks(word_shard(keys, word_shards), keys, counts)

    def merge_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = merge_counts(np.concatenate([unpack_keys(x) for x in table.column("keys").to_pylist()]), np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()]))
        ModelFolder(address).save(f"word-{shard}", {"hash": keys, "count": counts})
        tops = [int((counts == c).sum()) for c in (1, 2, 3, 4)]
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(keys)], "tokens": [int(counts.sum())], "tops": pa.array([tops], pa.list_(pa.int64()))})

    words = texts.mapInArrow(count_words, _BLOCK).groupBy("shard").applyInArrow(merge_words, "shard int, size long, tokens long, tops array<long>").collect()
    sizes = [0] * word_shards
    for r in words:
        sizes[r.shard] = r.size
    word_sizes, tokens = tuple(sizes), sum(r.tokens for r in words)
    vocabulary = sum(word_sizes)
    # words that outweigh a quarter of a shard are spread
    heavy = max(1, config.shard_tokens // 4)
    figures = {1: [sum(r.tops[k] for r in words) for k in range(4)] + [vocabulary, tokens]}
    if order > 1:
        figures = _fit_orders(texts, scratch, config, word_sizes, shards, heavy, n_texts)
    cuts = tuple(discounts(figures.get(k, [0] * 6)[:4]) for k in range(1, order + 1))
    lone = figures.get(1, [0] * 6)
    return KneserNeyModel(
        address, order, word_sizes, shards, heavy, config.span, n_texts, tokens, cuts,
        lone[5], (lone[0], lone[1], lone[4] - lone[0] - lone[1]),
    )


def _fit_orders(texts: DataFrame, scratch: Scratch, config: LanguageModelConfig, word_sizes: tuple[int, ...], shards: int, heavy: int, n_texts: int) -> dict[int, list[int]]:
    """Count n-grams from the highest order down and write their tables; types by count, types and total of each order."""
    address, order, span, vocabulary = scratch.root, config.order, config.span, sum(word_sizes)
    start_id, width = vocabulary, id_width(vocabulary + 1)  # every text is led by the start id
    kind = np.uint32 if width <= 4 else _U
    # the word that deals a window: its second one, or of two the first
    dealing = 1 if order > 2 else 0
    sorting = [*range(1, order - 1), 0, order - 1] if order > 2 else [0, 1]

    def count_windows(batches):
        known = _Words(ModelFolder(address), word_sizes)

        def windows(column):
            hashes, bounds = token_hashes(column)
            ids, counts = known.of_tokens(hashes)
            framed, at = padded(ids.astype(kind), bounds, order - 1, start_id)
            loud, _ = padded(counts > heavy, bounds, order - 1, n_texts > heavy)
            return np.stack([*(framed[at + (k - order + 1)] for k in sorting), loud[at + (dealing - order + 1)].astype(kind)])

        for part in _gathered(batches, windows, config.flush):
            sorted_rows = np.lexsort(part[-2::-1])
            columns = [c[sorted_rows] for c in part[:-1]]
            first = _firsts(columns)
            columns, counts, loud = [c[first] for c in columns], np.diff(np.append(first, len(sorted_rows))), part[-1][sorted_rows[first]].astype(bool)
            del part, sorted_rows, first
            natural = [columns[sorting.index(k)] for k in range(order)]
            if order == 2:
                rows = _row_blocks(columns, counts, *_dealt(columns, loud, shards), width)
            else:
                dealt = np.where(loud, hash_shard(hash_rows(natural[:-1]), shards), hash_shard(hash_rows(natural[1:2]), shards))
                rows = _row_blocks(columns, counts, np.where(loud, _CONTEXTS, _PLAIN), dealt, width)
            names, kinds = ("part", "shard", "rows", "counts"), (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], list(names))

    def merged(table: pa.Table, n: int) -> tuple[int, int, list[np.ndarray], np.ndarray]:
        part, shard = table.column("part")[0].as_py(), table.column("shard")[0].as_py()
        blocks = [unpack_rows(x, n, width) for x in table.column("rows").to_pylist()]
        counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
        return part, shard, *merge_rows([np.concatenate(c) for c in zip(*blocks)], counts)

    def lower(out: _Rows, level: int, part: int, shard: int, columns: list[np.ndarray], counts: np.ndarray) -> None:
        """Write the n-grams of an order below the highest and return what the next one needs."""
        tables = _named("gram.", hash_table(hash_rows(columns), counts[:, None]))
        contexts, totals = _context_totals(columns, counts)
        if part == _PLAIN:
            tables |= _named("context.", hash_table(hash_rows(contexts), totals))
        else:
            keys, totals = merge_counts(hash_rows(contexts), totals)
            out.sums(level, hash_shard(keys, shards), shard, keys, totals)
        ModelFolder(address).save(f"gram-{level}-{part}-{shard}", tables)
        out.tops(level, counts)
        if level == 2:
            ids, lefts = merge_rows([columns[1]], None)
            out.sums(1, ids[0].astype(np.int64) // span, shard, ids[0].astype(_U), lefts[:, None])
        else:
            suffixes, lefts = merge_rows(columns[1:], None)
            send(out, level - 1, suffixes, lefts, heavy_ids(suffixes[0]))

    def send(out: _Rows, level: int, columns: list[np.ndarray], counts: np.ndarray, loud: np.ndarray) -> None:
        """Partial counts of n-grams for the tasks of their order."""
        out.rows += [(_ROWS, level, shard, part, rows, n, None) for part, shard, rows, n in _row_blocks(columns, counts, *_dealt(columns, loud, shards), width)]

    def heavy_ids(ids: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(ids, return_inverse=True)
        return (_counts_of_ids(ModelFolder(address), word_sizes, distinct, n_texts) > heavy)[back]

    def merge_top(table: pa.Table) -> pa.Table:
        part, shard, columns, counts = merged(table, order)
        out = _Rows()
        if order == 2:
            lower(out, 2, part, shard, columns, counts)
            return out.table()
        natural = [columns[sorting.index(k)] for k in range(order)]
        _, totals = _context_totals(columns, counts)
        firsts = _firsts(columns[:-1])
        tables = _named("gram.", hash_table(hash_rows(natural), counts[:, None])) | _named("context.", hash_table(hash_rows([c[firsts] for c in natural[:-1]]), totals))
        ModelFolder(address).save(f"gram-{order}-{part}-{shard}", tables)
        out.tops(order, counts)
        suffixes, lefts = merge_rows(natural[1:], None)
        if part == _PLAIN:
            lower(out, order - 1, part, shard, suffixes, lefts)
        else:
            send(out, order - 1, suffixes, lefts, np.ones(len(lefts), bool))
        return out.table()

    def merge_level(level: int):
        def run(table: pa.Table) -> pa.Table:
            out = _Rows()
            lower(out, level, *merged(table, level))
            return out.table()

        return run

    def add_up(last: bool):
        def run(table: pa.Table) -> pa.Table:
            level, place = table.column("level")[0].as_py(), table.column("place")[0].as_py()
            wide = 1 if level == 1 else 4
            keys = np.concatenate([unpack_keys(x) for x in table.column("keys").to_pylist()])
            values = np.concatenate([unpack_counts(x).reshape(-1, wide) for x in table.column("values").to_pylist()])
            keys, values = merge_counts(keys, values)
            out = _Rows()
            if not last:
                out.sums(level, np.full(len(keys), place), table.column("part")[0].as_py() // config.fan, keys, values)
            elif level == 1:
                lefts = np.zeros(span, np.int64)
                lefts[(keys - _U(place * span)).astype(np.int64)] = values[:, 0]
                kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if lefts.max() <= np.iinfo(t).max)
                ModelFolder(address).save(f"single-{place}", {"lefts": lefts.astype(kind)})
                out.tops(1, values[:, 0])
            else:
                ModelFolder(address).save(f"context-{level}-{place}", _named("context.", hash_table(keys, values)))
            return out.table()

        return run

    found = scratch.keep("merged-top", texts.mapInArrow(count_windows, _ROW_BLOCK).groupBy("part", "shard").applyInArrow(merge_top, _MERGED))
    results = [found]
    for level in range(order - 1, 1, -1):
        rows = _union(results).where((F.col("what") == _ROWS) & (F.col("level") == level))
        rows = rows.select("part", F.col("place").alias("shard"), F.col("keys").alias("rows"), F.col("values").alias("counts"))
        results.append(scratch.keep(f"merged-{level}", rows.groupBy("part", "shard").applyInArrow(merge_level(level), _MERGED)))
    sums = _union(results).where(F.col("what") == _SUMS)
    parts, turn, tops = shards, 0, list(results)
    while True:
        last = parts <= config.fan
        dealt = sums.withColumn("deal", F.lit(0) if last else F.floor(F.col("part") / config.fan).cast("int"))
        found = scratch.keep(f"sums-{turn}", dealt.groupBy("level", "place", "deal").applyInArrow(add_up(last), _MERGED))
        tops.append(found)
        if last:
            break
        sums, parts, turn = found.where(F.col("what") == _SUMS), -(-parts // config.fan), turn + 1
    counted = _union(tops).where(F.col("what") == _TOPS).groupBy("level").agg(*[F.sum(F.col("tops")[k]).alias(f"t{k}") for k in range(6)])
    figures = {r.level: [int(r[f"t{k}"]) for k in range(6)] for r in counted.collect()}  # one row for each order
    for name in ["merged-top", *(f"merged-{k}" for k in range(order - 1, 1, -1)), *(f"sums-{k}" for k in range(turn + 1))]:
        scratch.drop(name)
    return figures


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _counts_of_ids(folder: ModelFolder, sizes: tuple[int, ...], ids: np.ndarray, n_texts: int) -> np.ndarray:
    """Training counts of sorted ids; the start id counts once for each text."""
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.full(len(ids), n_texts, np.int64)
    cuts = np.searchsorted(ids.astype(np.int64), base)
    for k in range(len(sizes)):
        if cuts[k] < cuts[k + 1]:
            out[cuts[k] : cuts[k + 1]] = folder.open(f"word-{k}")["count"][ids[cuts[k] : cuts[k + 1]].astype(np.int64) - base[k]]
    return out


def discounts(tops: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and over 2 from the numbers of types seen 1, 2, 3 and 4 times.

    Where a number is missing the estimate has no meaning and 0.5, 1.0 and 1.5 are taken.
    """
    n1, n2, n3, n4 = tops
    if min(n1, n2, n3) == 0:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in zip((1, 2, 3), raw))


class Scorer:
    """The model's maps in one worker, opened when they are first needed."""

    def __init__(self, model: KneserNeyModel, open_files: int = 4096):
        self.model, self.folder = model, ModelFolder(model.folder)
        self.words = _Words(self.folder, model.word_sizes)
        self.files: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()
        self.open_files = open_files

    def _file(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.files:
            if len(self.files) >= self.open_files:
                self.files.popitem(last=False)
            self.files[name] = self.folder.open(name)
        self.files.move_to_end(name)
        return self.files[name]

    def lefts(self, ids: np.ndarray) -> np.ndarray:
        """The number of different words before each word; 0 for unknown ones (-1)."""
        out = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        order = order[np.searchsorted(ids[order], 0) :]
        where = ids[order] // self.model.span
        cuts = _firsts([where])
        for a, b in zip(cuts, np.append(cuts[1:], len(where))):
            stored = self._file(f"single-{int(where[a])}")
            if stored is not None:
                out[order[a:b]] = stored["lefts"][ids[order[a:b]] - int(where[a]) * self.model.span]
        return out

    def rows(self, prefix: str, names: list[str], shards: np.ndarray, keys: np.ndarray, loud: np.ndarray, width: int) -> np.ndarray:
        """Rows of counts of hashes: where ``loud`` from the second of the two files' name patterns, else from the first."""
        out = np.zeros((len(keys), width), np.int64)
        place = shards + loud * self.model.shards
        if 2 * self.model.shards <= 1 << 16:
            place = place.astype(np.uint16)  # such are sorted by their bytes
        order = np.argsort(place, kind="stable")
        place = place[order].astype(np.int64)
        cuts = _firsts([place])
        for a, b in zip(cuts, np.append(cuts[1:], len(place))):
            k = int(place[a])
            stored = self._file(names[k >= self.model.shards].format(k % self.model.shards))
            if stored is not None:
                out[order[a:b]] = table_rows(stored, prefix, keys[order[a:b]])
        return out

    def log10(self, column: pa.Array, alpha: float) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, the add-alpha score, the model's score."""
        model, order = self.model, self.model.order
        hashes, bounds = token_hashes(column)
        distinct, back = np.unique(hashes, return_inverse=True)
        word_ids, word_counts = self.words.find(distinct)
        base = np.log10((word_counts + alpha) / (model.train_tokens + alpha * (model.vocabulary + 1)))[back]
        # single words by the number of different words before them, interpolated with the uniform law
        chance = np.full(len(distinct), 1.0 / (model.vocabulary + 1))
        if model.single_total:
            lone = word_counts if order == 1 else self.lefts(word_ids)
            cut = np.array([0.0, *model.cuts[0]])
            freed = (cut[1:] @ np.array(model.single_types, np.float64)) / model.single_total
            chance = (lone - cut[np.minimum(lone, 3)]) / model.single_total + freed * chance
        chance, counts = chance[back], word_counts[back]
        if order > 1 and model.vocabulary:
            lead = order - 1
            ids = word_ids[back]
            framed, at = padded(np.where(ids < 0, model.vocabulary + 1, ids), bounds, lead, model.vocabulary)
            loud, _ = padded(counts > model.heavy, bounds, lead, model.texts > model.heavy)
            by_word = hash_shard(hash_rows([framed]), model.shards)
            context = None
            for level in range(2, order + 1):
                context = hash_rows([framed[at - level + j] for j in range(1, level)])
                gram = _hash_step(context, framed[at])
                dealing = at - level + 1 + (level > 2 and level == order)  # the second word in the highest order
                deals, spread = by_word[dealing], loud[dealing]
                by_context = hash_shard(context, model.shards)
                if level == order > 2:
                    names = [f"gram-{level}-{_PLAIN}-{{}}", f"gram-{level}-{_CONTEXTS}-{{}}"]
                    totals = self.rows("context.", names, np.where(spread, by_context, deals), context, spread, 4)
                    shard = np.where(spread, by_context, deals)
                else:
                    totals = self.rows("context.", [f"gram-{level}-{_PLAIN}-{{}}", f"context-{level}-{{}}"], np.where(spread, by_context, deals), context, spread, 4)
                    names = [f"gram-{level}-{_PLAIN}-{{}}", f"gram-{level}-{_SUFFIXES}-{{}}"]
                    shard = np.where(spread, hash_shard(gram, model.shards), deals)
                seen = np.flatnonzero(totals[:, 0])
                found = self.rows("gram.", names, shard[seen], gram[seen], spread[seen], 1)[:, 0]
                cut = np.array([0.0, *model.cuts[level - 1]])
                spare = totals[seen, 1:] @ cut[1:]
                chance[seen] = (found - cut[np.minimum(found, 3)] + spare * chance[seen]) / totals[seen, 0]
        sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        return np.diff(bounds), sums((counts > 0).astype(np.int64)), sums(base), sums(np.log10(chance))


def score_texts(docs: DataFrame, model: KneserNeyModel, config: LanguageModelConfig = LanguageModelConfig()) -> DataFrame:
    """Score all texts: ``doc_id, n_tokens, n_known, base_score, score, perplexity``.

    ``score`` is the model's log10 probability of the text with its end token, ``base_score`` that of
    single words with add-alpha smoothing. A null text is an empty one. Rows do not depend on one
    another, so repeats and null ids are scored as they come; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value, config.open_files)
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                n, known, base, score = scorer.log10(batch.column(1), config.base_alpha)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), textbuf.int64s(n), textbuf.int64s(known), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / n))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
