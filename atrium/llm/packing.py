"""Cost-balanced packing of documents into fixed-length training sequences.

Attention over a piece of n tokens costs ``linear * n + quadratic * n * n``. Documents longer
than a sequence are cut into full sequences first. Of what is left, pools are formed in the
order the task meets them; inside a pool pieces go, most costly first, to the sequence with the
lowest cost so far that has room. A pool's sequences together hold exactly its tokens: all
have the full length but for a remainder, which is laid out as powers of two. A piece that
fits nowhere whole is cut over the sequences with the most room.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from atrium.llm import textbuf
from atrium.llm.chunks import ChunkTable, chunk_array


@dataclass(frozen=True)
class PackConfig:
    """``pool`` is the number of tokens of short pieces that a task gathers before it packs them."""

    length: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    pool: int = 1 << 20


def capacities(total: int, length: int) -> list[int]:
    """Sequence sizes that add up to ``total``: full ones, then descending powers of two."""
    full, rest = divmod(total, length)
    return [length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(sizes: list[int], config: PackConfig) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place pieces of at most ``length`` tokens each: rows (piece, start in it, tokens, sequence, offset).

    Also returns the number of sequences. All sequences are full. A piece is cut only if no sequence has
    room for it when its turn comes; of sequences of equal cost the first is taken, of equal pieces the earlier.
    """
    rooms = capacities(sum(sizes), config.length)
    used = [0] * len(rooms)
    cost = [0.0] * len(rooms)
    out: list[tuple[int, int, int, int, int]] = []

    def put(piece: int, start: int, tokens: int, s: int) -> None:
        out.append((piece, start, tokens, s, used[s]))
        used[s] += tokens
        cost[s] += config.linear * tokens + config.quadratic * tokens * tokens

    # sizes only go down, so a sequence waits, by its room, until the pieces are small enough for it
    open_now: list[tuple[float, int]] = []
    waiting = [(-room, s) for s, room in enumerate(rooms)]
    heapq.heapify(waiting)
    left: list[int] = []
    for piece in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        while waiting and -waiting[0][0] >= sizes[piece]:
            _, s = heapq.heappop(waiting)
            heapq.heappush(open_now, (cost[s], s))
        if not open_now:
            left.append(piece)
            continue
        _, s = heapq.heappop(open_now)
        put(piece, 0, sizes[piece], s)
        room = rooms[s] - used[s]
        if room >= sizes[piece]:
            heapq.heappush(open_now, (cost[s], s))
        elif room:
            heapq.heappush(waiting, (-room, s))
    gaps = [(used[s] - rooms[s], s) for s in range(len(rooms)) if used[s] < rooms[s]]
    heapq.heapify(gaps)
    for piece in left:
        start = 0
        while start < sizes[piece]:
            _, s = heapq.heappop(gaps)
            take = min(rooms[s] - used[s], sizes[piece] - start)
            put(piece, start, take, s)
            start += take
            if used[s] < rooms[s]:
                heapq.heappush(gaps, (used[s] - rooms[s], s))
    return out, len(rooms)


class TextTokens:
    """Token ids of whole texts by a byte-level tokenizer file, through a table of distinct chunks."""

    def __init__(self, tokenizer: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = ChunkTable(self._encode)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for start in range(0, len(chunks), 4000):  # the library's own records of a chunk are large
            out += [e.ids for e in self.tokenizer.encode_batch_fast(chunks[start : start + 4000], add_special_tokens=False)]
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, text after text, and their n + 1 bounds."""
        data, offsets = textbuf.text_buffer(column)
        whole = self._with_added_token(data, offsets)
        if not whole:
            return self.table.ids(*chunk_array(data, offsets, marker_only=False))[:2]
        # such a token may lie across a cut, so these texts are encoded as they are
        texts = column.to_pylist()
        rest = pa.array([None if k in whole else t for k, t in enumerate(texts)], pa.string())
        ids, at = self.ids(rest)
        parts = [self.tokenizer.encode(texts[k], add_special_tokens=False).ids if k in whole else ids[at[k] : at[k + 1]] for k in range(len(texts))]
        return np.concatenate([np.asarray(p, np.uint32) for p in parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _with_added_token(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        raw, found = data.tobytes(), set()
        for token in self.added:
            place = raw.find(token)
            while place >= 0:
                found.add(int(np.searchsorted(offsets, place, "right")) - 1)
                place = raw.find(token, place + 1)
        return {k for k in found if any(t in raw[offsets[k] : offsets[k + 1]] for t in self.added)}


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Pool:
    """Short pieces of one task until they are packed."""

    def __init__(self, config: PackConfig, partition: int):
        self.config, self.base, self.made = config, partition << 36, 0
        self.rows: list[tuple[int | None, int, bytes, int]] = []
        self.tokens = 0

    def cut(self, doc_id, ids: np.ndarray, out: list) -> None:
        length, n = self.config.length, len(ids)
        whole = n - n % length
        raw = ids.tobytes()
        for start in range(0, whole, length):
            out.append((doc_id, start, length, raw[4 * start : 4 * (start + length)], n, self.base + self.made, 0))
            self.made += 1
        if n > whole:
            self.rows.append((doc_id, whole, raw[4 * whole :], n))
            self.tokens += n - whole

    def flush(self, out: list) -> None:
        placed, count = pack([len(r[2]) // 4 for r in self.rows], self.config)
        for piece, start, tokens, s, offset in placed:
            doc_id, first, raw, n = self.rows[piece]
            out.append((doc_id, first + start, tokens, raw[4 * start : 4 * (start + tokens)], n, self.base + self.made + s, offset))
        self.made += count
        self.rows, self.tokens = [], 0


def pack_documents(docs: DataFrame, tokenizer: str, config: PackConfig = PackConfig(), digest: bool = False) -> DataFrame:
    """Tokenize and pack all texts; one row for each piece.

    ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: ``start`` counts the ids of
    the document before the piece, ``ids`` are little-endian unsigned 32-bit integers (with
    ``digest`` their CRC-32 as ``ids_crc32`` instead), ``offset`` is the place in the sequence.
    Every document ends with ``end_id``, so a null or empty text is one piece of one id.

    Tasks pack on their own and number sequences from their partition, so there is no shuffle;
    a repeated attempt gives the same rows. Repeated rows and null ids are packed as they come;
    other columns are ignored; an empty table gives an empty result.
    """
    schema = PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in schema.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        if digest and rows:
            columns[3] = [zlib.crc32(x) for x in columns[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        pool, tokens, out = _Pool(config, TaskContext.get().partitionId()), TextTokens(tokenizer), []
        for whole in batches:
            for batch in textbuf.slices(whole, "text", most=2 << 20):
                ids, at = tokens.ids(batch.column(1))
                keys = batch.column(0).to_pylist()
                for k, doc_id in enumerate(keys):
                    pool.cut(doc_id, np.append(ids[at[k] : at[k + 1]], np.uint32(config.end_id)), out)
                if pool.tokens >= config.pool:
                    pool.flush(out)
                if len(out) > 2000:
                    yield batch_of(out)
                    out = []
        pool.flush(out)
        yield batch_of(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, schema)
