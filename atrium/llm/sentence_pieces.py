"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of the vocabulary holds the space marker behind another character, a piece
never spans the start of a run of spaces. Each distinct chunk (a run of spaces and what
follows it) is then segmented once for a task and its ids are joined back by position.
A marker that stands in the text itself is to the library the same as a space, and is read as one here.
A vocabulary without that property, or a model that rewrites texts, is used on whole texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from atrium.llm import textbuf
from atrium.llm.chunks import ChunkTable, chunk_array, gather

MARKER = "▁"
#: White space, ligatures, wide and combined characters, controls: a model that normalises texts changes one of these.
_PROBE = f" a  {MARKER} ﬁ　\u00a0b\te\u0301 Ａ½\x01\u200b "


def pieces_keep_to_words(processor) -> bool:
    """Whether no piece holds the marker behind another character, and texts are taken as they are."""
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    if processor.normalize(_PROBE) != MARKER + _PROBE.replace(" ", MARKER):
        return False
    return not any(crossing.search(processor.id_to_piece(i)) for i in range(processor.vocab_size()))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with every marker in the texts replaced by a space, and its offsets."""
    raw = data.tobytes()
    marker = MARKER.encode()
    if marker not in raw:
        return data, offsets
    a, b, c = marker
    first = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c))
    out, keep = data.copy(), np.ones(len(data), bool)
    out[first] = 0x20
    keep[first + 1] = keep[first + 2] = False
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class PieceCodec:
    """Encodes and decodes the texts of Arrow batches; one for each task."""

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()
        self.by_chunk = pieces_keep_to_words(self.processor)
        # the library adds no marker to an empty text, so a lone space at a text's end is told from another
        self.space = self.processor.encode("x ")[len(self.processor.encode("x")) :]
        self.table = ChunkTable(self._segment)
        self._decoded: list[bytes] = []
        self._generation = self.table.generation

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        # every chunk starts with one space, which the library's own leading marker stands for
        return [ids if len(c) > 1 else self.space for c, ids in zip(chunks, self.processor.encode([c[1:] for c in chunks], num_threads=1))]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of all texts without begin and end, their bounds, and each text decoded again."""
        if not self.by_chunk:
            return self._whole(column)
        array, bounds = chunk_array(*spaced(*textbuf.text_buffer(column)), marker_only=True)
        ids, at, rows = self.table.ids(array, bounds, lead=" ")
        flat, starts = self._decode_table()
        octets, ends = gather(flat, starts, rows, bounds)
        raw = octets.tobytes()
        return ids, at, [raw[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _decode_table(self) -> tuple[np.ndarray, np.ndarray]:
        if self.table.generation != self._generation:
            self._decoded, self._generation = [], self.table.generation
        done = len(self._decoded)
        flat, starts = self.table.flat, self.table.starts
        if done < len(self.table.known):
            todo = [flat[starts[k] : starts[k + 1]].tolist() for k in range(done, len(self.table.known))]
            self._decoded += [b" " + t.encode() for t in self.processor.decode(todo)]
            self._lengths = np.concatenate([[0], np.cumsum([len(x) for x in self._decoded])])
            self._octets = np.frombuffer(b"".join(self._decoded), np.uint8)
        return self._octets if self._decoded else np.zeros(0, np.uint8), self._lengths if self._decoded else np.zeros(1, np.int64)

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        texts = [t or "" for t in column.to_pylist()]
        ids = self.processor.encode(texts, num_threads=1)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        full = [[self.begin, *x, self.end] for x in ids]
        return np.array([i for x in ids for i in x], np.uint32), bounds, [self.processor.decode(x).encode() for x in full]


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text: ``doc_id, ids (array<int>), decoded``.

    Ids are the library's for the whole text, with begin and end ids and no sampling. A null or
    empty text has only those two. Rows are independent of one another: repeated rows, null
    ids and other columns change nothing; an empty table gives an empty result.
    """

    def run(batches):
        codec = PieceCodec(model)
        for whole in batches:
            for batch in textbuf.slices(whole, "text", most=2 << 20):
                ids, at, decoded = codec.encode(batch.column(1))
                n = batch.num_rows
                sizes = np.diff(at) + 2
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = np.empty(ends[-1], np.int32)
                inner = np.ones(len(out), bool)
                inner[ends[:-1]] = inner[ends[1:] - 1] = False
                out[ends[:-1]], out[ends[1:] - 1] = codec.begin, codec.end
                out[inner] = ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out)), pa.array([d.decode() for d in decoded], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
                assert len(decoded) == n

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """The same as ``encode_texts`` with each text's results as digests, so that ids stay in the task.

    ``doc_id, n_tokens, ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (the decoded text in UTF-8). Nulls, empties and repeats as there.
    """

    def run(batches):
        codec = PieceCodec(model)
        first, last = (int(i).to_bytes(4, "little") for i in (codec.begin, codec.end))
        for whole in batches:
            for batch in textbuf.slices(whole, "text", most=2 << 20):
                ids, at, decoded = codec.encode(batch.column(1))
                raw = memoryview(ids.astype("<u4").tobytes())
                digests = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    h = hashlib.sha256(first)
                    h.update(raw[4 * a : 4 * b])
                    h.update(last)
                    digests.append(h.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), textbuf.int64s(np.diff(at) + 2), pa.array(digests, pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
