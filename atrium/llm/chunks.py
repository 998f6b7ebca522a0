"""Distinct-chunk tables: segment each distinct marked word once, join ids back by position.

A text is cut before every space that follows something other than white space and is
followed by something other than white space. Neither tokenizer used here has a token
that spans such a cut, so a chunk's ids do not depend on its neighbours. The chunks of an
Arrow batch tile its text buffer; Arrow's dictionary encoding finds the distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from atrium.llm import textbuf

#: Entries, and characters, after which a task's table is emptied; it only saves repeated work.
TABLE_LIMIT = 300_000
TABLE_CHARS = 8 << 20

#: ASCII punctuation but the apostrophe, which contractions bind to letters.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = True
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[[c for c in range(128) if not chr(c).isalpha()]] = True


def chunk_array(data: np.ndarray, offsets: np.ndarray, marker_only: bool) -> tuple[pa.Array, np.ndarray]:
    """Chunks that tile the buffer, and for each text the number of chunks before it (n + 1).

    With ``marker_only`` every run of spaces opens a chunk (and nothing else does), which is
    the rule for a vocabulary whose pieces hold the space marker only in front. Otherwise, by the
    rule of byte-level pre-tokenising, a single space between two non-spaces opens one, and so do a
    single line feed between two non-spaces, what follows it, and punctuation after a letter.
    """
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    space = data == 0x20
    opens = np.zeros(len(data), bool)
    if marker_only:
        opens[1:] = space[1:] & ~space[:-1]
    else:
        # White space outside ASCII also binds to its neighbours; a byte over 0x7F next to
        # the space could belong to one, so such a space opens no chunk.
        plain = ~textbuf.SEPARATORS[data] & (data < 0x80) & (data > 0x1F)
        letter = plain | (data >= 0xC3) & (data <= 0xC9)  # Latin letters of two bytes
        tail = plain.copy()
        tail[1:] |= (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
        opens[1:-1] = space[1:-1] & tail[:-2] & letter[2:]
        feed = (data[1:-1] == 0x0A) & tail[:-2] & letter[2:]
        opens[1:-1] |= feed
        opens[2:] |= feed
        # of the two-byte characters all but the signs of multiplication and division are letters
        ends_letter = tail & ~_NO_LETTER[data]
        ends_letter[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        opens[1:] |= _PUNCTUATION[data[1:]] & ends_letter[:-1]
    filled = offsets[1:] > offsets[:-1]
    firsts = offsets[:-1][filled]
    opens[firsts] = True
    # a space at the end of one text must not be judged by the first byte of the next
    lasts = offsets[1:][filled] - 1
    if not marker_only:
        single = lasts[~np.isin(lasts, firsts)]
        opens[single] &= ~space[single]
    starts = np.flatnonzero(opens)
    bounds = np.searchsorted(starts, offsets)
    edges = np.append(starts, len(data)).astype(np.int64)
    array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    return array, bounds


class ChunkTable:
    """Ids of distinct chunks, filled as new ones appear.

    ``encode`` maps a list of chunk texts to a list of sequences of ids.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = TABLE_LIMIT):
        self.encode, self.limit = encode, limit
        self.generation = 0
        self._clear()

    def _clear(self) -> None:
        self.generation += 1
        self.known: dict[str, int] = {}
        self.chars = 0
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _rows(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > self.limit or self.chars > TABLE_CHARS:
            self._clear()
        new = [c for c in chunks if c not in self.known]
        if new:
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.chars += sum(map(len, new))
            ids = self.encode(new)
            ends = np.cumsum([len(x) for x in ids]) + self.starts[-1]
            self.starts = np.concatenate([self.starts, ends])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1] - len(self.flat)))])
        known = self.known
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def ids(self, array: pa.Array, bounds: np.ndarray, lead: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, each text's bounds in them (n + 1), and each chunk's row of the table.

        ``lead`` stands before the first chunk of every text.
        """
        coded = array.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy(zero_copy_only=False)
        if lead and len(array):
            firsts = bounds[:-1][bounds[1:] > bounds[:-1]]
            opening = [lead + distinct[i] for i in at[firsts]]
            place = {c: k for k, c in enumerate(dict.fromkeys(distinct + opening))}
            order = np.fromiter((place[c] for c in distinct), np.int64, len(distinct))
            at = order[at]
            at[firsts] = [place[c] for c in opening]
            distinct = list(place)
        rows = self._rows(distinct)[at] if len(array) else np.zeros(0, np.int64)
        return *gather(self.flat, self.starts, rows, bounds), rows


def gather(flat: np.ndarray, starts: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``at`` of ``flat``; the bounds of groups of slices become bounds of items."""
    lengths = starts[at + 1] - starts[at]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], lengths)
    return flat[index], ends[bounds]
