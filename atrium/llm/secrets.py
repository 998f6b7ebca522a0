"""Secret scans: fixed patterns, and the guess cost of values that stand in a credential's place.

The guess cost of a value is the least sum of log10 guesses over all ways to cut it into
common words, dates, repeats, keyboard walks and brute-force characters, by dynamic programming. A
value that is dear to guess is a secret. The words are those of the whole corpus, by the number of
texts that hold them, after a short list of common passwords. A vectorised look at the bytes finds the texts that can
match at all; only those are searched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from atrium.llm import textbuf

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Words that announce a credential, for the guess-cost method.
_CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{6,})"""
)
_BEFORE = re.compile(rb"(?i:word|wd|phrase|code|secret|token|key|credentials?|bearer)[\"']?\x20*\Z")

#: Common passwords and words in them, most common first.
COMMON = (
    "password 123456 123456789 12345678 12345 qwerty abc123 password1 111111 123123 admin letmein welcome monkey login "
    "dragon master sunshine princess football baseball shadow iloveyou trustno1 superman batman michael jordan charlie "
    "secret hello freedom whatever ninja mustang access flower passw0rd starwars summer winter spring autumn hunter "
    "test guest root user default changeme pass love god money computer internet server database system private public "
    "token key example sample demo"
).split()
_RANK = {word: rank + 1 for rank, word in enumerate(COMMON)}
#: Letters of the longest word, and of the shortest one taken from a corpus.
_LONGEST, _SHORTEST = 24, 3
_WORD = re.compile(r"[^\W\d_]{%d,}" % _SHORTEST)
#: Rows of a keyboard.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:])}
_LEET = str.maketrans("04135$@7", "oalessat")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")

#: A repeat or walk that starts within ``_ENTRY`` characters of its stretch's start (the farthest that a word, date or
#: other repeat reaches into it) has any length; later starts, which gain little, are tried up to so many units.
_REPEATS, _ENTRY = 64, _LONGEST + 16
#: Inside a longer stretch only so many characters at its end are looked at one by one: whatever starts
#: before them is no cheaper than the stretch itself.
_LONG, _EXIT = 256, _REPEATS + _LONGEST
#: Characters between looks at the least cost so far.
_LOOK = 16


@dataclass(frozen=True)
class SecretConfig:
    """A value is a secret from ``log10_guesses`` on; the ``words`` most frequent words of a corpus are broadcast.

    At most 24 letters a word, these are under 20 MB at the default, and as a rule about 2 MB.
    """

    log10_guesses: float = 9.0
    words: int = 200_000


def _character_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def word_ranks(docs: DataFrame, config: SecretConfig = SecretConfig()) -> dict[str, int]:
    """Ranks of the common words and of the ``words`` most frequent ones of all texts.

    A word is a run of 3 to 24 letters in lower case; it ranks by the number of texts that hold it, then by its
    letters. Values in a credential's place are left out, so that a copied secret is not a word.
    """

    def count(batches):
        held: Counter = Counter()

        def block():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), textbuf.int64s(list(held.values()))], ["word", "n"])

        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                possible = possible_kinds(*textbuf.text_buffer(batch.column(0)))
                for text, kinds in zip(batch.column(0).to_pylist(), possible):
                    if text:
                        text = _CONTEXT.sub(" ", text) if "guess" in kinds else text
                        held.update(set(_WORD.findall(text.lower())))
                if len(held) > 300_000:
                    yield block()
                    held.clear()
        yield block()

    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count, "word string, n long").where(F.length("word") <= _LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    ranked = counted.orderBy(F.desc("n"), "word").limit(config.words).select("word").toArrow().column("word").to_pylist()
    return _RANK | {w: len(COMMON) + k for k, w in enumerate((w for w in ranked if w not in _RANK), 1)}


def _repeat_end(value: str, start: int, unit: int) -> int:
    """The first place from ``start`` on whose character differs from the one a unit later, or has none."""
    at, last, step = start, len(value) - unit, 16
    while at < last:
        end = min(at + step, last)
        if value[at:end] == value[at + unit : end + unit]:
            at, step = end, 2 * step
        elif end - at == 1:
            break
        else:
            step = (end - at) // 2
    return at


def _walk_end(low: str, start: int) -> int:
    end = start + 1
    while end < len(low) and (low[end - 1], low[end]) in _NEXT:
        end += 1
    return end


def guess_cost(value: str, ranks: Mapping[str, int] = _RANK, limit: float = math.inf) -> float:
    """Least log10 number of guesses over all segmentations of the value, with the words of ``ranks``.

    Every segmentation has a cut between the place reached and the farthest one that a segment from before it ends at; once the
    least cost of these reaches ``limit``, that cost, which is not above the result, is returned. A value of
    any length so takes a time that follows from the limit.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    # for each unit: where its stretch starts, and the first place after which the text differs from the unit before
    opened, turns = [0] * 9, [0] * 9
    walk_opened = walk_end = 0
    i, farthest, seen = 0, 0, 0

    def reach(j: int, cost: float) -> None:
        nonlocal farthest
        if cost < best[j]:
            best[j] = cost
        if j > farthest:
            farthest = j

    while i < n:
        if i >= seen:
            least = min(best[i : farthest + 1])
            if least >= limit:
                return least
            seen = i + _LOOK
        base = best[i]
        reach(i + 1, base + _character_cost(value[i]))
        words = {}
        for j in range(i + 2, min(n, i + _LONGEST) + 1):
            piece = value[i:j]
            if (rank := ranks.get(low[i:j])) is not None:
                extra = 0.0 if piece == low[i:j] else 0.3 if piece.istitle() or piece.isupper() else 0.9
            elif (rank := ranks.get(plain[i:j])) is not None:
                extra = 0.9
            if rank is not None:
                words[j] = math.log10(rank + 1) + extra
                reach(j, base + words[j])
        if date := _DATE.match(value, i):
            reach(date.end(), base + math.log10(366 * 120 if date.end() - i > 4 else 120))
        if i >= walk_end:
            walk_opened, walk_end = i, _walk_end(low, i)
        end = walk_end if i - walk_opened <= _ENTRY else min(walk_end, i + _REPEATS)
        beyond = i + 1  # where the next place to look at is
        if walk_end - walk_opened > _LONG and walk_opened + _ENTRY < beyond:
            beyond = max(beyond, walk_end - _EXIT)
        for j in _ends(i, 1, 3, end - i, walk_end):
            reach(j, base + math.log10(len("".join(_ROWS)) * 2 * (j - i)))
        for unit in range(1, min(8, (n - i) // 2) + 1):
            if i >= turns[unit]:
                opened[unit], turns[unit] = i, _repeat_end(value, i, unit)
            times = 1 + (turns[unit] - i) // unit
            stretch = turns[unit] + unit
            if stretch - opened[unit] > _LONG and opened[unit] + _ENTRY < i + 1:
                beyond = max(beyond, stretch - _EXIT)
            if times > 1:
                once = base + min(sum(map(_character_cost, value[i : i + unit])), words.get(i + unit, math.inf))
                for j in _ends(i, unit, 2, times if i - opened[unit] <= _ENTRY else min(times, _REPEATS), stretch):
                    reach(j, once + math.log10((j - i) // unit))
        i = beyond
    return best[n]


def _ends(start: int, unit: int, least: int, most: int, stretch: int) -> list[int]:
    """Places ``least`` to ``most`` units after ``start``; of many only those near it and near the end of its stretch."""
    if (most - least) * unit <= _LONG:
        return [start + k * unit for k in range(least, most + 1)]
    near = range(least, max(least, (_ENTRY + _LONGEST) // unit) + 1)
    far = range(max(near[-1] + 1, (stretch - _EXIT - start) // unit), most + 1)
    return [start + k * unit for k in (*near, *far)]


def find_spans(text: str, config: SecretConfig = SecretConfig(), kinds: frozenset[str] = frozenset(KINDS), ranks: Mapping[str, int] = _RANK) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end), by start, then kind as listed, then end."""
    found = set()
    if "assign" in kinds:
        found |= {(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6}
    if "access" in kinds:
        found |= {(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20}
    if "hex" in kinds:
        found |= {(m.start(), "hex", m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24}
    if "guess" in kinds:
        found |= {(m.start(1), "guess", m.end(1)) for m in _CONTEXT.finditer(text) if guess_cost(m[1], ranks, config.log10_guesses) >= config.log10_guesses}
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True


def possible_kinds(data: np.ndarray, offsets: np.ndarray) -> list[set[str]]:
    """For each text the kinds that it may hold; no text with a match is missed."""
    n = len(offsets) - 1
    out: list[set[str]] = [set() for _ in range(n)]
    if not len(data):
        return out
    raw = data.tobytes()

    def text_of(place: int) -> int:
        return int(np.searchsorted(offsets, place, "right")) - 1

    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _HEX_BYTES[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    for k in np.flatnonzero(turns[1::2] - turns[::2] >= 24).tolist():
        for t in range(text_of(turns[2 * k]), text_of(turns[2 * k + 1] - 1) + 1):
            out[t].add("hex")
    place = raw.find(b"AKIA")
    while place >= 0:
        out[text_of(place)].add("access")
        place = raw.find(b"AKIA", place + 1)  # a hit across two texts hides none
    for place in np.flatnonzero((data == 0x3A) | (data == 0x3D)).tolist():
        back = place
        while back and raw[back - 1] == 0x20:
            back -= 1
        if _BEFORE.search(raw, max(0, back - 16), back):
            out[text_of(place)] |= {"assign", "guess"}
    return out


def _scanned(batch: pa.RecordBatch, column: int, config: SecretConfig, ranks: Mapping[str, int]) -> list[tuple[str, list]]:
    """Text (only where something may be found) and spans of each row."""
    texts = batch.column(column)
    possible = possible_kinds(*textbuf.text_buffer(texts))
    rows = []
    for k, kinds in enumerate(possible):
        text = texts[k].as_py() if kinds else None
        rows.append((text, find_spans(text, config, frozenset(kinds), ranks) if text else []))
    return rows


def scan(docs: DataFrame, config: SecretConfig = SecretConfig(), ranks: Mapping[str, int] = _RANK) -> DataFrame:
    """Spans of every text: ``doc_id, spans`` (array of kind, start, end in code points, end exclusive).

    The words of ``ranks`` are cheap to guess (see ``word_ranks``; by default the common ones alone).
    A null text is an empty one and has none. Rows do not depend on one another: repeated rows
    and null ids give rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(ranks))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, "text"):
                spans = [[{"kind": k, "start": a, "end": b} for a, k, b in found] for _, found in _scanned(batch, 1, config, known)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def span_digests(docs: DataFrame, config: SecretConfig = SecretConfig(), ranks: Mapping[str, int] = _RANK) -> DataFrame:
    """Counts and digests of ``scan``'s spans: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""

    def run(batches):
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                named = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                base = [text for kind, text in named if kind != "guess"]
                counts = [sum(k == kind for k, _ in named) for kind in KINDS[:3]]
                out.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(t for _, t in named)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(docs, config, ranks).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    stretch_end = -1
    for start, _, end in spans:
        if start > stretch_end:
            out.append(text[at:start] + mark)
            stretch_end = end
        stretch_end = max(stretch_end, end)
        at = stretch_end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, config: SecretConfig = SecretConfig(), ranks: Mapping[str, int] = _RANK) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets in ``text`` replaced by a mark; ``n_chars`` follows, where present.

    A null text stays null. Rows do not depend on one another, so repeats stay; the names of other columns do not
    matter; an empty table gives an empty result.
    """
    names = docs.columns
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(dict(ranks))

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in textbuf.slices(whole, f"c{place}"):
                rows = _scanned(batch, place, config, known)
                if any(found for _, found in rows):
                    old = batch.column(place).to_pylist()
                    new = [redact(text, found) if found else before for (text, found), before in zip(rows, old)]
                    batch = batch.set_column(place, f"c{place}", pa.array(new, batch.column(place).type))
                yield batch

    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))
    out = numbered.mapInArrow(run, numbered.schema)
    if "n_chars" in names:
        k = names.index("n_chars")
        out = out.withColumn(f"c{k}", F.length(f"c{place}").cast(docs.schema[k].dataType))
    return out.toDF(*names)
