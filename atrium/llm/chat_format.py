"""Chat formatting: turns with typed content parts become marked text with a loss mask.

A visitor flattens the parts of a turn in order. Text is escaped, so that no control string of
the template can come from a text; images, audio and documents leave a numbered placeholder and
an attachment record with the tokens that it expands to. The output is one piece of formatted text
for each turn, so a conversation of any length is never held as a whole; its formatted text
is its pieces in order.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEADER = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash before every backslash and inside every ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class ChatConfig:
    """Roles whose text is learnt, and what one attachment expands to in tokens."""

    loss_roles: tuple[str, ...] = ("assistant",)
    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 800


def _measure(value: float | None) -> float:
    return value if value is not None and 0 < value < math.inf else 0


@dataclass
class PartVisitor:
    """Flattens typed parts; ``visit`` dispatches on the part's type.

    A null part leaves nothing. A null, negative or not finite measure counts as none, so that an attachment is at least one
    token. A type without a method of its own is an attachment of kind ``other``, one token.
    """

    config: ChatConfig
    before: int = 0  # attachments of earlier turns, which their numbers go on from
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)  # kind, reference, tokens, offset

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        patch = self.config.image_patch
        sides = [_measure(part.get(side)) or patch for side in ("width", "height")]
        self._attach("image", part, max(1, math.ceil(sides[0] / patch) * math.ceil(sides[1] / patch)))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil(_measure(part.get("seconds")) * self.config.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, _measure(part.get("pages"))) * self.config.document_tokens_per_page)

    def visit_unknown(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        offset = sum(map(len, self.pieces))
        self.attachments.append((kind, part.get("ref") or "", tokens, offset))
        self.pieces.append(f"<|{kind}_{self.before + len(self.attachments)}|>")


def format_turn(role: str, parts: list[dict], config: ChatConfig, before: int = 0) -> tuple[str, list[tuple[int, int]], list[tuple]]:
    """Formatted piece, its spans under the loss mask (start, length), and its attachments, numbered after ``before`` others."""
    visitor = PartVisitor(config, before)
    for part in parts:
        visitor.visit(part)
    head = f"{_OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = "".join(visitor.pieces)
    spans = [(len(head), len(body))] if role in config.loss_roles else []
    return f"{head}{body}{_CLOSE}\n", spans, [(k, r, t, len(head) + o) for k, r, t, o in visitor.attachments]


_TURNS = (
    "conv_id long, turn long, tie string, piece string, loss array<struct<start:int,length:int>>, "
    "attachments array<struct<kind:string,ref:string,tokens:int,offset:int>>"
)
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32()), ("offset", pa.int32())]))


def format_turns(conversations: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """Format every turn: ``conv_id, turn, tie, piece, loss, attachments``.

    Reads ``conv_id, turn, role, text`` and, where present, ``parts`` (array of structs with ``type``
    and any of ``text, ref, width, height, seconds, pages``); a turn with null parts has its text as the only
    one. Null roles and texts are empty ones; ``PartVisitor`` says what odd parts give. Rows of equal ``conv_id`` and ``turn`` all stay; ``tie`` puts
    them in order (by role, then text). Attachments are numbered through the conversation in that order. Other columns are
    ignored; an empty table gives an empty result.
    """
    parts = F.col("parts") if "parts" in conversations.columns else F.lit(None).cast("array<struct<type:string,text:string>>")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), parts.alias("parts"))
    if "parts" in conversations.columns:
        attached = F.coalesce(F.size(F.filter("parts", lambda p: p.isNotNull() & (F.coalesce(F.nullif(p["type"], F.lit("")), F.lit("text")) != "text"))), F.lit(0))
        earlier = Window.partitionBy("conv_id").orderBy("turn", "role", F.sha2("text", 256)).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.coalesce(F.sum(attached).over(earlier), F.lit(0)))
    else:
        rows = rows.withColumn("before", F.lit(0))

    def run(batches):
        for batch in batches:
            formatted, ties = [], []
            for role, text, parts, before in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                formatted.append(format_turn(role, [{"type": "text", "text": text}] if parts is None else parts, config, before))
                ties.append(f"{role}\x00{hashlib.sha256(text.encode()).hexdigest()}")
            pieces, loss, attached = zip(*formatted) if formatted else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(ties, pa.string()), pa.array(pieces, pa.string()),
                    pa.array([[{"start": s, "length": n} for s, n in x] for x in loss], _LOSS),
                    pa.array([[dict(zip(("kind", "ref", "tokens", "offset"), a)) for a in x] for x in attached], _ATTACHED),
                ],
                ["conv_id", "turn", "tie", "piece", "loss", "attachments"],
            )

    return rows.mapInArrow(run, _TURNS)


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted piece."""
    head = _HEADER.match(piece)
    return unescape(head[1]), unescape(piece[head.end() : -len(_CLOSE) - 1])


def parse_parts(piece: str, attachments: list[tuple[str, str, int, int]]) -> list[dict]:
    """Typed parts of a formatted piece: its texts, and where a record (kind, reference, tokens, offset) points, that attachment."""
    head = _HEADER.match(piece)
    at, end, out = head.end(), len(piece) - len(_CLOSE) - 1, []
    for kind, ref, tokens, offset in sorted(attachments, key=lambda a: a[3]):
        if offset > at:
            out.append({"type": "text", "text": unescape(piece[at:offset])})
        out.append({"type": kind, "ref": ref, "tokens": tokens})
        at = piece.index("|>", offset) + 2
    if at < end:
        out.append({"type": "text", "text": unescape(piece[at:end])})
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation as parsed from its formatted pieces.

    ``conv_id, n_turns, turns_sha256`` (role, line feed, text, line feed for each turn),
    ``loss_chars, loss_sha256`` (the unescaped text under the loss mask) and ``formatted_chars``. Pieces are
    hashed as they stream by in order of turn; a long conversation is not collected. Rows with a null conv_id are
    one conversation of their own.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")

    def run(batches):
        current, state, out = None, None, []

        def close():
            turns, whole, chars, loss, total = state
            return (current[0], turns, whole.hexdigest(), chars, loss.hexdigest(), total)

        for batch in batches:
            for conv, piece, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "piece", "loss"))):
                if current is None or current[0] != conv:
                    if current is not None:
                        out.append(close())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    learnt = unescape(piece[span["start"] : span["start"] + span["length"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(piece)
            if len(out) >= 1000:
                yield _digests(out)
                out = []
        if current is not None:
            out.append(close())
        yield _digests(out)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
