"""Chat formatting: turns with typed parts as template text, with a mask of what to learn and the attachments in order.

A turn's content is a list of parts: text, image, audio, document. A visitor flattens them into text with a
placeholder for each attachment, and records its reference, its place and how many tokens it expands to. The template is

    <turn ROLE>content</turn>\\n

Inside texts a backslash precedes every backslash and every control string, inside roles every backslash and ``>``; so
``read`` gets roles, texts and attachments back whatever they hold. Texts that follow one another are one text. The mask covers an
assistant's texts, not its placeholders.

Each turn is formatted by itself, in parallel; a conversation is its turns' pieces in order, which ``digests`` reads as they stream
by and ``whole`` puts into one row. Null roles, texts and contents are empty, a null conversation is one of its own. Turns of one number
are ordered by role and piece; null turns come first; repeated rows stay. Texts of any length are formatted whole. An empty table gives an
empty table. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, quoted

#: Pixels of an image patch (a token each), tokens of a second of audio and of a page of a document.
PATCH, PER_SECOND, PER_PAGE = 32, 25, 256
BEGIN, END = "<turn ", "</turn>"
KINDS = ("image", "audio", "document")
_CONTROL = r"<turn |</turn>|<\|(?:image|audio|document)\|>"
_ESCAPED = re.compile(rf"\\|{_CONTROL}")
_TOKEN = re.compile(rf"\\.|{_CONTROL}", re.DOTALL)
_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>", re.DOTALL)
LEARNED = "assistant"


@dataclass(frozen=True)
class Text:
    text: str = ""

    def accept(self, visitor: Any) -> None:
        visitor.visit_text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: Any) -> None:
        visitor.visit_image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0

    def accept(self, visitor: Any) -> None:
        visitor.visit_audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0

    def accept(self, visitor: Any) -> None:
        visitor.visit_document(self)


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Flattener:
    """Visits the parts of a turn in order: pieces of text and placeholders, spans of texts, attachments with their tokens."""

    at: int = 0
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)
    open: list[str] = field(default_factory=list)

    def visit_text(self, part: Text) -> None:
        self.open.append(part.text)

    def visit_image(self, part: Image) -> None:
        self._attach("image", part.ref, ceil((part.width or 0) / PATCH) * ceil((part.height or 0) / PATCH))

    def visit_audio(self, part: Audio) -> None:
        self._attach("audio", part.ref, ceil((part.seconds or 0) * PER_SECOND))

    def visit_document(self, part: Document) -> None:
        self._attach("document", part.ref, (part.pages or 0) * PER_PAGE)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.close()
        self.attachments.append((kind, ref, self.at, max(1, tokens)))
        self._put(f"<|{kind}|>")

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def close(self) -> None:
        """Texts that follow one another are escaped together: a control string may begin in one and end in the next."""
        if self.open:
            text = escaped("".join(self.open))
            self.spans.append((self.at, self.at + len(text)))
            self._put(text)
            self.open = []


def formatted(role: str, parts: list[Any]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int, int]]]:
    """A turn's piece, the spans of it that are learned, and its attachments (kind, reference, place in the piece, tokens)."""
    head = BEGIN + re.sub(r"[\\>]", lambda m: "\\" + m[0], role) + ">"
    visitor = Flattener(at=len(head), pieces=[head])
    for part in parts:
        part.accept(visitor)
    visitor.close()
    return "".join([*visitor.pieces, END, "\n"]), visitor.spans if role == LEARNED else [], visitor.attachments


def read(text: str) -> Iterator[tuple[str, list[str], list[str]]]:
    """(role, texts, kinds of attachments) of each turn of formatted text."""
    at = 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if head is None:
            raise ValueError(f"no turn begins at {at}")
        texts, kinds, since = [], [], head.end()
        for m in _TOKEN.finditer(text, head.end()):
            if m[0][0] == "\\":
                continue
            if m.start() > since:
                texts.append(unescaped(text[since : m.start()]))
            since = m.end()
            if m[0] == END:
                break
            if m[0] == BEGIN:
                raise ValueError(f"a turn begins within another at {m.start()}")
            kinds.append(m[0][2:-2])
        else:
            raise ValueError(f"the turn at {at} has no end")
        if text[since : since + 1] != "\n":
            raise ValueError(f"the turn at {at} has no end of line")
        yield unescaped(head[1]), texts, kinds
        at = since + 1


# -- over tables ---------------------------------------------------------------------------------------------------

#: A column of typed parts, and what formatting gives.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PIECES = "formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,place:long,tokens:long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))


def typed(parts: list[dict] | str | None) -> list[Any]:
    """Parts of a row; a plain string is one text. Unknown kinds are an error."""
    if parts is None or isinstance(parts, str):
        return [Text(parts or "")]
    make = {"text": lambda p: Text(p["text"] or ""), "image": lambda p: Image(p["ref"] or "", p["width"], p["height"]), "audio": lambda p: Audio(p["ref"] or "", p["seconds"]), "document": lambda p: Document(p["ref"] or "", p["pages"])}
    return [make[p["kind"]](p) for p in parts if p is not None]


def pieces(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(conv_id, turn, role, formatted, loss, attachments) of each turn; ``content`` is a string or a list of PARTS."""
    rows = turns.select(quoted(conv_id).alias("conv_id"), quoted(turn).alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"), quoted(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [formatted(r, typed(c)) for r, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            loss = pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in done], _LOSS)
            attached = pa.array([[{"kind": k, "ref": r, "place": p, "tokens": t} for k, r, p, t in x[2]] for x in done], _ATTACHED)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in done], pa.string()), loss, attached], ["conv_id", "turn", "role", "formatted", "loss", "attachments"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return map_batches(rows, run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, {PIECES}")


def whole(made: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, attachments): the pieces of each conversation in one row, for conversations that fit in one."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted", "loss", "attachments")))
    start = lambda x, i: F.aggregate(F.slice(x, 1, i), F.lit(0).cast("long"), lambda n, y: n + F.length(y["formatted"]))
    rows = made.groupBy("conv_id").agg(turns.alias("x"))
    moved = F.transform("x", lambda y, i: F.transform(y["loss"], lambda s: F.struct((s["start"] + start(F.col("x"), i)).alias("start"), (s["end"] + start(F.col("x"), i)).alias("end"))))
    attached = F.transform("x", lambda y, i: F.transform(y["attachments"], lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), (a["place"] + start(F.col("x"), i)).alias("place"), a["tokens"].alias("tokens"))))
    return rows.select("conv_id", F.array_join(F.col("x.formatted"), "").alias("formatted"), F.flatten(moved).alias("loss"), F.flatten(attached).alias("attachments"))


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from its pieces: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, n_expanded.

    Pieces are sorted by conversation and stream by; a task holds a batch of them.
    """
    kind = made.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("formatted").asc()]
    tokens = F.aggregate(F.col("attachments.tokens"), F.lit(0).cast("long"), lambda n, t: n + t)
    rows = made.select("conv_id", "turn", "role", "formatted", "loss", F.size("attachments").cast("long").alias("attached"), tokens.alias("tokens"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "loss", "attached", "tokens")
    return map_batches(rows, _digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_expanded long")


@dataclass
class _Read:
    """What is read of one conversation so far."""

    conv_id: Any
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    attached: int = 0
    tokens: int = 0
    all: Any = field(default_factory=hashlib.sha256)
    loss: Any = field(default_factory=hashlib.sha256)

    def take(self, piece: str, loss: list[dict]) -> None:
        for role, texts, _ in read(piece):
            self.turns += 1
            self.all.update(f"{role}\n{''.join(texts)}\n".encode())
        for span in loss:
            text = unescaped(piece[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attached, self.tokens


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_expanded"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    now, kind = None, None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv, piece, loss, attached, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.row())
                now = _Read(conv)
            now.take(piece, loss)
            now.attached += attached
            now.tokens += tokens
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [kind, *types], strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), [kind, *types], strict=True)], names)


#: What the template must keep of each conversation, and how long its pieces are.
SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) planted(i, r)),
long_ AS (SELECT *, length(regexp_replace(text, '(\\|<turn |</turn>|<\|(image|audio|document)\|>)', '\\\1', 'g')) + length(regexp_replace(role, '([\\>])', '\\\1', 'g')) + 15 AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS n_expanded FROM long_ GROUP BY conv_id
"""
