"""Chat formatting of typed content parts, with a loss mask.

A message's content is an array of parts (text, image, audio, document).  A visitor
turns each part into template text: text is escaped, every other kind becomes a
numbered placeholder, an attachment record and an expanded token count.  A turn is

    [INST:role] body [/INST]</s>

with line ends as shown in `turn_text`.  Control strings and placeholders start
with `[` or `<`; in texts these, and the backslash itself, get a backslash before
them, so that reading back is exact.  Spans of assistant bodies form the loss mask.

Only the order within a conversation needs a shuffle: rows are dealt by
conversation, sorted by turn, and streamed, so a long conversation is never held
as a list of rows; its formatted text, an output, is.

Defined results: NULL text or content is an empty body; a NULL role is the empty
role; rows of the same turn are ordered by role, then text; repeated rows are turns
of their own; NULL conversation ids form one conversation, ids keep their type; unknown kinds of part
become placeholders with no tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

OPEN, CLOSE = "[INST:", "[/INST]</s>\n"
ESCAPE = "\\"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder stands for: image tiles of `tile` pixels and one overview, audio seconds, pages."""

    tile: int = 512
    tile_tokens: int = 170
    image_tokens: int = 85
    audio_tokens_per_second: float = 12.5
    page_tokens: int = 600


def escape(text: str) -> str:
    """`[` and `<` start every control string; a backslash before them, and before itself, is the escape."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("[", ESCAPE + "[").replace("<", ESCAPE + "<")


def unescape(text: str) -> str:
    out, at = [], 0
    while (k := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:k])
        out.append(text[k + 1 : k + 2])
        at = k + 2
    return "".join(out) + text[at:]


def escape_column(c: Column) -> Column:
    for mark in (ESCAPE, "[", "<"):
        c = F.replace(c, F.lit(mark), F.lit(ESCAPE + mark))
    return c


def placeholder(kind: str, n: int) -> str:
    return f"[{kind}:{n}]"


class Visitor:
    """Flattens the parts of a conversation's messages in order."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['kind']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part: dict) -> str:
        c = self.costs
        tiles = -(-(part["width"] or 0) // c.tile) * -(-(part["height"] or 0) // c.tile)
        return self._attach(part, c.image_tokens + tiles * c.tile_tokens)

    def visit_audio(self, part: dict) -> str:
        return self._attach(part, int(-(-(part["seconds"] or 0) * self.costs.audio_tokens_per_second // 1)))

    def visit_document(self, part: dict) -> str:
        return self._attach(part, (part["pages"] or 0) * self.costs.page_tokens)

    def visit_other(self, part: dict) -> str:
        return self._attach(part, 0)

    def _attach(self, part: dict, tokens: int) -> str:
        n = len(self.attachments)
        kind = "".join(x for x in part["kind"] or "other" if x.isalnum()) or "other"
        self.attachments.append({"n": n, "kind": kind, "ref": part["ref"], "tokens": tokens})
        return placeholder(kind, n)


def turn_text(role: str, body: str) -> tuple[str, int]:
    """The turn, and where its body begins in it."""
    head = OPEN + escape(role).replace("]", ESCAPE + "]") + "]\n"
    return head + body + CLOSE, len(head)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, body (still escaped), and the body's place, of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        k = at + len(OPEN)
        while formatted[k] != "]" or _escaped(formatted, k):
            k += 1
        body = k + 2
        end = formatted.index(CLOSE, body)
        while _escaped(formatted, end):
            end = formatted.index(CLOSE, end + 1)
        turns.append((unescape(formatted[at + len(OPEN) : k]), formatted[body:end], body, end))
        at = end + len(CLOSE)
    return turns


def _escaped(text: str, at: int) -> bool:
    n = 0
    while at - n > 0 and text[at - n - 1] == ESCAPE:
        n += 1
    return n % 2 == 1


def text_parts(text: Column) -> Column:
    """A plain text as content: one text part."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"))).cast(f"array<{PART}>")


FORMATTED = "formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<n:int,kind:string,ref:string,tokens:long>>, attached_tokens long"


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), costs: Costs = Costs()) -> DataFrame:
    """messages: conv_id, turn, role, content (array of PART).  One row a conversation.

    loss: spans of code points in `formatted`, the bodies of `loss_roles`.
    """

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("attached_tokens", pa.int64())]
        now, turns, loss, length, visitor, started, ready = None, [], [], 0, Visitor(costs), False, []

        def done() -> dict:
            return {"conv_id": now, "formatted": "".join(turns), "loss": loss, "attachments": visitor.attachments, "attached_tokens": sum(a["tokens"] for a in visitor.attachments)}

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *fields])
            for conv, role, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if started and conv != now:
                    ready.append(done())
                    turns, loss, length, visitor = [], [], 0, Visitor(costs)
                now, started = conv, True
                body = "".join(visitor.visit(p) for p in content or () if p)
                text, at = turn_text(role or "", body)
                if role in loss_roles:
                    loss.append({"start": length + at, "end": length + at + len(body)})
                turns.append(text)
                length += len(text)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if started:
            yield pa.RecordBatch.from_pylist([*ready, done()], schema)

    order = ["conv_id", "turn", "role", F.to_json("content")]
    dealt = messages.select("conv_id", "turn", "role", "content").repartition("conv_id").sortWithinPartitions(*order)
    schema = StructType([StructField("conv_id", messages.schema["conv_id"].dataType), *StructType.fromDDL(FORMATTED).fields])
    return dealt.select("conv_id", "role", "content").mapInArrow(formatted, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text and mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns, masked = hashlib.sha256(), hashlib.sha256()
                n = chars = 0
                for role, body, _, _ in read_back(text):
                    turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in loss:
                    under = unescape(text[span["start"] : span["end"]])
                    masked.update(under.encode("utf-8", "surrogatepass"))
                    chars += len(under)
                rows.append((conv, n, turns.hexdigest(), chars, masked.hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    schema = StructType([StructField("conv_id", formatted.schema["conv_id"].dataType), *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(read, schema)
