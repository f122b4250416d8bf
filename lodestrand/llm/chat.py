"""Chat formatting: typed content parts.

A message is an ordered list of parts: text, image, audio or document. A visitor flattens the parts of each message
into text: a text part stands as it is, any other part becomes a placeholder, repeated as often as the part will
expand to tokens, and leaves a reference (kind, uri, place, token count) behind. The template writes each message as

    <s>[ROLE role]\\n text </s>\\n

where every control character sequence inside a text or role is escaped so that it cannot end a turn, begin one or
pass for a placeholder, and so that reading back restores the text exactly. The loss mask is a list of spans over the
formatted string that cover the text of assistant messages and nothing else.

Conversations are formatted by a stream over rows sorted by conversation and turn, so a task holds the turns of one
conversation at a time. Null text is empty, a null role is an empty role; a row without a conversation id is a
conversation of its own; ties of turn are ordered by role and text, and repeated rows are turns of their own. Null
parts are left out, a part without a kind is text, one of a kind without a visitor becomes the placeholder `other`,
and sizes that are null or NaN are 0 (a placeholder stands once at least). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deals

OPEN, NAMED, CLOSE = "<s>[ROLE ", "]\n", "</s>\n"
#: The escape character and what stands for it; control strings all hold one of the marked characters.
ESCAPE = "\\"
#: Characters that begin or end a control string, this template's and those of other common templates.
MARKED = "<>[]|" + ESCAPE
_ESCAPED = re.compile("[" + re.escape(MARKED) + "]")
_CODES = {c: f"{ESCAPE}{i}" for i, c in enumerate(MARKED)}
_BACK = {code: c for c, code in _CODES.items()}


def escape(text: str) -> str:
    """The text without any character that a control string needs."""
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(re.escape(ESCAPE) + "[0-9]", lambda m: _BACK[m[0]], text)


@dataclass(frozen=True)
class Part:
    """Content of one type. text parts have text; the others a uri and a size in their own unit."""

    kind: str
    text: str = ""
    uri: str = ""
    width: int = 0
    height: int = 0
    seconds: float = 0.0
    pages: int = 0


@dataclass
class Flattener:
    """Visits parts in order; visit_<kind> appends to the output and records attachments.

    image: a token for each patch of patch x patch pixels; audio: tokens a second; document: tokens a page.
    """

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: Part) -> None:
        visitor = getattr(self, f"visit_{part.kind}", None)
        if visitor is None:
            raise ValueError(f"unknown content type {part.kind!r}")
        visitor(part)

    def visit_text(self, part: Part) -> None:
        self.out.append(escape(part.text))

    def visit_image(self, part: Part) -> None:
        self._attach(part, -(-part.width // self.patch) * -(-part.height // self.patch))

    def visit_audio(self, part: Part) -> None:
        self._attach(part, round(part.seconds * self.per_second))

    def visit_document(self, part: Part) -> None:
        self._attach(part, part.pages * self.per_page)

    def visit_other(self, part: Part) -> None:
        self._attach(part, 1)

    def _attach(self, part: Part, tokens: int) -> None:
        tokens = max(1, tokens)
        self.attachments.append({"index": len(self.attachments), "kind": part.kind, "uri": part.uri, "tokens": tokens})
        self.out.append(f"<|{part.kind}|>" * tokens)


@dataclass
class Formatted:
    """A formatted conversation: its text, the loss spans and the attachments in order."""

    text: str
    loss: list[tuple[int, int]]
    attachments: list[dict]


def format_turns(turns: Iterable[tuple[str, list[Part]]], learn: tuple[str, ...] = ("assistant",)) -> Formatted:
    """Format (role, parts) messages; loss spans cover the content of messages whose role is in learn."""
    out, loss, at, attachments = [], [], 0, []
    for role, parts in turns:
        visitor = Flattener(attachments=attachments)
        for part in parts:
            visitor.visit(part)
        head, body = f"{OPEN}{escape(role)}{NAMED}", "".join(visitor.out)
        if role in learn:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return Formatted("".join(out), loss, attachments)


_PLACEHOLDERS = re.compile(r"(?:<\|(?:image|audio|document|other)\|>)+")


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Read (role, text) messages back from a formatted conversation; placeholders are left out."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no message begins at {at}")
        named = text.index(NAMED, at)
        end = text.index(CLOSE, named)
        yield unescape(text[at + len(OPEN) : named]), unescape(_PLACEHOLDERS.sub("", text[named + len(NAMED) : end]))
        at = end + len(CLOSE)


def part_of(content: dict) -> Part:
    """A part from a row of typed content: a null kind is text, a kind without a visitor is `other`, null sizes are 0."""
    known = {k: v for k, v in content.items() if v is not None and v == v}  # NaN is no size
    kind = known.pop("kind", "text")
    return Part(kind if hasattr(Flattener, f"visit_{kind}") else "other", **known)


CONTENT = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>, attachments array<struct<index:int,kind:string,uri:string,tokens:int>>"


def format_conversations(rows: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss spans and attachments of every conversation.

    rows: conv_id, turn, role and text, or content (an array of typed parts, see CONTENT) in the place of text.
    """
    if "content" in rows.columns:
        content = F.col("content").cast(CONTENT)
    else:
        text = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        content = F.array(text).cast("array<struct<kind:string,text:string>>")
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), content.alias("content"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.to_json("content")]
    # Rows without an id are conversations of their own, so they are dealt by what they say.
    deal = F.coalesce(F.xxhash64(F.when(F.col("conv_id").isNotNull(), F.col("conv_id"))), F.lit(0)) + F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", F.to_json("content"))).otherwise(0)
    sorted_turns = turns.repartition(deals(turns.select(F.to_json("content").alias("said")), "said"), deal).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[Part]]] = []
        own = None
        schema = pa.schema(
            [
                ("conv_id", pa.int64()),
                ("n_turns", pa.int64()),
                ("formatted", pa.string()),
                ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ("attachments", pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())]))),
            ]
        )

        def done() -> dict:
            made = format_turns(held, learn)
            return {"conv_id": own, "n_turns": len(held), "formatted": made.text, "loss": [{"start": a, "stop": b} for a, b in made.loss], "attachments": made.attachments}

        for batch in batches:
            ready = []
            for key, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "content"))):
                if held and (key is None or key != own):
                    ready.append(done())
                    held = []
                own = key
                held.append((role, [part_of(p) for p in parts or [] if p is not None]))
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
        if held:
            yield pa.RecordBatch.from_pylist([done()], schema)

    return sorted_turns.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings say: turns, and the text under the loss mask, unescaped."""
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                turns, learned, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in loss:
                    said = unescape(_PLACEHOLDERS.sub("", text[span["start"] : span["stop"]]))
                    learned.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(said)
                rows.append((key, n, turns.hexdigest(), chars, learned.hexdigest(), len(text)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in out.split(", ")])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, out)
