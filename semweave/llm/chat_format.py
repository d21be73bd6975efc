"""Chat formatting of typed content parts.

A message is a role and its content: a text, or an array of parts
``struct<type, text, ref, width, height, seconds, pages>``. A visitor
(:class:`PartVisitor`) walks the parts in order and flattens them into one
string: text is escaped, an image, audio or document part becomes a
placeholder ``<|image 2|>`` that carries its number in the message, and the
attachment it stands for is recorded with its reference, the place of the
placeholder and the tokens it expands to. A model reading the output sees
one string per message and the table of attachments.

Template of a message: ``<|turn|>role``, a line break, the content,
``<|end|>``, a line break. Every control string begins with ``<|``. Inside
roles and contents a backslash is put before ``<|`` and before every
backslash; in roles a line break becomes ``\\n`` written out. So a control string
inside a text is never a control string of the output, and
:func:`unescape` gives the text back exactly.

The loss mask is a list of spans of code points of the output: the text
parts of assistant messages, without markers and placeholders.

Messages of a conversation are ordered by turn (nulls first), then role,
then text. They are dealt out by ranges of (conversation, turn, role), so a
conversation that holds a third of all rows lies in several neighbouring
partitions; each partition is formatted in one streamed pass, and the
positions in the whole conversation (message number, code points, number of
attachments and tokens before) come from the sums of the partitions before,
a row for the first and last conversation of each. :func:`read_back` reads
the output again: conversations that lie in one partition are digested
there, the messages of the others go on to one task a conversation, which
streams over them (a SHA-256 of a whole conversation is sequential by
definition) and holds one Arrow batch.

Null texts, roles, references and measures are '' and 0; a null parts array
falls back on the text; a part of another or no type that has a text is a
text part, one without is a ``file``. A conversation with a null id is one
conversation of its own. Repeated rows are repeated messages. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from semweave.llm.token_counts import counter

KINDS = ("image", "audio", "document", "file")
CONTROL = re.compile(r"\\(\\|<\||n)|<\|(turn|end|(?:image|audio|document|file) \d+)\|>")
MESSAGE = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*)<\|end\|>\n\Z", re.DOTALL)
PARTS = ("array<struct<type:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>>")
ATTACHED = "array<struct<number:int, kind:string, ref:string, start:bigint, n_tokens:bigint>>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for: tiles of an image, seconds of audio, pages of a document."""

    tile: int = 28
    least_tiles: int = 1
    per_second: float = 12.5
    per_page: int = 512
    per_file: int = 1

    def image(self, width: int, height: int) -> int:
        return max(self.least_tiles, math.ceil(width / self.tile) * math.ceil(height / self.tile))

    def audio(self, seconds: float) -> int:
        return math.ceil(seconds * self.per_second)

    def document(self, pages: int) -> int:
        return pages * self.per_page


def escape(text: str) -> str:
    """``text`` with a backslash before every backslash and every ``<|``."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return text.replace("<|", "\\<|") if "<|" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    """The text behind escaped text (:func:`escape`, :func:`escape_role`)."""
    if "\\" not in text:
        return text
    return CONTROL.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


@dataclass
class PartVisitor:
    """Flattens the parts of one message; ``visit_<type>`` handles a type."""

    expansion: Expansion = field(default_factory=Expansion)
    count: Callable[[str], int] | None = None
    tokens: int = 0
    out: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attached: list[dict] = field(default_factory=list)

    def put(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        if kind not in KINDS:
            kind = "file" if part.get("text") is None and part.get("ref") is not None else "text"
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        start, text = self.length, part.get("text") or ""
        self.put(escape(text))
        self.tokens += self.count(text) if self.count else 0
        if self.length > start:
            self.spans.append((start, self.length))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attached) + 1
        self.attached.append({"number": number, "kind": kind, "ref": part.get("ref") or "", "start": self.length,
                              "n_tokens": tokens})
        self.tokens += tokens
        self.put(f"<|{kind} {number}|>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.expansion.image(part.get("width") or 0, part.get("height") or 0))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.expansion.audio(part.get("seconds") or 0.0))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.expansion.document(part.get("pages") or 0))

    def visit_file(self, part: dict) -> None:
        self.attach("file", part, self.expansion.per_file)


def format_message(role: str | None, parts: list[dict], expansion: Expansion = Expansion(), count=None) -> tuple:
    """``(formatted, loss spans, attachments, expanded tokens)`` of one message."""
    v = PartVisitor(expansion, count)
    v.put("<|turn|>" + escape_role(role or "") + "\n")
    for p in parts:
        v.visit(p or {})
    v.put("<|end|>\n")
    return "".join(v.out), v.spans if role == "assistant" else [], v.attached, v.tokens


def read_message(formatted: str) -> tuple[str, str]:
    """``(role, content)`` of a formatted message, unescaped, placeholders as they stand."""
    m = MESSAGE.match(formatted)
    if m is None:
        raise ValueError("not a formatted message")
    return unescape(m[1]), unescape(m[2])


_MESSAGE = pa.schema([
    ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("lot", pa.int32()), ("at", pa.int64()),
    ("chars", pa.int64()), ("files", pa.int64()), ("tokens", pa.int64()), ("formatted", pa.string()),
    ("n_chars", pa.int64()), ("n_tokens", pa.int64()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                                        ("start", pa.int64()), ("n_tokens", pa.int64())])))])
_MESSAGE_DDL = ("conv long, turn long, role string, lot int, at long, chars long, files long, tokens long, "
                "formatted string, n_chars long, n_tokens long, loss array<struct<start:bigint, end:bigint>>, "
                f"attachments {ATTACHED}")
KEPT_ROWS = 4096  # messages of an output batch, and about KEPT_CHARS at most
KEPT_CHARS = 16_000_000


def _format_partition(expansion: Expansion, model_file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = counter(model_file).count if model_file else None
        lot = TaskContext.get().partitionId()
        now, at, chars, files, tokens, held, size = ..., 0, 0, 0, 0, [], 0
        for b in batches:
            convs, turns, roles, texts, parts = (c.to_pylist() for c in b.columns)
            for conv, turn, role, text, content in zip(convs, turns, roles, texts, parts, strict=True):
                if conv != now or now is ...:
                    now, at, chars, files, tokens = conv, 0, 0, 0, 0
                formatted, loss, attached, more = format_message(
                    role, content if content is not None else [{"type": "text", "text": text}], expansion, count)
                held.append({"conv": conv, "turn": turn, "role": role, "lot": lot, "at": at, "chars": chars,
                             "files": files, "tokens": tokens, "formatted": formatted, "n_chars": len(formatted),
                             "n_tokens": more, "loss": [{"start": s, "end": e} for s, e in loss],
                             "attachments": attached})
                at, chars, files, tokens = at + 1, chars + len(formatted), files + len(attached), tokens + more
                size += len(formatted)
                if len(held) >= KEPT_ROWS or size >= KEPT_CHARS:
                    yield pa.RecordBatch.from_pylist(held, _MESSAGE)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _MESSAGE)
    return run


def format_conversations(messages: DataFrame, parts_col: str | None = None, expansion: Expansion = Expansion(),
                         model_file: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One formatted message a row, with its place in the conversation's output.

    ``(conv, turn, role, formatted, at, start, n_chars, first_file,
    first_token, n_tokens, loss, attachments, over)``: ``at`` counts the
    messages of the conversation from 0 and ``start`` its code points; the
    conversation's output is the messages' ``formatted`` one after another.
    ``loss`` and ``attachments.start`` are positions in ``formatted``;
    ``n_tokens`` are the tokens of the attachments and, with a ``model_file``
    of a piece vocabulary, of the text parts. ``first_file`` is the number of
    attachments and ``first_token`` the number of tokens before the message.
    Rows lie in order inside a partition; ``over`` marks the conversations
    that lie in more than one.
    """
    spark = messages.sparkSession
    parts = F.col(parts_col).cast(PARTS) if parts_col else F.lit(None).cast(PARTS)
    slim = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                           F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), parts.alias("parts"))
    # a fixed number of partitions, so that both readers of the exchange number them alike
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role"]
    dealt = slim.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    rows = dealt.mapInArrow(_format_partition(expansion, model_file), _MESSAGE_DDL)
    # what each partition adds to a conversation that goes on in the next: at most two rows a partition matter
    ends = rows.groupBy("conv", "lot").agg(
        F.max(F.col("at") + 1).alias("s_at"), F.max(F.col("chars") + F.col("n_chars")).alias("s_chars"),
        F.max(F.col("files") + F.size("attachments")).alias("s_files"),
        F.max(F.col("tokens") + F.col("n_tokens")).alias("s_tokens"))
    several = F.count(F.lit(1)).over(W.partitionBy("conv"))
    before = W.partitionBy("conv").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("lots", several).where("lots > 1").select(
        F.col("conv").alias("c1"), F.col("lot").alias("l1"),
        *(F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in ("at", "chars", "files", "tokens")))
    j = rows.join(F.broadcast(carried), rows["conv"].eqNullSafe(carried["c1"]) & (rows["lot"] == carried["l1"]), "left")

    def place(c: str, name: str):
        return (F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).cast("long").alias(name)

    return j.select("conv", "turn", "role", "formatted", place("at", "at"), place("chars", "start"), "n_chars",
                    place("files", "first_file"), place("tokens", "first_token"), "n_tokens", "loss", "attachments",
                    F.col("l1").isNotNull().alias("over"))


class _Reader:
    """Digests of one conversation, message by message."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        role, content = read_message(formatted)
        self.turns.update(f"{role}\n{content}\n".encode())
        for s in spans:
            text = unescape(formatted[s["start"]:s["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.n, self.chars = self.n + 1, self.chars + len(formatted)

    def row(self) -> dict:
        return {"conv": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_READ = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                   ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                   ("at", pa.int64()), ("formatted", pa.string()), ("loss", _MESSAGE.field("loss").type)])
_READ_DDL = ("conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
             "at long, formatted string, loss array<struct<start:bigint, end:bigint>>")


def _read_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the conversations inside the partition; pass on the messages of those that reach over its ends."""
    reader, held, size = None, [], 0
    for b in batches:
        convs, ats, formatted, loss, open_ = (c.to_pylist() for c in b.columns)
        for conv, at, text, spans, over in zip(convs, ats, formatted, loss, open_, strict=True):
            if over:
                held.append({"conv": conv, "at": at, "formatted": text, "loss": spans})
                size += len(text)
            else:
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        held.append(reader.row())
                    reader = _Reader(conv)
                reader.add(text, spans)
            if len(held) >= KEPT_ROWS or size >= KEPT_CHARS:
                yield pa.RecordBatch.from_pylist(held, _READ)
                held, size = [], 0
    if reader is not None:
        held.append(reader.row())
    if held:
        yield pa.RecordBatch.from_pylist(held, _READ)


def _read_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows as they are; messages, in order, into a row per conversation."""
    reader = None
    names = [f.name for f in _READ][:6]
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["at"] is None:
                out.append({k: r[k] for k in names})
                continue
            if reader is None or reader.conv != r["conv"]:
                if reader is not None:
                    out.append(reader.row())
                reader = _Reader(r["conv"])
            reader.add(r["formatted"], r["loss"])
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(_READ)[:6]))
    if reader is not None:
        yield pa.RecordBatch.from_pylist([reader.row()], pa.schema(list(_READ)[:6]))


def read_back(formatted: DataFrame, in_place: bool = False) -> DataFrame:
    """``(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of formatted conversations.

    Reads the output of :func:`format_conversations`: roles and contents are
    parsed and unescaped from ``formatted``, the loss text is cut out by the
    spans. ``in_place`` is for that DataFrame itself, whose partitions hold
    whole conversations but for the rows marked ``over``: only those are
    shuffled. Without it (a table that was stored) all messages are.
    """
    over = F.col("over") if in_place else F.lit(True)
    first = formatted.select("conv", "at", "formatted", "loss", over.alias("over")).mapInArrow(_read_partition, _READ_DDL)
    rest = first.repartition("conv").sortWithinPartitions("conv", F.col("at").asc_nulls_first())
    return rest.mapInArrow(_read_rest, _READ_DDL.split(", at long")[0])


#: The conversation that the query adds: its texts hold the backslash and strings that look like markers.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests, read back from the output, of all conversations and of the planted one."""
    planted = conversations.sparkSession.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_conversations(rows), in_place=True).withColumnRenamed("conv", "conv_id")


#: DuckDB: the digests from the rows themselves, the length from the template.
CHAT_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '\<|'), chr(10), '\n') AS r,
             replace(replace(text, '\', '\\'), '<|', '\<|') AS t FROM m),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             cast(sum(length('<|turn|>' || r || chr(10) || t || '<|end|>' || chr(10))) AS bigint) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, cast(length(loss) AS bigint) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
