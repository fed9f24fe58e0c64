"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor turns each into
template text: text is escaped, an attachment becomes a placeholder, with its reference and the
number of tokens that it expands to recorded in order. Turns are framed by control strings:

    <|im_start|>role
    content<|im_end|>

Control strings inside texts are escaped by one more backslash between ``<`` and ``|``, and read
back by removing one, so that any text survives. The loss mask lists the spans of the formatted
text that assistants wrote.

A conversation may be longer than a task should hold. Turns are range-partitioned by conversation and
turn and formatted into pieces of bounded size; a conversation is its pieces in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
PIECE_TURNS, PIECE_CHARS = 1024, 1 << 20  # a piece ends after so many turns or characters

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()),
                     T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
                     T.StructField("pages", T.IntegerType())])
PIECES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("piece", T.LongType()),
    T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss", T.ArrayType(T.LongType())), T.StructField("attachments", T.ArrayType(T.StringType())),
    T.StructField("expanded_tokens", T.LongType())])


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on a line of its own, so line ends in it are escaped as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Formatted(NamedTuple):
    text: str
    attachments: list[str]
    tokens: int


class Visitor:
    """One method per type of part; attachments are numbered in the order of the conversation's piece."""

    PATCH, FRAME_SECONDS, PAGE_TOKENS = 28, 0.04, 512  # pixels a token's side, seconds a token, tokens a page

    def __init__(self):
        self.attachments: list[str] = []
        self.tokens = 0

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        side = lambda n: -(-max(1, n or 1) // self.PATCH)
        return self._placeholder("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> str:
        return self._placeholder("audio", part, max(1, round((part.get("seconds") or 0) / self.FRAME_SECONDS)))

    def visit_document(self, part: dict) -> str:
        return self._placeholder("document", part, max(1, part.get("pages") or 1) * self.PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"unknown type of content part: {part.get('type')!r}")

    def _placeholder(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append(f"{kind}:{part.get('ref') or ''}")
        self.tokens += tokens
        return f"<|{kind}_{len(self.attachments)}:{tokens}|>"


PLACEHOLDER = re.compile(r"<\|(image|audio|document)_\d+:\d+\|>")


class Piece:
    """Turns of one conversation, formatted until the piece is full."""

    def __init__(self, conv_id):
        self.conv_id, self.out, self.loss, self.at, self.turns = conv_id, [], [], 0, 0
        self.visitor = Visitor()

    def add(self, role: str, parts: list[dict]) -> None:
        head, content = f"{START}{escape_role(role)}\n", "".join(map(self.visitor.visit, parts))
        if role == "assistant":
            self.loss += [self.at + len(head), self.at + len(head) + len(content)]
        self.out.append(f"{head}{content}{END}\n")
        self.at += len(self.out[-1])
        self.turns += 1

    def full(self) -> bool:
        return self.turns >= PIECE_TURNS or self.at >= PIECE_CHARS


def pieces(turns: DataFrame) -> DataFrame:
    """Formatted pieces of all conversations.

    ``turns`` has conv_id, turn, role and either ``parts`` (an array of PART) or ``text``, which is one text
    part. Turns go by number, equal or missing numbers (first) by role and content; repeated rows are
    turns of their own. A null role is empty, a null text or list of parts is an empty content, a null
    conv_id is a conversation of its own; other columns are left out. ``part`` and ``piece`` order a
    conversation's pieces; ``loss`` has the starts and ends of assistants' contents in ``formatted``.
    """
    lower = {c.lower() for c in turns.columns}
    if "parts" in lower:
        content = F.coalesce(F.col("parts"), F.array().cast(T.ArrayType(PART)))
    else:
        content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"),
                                   *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]])).cast(T.ArrayType(PART))
    rows = turns.select(quoted("conv_id").cast("bigint").alias("conv_id"), quoted("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    order = ["conv_id", "turn", "role", "parts"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        part, number, piece, done = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for conv, role, parts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if piece and (piece.conv_id != conv or piece.full()):
                    done.append((part, number, piece))
                    number, piece = number + 1, None
                piece = piece or Piece(conv)
                piece.add(role, parts)
            if done:
                yield batch(done)
                done = []
        if piece:
            yield batch([(part, number, piece)])

    return rows.mapInArrow(run, PIECES)


def batch(done: list[tuple[int, int, Piece]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
    rows = [(p.conv_id, part, n, p.turns, "".join(p.out), p.loss, p.visitor.attachments, p.visitor.tokens) for part, n, p in done]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=PIECES.names)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and content of each turn, unescaped. Control strings only stand where the template put them."""
    for turn in formatted.split(START)[1:]:
        role, content = turn[:-len(END) - 1].split("\n", 1)
        yield unescape_role(role), unescape(content)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted pieces: n_turns, turns_sha256 (role, line
    end, content, line end per turn), loss_chars and loss_sha256 (all text under the loss mask,
    unescaped), formatted_chars, attachments and expanded_tokens.

    A digest runs over a conversation in order, so one task reads a conversation's pieces; it streams them
    and holds one at a time. Pieces, not turns, are shuffled.
    """
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, n_attachments bigint, expanded_tokens bigint")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now, state = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state:
                        out.append(ended(now, state))
                    now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, content in read_back(r["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(r["loss"][::2], r["loss"][1::2]):
                    text = unescape(r["formatted"][s:e])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(r["formatted"])
                state[5] += len(r["attachments"])
                state[6] += r["expanded_tokens"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)
        if state:
            yield pa.RecordBatch.from_pylist([ended(now, state)], schema=types)

    def ended(conv, state):
        return dict(zip(names, [conv, *[x.hexdigest() if hasattr(x, "hexdigest") else x for x in state]]))

    types = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in schema.split(", ")])
    return rows.mapInArrow(run, schema)
