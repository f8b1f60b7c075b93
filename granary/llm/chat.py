"""Chat formatting of typed content parts.

Every turn is formatted by itself, so no shuffle is needed: <|im_start|>role, a line break, the content, <|im_end|>, a
line break. A visitor flattens the parts of a turn in order: text stays, an image, audio or document part becomes a
placeholder, and its reference and token count are recorded with the placeholder's place. Control strings inside texts
are escaped by a backslash between < and |, and one more where backslashes stand there already. Neighbouring texts are
escaped as one, as a control string may be spread over them; so no text can hold one, and every run of texts can be had
back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholders by type of part.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_PLACEHOLDER = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))

PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"
TURN_SCHEMA = "conv_id long, turn long, formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<place:int,type:string,ref:string,n_tokens:int>>, expanded_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


class PartVisitor:
    """Flattens the typed parts of one turn into text, places of attachments and spans of runs of texts."""

    def __init__(self, at: int):
        self.at, self.out, self.attachments, self.texts, self.expanded = at, [], [], [], 0
        self.run: list[str] = []  # texts with no attachment between them

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def end_run(self) -> None:
        if self.run:
            start = self.at
            self._add(escape("".join(self.run)))
            self.texts.append((start, self.at))
            self.run = []

    def visit_text(self, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def _attach(self, part: dict) -> None:
        self.end_run()
        n = part.get("n_tokens") or 0
        self.attachments.append({"place": self.at, "type": part["type"], "ref": part.get("ref"), "n_tokens": n})
        self.expanded += n
        self._add(PLACEHOLDERS[part["type"]])

    visit_image = visit_audio = visit_document = _attach

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"no such type of part: {part['type']}")


def format_turn(role: str | None, parts: list[dict] | None, loss_roles: tuple[str, ...] = ("assistant",)) -> dict:
    head = f"{START}{escape_role(role or '')}\n"
    visitor = PartVisitor(len(head))
    for part in parts or []:
        visitor.visit(part or {})
    visitor.end_run()
    loss = [{"start": a, "end": b} for a, b in visitor.texts] if role in loss_roles else []
    return {"formatted": head + "".join(visitor.out) + END + "\n", "loss": loss, "attachments": visitor.attachments, "expanded_tokens": visitor.expanded}


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """A row for each turn: conv_id, turn, formatted, loss (spans of assistants' text in code points, one for each run of
    neighbouring texts), attachments (place of the placeholder, type, ref, n_tokens) and expanded_tokens (their sum).

    A conversation's text is its rows' in ascending turn. Null roles count as empty, null parts and null texts as empty
    texts, null counts as 0; an unknown type of part is an error; repeated turns are formatted each; an empty table
    gives no rows; other columns are not read.
    """
    schema = T.StructType.fromDDL(TURN_SCHEMA)
    arrow = pa.schema([("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int32())]))), ("expanded_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [format_turn(r, p) for r, p in zip(b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *out.columns], names=schema.names)

    return df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).cast(PARTS).alias("parts")).mapInArrow(run, schema)


def text_parts(text_col: str = "text"):
    """A column of one text part for each text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def parse(formatted: str) -> list[tuple[str, list[str]]]:
    """(role, contents) of the turns in formatted text; contents are texts and placeholders by turns."""
    out = []
    for role, body in _TURN.findall(formatted):
        at, content = 0, []
        for m in _PLACEHOLDER.finditer(body):
            content += [unescape(body[at : m.start()]), m[0]]
            at = m.end()
        out.append((unescape_role(role), [*content, unescape(body[at:])]))
    return out


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from what format_chat() returns.

    Turns are sorted within partitions and hashed as they stream by, so no conversation is held in memory. Equal turn
    numbers go by their formatted text; null turns come first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now: list | None = None

        def digest(x: list) -> dict:
            return {"conv_id": x[0], "n_turns": x[1], "turns_sha256": x[2].hexdigest(), "loss_chars": x[3], "loss_sha256": x[4].hexdigest(), "formatted_chars": x[5]}

        for b in batches:
            done = []
            for conv, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if now is None or now[0] != conv:
                    done += [digest(now)] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{''.join(content)}\n".encode())
                for span in loss:
                    part = unescape(text[span["start"] : span["end"]])
                    now[3] += len(part)
                    now[4].update(part.encode())
                now[5] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([digest(now)], schema=schema)

    return formatted.select("conv_id", "turn", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, DIGEST_SCHEMA)
