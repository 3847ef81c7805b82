"""Chat formatting with typed content parts, escaped control strings and an exact loss mask.

A message's content is a list of parts ``{"type": "text" | "image" | "audio" | "document", ...}``; plain text
is cut into such parts at Markdown images and links to sound and document files. A visitor flattens parts
into text with ordered placeholders; every attachment is recorded with its reference, its number in the
conversation, the tokens it expands to and the markup it stood for, so that reading gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: File endings by which links count as attachments.
AUDIO, DOCUMENTS = ("mp3", "wav", "ogg", "flac", "m4a"), ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx")
_LABEL, _TARGET = r"\[[^\]\[<\x0A]*\]", r"[^()<\x00-\x20]"
#: Markup of each kind of attachment, also for SQL; none of it can hold a control string.
MARKUP = {
    "image": rf"!{_LABEL}\({_TARGET}+\)",
    "audio": rf"{_LABEL}\({_TARGET}*\.(?:{'|'.join(AUDIO)})\)",
    "document": rf"{_LABEL}\({_TARGET}*\.(?:{'|'.join(DOCUMENTS)})\)",
}
_MARKUP = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in MARKUP.items()))
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):([0-9]+)\|>")
#: Control strings look like <|name|>; escaping adds one backslash after "<", and one more to those already escaped.
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """No "<|" is left in the result; ``unescape`` gives the text back."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parts_of(text: str | None) -> list[dict]:
    """Typed parts of plain text; joined in order, the texts and the sources of attachments are the text again."""
    parts, at, text = [], 0, text or ""
    for m in _MARKUP.finditer(text):
        if m.start() > at:
            parts.append({"type": "text", "text": text[at : m.start()]})
        source = m.group()
        parts.append({"type": m.lastgroup, "ref": source[source.index("](") + 2 : -1], "source": source})
        at = m.end()
    if at < len(text):
        parts.append({"type": "text", "text": text[at:]})
    return parts


@dataclass
class Attachment:
    kind: str
    number: int
    reference: str | None
    tokens: int
    turn: int
    source: str | None = None


def _number(value) -> float:
    """A finite count or size, 0 for anything else."""
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value > 0 else 0.0


@dataclass
class PartVisitor:
    """Flattens parts in order; ``visit_<type>`` handles each type, and what is no such part becomes its JSON text.

    Expanded tokens: an image takes one for each started 28 x 28 tile (1 without a size), audio 25 a
    started second, a document its ``tokens`` or one for each 4 started characters of its text; sizes that are no
    numbers count as missing.
    """

    tile: int = 28
    audio_rate: int = 25
    attachments: list[Attachment] = field(default_factory=list)
    turn: int = 0

    def flatten(self, content: str | list | None) -> str:
        """Escaped text of a message; null content is empty."""
        return "".join(self.visit(part) for part in (parts_of(content) if content is None or isinstance(content, str) else content))

    def visit(self, part: dict) -> str:
        method = getattr(self, f"visit_{part.get('type')}", None) if isinstance(part, dict) else None
        return method(part) if method else escape(json.dumps(part, ensure_ascii=False, sort_keys=True))

    def visit_text(self, part: dict) -> str:
        text = part.get("text")
        return escape(text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False, sort_keys=True))

    def visit_image(self, part: dict) -> str:
        width, height = _number(part.get("width")), _number(part.get("height"))
        return self._place("image", part, max(1, math.ceil(width / self.tile) * math.ceil(height / self.tile)))

    def visit_audio(self, part: dict) -> str:
        return self._place("audio", part, max(1, math.ceil(_number(part.get("seconds")) * self.audio_rate)))

    def visit_document(self, part: dict) -> str:
        text = part.get("text")
        by_text = math.ceil(len(text) / 4) if isinstance(text, str) else 0
        return self._place("document", part, max(1, math.ceil(_number(part.get("tokens"))) or by_text))

    def _place(self, kind: str, part: dict, tokens: int) -> str:
        number, ref, source = len(self.attachments), part.get("ref"), part.get("source")
        self.attachments.append(Attachment(kind, number, ref if ref is None else str(ref), tokens, self.turn, source if isinstance(source, str) else None))
        return f"<|{kind}:{number}|>"


def restored(flat: str, sources: list[str | None]) -> str:
    """Text of a flattened message: placeholders become the markup they stood for (or stay), the rest is unescaped."""
    out, at = [], 0
    for m in _PLACEHOLDER.finditer(flat):
        source = sources[int(m.group(1))] if int(m.group(1)) < len(sources) else None
        out += [unescape(flat[at : m.start()]), m.group() if source is None else source]
        at = m.end()
    return "".join([*out, unescape(flat[at:])])


def format_conversation(turns: Iterable[tuple[str | None, str | list | None]], visitor: PartVisitor | None = None) -> tuple[str, list[tuple[int, int]], list[Attachment]]:
    """Formatted text, loss spans (code points, end exclusive) over the texts of assistant turns, attachments.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; roles are escaped too, and a line break in a role
    is written as ``<|nl|>`` so that the first line break ends the role. Null role and text are empty.
    """
    visitor = visitor or PartVisitor()
    out, spans, at = [], [], 0
    for visitor.turn, (role, content) in enumerate(turns):
        text = visitor.flatten(content)
        head = f"{START}{escape(role or '').replace(chr(10), '<|nl|>')}\n"
        out += [head, text, f"{END}\n"]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(text)))
        at += len(head) + len(text) + len(END) + 1
    return "".join(out), spans, visitor.attachments


def parse(formatted: str, sources: list[str | None] | None = None) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, with ``sources`` of its attachments in order; ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        turns.append((unescape(formatted[at + len(START) : line].replace("<|nl|>", "\n")), restored(formatted[line + 1 : end], sources or [])))
        at = end + len(END) + 1
    return turns


FORMATTED = "conv_id long, n_rows long, formatted string, loss_starts array<long>, loss_ends array<long>, attachments string, expanded_tokens long"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose two texts hold the template's own control strings."""
    spark = conversations.sparkSession
    text = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


def format_table(turns: DataFrame, parts_json: bool = False) -> DataFrame:
    """One formatted conversation for each conv_id of (conv_id, turn, role, text); other columns are ignored.

    Turns are ordered by turn, role and text (nulls first); repeated rows stay; null conv_id is one
    conversation. Texts go through the visitor as typed parts: those that their markup gives, or with ``parts_json``
    those of a text that is a JSON list of objects. A conversation is one output value, so its turns meet in one task;
    that is bounded by the longest conversation.
    """
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def content(text: str | None) -> str | list | None:
        if parts_json and text and text.lstrip().startswith("["):
            try:
                value = json.loads(text)
            except ValueError:
                return text
            if isinstance(value, list) and all(isinstance(x, dict) for x in value):
                return value
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = found.as_py()
                text, spans, attachments = format_conversation((t["role"], content(t["text"])) for t in found)
                rows.append({"conv_id": conv, "n_rows": len(found), "formatted": text, "loss_starts": [a for a, _ in spans], "loss_ends": [b for _, b in spans], "attachments": json.dumps([vars(a) for a in attachments]), "expanded_tokens": sum(a.tokens for a in attachments)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_rows", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("attachments", pa.string()), ("expanded_tokens", pa.int64())]))

    return grouped.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings, their loss masks and their attachments hold."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends, found in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found = json.loads(found)
                sources = [a["source"] for a in found]
                turns, loss = parse(text, sources), "".join(restored(text[a:b], sources) for a, b in zip(starts, ends))
                whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                rows.append((conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(found), sum(a["tokens"] for a in found)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends", "attachments").mapInArrow(run, schema)


def oracle_sql() -> str:
    """DuckDB SQL for the digests of all conversations with the probe, as the formatted strings must give them back."""
    probe = f"{END}{START}assistant ok"
    control = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
    flat = control.format("text")
    for kind, pattern in MARKUP.items():
        flat = f"regexp_replace({flat}, '{pattern}', '<|{kind}:|>', 'g')"
    # escaped texts hold no "<|", so what is counted here are placeholders
    placed = "len(regexp_extract_all(flat, '<\\|(?:image|audio|document):\\|>'))"
    return f"""
    with every as (select conv_id::bigint as conv_id, turn::bigint as turn, role, text from conversations
        union all select -1, 0, 'user', '{probe}' union all select -1, 1, 'assistant', '{probe}'),
    said as (select conv_id, turn, role as r, text as t, coalesce(role, '') as role, coalesce(text, '') as text from every),
    flattened as (select *, {flat} as flat, replace({control.format('role')}, chr(10), '<|nl|>') as head from said),
    counted as (select *, {placed} as placed from flattened),
    summed as (select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first)) as turns_sha256,
        string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, r nulls first, t nulls first) as loss,
        sum(length(head) + length(flat) + {len(START) + len(END) + 2})::bigint as chars, sum(placed)::bigint as n_attachments
        from counted group by conv_id)
    select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
        chars + coalesce(list_sum(list_transform(range(n_attachments), lambda i: length(i::varchar))), 0)::bigint as formatted_chars,
        n_attachments, n_attachments as expanded_tokens from summed
    """
