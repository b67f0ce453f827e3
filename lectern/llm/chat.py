"""Chat formatting with typed content parts.

A turn's content is plain text or a JSON list of parts: text, image, audio and document (which may hold
parts of its own). ``Flatten`` visits the parts in order and writes one string: texts escaped, every
attachment as a numbered placeholder, with its reference and the number of tokens it expands to kept
beside. A ``Template`` wraps the string in the markers of the turn's role. Every turn is formatted by
itself, so ``format_turns`` needs no shuffle and a conversation of any length is spread over all tasks;
``read_back`` streams a conversation's turns in order and holds one at a time (its digests are sequential
by definition, only those rows follow their key).

Escaping: a backslash is doubled, and one is put behind the first character of each control string found
in a text, overlapping ones included. No control string is then left in a text; ``unescape`` drops single
backslashes and halves double ones. ``Template`` refuses markers that could join with a text's edge.

Defined results: a null text is the empty text, a null role the empty role, a null conversation id a
conversation of its own; turns go by number (null first), equal numbers by role, then text; repeated rows
are turns each; roles without markers of their own are written out; content that is no JSON list of parts
is one text; parts of unknown type are attachments of kind ``other`` with their JSON as reference; empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read

#: Placeholders and the markers of unnamed roles all begin so.
OPEN = "<|"
KINDS = ("image", "audio", "document", "other")
TOKEN = re.compile(r"<\|(?:(image|audio|document|other)_([0-9]+)|(/document))\|>")
PIECES = (
    "conv_id bigint, turn bigint, role string, piece string, n_chars bigint, n_tokens bigint, loss array<struct<start:bigint,stop:bigint>>, "
    "attachments array<struct<number:bigint,parent:bigint,kind:string,reference:string,n_tokens:bigint>>"
)
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, n_tokens bigint"


@dataclass(frozen=True)
class Expand:
    """Tokens that an attachment expands to. ``unknown`` where its size is not given."""

    patch: int = 28
    audio_per_second: float = 25.0
    page: int = 256
    unknown: int = 256

    def image(self, part: dict) -> int:
        w, h = number(part.get("width")), number(part.get("height"))
        return math.ceil(w / self.patch) * math.ceil(h / self.patch) if w and h else self.unknown

    def audio(self, part: dict) -> int:
        return math.ceil(seconds * self.audio_per_second) if (seconds := number(part.get("seconds"))) else self.unknown

    def document(self, part: dict) -> int:
        if part.get("parts"):
            return 0  # its parts are counted
        return math.ceil(pages) * self.page if (pages := number(part.get("pages"))) else self.unknown


def number(value) -> float:
    return value if isinstance(value, int | float) and not isinstance(value, bool) and 0 < value < 1e9 else 0


@dataclass(frozen=True)
class Template:
    """Markers (role, before, after); other roles are written between ``other``'s first two."""

    turns: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    learned: tuple[str, ...] = ("assistant",)
    markers: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "markers", tuple(m for _, *pair in self.turns for m in pair) + self.other)
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string needs two characters and no backslash: {c!r}")
            for m in (*self.markers, OPEN):
                for i in range(1, len(c)):
                    a, b = c[:i], c[i:]
                    if m.startswith(b) or b.startswith(m) or m.endswith(a) or a.endswith(m):
                        raise ValueError(f"{m!r} beside a text could be read as {c!r}")

    @cached_property
    def controls(self) -> tuple[str, ...]:
        return tuple(sorted({m for m in self.markers if not m.startswith(OPEN)} | {OPEN}, key=lambda m: (-len(m), m)))

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile(f"(?=(?:{'|'.join(map(re.escape, self.controls))}))(.)", re.DOTALL)

    @cached_property
    def _marker(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.markers, key=len, reverse=True))) + "|" + TOKEN.pattern)

    def escape(self, text: str) -> str:
        return self._control.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def around(self, role: str) -> tuple[str, str]:
        for name, before, after in self.turns:
            if name == role:
                return before, after
        return f"{self.other[0]}{self.escape(role)}{self.other[1]}", self.other[2]

    def parse(self, formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        """(role, [(kind, text or number)]) of every turn in a formatted string."""
        before = {b: (r, a) for r, b, a in self.turns} | {self.other[0]: (None, self.other[2])}
        role = after = None
        parts: list[tuple[str, str]] = []
        at = 0
        for m in self._marker.finditer(formatted):
            text = self.unescape(formatted[at : m.start()])
            at, mark = m.end(), m.group()
            if after is None:
                if mark not in before or text:
                    raise ValueError(f"no turn begins at {m.start()}")
                role, after = before[mark]
                parts = []
            elif role is None:
                if mark != self.other[1]:
                    raise ValueError(f"no role ends at {m.start()}")
                role = text
            else:
                if text:
                    parts.append(("text", text))
                if mark == after:
                    yield role, parts
                    after = None
                elif m.group(1) or m.group(3):
                    parts.append((m.group(1) or m.group(3), m.group(2) or ""))
                else:
                    raise ValueError(f"{mark!r} inside a turn")
        if after is not None or at < len(formatted):
            raise ValueError("an unfinished turn")


class Flatten:
    """The visitor. Nested parts are kept on a stack of its own, so their depth costs no recursion."""

    def __init__(self, template: Template, expand: Expand, tokens=None):
        self.template, self.expand, self.tokens = template, expand, tokens or (lambda text: 0)
        self.out: list[str] = []
        self.size = self.n_tokens = 0
        self.texts: list[dict] = []  # where escaped texts stand in the output
        self.attachments: list[dict] = []

    def flatten(self, parts: list) -> str:
        todo = [(p, 0) for p in reversed(parts)]
        while todo:
            part, parent = todo.pop()
            if part is None:
                self.write("<|/document|>")
                continue
            todo += reversed(self.visit(part, parent))
        return "".join(self.out)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part, parent: int) -> list:
        if isinstance(part, str):
            part = {"type": "text", "text": part}
        kind = part.get("type") if isinstance(part, dict) else None
        return getattr(self, f"visit_{kind}", self.visit_other)(part, parent) if isinstance(kind, str) else self.visit_other(part, parent)

    def visit_text(self, part: dict, parent: int) -> list:
        if not isinstance(text := part.get("text"), str):
            return [] if text is None else self.visit_other(part, parent)
        escaped = self.template.escape(text)
        if escaped:
            self.texts.append({"start": self.size, "stop": self.size + len(escaped)})
            self.n_tokens += self.tokens(text)
        self.write(escaped)
        return []

    def attach(self, kind: str, reference: str | None, n: int, parent: int) -> int:
        self.attachments.append({"number": len(self.attachments) + 1, "parent": parent, "kind": kind, "reference": reference, "n_tokens": n})
        self.n_tokens += n
        self.write(f"<|{kind}_{len(self.attachments)}|>")
        return len(self.attachments)

    def visit_image(self, part: dict, parent: int) -> list:
        self.attach("image", reference(part), self.expand.image(part), parent)
        return []

    def visit_audio(self, part: dict, parent: int) -> list:
        self.attach("audio", reference(part), self.expand.audio(part), parent)
        return []

    def visit_document(self, part: dict, parent: int) -> list:
        me = self.attach("document", reference(part), self.expand.document(part), parent)
        inner = part.get("parts")
        return [(p if p is not None else "", me) for p in (inner if isinstance(inner, list) else [])] + [(None, me)]

    def visit_other(self, part, parent: int) -> list:
        self.attach("other", json.dumps(part, ensure_ascii=False, sort_keys=True), self.expand.unknown, parent)
        return []


def reference(part: dict) -> str | None:
    found = part.get("reference", part.get("url"))
    return found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False, sort_keys=True)


def parts_of(text: str | None, content: str | None) -> list:
    if content is not None:
        try:
            if isinstance(parts := json.loads(content), list):
                return [p if p is not None else "" for p in parts]
        except (ValueError, RecursionError):
            pass
        return [content]
    return [text or ""]


def format_turns(rows: DataFrame, template: Template | None = None, expand: Expand | None = None, content: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text[, content]) -> PIECES, one row a turn. ``content`` names a column of JSON
    parts that goes before ``text`` where it is not null; ``tokenizer`` is the file that counts texts' tokens
    (without it only attachments count). ``loss`` holds the spans of ``piece`` that are learned."""
    template, expand = template or Template(), expand or Expand()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        if tokenizer:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            model.encode_special_tokens = True
            count = lambda text: len(model.encode(text, add_special_tokens=False).ids)
        for batch in batches:
            out = []
            for conv, turn, role, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                visitor = Flatten(template, expand, count)
                before, after = template.around(role or "")
                body = visitor.flatten(parts_of(text, parts))
                shift = len(before)
                loss = [{"start": s["start"] + shift, "stop": s["stop"] + shift} for s in visitor.texts] if role in template.learned else []
                piece = before + body + after
                out.append({"conv_id": conv, "turn": turn, "role": role, "piece": piece, "n_chars": len(piece), "n_tokens": visitor.n_tokens, "loss": loss, "attachments": visitor.attachments})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], PIECES).schema)
    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    return rows.select(*ids, "role", "text", (F.col(content) if content else F.lit(None).cast("string")).alias("content")).mapInArrow(run, PIECES)


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """PIECES -> DIGESTS, one row a conversation, from the formatted strings and loss spans alone."""
    template = template or Template()

    class Conversation:
        def __init__(self, conv):
            self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.n_loss = self.n_chars = self.n_attachments = self.n_tokens = 0

        def add(self, piece: str, spans: list[dict], n_tokens: int) -> None:
            for role, parts in template.parse(piece):
                self.turns.update(f"{role}\n{''.join(t for kind, t in parts if kind == 'text')}\n".encode())
                self.n_turns += 1
                self.n_attachments += sum(kind in KINDS for kind, _ in parts)
            for s in spans:
                text = template.unescape(piece[s["start"] : s["stop"]])
                self.n_loss += len(text)
                self.loss.update(text.encode())
            self.n_chars += len(piece)
            self.n_tokens += n_tokens

        def row(self) -> tuple:
            return self.conv, self.n_turns, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.n_chars, self.n_attachments, self.n_tokens

    names = [c.split()[0] for c in DIGESTS.split(", ")]
    types = [pa.string() if "string" in c else pa.int64() for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            for conv, piece, spans, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv)
                now.add(piece, spans, n)
            yield rows_of(done)
        if now is not None:
            yield rows_of([now.row()])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return ordered.select("conv_id", "piece", "loss", "n_tokens").mapInArrow(run, DIGESTS)


#: A conversation that the operator must bring through unharmed.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    read_again = read_back(format_turns(rows.unionByName(probe)))
    return read_again.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_sql(template: Template | None = None) -> str:
    """Control strings of the default template do not overlap, so replacing them one by one is exact."""
    template = template or Template()
    escape = lambda x: _nested(x, [("\\", "\\\\"), *((c, f"{c[0]}\\{c[1:]}") for c in template.controls)])
    around = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, a, b in template.turns)
    probe = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
    return f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES {probe}),
sized AS (SELECT *, length({escape('text')}) + CASE role {around} ELSE {sum(map(len, template.other))} + length({escape('role')}) END AS n FROM given)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def _nested(column: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column
