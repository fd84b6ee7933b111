"""Chat formatting: layouts told by fingerprints of their field paths, mapped to canonical turns, written by a template.

A layout is the set of nested field paths of a record (`messages[].role`, `instruction`, ...). Its fingerprint is a hash of
the sorted paths, restricted to paths that some mapping knows, so further columns don't matter. A table of mappings, each a
plain declaration of where roles and texts are, is looked up by the fingerprint: exactly where it can be, else the mapping
with most paths among those that the record has in full, the earlier of equals. Typed tables are fingerprinted once by
their schema, JSON records one by one (a layout seen before is only looked up).

A canonical turn is (conv_id, turn, role, text). A template writes each turn as a piece: a mark, the text, an end mark; a
conversation's formatted text is its pieces in order. Control strings inside texts are broken by a mark after their first
character, and marks that were there already get one more, so that texts are restored exactly and nothing in a text can
open or close a turn. Only texts of the trained roles are under the loss mask.

Scale: turns are formatted row by row, where they are read. Reading back sorts each conversation's pieces within a
partition and streams them through a parser that holds one turn at a time, and digests as it goes: a conversation of any
length costs one task its time, not its memory (a hash of a whole can't be taken in parts).

Defined results: a null text is empty, a null role is the empty role; turns are ordered by turn (nulls last), then role,
then piece, so ties and repeated rows have one order and all count; turns with a null conv_id are one conversation; records
that no mapping fits, and cells that aren't JSON, give no turns and are counted by `layouts`; extra columns are ignored
unless their names belong to a mapping; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.plans.scratch import kernel_parts

from ._kit import Batches, batches, pieces


@dataclass(frozen=True)
class Turn:
    """A turn of a fixed role whose text is one or more fields, the non-empty ones joined by an empty line."""

    role: str
    text: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Each:
    """A turn for each item of a list of objects; the text may be a list of parts with a `text` of their own."""

    items: str
    role: str
    text: str
    roles: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Rows:
    """Every row is a turn."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Mapping:
    name: str
    turns: tuple[Turn | Each | Rows, ...]

    def paths(self, optional: bool = False) -> frozenset[str]:
        found: set[str] = set()
        for t in self.turns:
            if isinstance(t, Turn):
                found |= set() if t.optional and not optional else set(t.text if optional else t.text[:1])
            elif isinstance(t, Each):
                found |= {f"{t.items}.{t.role}", f"{t.items}.{t.text}"}
            else:
                found |= {t.order, t.role, t.text}
        return frozenset(found)


#: The roles of layouts that name them otherwise.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS = (
    Mapping("turn rows", (Rows("turn", "role", "text"),)),
    Mapping("message parts", (Each("messages[]", "role", "content[].text", SPEAKERS),)),
    Mapping("messages", (Each("messages[]", "role", "content", SPEAKERS),)),
    Mapping("speakers", (Turn("system", ("system",), True), Each("conversations[]", "from", "value", SPEAKERS))),
    Mapping("dialog", (Each("dialog[]", "speaker", "text", SPEAKERS),)),
    Mapping("instruction", (Turn("system", ("system",), True), Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Mapping("instruction and response", (Turn("user", ("instruction", "context")), Turn("assistant", ("response",)))),
    Mapping("prompt and completion", (Turn("system", ("system",), True), Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Mapping("prompt and response", (Turn("system", ("system",), True), Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Mapping("question and answer", (Turn("system", ("system",), True), Turn("user", ("question", "context")), Turn("assistant", ("answer",)))),
)
CANONICAL = "conv_id long, turn long, role string, text string"


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Registry:
    """Mappings by fingerprints; what was looked up once is kept (there are as many entries as layouts)."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known = frozenset().union(*(m.paths(optional=True) for m in mappings))
        self.table: dict[str, Mapping | None] = {}
        for m in mappings:
            self.table.setdefault(fingerprint(m.paths()), m)
            self.table.setdefault(fingerprint(m.paths(optional=True)), m)

    def select(self, paths: set[str]) -> tuple[str, Mapping | None]:
        own = paths & self.known
        mark = fingerprint(own)
        if mark not in self.table:
            fits = [m for m in self.mappings if m.paths() <= own]
            self.table[mark] = max(fits, key=lambda m: len(m.paths(optional=True) & own), default=None)
        return mark, self.table[mark]


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of the plain values of a schema."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def value_paths(value, at: str = "") -> set[str]:
    """Paths of the plain values of a record; of a list, those of all its items."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{at}[]") for v in value))
    return {at}


def _said(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of one record by its mapping."""
    out = []
    for t in mapping.turns:
        if isinstance(t, Turn):
            parts = [_said(record.get(f)) for f in t.text]
            if not t.optional or any(parts):
                out.append((t.role, "\n\n".join(p for p in parts if p)))
        elif isinstance(t, Each):
            name, _, inner = t.text.partition("[].")
            for item in record.get(t.items.removesuffix("[]")) or []:
                if isinstance(item, dict):
                    role, text = _said(item.get(t.role)), item.get(name)
                    if inner and isinstance(text, list):
                        text = "".join(_said(x.get(inner)) if isinstance(x, dict) else _said(x) for x in text)
                    out.append((t.roles.get(role, role), _said(text)))
        else:
            out.append((_said(record.get(t.role)), _said(record.get(t.text))))
    return out


def _item(t: Each):
    """What makes a turn of an item, in DataFrame functions."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    name, _, inner = t.text.partition("[].")

    def turn(x: Column) -> Column:
        role = F.coalesce(*(F.when(text(x[t.role]) == k, v) for k, v in t.roles.items()), text(x[t.role]))
        said = F.array_join(F.transform(x[name], lambda p: text(p[inner])), "") if inner else x[name]
        return F.struct(role.alias("role"), text(said).alias("text"))

    return turn


def _typed_turns(df: DataFrame, mapping: Mapping) -> Column:
    """Array of (role, text) of a typed row by its mapping, in DataFrame functions."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    pair = lambda role, said: F.struct(role.alias("role"), said.alias("text"))
    parts = []
    for t in mapping.turns:
        if isinstance(t, Turn):
            there = [f for f in t.text if f in df.columns]
            said = F.array_join(F.filter(F.array(*(text(F.col(f)) for f in there)), lambda v: v != ""), "\n\n") if there else F.lit("")
            one = F.array(pair(F.lit(t.role), said))
            parts.append(F.when(said != "", one).otherwise(F.filter(one, lambda _: F.lit(False))) if t.optional else one)
        elif isinstance(t, Each):
            items = F.filter(F.col(t.items.removesuffix("[]")), lambda x: x.isNotNull())
            parts.append(F.coalesce(F.transform(items, _item(t)), F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*parts)


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", registry: Registry | None = None) -> DataFrame:
    """Turns of a typed table in whichever layout its fingerprint tells; other layouts than the known raise a ValueError."""
    mark, mapping = (registry or Registry()).select(schema_paths(df.schema))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {mark} of columns {', '.join(df.columns)}")
    cid = F.col(conv_id).cast("long").alias("conv_id")
    if isinstance(mapping.turns[0], Rows):
        r = mapping.turns[0]
        return df.select(cid, F.col(r.order).cast("long").alias("turn"), F.coalesce(F.col(r.role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(r.text).cast("string"), F.lit("")).alias("text"))
    turns = df.select(cid, F.posexplode(_typed_turns(df, mapping)).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def turns_of_json(df: DataFrame, column: str, conv_id: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of JSON records of any mixture of layouts, each by its own fingerprint."""
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(column).alias("text"))

    def run(parts: Batches) -> Batches:
        registry, schema = Registry(mappings), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for b in pieces(parts):
            out: dict[str, list] = {"conv_id": [], "turn": [], "role": [], "text": []}
            for cid, cell in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                record = _parsed(cell)
                mapping = registry.select(value_paths(record))[1] if record else None
                for k, (role, text) in enumerate(record_turns(record, mapping) if mapping else ()):
                    for c, v in zip(out, (cid, k, role, text), strict=True):
                        out[c].append(v)
            yield batches(out, schema)

    return rows.mapInArrow(run, CANONICAL)


def _parsed(cell: str | None) -> dict | None:
    try:
        record = json.loads(cell) if cell else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def layouts(df: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, mapping, n): how many JSON records have each layout; mapping is null where none fits."""

    def run(parts: Batches) -> Batches:
        registry, schema = Registry(mappings), pa.schema([("fingerprint", pa.string()), ("mapping", pa.string())])
        for b in pieces(parts):
            got = [registry.select(value_paths(_parsed(c) or {})) for c in b.column("text").to_pylist()]
            yield batches({"fingerprint": [g[0] for g in got], "mapping": [g[1] and g[1].name for g in got]}, schema)

    return df.select(F.col(column).alias("text")).mapInArrow(run, "fingerprint string, mapping string").groupBy("fingerprint", "mapping").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn's text, by role; `other` stands for any further role, whose name follows its mark.

    No control string may hold another one's beginning, nor end in one; `check` says so.
    """

    marks: dict
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    trained: tuple[str, ...] = ("assistant",)
    breaker: str = "\\"

    def pattern(self, at_least: str) -> str:
        """A control string, broken by marks after its first character."""
        by_first: dict[str, list[str]] = {}
        for c in sorted(self.controls, key=len, reverse=True):
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"{re.escape(f)}{at_least}(?=(?:{'|'.join(rest)}))" for f, rest in by_first.items())

    def check(self) -> None:
        for a in self.controls:
            for b in self.controls:
                if a != b and (b in a or any(a.endswith(b[:k]) for k in range(1, len(b)))):
                    raise ValueError(f"control strings {a!r} and {b!r} run into each other")
        for mark in (m for pair in (*self.marks.values(), self.other) for m in pair if m.strip()):
            if not any(c in mark for c in self.controls):
                raise ValueError(f"no control string in the mark {mark!r}")


#: Control strings that chat templates in use give a meaning to.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
INST = Template(
    marks={"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")},
    other=("[TURN]", "\n", "[/TURN]"),
    controls=CONTROLS,
)


class Writer:
    """Turns to pieces and back, for one template."""

    def __init__(self, template: Template):
        template.check()
        self.template = template
        e = re.escape(template.breaker)
        self.raw, self.broken = re.compile(template.pattern(f"{e}*")), re.compile(template.pattern(f"{e}+"))

    def escaped(self, text: str) -> str:
        return self.raw.sub(lambda m: m[0] + self.template.breaker, text)

    def restored(self, text: str) -> str:
        return self.broken.sub(lambda m: m[0][:-1], text)

    def piece(self, role: str, text: str) -> tuple[str, int, int]:
        """(piece, where its text under the loss mask begins and ends; 0, 0 if there is none)."""
        body = self.escaped(text)
        if role in self.template.marks:
            before, after = self.template.marks[role]
        else:
            before, after = self.template.other[0] + self.escaped(role).replace("%", "%25").replace("\n", "%0A") + self.template.other[1], self.template.other[2]
        whole = before + body + after
        return (whole, len(before), len(before) + len(body)) if role in self.template.trained else (whole, 0, 0)

    def parse(self, held: str) -> tuple[str, str, int, int, int] | None:
        """(role, text, begin and end of the escaped text, end of the turn) of the turn that `held` begins with, None if it isn't whole."""
        for role, (before, after) in self.template.marks.items():
            if held.startswith(before):
                end = held.find(after, len(before))
                return None if end < 0 else (role, self.restored(held[len(before) : end]), len(before), end, end + len(after))
        before, between, after = self.template.other
        if held.startswith(before):
            at = held.find(between, len(before))
            end = held.find(after, at) if at >= 0 else -1
            if end >= 0:
                role = self.restored(held[len(before) : at].replace("%0A", "\n").replace("%25", "%"))
                return role, self.restored(held[at + len(between) : end]), at + len(between), end, end + len(after)
        return None


def format_turns(turns: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, turn, role, text, and of each turn its piece and the span of the piece under the loss mask (code points)."""

    def run(parts: Batches) -> Batches:
        writer, schema = Writer(template), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        for b in pieces(parts):
            made = [writer.piece(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield batches({c: b.column(c) for c in ("conv_id", "turn", "role", "text")} | {"piece": [m[0] for m in made], "loss_start": [m[1] for m in made], "loss_end": [m[2] for m in made]}, schema)

    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.mapInArrow(run, CANONICAL + ", piece string, loss_start long, loss_end long")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """One conversation as it is read back."""

    def __init__(self, conv_id, writer: Writer):
        self.conv_id, self.writer, self.held, self.mask = conv_id, writer, "", []
        self.n, self.loss, self.size, self.turns, self.masked = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, start: int, end: int) -> None:
        self.mask += [(len(self.held) + start, len(self.held) + end)] if end > 0 else []
        self.held += piece
        self.size += len(piece)
        while self.held:
            got = self.writer.parse(self.held)
            if got is None:
                return
            role, text, _, _, over = got
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            while self.mask and self.mask[0][1] <= over:
                a, b = self.mask.pop(0)
                under = self.writer.restored(self.held[a:b])
                self.loss += len(under)
                self.masked.update(under.encode())
            self.held = self.held[over:]
            self.mask = [(a - over, b - over) for a, b in self.mask]

    def row(self) -> tuple:
        if self.held:
            raise ValueError(f"conversation {self.conv_id} doesn't end with a whole turn")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.size


def read_back(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """Turns and loss of every conversation, as its formatted text and loss mask give them."""

    def run(parts: Batches) -> Iterator[pa.RecordBatch]:
        writer, schema = Writer(template), pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in DIGEST.split(", ")])
        now: _Reader | None = None
        done: list[tuple] = []
        for b in pieces(parts, "piece"):
            for cid, piece, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if now is None or now.conv_id != cid:
                    done += [now.row()] if now else []
                    now = _Reader(cid, writer)
                now.feed(piece, start, end)
            if len(done) >= 1024:
                yield batches(dict(zip(schema.names, zip(*done, strict=True), strict=True)), schema)
                done = []
        done += [now.row()] if now else []
        if done:
            yield batches(dict(zip(schema.names, zip(*done, strict=True), strict=True)), schema)

    order = formatted.select("conv_id", "turn", "role", "piece", "loss_start", "loss_end").repartition(kernel_parts(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "piece")
    return order.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(run, DIGEST)
