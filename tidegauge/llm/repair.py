"""Repair of conversations by weighted CYK parsing of intervals.

The role initials of a sound conversation are ``(s?(ua)+)?``. The grammar in Chomsky normal form has a nonterminal ``pq`` for each
pair of places p, q in that pattern (0 begin, 1 after s, 2 after u, 3 after a; a conversation is ``00`` or ``03``) and the
rules ``pq -> pr rq``. A row derives ``pq`` by keeping, changing or deleting it; the empty string derives ``pq`` by
insertions, and the insertion closure of a row's cell takes any number of them on both sides.

A cell of a span holds for each nonterminal the least (cost, audit), audit being the initials of the edits in order. Cells are
combined bottom-up by span length: 1, 2, 4, 8, ... rows. As a nonterminal is a pair of places, every split of a span derives the
same edit sequences, so one split of each span is enough and the work is linear in the rows. Minima of parts make minima of
the whole: equal costs of the same rows never have audits that begin with one another, so the order of audits survives joining.

On Spark: rows are dealt by ranges of (conv_id, turn, role, text), so a conversation may lie in many tasks. A run of
rows of one conversation in a task is a fragment with its cell; cells of fragments are folded in order. Repeated rows are found by an
aggregation of digests. Only a conversation's audit and its repaired text pass through one task, in a stream: an
audit is one value and a digest is a chain.

Defined results: a null conv_id is a conversation of its own; a null turn comes first; a null role or text is one space, so the
row is blank or has no sound role. Rows of the same turn stand in the order of role and text. Roles count by their first character.
Rows that repeat count each. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import table
from tidegauge.llm.registry import query
from tidegauge.session import durable

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
TURNS = {2: "user", 3: "assistant"}  #: role of a row that ends at a place
NONTERMINALS = tuple((p, q) for p in range(4) for q in range(4) if q >= p or (p, q) == (3, 2))
RULES = tuple((pq, tuple(((pq[0], r), (r, pq[1])) for r in range(4) if (pq[0], r) in NONTERMINALS and (r, pq[1]) in NONTERMINALS)) for pq in NONTERMINALS)
ENDS = ((0, 0), (0, 3))
Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out = {}
    for pq, splits in RULES:
        best = None
        for a, b in splits:
            if (x := left.get(a)) and (y := right.get(b)):
                cost = x[0] + y[0]
                if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                    best = (cost, x[1] + y[1])
        if best is not None:
            out[pq] = best
    return out


def insertions() -> Cell:
    """What the empty string derives: fewest insertions from each place to each other."""
    cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit) in list(cell.items()):
            for (role, at), to in STEPS.items():
                if at == q and role != "s" and cell.get((p, to), (99,))[0] > cost + INSERT:
                    cell[p, to] = (cost + INSERT, audit + "I")
    return cell


INSERTED = insertions()


@lru_cache(maxsize=None)
def row_cell(symbol: str) -> Cell:
    """The cell of one row. Symbols: D must be deleted; s, u, a, x (no sound role), in capitals when truncated."""
    cell = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "D":
        extra, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        for (made, p), q in STEPS.items():
            if made == role:
                edit = (KEEP + extra, "K")
            elif made != "s":
                edit = (REROLE + extra, "R")
            else:
                continue
            cell[p, q] = min(edit, cell.get((p, q), edit))
    return join(join(INSERTED, cell), INSERTED)


def _combine(symbols: str) -> Cell:
    """Cells of spans of 1, 2, 4, 8, ... rows; the last span of a length may be shorter."""
    cells = [row_cell(s) for s in symbols]
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTED


_short = lru_cache(maxsize=1 << 14)(_combine)


def parse(symbols: str) -> Cell:
    return _short(symbols) if len(symbols) <= 16 else _combine(symbols)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that a digest of conversation and turn chooses."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    return rows.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, their place in the order of (conv_id, turn, role, text), written once; ranges are dealt, not conversations."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return durable(dealt.select(
        "*", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2")))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, initial, fault) of placed rows; the fault is the first of blank, duplicate and truncated, or empty.

    A row is no repetition if it is the first of its conversation with its digest. First rows are matched by their place, which is
    unique, so a text that fills a conversation is no hot key.
    """
    firsts = rows.groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    slim = rows.select(
        "conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")).alias("has_text"),
        F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")).alias("ended"))
    fault = F.when(~F.col("has_text"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    return slim.join(firsts, "at", "left").select("conv_id", "at", "turn", "initial", fault.alias("fault"))


def symbol(initial: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "D"
    own = initial if initial in ("s", "u", "a") else "x"
    return own.upper() if fault == "truncated" else own


class Fragment:
    """A run of rows of one conversation, or the runs so far when fragments are folded."""

    FIELDS = ("conv_id", "at", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns")
    TYPES = "conv_id bigint, at bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, first_turn bigint, last_turn bigint, turns bigint"

    def __init__(self, conv_id: int | None, at: int):
        self.conv_id, self.at = conv_id, at
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None
        self.symbols: list[str] = []
        self.cell: Cell = INSERTED

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.link(initial, initial, turn, turn, int(turn is not None))
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.symbols.append(symbol(initial, fault))

    def append(self, other: Fragment) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.link(other.first, other.last, other.first_turn, other.last_turn, other.turns)
        # only what starts at the beginning can become a conversation
        self.cell = {pq: v for pq, v in join(self.cell, other.cell).items() if pq[0] == 0}

    def link(self, first: str, last: str, first_turn: int | None, last_turn: int | None, turns: int) -> None:
        if self.last is None:
            self.first = first
        else:
            self.illegal += self.last + first not in ("su", "ua", "au")
        self.last = last
        if first_turn is not None:  # turns ascend, so only neighbours can share one
            self.turns += turns - (self.last_turn == first_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, cut when their strings reach ``size``."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(v) for v in row if isinstance(v, str))
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def fragments(rows: DataFrame) -> DataFrame:
    """Fragments with their cells (a list of costs and one of audits by nonterminal), from marked rows dealt by ranges of their place."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*Fragment.FIELDS, "costs", "audits"]
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.string())]

    def done(f: Fragment) -> tuple:
        cell = parse("".join(f.symbols))
        return *(getattr(f, name) for name in Fragment.FIELDS), [cell.get(pq, (None, None))[0] for pq in NONTERMINALS], [cell.get(pq, (None, None))[1] for pq in NONTERMINALS]

    def run(batches):
        def found():
            now = None
            for conv_id, at, turn, initial, fault in _rows(batches):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield done(now)
                    now = Fragment(conv_id, at)
                now.add(turn, initial, fault)
            if now is not None:
                yield done(now)

        yield from _batches(found(), names, types)

    dealt = rows.repartitionByRange(parts, "at").sortWithinPartitions("at").select("conv_id", "at", "turn", "initial", "fault")
    return dealt.mapInArrow(run, f"{Fragment.TYPES}, costs array<bigint>, audits array<string>")


HEADS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def fold(found: DataFrame) -> DataFrame:
    """One row per conversation from its fragments in order."""
    fields = HEADS.replace(",", "").split()
    names, types = fields[::2], [pa.string() if t == "string" else pa.int64() for t in fields[1::2]]

    def done(f: Fragment) -> tuple:
        cost, audit = min(f.cell[end] for end in ENDS if end in f.cell)
        return f.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, cost, audit

    def run(batches):
        def whole():
            now = None
            for row in _rows(batches):
                *fields, costs, audits = row
                part = Fragment(row[0], row[1])
                for name, value in zip(Fragment.FIELDS, fields):
                    setattr(part, name, value)
                part.cell = {pq: (c, a) for pq, c, a in zip(NONTERMINALS, costs, audits) if c is not None}
                if now is None or now.conv_id != part.conv_id:
                    if now is not None:
                        yield done(now)
                    now = part
                else:
                    now.append(part)
            if now is not None:
                yield done(now)

        yield from _batches(whole(), names, types)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, HEADS)


def parsed(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (``HEADS``) for every conv_id of ``conversations``, from the placed rows that are to be repaired."""
    heads = fold(fragments(marked(rows))).withColumnRenamed("conv_id", "id")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(heads, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"))


def _streams(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads, each followed by its conversation's rows in order."""
    head = heads.select("conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*heads.columns[1:]).alias("head"))
    body = rows.select("conv_id", "at", "role", "text", F.lit(None).cast(head.schema["head"].dataType).alias("head"))
    return head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def _edits(stream: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, head, None) for each conversation, then (conv_id, None, (edit, role, text)) for each row that stays or comes in."""
    conv_id, audit, i, place = None, "", 0, 0

    def inserted():
        nonlocal i, place
        while i < len(audit) and audit[i] == "I":
            i, place = i + 1, 3 if place == 2 else 2
            yield conv_id, None, ("I", TURNS[place], "")

    for row_conv, at, role, text, head in stream:
        if at < 0:
            yield from inserted()
            conv_id, audit, i, place = row_conv, head["audit"], 0, 0
            yield conv_id, head, None
            continue
        yield from inserted()
        edit, i = audit[i], i + 1
        if edit == "K":
            place = STEPS[role[0], place]
            yield conv_id, None, ("K", role, text)
        elif edit == "R":
            place = 3 if place == 2 else 2
            yield conv_id, None, ("R", TURNS[place], text)
    yield from inserted()


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role, text."""

    def run(batches):
        def turns():
            place = 0
            for conv_id, head, turn in _edits(_rows(batches)):
                if head is not None:
                    place = 0
                else:
                    yield conv_id, place, *turn
                    place += 1

        yield from _batches(turns(), ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])

    return _streams(rows, heads).mapInArrow(run, "conv_id bigint, place bigint, edit string, role string, text string")


def digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads with ``repaired_sha256``, of the repaired ``role:text`` joined by line feeds; the text streams through."""
    names = [*heads.columns, "repaired_sha256"]
    types = [pa.string() if f.dataType.typeName() == "string" else pa.int64() for f in heads.schema.fields] + [pa.string()]
    others = heads.columns[1:]

    def run(batches):
        def whole():
            now, hashed, lines = None, hashlib.sha256(), 0
            for conv_id, head, turn in _edits(_rows(batches)):
                if head is not None:
                    if now is not None:
                        yield *now, hashed.hexdigest()
                    now, hashed, lines = (conv_id, *(head[c] for c in others)), hashlib.sha256(), 0
                else:
                    hashed.update(b"\n" if lines else b"")
                    hashed.update(f"{turn[1]}:{turn[2]}".encode())
                    lines += 1
            if now is not None:
                yield *now, hashed.hexdigest()

        yield from _batches(whole(), names, types)

    return _streams(rows, heads).mapInArrow(run, f"{HEADS}, repaired_sha256 string")


@query("op13_repair")
def op13(spark, folder):
    conversations = table(spark, folder, "conversations")
    rows = placed(damage(conversations))
    return digests(rows, parsed(conversations, rows))
