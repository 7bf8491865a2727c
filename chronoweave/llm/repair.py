"""Least-cost repair of a conversation's structure by weighted interval parsing.

Legal role sequences are ``(s?(ua)+)?`` (s, u, a: system, user, assistant). Its automaton has the states START, after s, after u and
after a. The repair grammar has one symbol for each pair of states, [p, r]: "the rows of a span, edited, lead from p to r". In Chomsky
normal form its rules are

* [p, r] -> [p, q] [q, r], two spans side by side;
* [p, r] -> one row, kept or given another role (p to r along a role's arc), or deleted (p = r);
* insertions read no row; their closure is put on both sides of every row beforehand, which is enough, as they combine to nothing new.

A cell holds the least (cost, audit) of a span and a symbol. The edits of a span add up the same wherever it is divided (the rules are
associative, and of two audits of equal cost neither begins the other, so the least of a span is made of the least of its parts). One
division a span is therefore enough, and spans are combined bottom up by length: 1, 2, 4, 8 rows and so on. The spans of one
conversation may come from different tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.llm.common import shuffle_parts, workers, written
from chronoweave.operators.skew import lookup_join

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: White space of blank texts and behind a last word.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a span whose cells a worker remembers by the rows' marks, and how many spans.
SHORT, REMEMBERED = 8, 1 << 15

# ---- the grammar

START, AFTER_S, AFTER_U, AFTER_A = range(4)
ARCS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
ENDS = (START, AFTER_A)


def _symbols() -> list[tuple[int, int]]:
    """Pairs of states with a way from the first to the second."""
    out = {(p, p) for p in range(4)}
    while True:
        more = out | {(p, r) for p, q in out for (f, _), r in ARCS.items() if f == q}
        if more == out:
            return sorted(out)
        out = more


SYMBOLS = _symbols()
_place = {s: i for i, s in enumerate(SYMBOLS)}
RULES = [(_place[p, r], _place[p, q], _place[q2, r]) for p, q in SYMBOLS for q2, r in SYMBOLS if q == q2]

Cells = list[tuple[int, str] | None]


def _better(cells: Cells, at: int, cost: int, audit: str) -> None:
    if cells[at] is None or (cost, audit) < cells[at]:
        cells[at] = (cost, audit)


def combine(one: Cells, two: Cells) -> Cells:
    """The cells of two spans side by side."""
    out: Cells = [None] * len(SYMBOLS)
    for at, left, right in RULES:
        a, b = one[left], two[right]
        if a is not None and b is not None:
            now = out[at]
            cost = a[0] + b[0]
            if now is None or cost < now[0] or (cost == now[0] and a[1] + b[1] < now[1]):
                out[at] = (cost, a[1] + b[1])
    return out


def _insertions() -> Cells:
    """The cells of a span of no rows: nothing, or inserted users and assistants."""
    once: Cells = [None] * len(SYMBOLS)
    for p in range(4):
        once[_place[p, p]] = (0, "")
    for (p, role), r in ARCS.items():
        if role in NAMES:
            _better(once, _place[p, r], INSERT, "I")
    while (more := combine(once, once)) != once:
        once = more
    return once


NOTHING = _insertions()


@lru_cache(maxsize=None)
def row_cells(mark: str) -> Cells:
    """The cells of one row by its mark: x must go; s, u, a, o: its role's initial (o: another), a capital if its text is truncated."""
    out: Cells = [None] * len(SYMBOLS)
    for p in range(4):
        _better(out, _place[p, p], DELETE, "D")
    if mark != "x":
        more = TRUNCATED if mark.isupper() else 0
        for (p, role), r in ARCS.items():
            if role == mark.lower():
                _better(out, _place[p, r], KEEP + more, "K")
            if role in NAMES:
                _better(out, _place[p, r], REROLE + more, "R")
    return combine(combine(NOTHING, out), NOTHING)


def _spans(marks: str) -> Cells:
    if len(marks) == 1:
        return row_cells(marks)
    half = 1 << ((len(marks) - 1).bit_length() - 1)
    return combine(span_cells(marks[:half]), span_cells(marks[half:]))


_remembered = lru_cache(maxsize=REMEMBERED)(_spans)


def span_cells(marks: str) -> Cells:
    """The cells of a span of rows; spans of few rows recur."""
    if not marks:
        return NOTHING
    return _remembered(marks) if len(marks) <= SHORT else _spans(marks)


def cheapest(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) from START to an end."""
    return min(cells[_place[START, e]] for e in ENDS if cells[_place[START, e]] is not None)


def roles(audit: str) -> Iterator[str | None]:
    """The role's initial that each edit leaves (None: deleted): of an odd number of rows the first is the system's."""
    left = len(audit) - audit.count("D")
    at = -(left % 2)
    for edit in audit:
        if edit == "D":
            yield None
        else:
            yield "s" if at < 0 else "ua"[at % 2]
            at += 1


# ---- damage and faults, as columns

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space) and gone: each row with the damage that crc32 of ``conv_id:turn`` (null: one space) modulo 20 deals it.

    0 drops the row (gone), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"),
                                 (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return dealt.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                        (F.col("damage") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("again")).drop("again")


def _told(rows: DataFrame) -> DataFrame:
    """Adds ``same``: SHA-256 of conversation, role and text, by which rows of one turn and role are ordered and repeats found."""
    conv = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    told = F.concat_ws(":", F.length(conv), conv, F.length("role"), "role", "text")  # with lengths, so that no two read the same
    return rows.withColumn("same", F.unhex(F.sha2(told.cast("binary"), 256)))


ORDER = ["conv_id", "turn", "role", "same"]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, same, gone, fault: b blank, d said in an earlier turn, t truncated, or empty.

    Rows that repeat one of their own turn stand next to it in ``ORDER`` and are told there.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    own = _told(rows).select("conv_id", "turn", "role", "same", "gone", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = own.filter("not gone and not blank").groupBy("same").agg(F.min(turn).alias("first"), F.max(turn).alias("last"))
    often = written(said.filter(F.col("first") < F.col("last")).select("same", "first"), "said-again")
    met = lookup_join(own, often, ["same"], "left")
    later = F.coalesce(F.col("first") < turn, F.lit(False))
    fault = F.when(F.col("blank"), "b").when(later, "d").when(F.col("cut"), "t").otherwise("")
    return met.select(*ORDER, "gone", fault.alias("fault"))


# ---- parsing: the rows of all conversations in order, cut anywhere

class Segment:
    """Consecutive rows of one conversation, as far as a repair depends on them."""

    __slots__ = ("marks", "cells", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "first", "last", "heads", "tails", "n")

    def __init__(self):
        self.marks, self.cells = [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.n = 0
        self.low = self.high = self.first = self.last = None
        self.heads = self.tails = ""

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.n:
            self.illegal += self.tails + initial not in LEGAL
        else:
            self.heads, self.first = initial, turn
        if turn is not None:
            if self.high is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn
        self.tails, self.last = initial, turn
        self.n += 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        mark = initial if initial in "sua" and initial else "o"
        self.marks.append("x" if fault in ("b", "d") else mark.upper() if fault == "t" else mark)

    def close(self) -> "Segment":
        self.cells = span_cells("".join(self.marks))
        self.marks = None
        return self

    def follow(self, other: "Segment") -> None:
        """Take the rows of a segment behind this one."""
        if other.n:
            if self.n:
                self.illegal += self.tails + other.heads not in LEGAL
            else:
                self.heads, self.first = other.heads, other.first
            if self.high is None:
                self.low = other.low
            self.turns += other.turns - (other.turns > 0 and self.turns > 0 and other.low == self.high)
            self.high = self.high if other.high is None else other.high
            self.tails, self.last = other.tails, other.last
        self.cells = combine(self.cells, other.cells)
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def result(self) -> dict:
        cost, audit = cheapest(self.cells)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}

    def pack(self) -> str:
        return json.dumps([getattr(self, s) for s in self.__slots__])

    @classmethod
    def unpack(cls, packed: str) -> "Segment":
        out = cls()
        for name, value in zip(cls.__slots__, json.loads(packed)):
            setattr(out, name, value)
        out.cells = [None if c is None else tuple(c) for c in out.cells]
        return out


LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: Rows of a batch that a task gives back.
ROWS = 1 << 12


def _types(rows: DataFrame) -> tuple[pa.DataType, str]:
    """The type of conv_id, and the columns of a repair."""
    conv = rows.schema["conv_id"].dataType
    return to_arrow_type(conv), f"conv_id {conv.simpleString()}, " + "".join(f"{c} long, " for c in COUNTS) + "audit string"


def _schema(kind: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", kind), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), *more])


def _parsed(kind: pa.DataType):
    """Repairs of whole conversations; of the first and last of a task, which may go on in another, the segment."""
    schema = _schema(kind, ("place", pa.int32()), ("segment", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, own, place, before, first = [], None, None, 0, None, True

        def closed(border: bool) -> dict:
            own.close()
            row = {"conv_id": now[0], "place": place, "segment": None}
            return {**row, "segment": own.pack()} if border else {**row, **own.result()}

        for batch in batches:
            for conv, turn, role, same, gone, fault, place_ in zip(*(batch.column(c).to_pylist() for c in (*ORDER, "gone", "fault", "place"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        held.append(closed(first))
                        first = False
                    now, own, before, place = (conv,), Segment(), None, place_
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if gone:
                    continue
                if fault != "b" and before == (turn, same):
                    fault = "d"
                before = (turn, same)
                own.add(turn, role[:1], fault)
        if now is not None:
            held.append(closed(True))
            yield pa.RecordBatch.from_pylist(held, schema=schema)
    return run


def _joined(kind: pa.DataType):
    """The segments of one conversation, in order: at most one a task."""
    schema = _schema(kind)

    def run(table: pa.Table) -> pa.Table:
        order = sorted(zip(table.column("place").to_pylist(), table.column("segment").to_pylist()))
        level = [Segment.unpack(s) for _, s in order]
        while len(level) > 1:
            for one, two in zip(level[::2], level[1::2]):
                one.follow(two)
            level = level[::2]
        return pa.Table.from_pylist([{"conv_id": table.column("conv_id")[0].as_py(), **level[0].result()}], schema=schema)
    return run


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of ``damaged`` rows.

    The rows of all conversations are sorted together and dealt out by ranges, so a conversation of any length is parsed by as many tasks
    as its rows fill; their cells meet afterwards.
    """
    spark = rows.sparkSession
    workers(spark)
    told = faults(rows)
    kind, ddl = _types(told)
    parts = shuffle_parts(spark)
    ranged = told.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("place", F.spark_partition_id())
    parsed = written(ranged.mapInArrow(_parsed(kind), f"{ddl}, place int, segment string"), "segments")
    whole = parsed.filter("segment is null").drop("place", "segment")
    cut = parsed.filter("segment is not null").groupBy("conv_id").applyInArrow(_joined(kind), ddl)
    return whole.unionByName(cut)


# ---- the repaired text

def _hashed(kind: pa.DataType):
    schema = _schema(kind, ("repaired_sha256", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, own, lines = [], None, None, None

        def inserted() -> tuple[str | None, str] | None:
            """Write the rows inserted here; the next row's new role and edit, or None behind the last."""
            for role, edit in lines:
                if edit != "I":
                    return role, edit
                own.line(f"{NAMES[role]}:")
            return None

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if head is not None:
                        inserted()
                        held.append({**head, "repaired_sha256": own.hash.hexdigest()})
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                    head = {c: row[c] for c in ("conv_id", *COUNTS, "audit")}
                    own, lines = _Lines(), zip(roles(row["audit"]), row["audit"])
                    continue
                role, edit = inserted()
                if edit != "D":
                    own.line(f"{NAMES[role] if edit == 'R' else row['role']}:{row['text']}")
        if head is not None:
            inserted()
            held.append({**head, "repaired_sha256": own.hash.hexdigest()})
            yield pa.RecordBatch.from_pylist(held, schema=schema)
    return run


class _Lines:
    """SHA-256 of lines joined by newlines, one at a time."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def line(self, text: str) -> None:
        if self.some:
            self.hash.update(b"\n")
        self.some = True
        self.hash.update(text.encode())


def repaired(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows``: the rows to repair (``damaged``: every conversation, with ``gone``); by default the damage of ``damaged`` is done first.

    Rows are taken by turn (nulls first), those of one turn by role and the SHA-256 of their text. A row's fault is the first of: blank
    (nothing but white space), duplicate (role and text stand earlier), truncated (the last character that is not white space is none of
    ``.!?``). Null roles and texts are one space, so a blank row of no known role. A row repeated in the table is a
    duplicate; extra columns do not count. Rows without conv_id are one conversation, whose conv_id is null. A conversation
    without rows after damage has zeros, an empty audit and the hash of the empty string; an empty table gives an empty result.

    The hash of a conversation runs through its rows one after another, so one task reads a conversation's texts, without holding them.
    """
    own = damaged(conversations) if rows is None else rows
    kept = _told(own.filter("not gone"))
    found = repairs(own)
    lines = kept.select("conv_id", "turn", "role", "same", "text", F.lit(1).alias("line"))
    stream = found.withColumn("line", F.lit(0)).unionByName(lines, allowMissingColumns=True)
    order: list[Column | str] = ["conv_id", "line", "turn", "role", "same"]
    kind, ddl = _types(found)
    return stream.repartition(shuffle_parts(own.sparkSession), "conv_id").sortWithinPartitions(*order).mapInArrow(_hashed(kind), f"{ddl}, repaired_sha256 string")


def _paid(value: str, cost: str, edit: str) -> str:
    """SQL of a cell (nine digits of cost, then the audit, so that text order is the cells' order) after one more edit."""
    return f"(lpad((substr({value}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{edit}')"


_GONE = {i: _paid(f"v{i}", str(DELETE), "D") for i in range(4)}
_KEPT, _MADE = (lambda v: _paid(v, f"{KEEP} + cut", "K")), (lambda v: _paid(v, f"{REROLE} + cut", "R"))
_BEFORE_U = "least(v0, v1, v3)"

#: The same from the first row to the last: the cells of START, after s, after u and after a, row by row.
SQL = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS label FROM conversations),
dealt AS (SELECT *, xor(list_reduce(list_transform(range(length(label)), lambda i: ascii(substr(label, i + 1, 1))::BIGINT),
  lambda crc, code: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, code)), 4294967295::BIGINT), 4294967295) % 20 AS damage FROM named),
harmed AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM dealt WHERE damage <> 0),
told AS (SELECT *, coalesce('+' || conv_id::VARCHAR, '-') AS name FROM harmed),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn NULLS FIRST, role, sha256(length(name) || ':' || name || ':' || length(role) || ':' || role || ':' || text), again) AS n,
  row_number() OVER (PARTITION BY name, role, text ORDER BY turn NULLS FIRST, again) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM told),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS initial,
  lag(left(role, 1)) OVER (PARTITION BY name ORDER BY n) AS earlier FROM placed),
counted AS (SELECT name, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY name),
parsed(name, n, v0, v1, v2, v3) AS (
  SELECT name, 0::BIGINT, '000000000', NULL::VARCHAR, '000000002I', '000000004II' FROM counted
  UNION ALL
  SELECT name, n, v0, v1, w2, least(v3, {_paid("w2", str(INSERT), "I")}) FROM (
    SELECT *, least(v2, {_paid("v0", str(INSERT), "I")}, {_paid("v1", str(INSERT), "I")}, {_paid("v3", str(INSERT), "I")}) AS w2 FROM (
      SELECT name, n, {_GONE[0]} AS v0, least({_GONE[1]}, CASE WHEN may AND initial = 's' THEN {_KEPT("v0")} END) AS v1,
        least({_GONE[2]}, CASE WHEN may AND initial = 'u' THEN {_KEPT(_BEFORE_U)} END, CASE WHEN may THEN {_MADE(_BEFORE_U)} END) AS v2,
        least({_GONE[3]}, CASE WHEN may AND initial = 'a' THEN {_KEPT("v2")} END, CASE WHEN may THEN {_MADE("v2")} END) AS v3
      FROM (SELECT p.name, f.n, p.v0, p.v1, p.v2, p.v3, f.initial, f.fault NOT IN ('b', 'd') AS may, (f.fault = 't')::INT AS cut FROM parsed p JOIN faults f ON f.name = p.name AND f.n = p.n + 1)))),
best AS (SELECT name, least(v0, v3) AS cell FROM parsed JOIN counted USING (name) WHERE n = rows),
edits AS (SELECT name, substr(cell, 10) AS audit, unnest(range(1, length(cell) - 8)) AS i FROM best),
letters AS (SELECT name, i, substr(audit, i, 1) AS edit, length(replace(audit, 'D', '')) % 2 AS odd FROM edits),
steps AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w - 1 - odd AS place FROM letters WINDOW w AS (PARTITION BY name ORDER BY i ROWS UNBOUNDED PRECEDING)),
lines AS (SELECT s.name, i, CASE edit WHEN 'K' THEN f.role ELSE ['user', 'assistant'][place % 2 + 1] END || ':' || CASE edit WHEN 'I' THEN '' ELSE f.text END AS line
  FROM steps s LEFT JOIN faults f ON f.name = s.name AND f.n = s.n AND edit <> 'I' WHERE edit <> 'D'),
texts AS (SELECT name, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY name),
every AS (SELECT DISTINCT conv_id, coalesce('+' || conv_id::VARCHAR, '-') AS name FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(cell, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(cell, 10), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM every e LEFT JOIN counted USING (name) LEFT JOIN best USING (name) LEFT JOIN texts t USING (name)
"""
