"""Repaired conversations against a plain left-to-right search and against all edits of short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import repair
from chronoweave.llm.queries import op12_repair

LEGAL = re.compile(r"(s?(ua)+)?")
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_audit(rows):
    """Cheapest (cost, audit) of rows (initial, must go, truncated), kept for each state from the first row to the last."""
    def insert(best):
        for _ in range(4):
            for p, (c, w) in list(best.items()):
                for role in "ua":
                    q = STEP[p].get(role)
                    if q and (q not in best or (c + 2, w + "I") < best[q]):
                        best[q] = (c + 2, w + "I")
        return best

    best = insert({"": (0, "")})
    for initial, must, cut in rows:
        now = {}
        for p, (c, w) in best.items():
            options = [(p, c + 3, w + "D")]
            if not must:
                options += [(STEP[p].get(initial), c + cut, w + "K"), *((STEP[p].get(r), c + 2 + cut, w + "R") for r in "ua")]
            for q, cost, word in options:
                if q is not None and (q not in now or (cost, word) < now[q]):
                    now[q] = (cost, word)
        best = insert(now)
    return min(best[p] for p in ("", "a") if p in best)


def every_audit(rows):
    """The same over all edits with up to four insertions."""
    found = []
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(must and e != "D" for e, (_, must, _) in zip(edits, rows)):
            continue
        for extra in range(5):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), extra):
                word, cost, slots = "", 2 * extra, []
                for i in range(len(rows) + 1):
                    word += "I" * places.count(i)
                    slots += ["ua"] * places.count(i)
                    if i < len(rows):
                        word += edits[i]
                        initial, _, cut = rows[i]
                        cost += {"K": cut, "R": 2 + cut, "D": 3}[edits[i]]
                        slots += {"K": [initial], "R": ["ua"], "D": []}[edits[i]]
                if any(LEGAL.fullmatch("".join(pick)) for pick in itertools.product(*slots)):
                    found.append((cost, word))
    return min(found)


MARK = st.sampled_from([("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("s", 0, 1), ("u", 0, 1), ("a", 0, 1), ("t", 0, 0), (" ", 0, 1), ("u", 1, 0)])


def marks(rows):
    return "".join("x" if must else m.upper() if cut else m for i, must, cut in rows for m in [i if i in "sua" else "o"])


@settings(max_examples=60, deadline=None)
@given(st.lists(MARK, max_size=3))
def test_cheapest_of_all_edits(rows):
    assert every_audit(rows) == plain_audit(rows) == repair.cheapest(repair.span_cells(marks(rows)))


@settings(max_examples=300, deadline=None)
@given(st.lists(MARK, max_size=40), st.integers(0, 40))
def test_any_division_gives_the_same(rows, at):
    want = plain_audit(rows)
    own = marks(rows)
    assert repair.cheapest(repair.span_cells(own)) == want
    assert repair.cheapest(repair.combine(repair.span_cells(own[:at]), repair.span_cells(own[at:]))) == want
    assert LEGAL.fullmatch("".join(r for r in repair.roles(want[1]) if r))


def plain(table):
    """conv_id -> all columns, from rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            rows += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        name = "-" if conv is None else f"+{conv}"
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(name)}:{name}:{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain_audit([(r[:1], f in ("b", "d"), f == "t") for (_, r, _), f in zip(rows, faults)])
        edits, kept, at = iter(audit), [], -((len(audit) - audit.count("D")) % 2)
        todo = iter(rows)
        for e in edits:
            row = next(todo) if e != "I" else None
            if e != "D":
                name = "system" if at < 0 else ("user", "assistant")[at % 2]
                kept.append(f"{name}:" if e == "I" else f"{row[1] if e == 'K' else name}:{row[2]}")
                at += 1
        turns = [t for t, _, _ in rows if t is not None]
        starts = [r[:1] for _, r, _ in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def odd_table():
    r = random.Random(6)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "USER"]
    texts = ["Yes.", "No", "Well!  \n", " \t", "", None, "a\nb?", "…", "Yes.", "x" * 300, "é."]
    rows = [(c, t if r.random() < .95 else None, r.choice(roles[:3] if r.random() < .9 else roles), r.choice(texts)) for c in range(60) for t in r.sample(range(12), r.randint(1, 9))]
    rows += [(70, t, r.choice(roles[:2]), r.choice(texts) if t % 3 else f"said {t}.") for t in range(700)]  # most rows in one conversation
    rows += [(71, 5, "user", "Same."), (71, 5, "user", "Same."), (71, 5, "assistant", "Same."), (71, -2, "system", "x")]
    rows += [(None, t, "user", "lost.") for t in (1, 2, None)] + [(80, None, "system", "All null."), (81, 3, "system", "z" * 200_000)]
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_conversations(spark, parts):
    table = odd_table()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.createDataFrame([(*r, 1, "k") for r in table], "conv_id long, turn long, role string, text string, cost int, audit string").repartition(5)
        assert result(repair.repaired(rows)) == plain(table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    schema = "conv_id long, turn long, role string, text string"
    assert result(repair.repaired(spark.createDataFrame([(5, gone, "user", "Hi.")], schema))) == {5: nothing}
    assert repair.repaired(spark.createDataFrame([], schema)).collect() == []


def test_names_of_conversations_may_be_strings(spark):
    rows = [("a", t, "user", "Hi.") for t in range(6)] + [(" ", 1, "assistant", "x."), (None, 1, "user", "y.")]
    assert result(repair.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))) == plain(rows)


def test_query_reads_the_conversations_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op12_repair(spark, "/root/testdata/sf0.01")) == plain(rows)


def test_sql_says_the_same():
    import duckdb
    import pyarrow as pa
    con = duckdb.connect()
    table = odd_table()
    con.register("conversations", pa.table({c: [r[i] for r in table] for i, c in enumerate(("conv_id", "turn", "role", "text"))}))
    got = con.execute(repair.SQL)
    names = [d[0] for d in got.description]
    rows = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == plain(table)
