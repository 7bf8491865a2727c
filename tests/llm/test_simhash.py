"""Fingerprints and their links against plain versions of both."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import simhash
from chronoweave.llm.queries import op11_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, n=3):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, budget=2):
    """Smallest reachable doc_id of each (doc_id, print) row."""
    near = {a: [b for _, b in rows if (a ^ b).bit_count() <= budget] for _, a in rows}
    least = {p: min(d for d, q in rows if q == p) for p in near}
    while True:
        now = {p: min(least[q] for q in near[p]) for p in near}
        if now == least:
            return least
        least = now


def corpus():
    r = random.Random(11)
    words = ["the", "of", "Zürich", "中文", "AB", "x", "quick", "É", "\x85", "a\xa0b"]
    gaps = [" ", "  ", "\n", "\t \x0b"]
    make = lambda k: "".join(r.choice(words) + r.choice(gaps) for _ in range(k))
    rows = [(i * 3 - 40, make(r.randint(0, 40))) for i in range(150)]
    long = make(600)
    for i in range(60):  # near copies: some words of a long text changed
        own = WORD.findall(long)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = r.choice(words)
        rows.append((1000 + i, " ".join(own)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One  "), (5005, "a b"), (5006, long.upper()), (5007, long), (-40, "again"), (-40, "again")]


@pytest.mark.parametrize("bounds", [{}, {"most": 8, "step": 6}])
def test_documents_and_components(spark, bounds):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(None, "lost", "x", 1)], "doc_id long, text string, print string, node int").repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(docs, **bounds).collect()))
    prints = [(i, plain_print(t)) for i, t in rows]
    least = plain_components(prints)
    assert got == sorted((i, f"{p:016x}", least[p]) for i, p in prints)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, "0" * 16, 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "Déf", " ", "\n", "  "]), max_size=60), st.integers(1, 9), st.integers(1, 4))
def test_pieces_of_a_long_text(parts, size, n):
    text = "".join(parts)
    assert int(simhash.prints_of([text.encode()], n, size)[0]) == plain_print(text, n)


def test_a_long_text_in_the_default_pieces():
    r = random.Random(2)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(400_000))
    assert len(text) > 2 * simhash.PIECE
    assert int(simhash.prints_of([b"x", text.encode()], 3)[1]) == plain_print(text)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 255), min_size=1, max_size=60), st.sets(st.integers(0, 255), min_size=1, max_size=60),
       st.integers(0, 3), st.sampled_from([1, 5, 1 << 16]), st.booleans(), st.integers(0, 8))
def test_walk_finds_each_pair_once(first, second, budget, wide, spread, far):
    # eight bits that vary, in a row or far apart, at the end or not
    place = (lambda v: sum((v >> b & 1) << 8 * b for b in range(8))) if spread else (lambda v: v << far)
    one = np.sort(np.array([place(v) for v in first], np.uint64))
    two = np.sort(np.array([place(v) for v in second], np.uint64))
    both = [(int(a), int(b)) for a in one for b in two if int(a ^ b).bit_count() <= budget]
    assert sorted((int(one[x]), int(two[y])) for p in simhash.walk(one, two, 0, budget, wide) for x, y in zip(*p)) == sorted(both)
    alone = [(int(a), int(b)) for a in one for b in one if a < b and int(a ^ b).bit_count() <= budget]
    found = [tuple(sorted((int(one[x]), int(one[y])))) for p in simhash.walk(one, one, 0, budget, wide) for x, y in zip(*p)]
    assert sorted(found) == sorted(alone)


def test_crowded_prefix_is_opened_and_no_link_lost(spark):
    r = random.Random(4)
    centre = r.getrandbits(64)
    values = {r.getrandbits(64) for _ in range(300)} | {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    nodes = simhash.closed_nodes(prints, 16, 8).collect()
    assert max(len(n.prints) for n in nodes) <= 16 and sorted(p for n in nodes for p in n.prints) == sorted(signed)
    assert len({n.depth for n in nodes}) > 2
    edges = {(e.a, e.b) for e in simhash.links(prints, 2, 16, 8).collect()}
    least = plain_components([(v, v % (1 << 64)) for v in signed])
    up = {v: v for v in signed}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: root(v) for v in signed} == {v: least[v % (1 << 64)] for v in signed}


def test_query_reads_the_documents_table(spark):
    got = op11_simhash(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, plain_print(t)) for i, t in rows]
    least = plain_components(prints)
    assert sorted(map(tuple, got.collect())) == sorted((i, f"{p:016x}", least[p]) for i, p in prints)
