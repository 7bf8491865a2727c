"""Repeated strings, near copies, mixing and the pipeline against plain versions of each."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from chronoweave.llm import mixing, ngrams, suffixes
from chronoweave.llm.components import components
from chronoweave.llm.induced import CAP, Shard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k:k + 100]
            if s in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    r = random.Random(3)
    parts = ["the ", "of ", "ab ", "x", "élan ", "\n"]
    shared = ["".join(r.choices(parts, k=k)) for k in (30, 60, 100, 300, 50)]
    rows = []
    for d in range(120):
        text = "".join(r.choice(shared)[r.randint(0, 40):] if r.random() < .6 else "".join(chr(97 + r.randrange(26)) for _ in range(r.randint(1, 900))) for _ in range(r.randint(0, 5)))
        rows.append((d * 7 - 50, "a" * r.randint(50, 700) if r.random() < .1 else text))
    return [*rows, (9000, None), (9001, ""), (9002, rows[3][1]), (9003, "ab" * 400), (9004, "zz" + "ab" * 300), (9005, "é" * 9000)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=150), min_size=1, max_size=5), st.sampled_from([0, 300, 1 << 26]))
def test_suffix_array_and_prefixes(segments, memory):
    text = np.concatenate([np.append(np.frombuffer(s.encode(), np.uint8).astype(np.uint16) + 2, np.uint16(1)) for s in segments] + [np.zeros(1, np.uint16)])
    shard = Shard(text, memory).sort()
    assert sorted(shard.suffixes.tolist()) == list(range(len(text)))
    heads = [tuple(text[i:i + CAP].tolist()) for i in shard.suffixes]
    assert heads == sorted(heads)
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]
    assert shared == shard.prefixes.tolist()


@pytest.mark.parametrize("bounds", [{}, {"hot": 3}, {"sent": 2, "hot": 5}, {"sent": 1, "hot": 1}])
def test_repeated_strings(spark, bounds):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, "q" * 300, 1, "x")], "doc_id long, text string, mark int, blob string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, **bounds).collect()}
    assert got == plain_repeats(rows)


def test_long_text_in_pieces(spark):
    r = random.Random(1)
    long = "".join(r.choices("abcdefgh ", k=suffixes.PIECE + 5000))
    again = long[suffixes.PIECE - 700:suffixes.PIECE + 900]
    rows = [(1, long), (2, "0" * 50 + again + "1" * 20)]
    got = {x.doc_id: x for x in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans) == (1600, 1)


def test_equal_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "z" * 99 + "y" * 99), (1, "z" * 99 + "y" * 99), (2, "z" * 99 + "y" * 99)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.without_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 198)]
    assert sorted(len(r.text) for r in suffixes.deduplicated(docs).collect()) == [0, 198, 198]


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies():
    r = random.Random(4)
    v = [f"W{i}" for i in range(60)]
    rows = []
    for _ in range(25):
        base = r.choices(v, k=r.choice([1, 2, 5, 11, 14, 25, 40, 80, 200]))
        for _ in range(r.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(v) if r.random() < .7 else ""
            rows.append((len(rows) * 3, "  ".join(w)))
    return [*rows, (100000, None), (100001, ""), (100002, " \n"), (100003, "A b"), (100004, "a B")]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 2048), (5, 80, 8), (1, 50, 2048)])
def test_components_of_near_copies(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows] + [(None, "a b c", 1, 2)], "doc_id long, text string, key int, component_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.similar(docs, n, percent).collect()}
    assert got == plain_components(rows, n, percent)


def test_t_occurrence_counts_all_lists():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40)) for _ in range(30)]
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(30), [len(s) for s in sets])
    lengths = np.bincount(grams, minlength=60)
    starts = np.cumsum(lengths) - lengths
    members = owner[np.argsort(grams, kind="stable")]
    for x in range(30):
        for least in (1, 8, 20):
            found, overlap = ngrams.t_occurrence(sets[x], starts, lengths, members, least, x, np.zeros(30))
            want = {y: len(np.intersect1d(sets[x], sets[y])) for y in range(x + 1, 30)}
            got = {y: o for y, o in zip(found.tolist(), overlap.tolist(), strict=True) if o >= least}
            assert got == {y: o for y, o in want.items() if o >= least}


def test_one_of_each_component_stays(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows] + [(0, rows[0][1], "s")], "doc_id long, text string, row string")
    want = plain_components(rows, 5, 80)
    got = ngrams.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in want if want[i][1] == i)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert suffixes.without_repeats(none).collect() == []
    assert ngrams.similar(none).collect() == []
    assert mixing.schedule(none).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == []


def plain_mix(rows, weights=(5, 2, 1), repeats=3):
    """Targets by sharing what full sources leave, again and again; queues word by word."""
    rows = [(i, s, len(WORD.findall((t or "").encode()))) for i, t, s in rows]
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, s, _ in rows)
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(size.values())), list(names)
    while open_ and left > 1e-9:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if target[s] + share[s] >= repeats * size[s]]
        if not full:
            for s in open_:
                target[s] += share[s]
            break
        for s in full:
            left -= repeats * size[s] - target[s]
            target[s] = repeats * size[s]
        open_ = [s for s in open_ if s not in full]
    return {i: (n, size[s], target[s]) for i, s, n in rows}, size, target


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["b", "a", "a", "a", "é", None, ""])) for i in range(300)] + [(900, None, "b"), (901, "one\ttwo\n three\x0bfour", "only")]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, size int, key string")
    got = mixing.schedule(docs).collect()
    want, size, target = plain_mix(rows)
    taken = dict.fromkeys(size, 0)
    source = {i: s for i, _, s in rows}
    for x in got:
        n, own, goal = want[x.doc_id]
        assert (x.size, x.source_size) == (n, own) and abs(x.target - goal) < 1e-6 * max(goal, 1)
        assert 0 <= x.taken <= 3 * n
        taken[source[x.doc_id]] += x.taken
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in target)
    assert sorted(map(tuple, mixing.schedule(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    copies = {x.doc_id: x.copies for x in got}
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns
    seen = [x.doc_id for x in whole.collect()]
    assert all(seen.count(i) == c for i, c in copies.items())


def test_mix_takes_repeated_rows_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (None, None, None)], "doc_id long, text string, source string")
    assert mixing.schedule(docs).count() == 4
    assert mixing.schedule(docs).groupBy("source_size").sum("taken").count() == 2


def test_stages_keep_the_columns(spark):
    r = random.Random(9)
    v = ["the", "and", "of", "thing", "other", "house", "river", "stone", "cloud", "green"]
    rows = [(i, " ".join(r.choices(v, k=r.randint(20, 80))), "en", f"s{i % 3}", 5) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 5) for i in range(5)] + [(200, "123 456", "en", "s1", 5), (201, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(sorted(x.doc_id for x in docs.collect()))
    assert ids[0] == sorted([*range(60), *range(100, 105)])
    assert ids[1] == list(range(60)) and ids[2] == ids[1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_grams_with_equal_polynomial_hashes(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    twin = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, twin), (3, word), (4, f"{word} {twin} x y"), (5, f"{twin} {word} x y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.similar(docs, 3, 90).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (2, 4), 5: (2, 5)}
    assert ngrams.gram_sets([f"{word} {twin} {word}".encode()], 1)[1].tolist() == [2]
