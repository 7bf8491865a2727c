"""Classifiers on held-out rows, vector searches against all pairs."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import language, quality, rotated, topk

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, labels, quality.held_out())
    assert got.count() == docs.count()
    met = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (met.quality == met.predicted).mean() > 0.95
    assert ((met.score >= 0) & (met.score <= 1)).all()


def test_quality_does_not_see_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, x, quality.held_out()).collect())) for x in (labels, turned))
    assert a == b


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "fine words here", 0), (3, "fine words here", 0), (None, "x", 0)], "doc_id long, text string, label int")
    for rows in ([], [(1, 1, 5)], [(3, None, 0), (None, 1, 0), (3, 7, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, features int")
        got = quality.score(docs, labels, quality.held_out()).collect()
        assert len(got) == 4 and len({r.score for r in got}) == 1
    assert quality.score(docs.limit(0), labels, quality.held_out()).collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(1)
    x = (r.random((60, 8)) < .4).astype(float)
    y = np.where(x @ r.standard_normal(8) > 0, 1.0, -1.0)
    data = [np.flatnonzero(v) for v in x]
    w = quality.dual_coordinate_descent(data, [np.ones(len(d)) for d in data], y, 8, 1.0, 2000)
    full = np.hstack([x, np.ones((60, 1))])
    slack = np.maximum(1 - y * (full @ w), 0)
    gradient = w - 2 * full.T @ (y * slack)
    assert np.abs(gradient).max() < 1e-2


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    met = language.identify(docs, language.held_out()).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(met) == docs.count()
    held = met[met.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert met.rejected.mean() < 0.01


def test_language_edges(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the river", "en"), ("la maison et le fleuve", "fr")] * 20)]
    more = [(100, None, "en"), (101, "", "fr"), (102, "12 34!", "en"), (103, "дом река небо", None), (104, "The House", None), (104, "The House", None), (None, "the", "en")]
    docs = spark.createDataFrame([(*x, "k") for x in train + more], "doc_id long, text string, lang string, letters string")
    got = language.identify(docs, F.lit(False)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(train) + len(more) - 1
    assert all(by_id[i].lang_pred == "und" and by_id[i].rejected and by_id[i].score == 0 for i in (100, 101, 102))
    assert by_id[103].rejected and by_id[103].lang_pred in ("en", "fr")
    assert by_id[104].lang_pred == "en" and not by_id[104].rejected
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {100, 101, 102, 103}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = language.identify(docs.filter("lang is null"), F.lit(False)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in nothing} == {("und", 0.0, True)}


def strangers():
    r = random.Random(8)
    word = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(60))
    return ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
            "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
            "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
            "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
            "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。", word("bcdfghjklmnpqrstvwxz"), word("abcdefghijklmnopqrstuvwxyz"),
            base64.b64encode(r.randbytes(400)).decode()]


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(strangers())], docs.schema)
    met = language.identify(docs.unionByName(odd), language.held_out()).toPandas()
    assert met[met.doc_id >= 10**9].rejected.tolist() == [True] * len(strangers())
    own = met[(met.doc_id < 10**9) & met.held_out].merge(docs.selectExpr("doc_id", "length(text) n").toPandas(), on="doc_id")
    assert own.rejected.mean() < 0.01 and not own[own.n >= 30].rejected.any()
    assert language.accepted(docs.unionByName(odd)).filter("doc_id >= 1000000000").count() == 0


def vectors():
    r = np.random.default_rng(6)
    v = [(i, [float(x) for x in r.standard_normal(16).astype(np.float32)]) for i in range(700)]
    same = v[10][1]
    v += [(i, same) for i in range(1000, 1040)]
    odd = [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [None] + [1.0] * 15), (2200, [float("nan")] + [1.0] * 15), (2250, [float("inf")] + [1.0] * 15), (2300, [1.0, 2.0]), (2301, [2.0, 1.0]), (None, same), (10, same)]
    return v, odd


def plain(v, k, score):
    out = {}
    for q, a in v:
        if q % 50 == 0:
            best = sorted(((-score(a, b), i) for i, b in v if i != q and len(a) == len(b)))[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def cosine(a, b):
    dot = x = y = 0.0
    for p, q in zip(a, b, strict=True):
        dot, x, y = dot + p * q, x + p * p, y + q * q
    return min(1.0, max(-1.0, dot / (np.sqrt(x) * np.sqrt(y))))


@pytest.mark.parametrize("which", ["cosine", "integers"])
def test_searches(spark, which):
    v, odd = vectors()
    table = spark.createDataFrame([(*x, "b") for x in v + odd], "vec_id long, embedding array<float>, block string")
    if which == "cosine":
        got = rotated.nearest_by_cosine(table, F.col("vec_id") % 50 == 0).collect()
        want = plain([*v, (2300, [1.0, 2.0]), (2301, [2.0, 1.0])], 5, cosine)
    else:
        got = topk.top_inner_products(table, F.col("vec_id") % 50 == 0).collect()
        whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in a]) for i, a in [*v, (2100, [0.0] * 16), (2300, [1.0, 2.0]), (2301, [2.0, 1.0])]]
        want = plain(whole, 5, lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)))
    found = {}
    for r in sorted(got):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {q for q in want if want[q]}
    for q in found:
        assert [x[:2] for x in found[q]] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in found[q]], [x[2] for x in want[q]], rtol=0, atol=1e-12)


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    alone = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for table in (none, alone):
        assert rotated.nearest_by_cosine(table, F.col("vec_id") % 50 == 0).collect() == []
        assert topk.top_inner_products(table, F.col("vec_id") % 50 == 0).collect() == []


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(3)
    v = r.standard_normal((400, 64))
    q = r.standard_normal((20, 64))
    index = rotated.encode(np.zeros(64))(v)
    signs = np.unpackbits(np.frombuffer(index["bits"], np.uint8).reshape(400, -1), axis=1, count=64).astype(float) * 2 - 1
    _, corrected, _ = np.frombuffer(index["scalars"]).reshape(400, 3).T
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit(q) @ rotated.rotation(64)
    estimate = turned @ signs.T / 8 / corrected
    margin = rotated.EPSILON * np.sqrt(1 - corrected**2) / corrected / np.sqrt(63)
    assert (np.abs(estimate - unit(q) @ unit(v).T) <= margin).mean() > 0.999


def test_sorted_lists_keep_the_best():
    r = random.Random(4)
    v = np.array([[r.randint(-40, 40) for _ in range(6)] for _ in range(300)], np.int64)
    places = np.frombuffer(topk.ranks(v)["places"], np.int32).reshape(v.shape)
    queries = np.arange(0, 300, 10)
    barred = queries[:, None] == np.arange(300)[None, :]
    for scale in (1, 1 << 24):
        left = topk.search_block(v[queries] * scale, v * scale, places, barred, 5)
        for row, i in enumerate(queries):
            best = sorted((j for j in range(300) if j != i), key=lambda j: (-int(v[i] @ v[j]), j))[:5]
            assert set(best) <= set(np.flatnonzero(left[row])) and not left[row, i]
        assert left.sum(1).mean() < 60
    assert topk.search_block(np.zeros((1, 6), np.int64), v, places, barred[:1], 5).sum() == 299
