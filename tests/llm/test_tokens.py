"""Byte-level BPE, wavelet matrices and URL verdicts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import bpe, urls, wavelet
from chronoweave.llm.queries import BYTE_BPE, END_ID, MULTI_RANKS, op6_wavelet

ODD = ["a", "'", "s", "t", "re", " ", "  ", "\n", "\t", "1", "²", "é", "!", "ll", "\x85", "\xa0", "\0", "'ve", "中", "٣", "_", "½", "ª", "\u2009", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(MULTI_RANKS, "rb") if x.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    r = random.Random(5)
    return ["".join(r.choices(ODD, k=r.randint(0, 25))) for _ in range(n)] + ["", " ", "it's x''s 's", "word" * 400]


def test_matches_are_encoded_as_the_whole_text(library):
    codec = bpe.RankFile(MULTI_RANKS, public_tokenizers.PATTERN)
    many = odd_texts(3000)
    ids, sizes = codec.encode(many)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [library.encode_ordinary(t) for t in many]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_pieces_of_a_text_have_its_ids(text, limit):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" a": 257, b"\n\n": 258}
    library = tiktoken.Encoding("tiny", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = list(bpe.safe_pieces(text, limit))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_round_trip_and_decoding(spark, library):
    many = odd_texts(200)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(many)] + [(900, None, "x"), (None, "lost", "x"), (0, many[0], "x")], "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, MULTI_RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(many) + 2
    for r in got:
        text = "" if r.doc_id == 900 else many[r.doc_id]
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, MULTI_RANKS, public_tokenizers.PATTERN), MULTI_RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.bytes).decode() == ("" if r.doc_id == 900 else many[r.doc_id]) for r in back)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, MULTI_RANKS, public_tokenizers.PATTERN).collect() == []
    assert wavelet.stored(none, BYTE_BPE, END_ID).collect() == []
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=70))
def test_wavelet_matrix(values):
    v = np.array(values, np.uint16)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(v, 4).to_bytes())
    assert w.values().tolist() == values
    assert w.access(np.arange(len(v))).tolist() == values
    for x in range(11):
        where = [i for i, y in enumerate(values) if y == x]
        assert w.count(x) == len(where)
        assert w.count(x, len(v) // 3, len(v) // 2) == sum(len(v) // 3 <= i < len(v) // 2 for i in where)
        assert [w.select(x, k) for k in range(len(where))] == where and w.select(x, len(where)) == -1


def test_files_hold_all_documents_in_order(spark, monkeypatch):
    many = odd_texts(300)
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    docs = spark.createDataFrame([(7 * i - 400, t) for i, t in enumerate(many)] + [(5000, None)], "doc_id long, text string").repartition(3)
    got = sorted(wavelet.stored(docs, BYTE_BPE, END_ID).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, t in zip(got, [*many, ""], strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_added_tokens_of_the_query_are_the_librarys(spark, tmp_path):
    many = [*odd_texts(300), "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "é<|endoftext|><|endoftext|>中"]
    library = Tokenizer.from_file(BYTE_BPE)
    assert 50256 in library.encode(many[-4], add_special_tokens=False).ids
    spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op6_wavelet(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, t in zip(got, many, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_urls(spark):
    cases = {
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "https://WWW.Example.org/es/casino?q": ("www.example.org", "/es/casino", "example.org/es/", "block"),
        "http://example.org/en/12#casino": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://shop.com/de/x": ("shop.com", "/de/x", "com/de/", "block"),
        "http://shop.com/en/casino": ("shop.com", "/en/casino", None, "block"),
        "http://shop.com/en/casinos": ("shop.com", "/en/casinos", None, "allow"),
        "http://free-bets.net/": ("free-bets.net", "/", None, "block"),
        "http://free-free.net/": ("free-free.net", "/", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "a://b?c://d/e": ("b", "", None, "allow"),
    }
    rows = [(i, u, "x", 1) for i, u in enumerate(cases)] + [(90, None, "x", 1), (None, "http://a.org/x", "x", 1)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, strict_hits int")).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    assert (got[90].host, got[90].rule, got[90].verdict) == ("", None, "allow") and got[None].verdict == "allow"


def thue_morse(n=1024):
    """A word and its complement, whose polynomial hashes modulo a power of two are equal for every odd base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_matches_with_equal_hashes(library):
    codec = bpe.RankFile(MULTI_RANKS, public_tokenizers.PATTERN)
    t, u = thue_morse()
    for many in ([t, u], [u, t + " " + u, "x"], [t]):
        ids, sizes = codec.encode(many)
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(x) for x in many]
