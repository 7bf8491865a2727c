"""The whole chain on a small table against plain versions of its stages, one after another."""

import base64
import hashlib
import math
import random

import public_tokenizers
import tiktoken
from llm.test_corpus import WORD, plain_mix

import corpus_pipeline
from chronoweave.llm.queries import MULTI_RANKS

ENGLISH = "the and of thing other house river stone cloud green table window water morning letter garden".split()
FRENCH = "maison rivière été déjà garçon fenêtre être où chaque lumière forêt élève après même très gâteau".split()


def corpus():
    r = random.Random(12)
    text = lambda words, k: " ".join(r.choices(words, k=k))
    rows = [(i, text(ENGLISH if i % 3 else FRENCH, r.randint(40, 90)), "en" if i % 3 else "fr", ["web", "books", "code", None][i % 4]) for i in range(80)]
    passage = text(ENGLISH, 60)
    for i in (7, 22, 31):  # a passage that stands in several documents
        rows[i] = (i, f"{rows[i][1]} {passage} {text(ENGLISH, 30)}", *rows[i][2:])
    for i in range(6):  # near copies: a word or two changed
        own = rows[i * 5][1].split()
        own[r.randrange(len(own))] = "changed"
        rows.append((100 + i, " ".join(own), rows[i * 5][2], "web"))
    rows += [(110, rows[4][1], "en", "books"), (111, rows[4][1], "en", "books")]
    foreign = [(200, "Съешь же ещё этих мягких французских булок да выпей чаю " * 4, None, "web"), (201, "123 456", "en", "web"), (202, None, None, None),
               (203, "".join(r.choices("qxzjkvwq ", k=300)), None, "books")]
    return rows, foreign


def plain_copies(rows):
    """doc_ids that are no near copy of a smaller one."""
    def grams(t):
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = {d: grams(t) for d, t, *_ in rows}, {d: d for d, *_ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {root(d) for d in sets}


def plain_kept(rows):
    """Texts without the bytes of strings of 100 bytes that start earlier."""
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(raw[k:k + 100])
        out[d] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def plain_mixed(rows):
    """doc_ids as often as the mix begins them."""
    sizes, own, target = plain_mix([(d, t, s) for d, t, _, s in rows])
    source, out = {d: s for d, _, _, s in rows}, []
    for name in own:
        start = 0
        for d in sorted((d for d in sizes if source[d] == name), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), sizes[d][0])):
            out += [d] * sum(sizes[d][0] > 0 and start + turn * own[name] < math.floor(target[name] + 1e-9) for turn in range(3))
            start += sizes[d][0]
    return out


def test_run(spark, tmp_path):
    rows, foreign = corpus()
    table = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows + foreign], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [x for x in rows if x[0] in plain_copies(rows)]  # the languages that no row teaches are gone, all others stay
    assert 6 <= len(rows) - len(kept) <= 8  # a changed word of a short text is more than a fifth of its grams
    texts = plain_kept(kept)
    assert sum(texts[d] != t for d, t, *_ in kept) >= 2
    left = [(d, texts[d], lang, s) for d, _, lang, s in kept]
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(MULTI_RANKS, "rb") if x.strip())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in plain_mixed(left):
        ids = library.encode_ordinary(texts[d])
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest()))
    assert got == sorted(want)
