"""Removal of byte strings that stand earlier in the corpus, by suffix arrays of shards.

Every string of ``length`` bytes has one anchor: its gram of ``GRAM`` bytes with the smallest hash, the first if
there are several. Equal strings have equal anchors, so a shard that holds all strings of its anchors can be
sorted on its own. Consecutive strings with one anchor are one segment of text.

1. In each batch of documents, a segment that repeats another is covered whole; the others are sent to the part of
   their anchor's hash, as hashes.
2. Parts find segments that repeat across batches, and anchors with several different segments.
3. Only the segments of such anchors are cut out of the texts and dealt into shards by anchor (those of a very
   frequent anchor into several). Induced sorting gives each shard's suffix array with common prefixes: runs
   with prefixes of ``length`` hold the equal strings. For anchors in several shards a shard's first
   occurrences are compared across shards in a last aggregation.
4. All covered runs meet their document, which drops their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import _INVERSE, _power, exchange_parts, give_back, mix, prefix_sums, rows, shuffle_parts, span_hashes, steps, texts, written
from chronoweave.llm.induced import CAP, Shard
from chronoweave.llm.ngrams import groups, pack, unpack

LENGTH = CAP
GRAM = 32
#: Bytes of text in a batch, and of a piece of a longer text.
BATCH_BYTES = 1 << 21
PIECE = 1 << 22
#: Bytes of text that are hashed at once.
STEP = 1 << 18
#: Different segments of one anchor that a batch sends on as hashes, and that one shard takes.
SENT = 64
HOT = 20_000
#: Bytes of a shard, beyond which the next group of an anchor starts another.
SHARD_BYTES = 1 << 20

ROWS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary())])
ROWS_DDL = "kind int, key long, doc_id long, mark long, blob binary"
HASHES, COVERED, WANTED = range(3)


def anchors(data: np.ndarray, begins: np.ndarray, gram: int = GRAM, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand one after another: first byte, end byte, hash of the anchor, hash of the segment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    hashes = mix((sums[gram:] - sums[:-gram]) * _power(_INVERSE, n - gram + 1))
    width = length - gram + 1
    keys = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    # least key of each window: of the rest of its block and of the start of the next
    pad = -len(keys) % width
    blocks = np.append(keys, np.full(pad, ~np.uint64(0))).reshape(-1, width)
    windows = n - length + 1
    least = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    np.minimum.accumulate(blocks, axis=1, out=blocks)
    least = np.minimum(least, blocks.ravel()[width - 1:width - 1 + windows])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int32)
    del blocks, keys, least
    sizes = np.diff(begins)
    whole = np.maximum(sizes - length + 1, 0)
    at = np.arange(int(whole.sum())) + np.repeat(begins[:-1] - (np.cumsum(whole) - whole), whole)
    own = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    end = at[np.append(new[1:], True)] + length if len(at) else first
    return first, end, hashes[own[new]], span_hashes(sums, first, end)


def merged(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans of each document, ascending."""
    if not len(doc):
        return doc, first, end
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], end[order]
    _, group = np.unique(doc, return_inverse=True)
    shift = group.astype(np.int64) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + shift)
    new = np.append(True, (first + shift)[1:] > top[:-1])
    new[1:] |= doc[1:] != doc[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return doc[new], first[new], top[last] - shift[last]


def _span_rows(doc_ids, marks, doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    doc, first, end = merged(doc, first, end)
    if len(doc):
        own, at = np.unique(doc, return_index=True)
        cut = np.append(at, len(doc)).tolist()
        blobs = [pack(first[a:b], end[a:b]) for a, b in zip(cut, cut[1:])]
        yield rows(ROWS, kind=[COVERED] * len(own), key=[0] * len(own), doc_id=doc_ids[own], mark=marks[own], blob=blobs)


def _want_rows(doc_ids, marks, doc, start, size, anchor, salt) -> Iterator[pa.RecordBatch]:
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, size, anchor, salt = doc[order], start[order], size[order], anchor[order], salt[order]
        own, at = np.unique(doc, return_index=True)
        cut = np.append(at, len(doc)).tolist()
        blobs = [pack(start[a:b], size[a:b], anchor[a:b], salt[a:b]) for a, b in zip(cut, cut[1:])]
        yield rows(ROWS, kind=[WANTED] * len(own), key=[0] * len(own), doc_id=doc_ids[own], mark=marks[own], blob=blobs)


def _repeats(segment: np.ndarray, anchor: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, segment and occurrence, and which rows in it have an equal segment before them."""
    order = np.lexsort((start, rank, segment, anchor))
    same = np.zeros(len(order), bool)
    same[1:] = (segment[order][1:] == segment[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    return order, same


def _later(order: np.ndarray, same: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows that repeat another, but for those at its very place (a row that stands in the table twice)."""
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    twice = (rank[order] == rank[head]) & (start[order] == start[head])
    return order[same & ~twice]


def _batch(doc_ids: np.ndarray, marks: np.ndarray, doc, start, size, anchor, segment, parts: int, number: int, sent: int) -> Iterator[pa.RecordBatch]:
    ids, own = np.unique(np.stack([doc_ids, marks], 1), axis=0, return_inverse=True)
    rank = own.ravel()[doc]
    doc_ids, marks = ids[:, 0].copy(), ids[:, 1].copy()
    order, same = _repeats(segment, anchor, rank, start)
    late = _later(order, same, rank, start)
    yield from _span_rows(doc_ids, marks, rank[late], start[late], start[late] + size[late])
    kept = order[~same]  # in order of anchor
    rank, start, size, anchor, segment = rank[kept], start[kept], size[kept], anchor[kept], segment[kept]
    new = np.append(True, anchor[1:] != anchor[:-1]) if len(anchor) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchor)))
    often = np.repeat(count > sent, count)
    # a very frequent anchor's segments are wanted for certain; the others need to know of one of them only
    salt = (mix(rank[often].astype(np.uint64) + np.uint64(number)) >> np.uint64(1) << np.uint64(1)) | np.uint64(1)
    yield from _want_rows(doc_ids, marks, rank[often], start[often], size[often], anchor[often], salt)
    send = ~often | new
    rank, start, size, anchor, segment, often = rank[send], start[send], size[send], anchor[send], segment[send], often[send]
    # anchors are minima, so their own high bits are small
    part = ((mix(anchor) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((start, rank, part))
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    keys, blobs = [], []
    for i in range(parts):
        o = order[cut[i]:cut[i + 1]]
        if len(o):
            used, local = np.unique(rank[o], return_inverse=True)
            blobs.append(pack(doc_ids[used], marks[used], np.bincount(local).astype(np.uint32), start[o], size[o].astype(np.uint8), often[o].astype(np.uint8), anchor[o], segment[o]))
            keys.append(i)
    for a in range(0, len(keys), 64):
        k = keys[a:a + 64]
        yield rows(ROWS, kind=[HASHES] * len(k), key=k, doc_id=[0] * len(k), mark=[0] * len(k), blob=blobs[a:a + 64])


def _hashes(parts: int, sent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, docs = TaskContext.get().partitionId() << 24, [], 0, 0

        def flush():
            return _batch(*(np.concatenate([h[i] for h in held]) for i in range(7)), parts, number, sent)

        for batch in batches:
            doc_ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for first, end, many in steps(batch, "text", STEP):
                # a long text in pieces that overlap by one byte less than a string
                cuts = [(i, a) for i, p in enumerate(many) for a in (range(0, max(1, len(p) - LENGTH + 1), PIECE) if len(p) > PIECE else (0,))]
                for g in range(0, len(cuts), len(cuts) if len(many) > 1 else 1):
                    some = cuts[g:g + (len(cuts) if len(many) > 1 else 1)]
                    pieces = [many[i][a:a + PIECE + LENGTH - 1] if len(many[i]) > PIECE else many[i] for i, a in some]
                    begins = np.append(0, np.cumsum([len(p) for p in pieces]))
                    a, b, anchor, segment = anchors(np.frombuffer(b"".join(pieces), np.uint8), begins)
                    piece = np.searchsorted(begins, a, "right") - 1
                    of, offset = np.array([i for i, _ in some])[piece], np.array([x for _, x in some])[piece]
                    held.append((doc_ids[first:end][:0], marks[:0], of + docs, (a - begins[piece] + offset), b - a, anchor, segment))
                held.append((doc_ids[first:end], marks[first:end], *(x[:0] for x in held[-1][2:])))
                docs += end - first
                size += sum(map(len, many))
                if size >= BATCH_BYTES:
                    yield from flush()
                    number, held, size, docs = number + 1, [], 0, 0
        if held:
            yield from flush()
    return run


def _across(table: pa.Table, hot: int) -> pa.Table:
    """One part of the anchors: segments that repeat across batches, and those whose anchor has several."""
    doc_ids, marks, start, size, often, anchor, segment = [], [], [], [], [], [], []
    for blob in table.column("blob").to_pylist():
        ids, own, count, *rest = unpack(blob)
        doc_ids.append(np.repeat(ids, count))
        marks.append(np.repeat(own, count))
        for to, x in zip((start, size, often, anchor, segment), rest, strict=True):
            to.append(x)
    doc_ids, marks, start, size, often, anchor, segment = (np.concatenate(x) for x in (doc_ids, marks, start, size, often, anchor, segment))
    by_id = np.lexsort((marks, doc_ids))
    new = np.append(True, (doc_ids[by_id][1:] != doc_ids[by_id][:-1]) | (marks[by_id][1:] != marks[by_id][:-1]))
    rank = np.empty(len(doc_ids), np.int64)
    rank[by_id] = np.cumsum(new) - 1
    doc_ids, marks = doc_ids[by_id][new], marks[by_id][new]
    size = size.astype(np.int64)
    order, same = _repeats(segment, anchor, rank, start)
    late = _later(order, same, rank, start)
    out = list(_span_rows(doc_ids, marks, rank[late], start[late], start[late] + size[late]))
    heads = order[~same]
    group = np.cumsum(np.append(True, anchor[heads][1:] != anchor[heads][:-1])) - 1
    count = np.bincount(group)
    spread = np.bincount(group, weights=often[heads]) > 0
    spread |= count > hot
    # a salt of 0 keeps an anchor in one shard; an odd one says that others hold it too
    parts = -(-count // hot)[group].astype(np.uint64)
    salt = np.where(spread[group], mix(rank[heads].astype(np.uint64)) % np.maximum(parts, 1) * np.uint64(2) + np.uint64(1), np.uint64(0))
    take = ((count > 1) | spread)[group] & (often[heads] == 0)
    heads = heads[take]
    out += _want_rows(doc_ids, marks, rank[heads], start[heads], size[heads], anchor[heads], salt[take])
    return pa.Table.from_batches(out, ROWS) if out else ROWS.empty_table()


SEGMENTS = pa.schema([("anchor", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("segment", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted segments of each text."""
    for batch in batches:
        doc_ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
        for first, end, many in steps(batch, "text"):
            found = [[unpack(b) for b in blobs.as_py()] for blobs in batch.column("blobs").slice(first, end - first)]
            start, size, anchor, salt = (np.concatenate([f[k] for own in found for f in own]) for k in range(4))
            count = [sum(len(f[0]) for f in own) for own in found]
            text = np.repeat(np.arange(end - first), count)
            cut = [many[t][a:a + n] for t, a, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield rows(SEGMENTS, anchor=anchor.view(np.int64), salt=salt.view(np.int64), doc_id=doc_ids[first:end][text], mark=marks[first:end][text],
                       start=start, segment=cut)


FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("blob", pa.binary()), ("at", pa.int64())])
FOUND_DDL = ROWS_DDL + ", at long"


def _first_of_shard(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Sort a shard; its covered runs, and the first occurrences of strings whose anchor other shards have too."""
    table = pa.concat_tables(tables).combine_chunks()
    segments = table.column("segment").to_pylist()
    doc_ids, marks, start, salt = (table.column(c).to_numpy() for c in ("doc_id", "mark", "start", "salt"))
    order = np.lexsort((start, marks, doc_ids))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = np.array([len(s) for s in segments])
    begins = np.append(0, np.cumsum(sizes + 1))
    text = np.zeros(begins[-1] + 1, np.uint16)
    text[:-1] = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:-1] += 2
    text[begins[1:] - 1] = 1
    text[-1] = 0
    shard = Shard(text).sort()
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    offset = np.arange(len(of), dtype=np.int32) - begins[:-1].astype(np.int32)[of]
    at, group = shard.suffixes, np.cumsum(shard.prefixes < LENGTH, dtype=np.int32)
    del shard, text
    real = at < len(of)
    at, group = at[real], group[real]
    real = offset[at] <= sizes[of[at]] - LENGTH
    at, group = at[real], group[real]
    seg, offset = of[at], offset[at]
    # occurrences of each string in the order of the corpus
    order = np.lexsort((start[seg] + offset, marks[seg], doc_ids[seg], group))
    seg, offset, group = seg[order], offset[order], group[order]
    head = np.append(True, group[1:] != group[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    place = start[seg] + offset
    twice = (doc_ids[seg] == doc_ids[seg][first]) & (marks[seg] == marks[seg][first]) & (place == place[first])
    late = np.flatnonzero(~head & ~twice)
    ids, own = np.unique(np.stack([doc_ids, marks], 1), axis=0, return_inverse=True)
    own = own.ravel()
    found = list(_span_rows(ids[:, 0], ids[:, 1], own[seg[late]], place[late], place[late] + LENGTH))
    for batch in found:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], schema=FOUND)
    open_ = np.flatnonzero(head & (salt[seg] & 1 == 1))
    for a in range(0, len(open_), 1 << 14):
        o = open_[a:a + (1 << 14)]
        strings = [segments[s][k:k + LENGTH] for s, k in zip(seg[o].tolist(), offset[o].tolist(), strict=True)]
        yield rows(FOUND, kind=[WANTED] * len(o), key=[0] * len(o), doc_id=doc_ids[seg[o]], mark=marks[seg[o]], blob=strings, at=place[o])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for _, table in groups(batches, ["anchor", "salt"]):
        if table.num_rows < 2 and not table.column("salt")[0].as_py() & 1:
            continue
        held.append(table)
        size += table.column("segment").nbytes
        if size >= SHARD_BYTES:
            yield from _first_of_shard(held)
            held, size = [], 0
            give_back()
    if held:
        yield from _first_of_shard(held)
    give_back()


REMOVED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, many in steps(batch, "text"):
                n, removed, spans, hashes, kept = [], [], [], [], []
                for i, text in enumerate(many):
                    found = [unpack(b) for b in batch.column("covered")[first + i].as_py() or ()]
                    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                    b = np.concatenate([f[1] for f in found]) if found else a
                    _, a, b = merged(np.zeros(len(a), np.int64), a, b)
                    cut = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                    left = b"".join(text[x:y] for x, y in zip(cut[::2], cut[1::2], strict=True))
                    n.append(len(text))
                    removed.append(len(text) - len(left))
                    spans.append(len(a))
                    hashes.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if keep_bytes else None)
                yield rows(REMOVED, doc_id=batch.column("doc_id").slice(first, end - first), mark=batch.column("mark").slice(first, end - first), n_bytes=n, n_removed=removed, n_spans=spans, kept_sha256=hashes, kept=kept)
    return run


def covered(docs: DataFrame, sent: int = SENT, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The texts dealt out by doc_id, and the runs of bytes that each must lose: kind, key, doc_id, mark, blob."""
    parts = shuffle_parts(docs.sparkSession)
    own = texts(docs).withColumn("mark", F.xxhash64("text"))
    hashes = own.mapInArrow(_hashes(exchange_parts(docs), sent), ROWS_DDL)
    # what a batch knows for itself passes through the exchange with the rest
    spread = hashes.withColumn("key", F.when(F.col("kind") == HASHES, F.col("key")).otherwise(-1 - F.pmod(F.col("doc_id"), F.lit(parts))))

    def part(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == HASHES:
            return _across(table, hot)
        return table.select(ROWS.names).cast(ROWS)

    known = written(spread.groupBy("key").applyInArrow(part, ROWS_DDL), "repeats")
    dealt = own.repartition(parts, "doc_id")
    wanted = known.filter(F.col("kind") == WANTED).groupBy("doc_id", "mark").agg(F.collect_list("blob").alias("blobs"))  # no more than its text
    segments = (dealt.join(wanted, ["doc_id", "mark"]).mapInArrow(_cut, "anchor long, salt long, doc_id long, mark long, start long, segment binary")
                .repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt"))
    found = written(segments.mapInArrow(_shards, FOUND_DDL), "shards")
    firsts = found.filter(F.col("kind") == WANTED)
    least = firsts.groupBy("blob").agg(F.min(F.struct("doc_id", "mark", "at")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = firsts.join(least, "blob").filter(F.struct("doc_id", "mark", "at") != F.col("least")).select("doc_id", "mark", "at")

    def whole(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            blobs = [pack(np.array([a]), np.array([a + LENGTH])) for a in at.tolist()]
            n = batch.num_rows
            yield rows(ROWS, kind=[COVERED] * n, key=[0] * n, doc_id=batch.column("doc_id"), mark=batch.column("mark"), blob=blobs)

    runs = (known.filter(F.col("kind") == COVERED).unionByName(found.filter(F.col("kind") == COVERED).drop("at"))
            .unionByName(late.mapInArrow(whole, ROWS_DDL)))
    return dealt, runs


def without_repeats(docs: DataFrame, keep_bytes: bool = False, sent: int = SENT, hot: int = HOT) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_bytes, n_removed, n_spans, kept_sha256, kept of every document.

    Every byte goes that a string of ``LENGTH`` bytes covers which also starts earlier: in a document with a
    smaller doc_id, or in the same one before. Strings are judged on the input and never cross documents.
    Null and short texts lose nothing. Rows without doc_id are left out; rows that repeat a doc_id are
    documents in the order of ``mark``, and rows equal in both are one document with a row each.
    """
    dealt, runs = covered(docs, sent, hot)
    runs = runs.groupBy("doc_id", "mark").agg(F.collect_list("blob").alias("covered"))  # no more than its text
    return dealt.join(runs, ["doc_id", "mark"], "left").mapInArrow(_remove(keep_bytes), "doc_id long, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts (bytes of cut characters dropped) and their n_chars; all columns.

    Rows without doc_id keep their texts.
    """
    runs = covered(docs)[1].groupBy("doc_id", "mark").agg(F.collect_list("blob").alias("covered"))  # no more than its text
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    met = own.join(runs, ["doc_id", "mark"], "left")
    left = F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(_left(F.col("row.text"), F.col("covered")))
    met = met.select("row", left.alias("left"), F.col("covered").isNotNull().alias("cut"))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("cut"), F.length("left").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return met.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _left(text, runs):
    @F.pandas_udf("string")
    def run(texts_, found):
        out = []
        for t, f in zip(texts_, found, strict=True):
            if f is not None and t is not None:
                spans = [unpack(b) for b in f]
                a, b = np.concatenate([x[0] for x in spans]), np.concatenate([x[1] for x in spans])
                _, a, b = merged(np.zeros(len(a), np.int64), a, b)
                raw = t.encode()
                cut = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                t = b"".join(raw[x:y] for x, y in zip(cut[::2], cut[1::2], strict=True)).decode("utf-8", "ignore")
            out.append(t)
        return texts_.__class__(out, dtype=object)
    return run(text, runs)
