"""Similarity join over sets of word n-grams by T-occurrence search (DivideSkip), and its components.

Documents come in batches. Inverted lists are made in three exchanges of packed blocks, in which a batch
sends a gram once, however many of its documents have it:

1. lengths of inverted lists (document frequencies) for the grams with the smallest hashes;
2. back to each batch, where a document sets its long lists aside: with an overlap of T needed, one of its
   size - T + 1 grams with the shortest lists must be shared, so only those are sent on, and none that only
   this document has;
3. documents that meet in such a list and are close in size are joined to candidate clusters.

Within a cluster (large ones cut into pairs of blocks) a T-occurrence search merges the short lists, probes
the long ones and keeps the pairs with the required overlap; union gives the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import exchange_parts, give_back, mix, rows, shingle_hashes, shuffle_parts, steps, texts, unique_in_groups, written
from chronoweave.llm.components import Union, components, stars
from chronoweave.operators.skew import fits_broadcast, lookup_join

#: Bytes of text in a batch.
BATCH_BYTES = 1 << 21
#: Grams whose lists are measured, as a multiple of those that a document can differ in.
MEASURED = 2.0
#: Documents of a cluster, and grams of theirs, that one search holds at most about twice.
BLOCK = 2048
BLOCK_GRAMS = 1 << 19

ROWS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
ROWS_DDL = "kind int, key long, batch long, blob binary"
BATCH, LISTS, EDGES = range(3)
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value: each as its type, length and bytes."""
    return b"".join(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = np.dtype(blob[at:at + 4].strip().decode()), int.from_bytes(blob[at + 4:at + 12], "little")
        out.append(np.frombuffer(blob, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def gram_sets(parts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct word n-grams, ascending, one text after another, and how many each has.

    A text of fewer words has its whole sequence as one gram; a text without words has none.
    """
    return unique_in_groups(*shingle_hashes(parts, n))


def least_overlap(percent: int, sizes):
    """The overlap that two sets with this sum of sizes need."""
    return -(-percent * sizes // (100 + percent))


def _differs(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of its grams a set can lack in a set that it links with: all but ceil(percent / 100 * size)."""
    return sizes - -(-percent * sizes // 100)


def _place(grams: np.ndarray, lists: int) -> np.ndarray:
    """Identity of a gram in the exchanges: its part in the high, 32 bits of its hash in the low half."""
    h = mix(grams + np.uint64(0x51ED270B))
    return (((h >> np.uint64(32)) * np.uint64(lists) >> np.uint64(32)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _batch(number: int, doc_ids: np.ndarray, grams: np.ndarray, sizes: np.ndarray, percent: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Rows of one batch: itself, its shares of the lists, and the documents whose sets equal an earlier one's."""
    ends = np.cumsum(sizes)
    sums = [np.append(np.uint64(0), np.cumsum(mix(grams + np.uint64(c)), dtype=np.uint64)) for c in (1, 2)]
    marks = [s[ends] - s[ends - sizes] for s in sums]
    order = np.lexsort((doc_ids, marks[1], marks[0], sizes))
    same = np.zeros(len(order), bool)
    same[1:] = (sizes[order][1:] == sizes[order][:-1]) & (marks[0][order][1:] == marks[0][order][:-1]) & (marks[1][order][1:] == marks[1][order][:-1])
    same &= sizes[order] > 0
    heads = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    keep = np.ones(len(sizes), bool)
    keep[order[same]] = False
    keep &= sizes > 0
    kept = np.flatnonzero(keep)
    n = sizes[kept]
    limit = np.uint64(min((1 << 64) - 1, int(MEASURED * (100 - percent) / 100 * (1 << 64))))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(grams)) - np.repeat(ends - sizes, sizes)
    measured = grams < limit
    n_measured = np.bincount(doc[measured], minlength=len(sizes))
    # the shortest lists come first, unmeasured grams after them by hash; more are needed where few are measured
    need = _differs(sizes, percent) + 1
    own = keep[doc] & measured
    more = keep[doc] & ~measured & (nth < need[doc])
    local = np.cumsum(keep) - 1
    place, index = np.unique(_place(grams[own], lists), return_inverse=True)
    count = np.bincount(index, minlength=len(place)).astype(np.uint32)
    bounds = np.searchsorted(place, np.arange(lists + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int64)
    blob = pack(doc_ids, sizes, doc_ids[kept], n, n_measured[kept], index.astype(np.uint32), local[doc[more]].astype(np.uint32), _place(grams[more], lists), bounds)
    yield rows(ROWS, kind=[BATCH], key=[0], batch=[number], blob=[blob])
    for a in range(0, lists, 256):
        some = [i for i in range(a, min(a + 256, lists)) if bounds[i + 1] > bounds[i]]
        if some:
            blobs = [pack((place[bounds[i]:bounds[i + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), count[bounds[i]:bounds[i + 1]]) for i in some]
            yield rows(ROWS, kind=[LISTS] * len(some), key=some, batch=[number] * len(some), blob=blobs)
    found = _bucketed(doc_ids[heads[same]], doc_ids[order[same]], lists)
    if found:
        yield rows(ROWS, kind=[EDGES] * len(found), key=[k for k, _ in found], batch=[number] * len(found), blob=[x for _, x in found])


def _batches(n: int, percent: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def flush():
            return _batch(number, *(np.concatenate([h[i] for h in held]) for i in range(3)), percent, lists)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, end, parts in steps(batch, "text"):
                held.append((doc_ids[first:end], *gram_sets(parts, n)))
                size += sum(map(len, parts))
                if size >= BATCH_BYTES:
                    yield from flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield from flush()
    return run


def _lengths(table: pa.Table) -> pa.Table:
    """One part of the lists: back to each batch, the grams that other documents have too, and how many have them."""
    blocks = [unpack(b) for b in table.column("blob").to_pylist()]
    _, index = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate([b[1] for b in blocks])).astype(np.int64)[index]
    blobs, at = [], 0
    for b in blocks:
        own = total[at:at + len(b[0])]
        at += len(own)
        shared = np.flatnonzero(own > 1)
        blobs.append(pack(shared.astype(np.uint32), b[0][shared], np.minimum(own[shared], 1 << 31).astype(np.uint32)))
    return pa.Table.from_batches([rows(ROWS, kind=[LISTS] * len(blobs), key=table.column("key"), batch=table.column("batch"), blob=blobs)])


def _runs(place: np.ndarray, low: np.ndarray, high: np.ndarray, leader: np.ndarray, percent: int) -> np.ndarray:
    """Of rows in order of (place, low): the first row of each chain of rows whose sizes are close enough to link."""
    top = np.copy(high)
    group = np.append(True, place[1:] != place[:-1])
    # the largest size so far in each place
    shift = np.cumsum(group).astype(np.int64) * (int(high.max()) + 1)
    top = np.maximum.accumulate(high + shift) - shift
    new = group.copy()
    new[1:] |= 100 * top[:-1] < percent * low[1:]
    return np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))


def _prefixes(percent: int, lists: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        blobs = table.column("blob").to_pylist()
        number = table.column("batch")[0].as_py()
        out = []
        if (kinds == BATCH).any():
            _, _, doc_ids, n, n_measured, index, more_doc, more_place, bounds = unpack(blobs[int(np.flatnonzero(kinds == BATCH)[0])])
            length, low = np.ones(bounds[-1], np.int64), np.zeros(bounds[-1], np.uint64)
            keys = table.column("key").to_numpy()
            for i in np.flatnonzero(kinds == LISTS):
                at, rest, total = unpack(blobs[i])
                at = at + bounds[keys[i]]
                length[at] = total
                low[at] = (np.uint64(keys[i]) << np.uint64(32)) | rest
            doc = np.repeat(np.arange(len(n)), n_measured)
            own = length[index]
            shared = own > 1
            lone = n_measured - np.bincount(doc[shared], minlength=len(n))
            left = _differs(n, percent) + 1 - lone
            doc, place, own = doc[shared], low[index[shared]], own[shared]
            order = np.lexsort((place, own, doc))
            doc, place = doc[order], place[order]
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            pick = nth < left[doc]
            # unmeasured grams count only where all measured ones are in the prefix
            whole = left[more_doc] > (n_measured - lone)[more_doc]
            doc = np.concatenate([doc[pick], more_doc[whole]])
            place = np.concatenate([place[pick], more_place[whole]])
            order = np.lexsort((doc_ids[doc], n[doc], place))
            doc, place = doc[order], place[order]
            if len(doc):
                head = _runs(place, n[doc], n[doc], doc, percent)
                tail = np.append(head[1:] != head[:-1], True)
                first, last = np.unique(head), np.flatnonzero(tail)
                a, b = doc_ids[doc[head]], doc_ids[doc]
                out += [(EDGES, *x) for x in _bucketed(a, b, lists)]
                part = (place[first] >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(lists + 1))
                for i in np.unique(part):
                    f, t = first[cut[i]:cut[i + 1]], last[cut[i]:cut[i + 1]]
                    out.append((LISTS, int(i), pack((place[f] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[doc[f]], n[doc[t]], doc_ids[doc[f]])))
        return pa.Table.from_batches([rows(ROWS, kind=[o[0] for o in out], key=[o[1] for o in out], batch=[number] * len(out), blob=[o[2] for o in out])])
    return run


def _bucketed(a: np.ndarray, b: np.ndarray, lists: int) -> list[tuple[int, bytes]]:
    """Distinct pairs (a, b) of different documents, packed by a hash of a, so that equal pairs meet wherever they were found."""
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    bucket = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(lists)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[order], bucket[order]
    own, at = np.unique(bucket, return_index=True)
    cut = np.append(at, len(bucket)).tolist()
    return [(k, pack(pairs[x:y, 0].copy(), pairs[x:y, 1].copy())) for k, x, y in zip(own.tolist(), cut, cut[1:])]


def _meet(percent: int, lists: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = [unpack(b) for b in table.column("blob").to_pylist()]
        place, low, high, leader = (np.concatenate([b[i] for b in blocks]) for i in range(4))
        order = np.lexsort((leader, low, place))
        place, low, high, leader = place[order], low[order], high[order], leader[order]
        head = _runs(place, low, high, leader, percent)
        found = _bucketed(leader[head], leader, lists)
        n = len(found)
        return pa.Table.from_batches([rows(ROWS, kind=[EDGES] * n, key=[k for k, _ in found], batch=[0] * n, blob=[x for _, x in found])])
    return run


def _pairs_of(table: DataFrame) -> DataFrame:
    """The distinct pairs in packed rows, as stars: one pair a document and part."""
    def run(own: pa.Table) -> pa.Table:
        found = [unpack(x) for x in own.column("blob").to_pylist()]
        pairs = stars(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        return pa.Table.from_batches([rows(PAIRS, a=pairs[:, 0], b=pairs[:, 1])])
    return table.filter(F.col("kind") == EDGES).groupBy("key").applyInArrow(run, "a long, b long")


def t_occurrence(query: np.ndarray, starts: np.ndarray, lengths: np.ndarray, members: np.ndarray, least: int, after: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets after place ``after`` that occur at least ``least`` times in the lists of the query's grams, with their counts.

    DivideSkip: the L longest lists are set aside; what the short lists hold at least ``least`` - L times is a
    candidate, and the long lists are then probed for each candidate by binary search.
    """
    order = query[np.argsort(-lengths[query], kind="stable")]
    longest = int(lengths[order[0]])
    aside = min(least - 1, int(least / (0.01 * math.log2(longest + 1) + 1)))
    long, short = order[:aside], order[aside:]
    size = lengths[short]
    at = np.arange(int(size.sum())) + np.repeat(starts[short] - (np.cumsum(size) - size), size)
    merged = members[at]
    count = np.bincount(merged[merged > after], minlength=len(sizes))
    found = np.flatnonzero(count >= max(1, least - aside))
    total = count[found]
    for k, g in enumerate(long.tolist()):
        if not len(found):
            break
        own = members[starts[g]:starts[g] + lengths[g]]
        where = np.searchsorted(own, found)
        total = total + (own[np.minimum(where, len(own) - 1)] == found)
        if k % 16 == 15:
            reach = total + (aside - k - 1) >= least
            found, total = found[reach], total[reach]
    return found, total


def search(doc_ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of documents that link, enough of them to connect every component of a block."""
    out, unique = [], {}
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), doc_ids[i]))
    kept = []
    for i in order:
        head = unique.setdefault(sets[i].tobytes(), i)
        if head == i:
            kept.append(i)
        elif doc_ids[head] != doc_ids[i]:
            out.append((doc_ids[head], doc_ids[i]))
    union, parts = Union(), len(kept)
    if len(kept) < 2:
        return out
    sizes = np.array([len(sets[i]) for i in kept])
    _, grams = np.unique(np.concatenate([sets[i] for i in kept]), return_inverse=True)
    owner = np.repeat(np.arange(len(kept)), sizes)
    lengths = np.bincount(grams)
    starts = np.cumsum(lengths) - lengths
    members = owner[np.argsort(grams, kind="stable")]
    ends = np.cumsum(sizes)
    for x in range(len(kept) - 1):
        if parts == 1:
            break
        if 100 * sizes[x] < percent * sizes[x + 1]:  # no later set is close enough in size
            continue
        least = int(least_overlap(percent, 2 * int(sizes[x])))
        found, overlap = t_occurrence(grams[ends[x] - sizes[x]:ends[x]], starts, lengths, members, least, x, sizes)
        for y in found[100 * overlap >= percent * (sizes[x] + sizes[found] - overlap)].tolist():
            if union.join(x, y):
                parts -= 1
                out.append((doc_ids[kept[x]], doc_ids[kept[y]]))
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal keys, from batches in which these stand together."""
    held, now = [], None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _sets(n: int):
    schema = pa.schema([("cluster", pa.int64()), ("blocks", pa.int32()), ("doc_id", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, end, parts in steps(batch, "text"):
                flat, sizes = gram_sets(parts, n)
                ends = np.append(0, np.cumsum(sizes))
                keep = {c: batch.column(c).slice(first, end - first) for c in ("cluster", "blocks", "doc_id")}
                yield rows(schema, **keep, grams=[flat[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())])
    return run


def _links(percent: int):
    def run(batches):
        for _, table in groups(batches, ["cluster", "one", "two"]):
            sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            ids = table.column("doc_id").to_pylist()
            some = [i for i, s in enumerate(sets) if len(s)]
            found = search([ids[i] for i in some], [sets[i] for i in some], percent)
            del table, sets
            if found:
                yield rows(PAIRS, a=[a for a, _ in found], b=[b for _, b in found])
            give_back()
    return run


def similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are runs of other bytes than white space, A-Z in small; a document's set has its distinct word
    n-grams. Two documents link when 100 * intersection >= percent * union; a component is what links
    reach, named by its smallest doc_id. Null, empty and wordless texts have size 0 and are on their own. Rows
    that repeat a doc_id are one document in links and have a row each. Rows without doc_id are left out.
    """
    spark = docs.sparkSession
    lists = exchange_parts(docs)
    own = texts(docs)
    made = written(own.mapInArrow(_batches(n, percent, lists), ROWS_DDL), "gram-batches")
    lengths = made.filter(F.col("kind") == LISTS).groupBy("key").applyInArrow(_lengths, ROWS_DDL)
    cut = made.filter(F.col("kind") == BATCH).unionByName(lengths).groupBy("batch").applyInArrow(_prefixes(percent, lists), ROWS_DDL)
    cut = written(cut, "gram-prefixes")
    met = cut.filter(F.col("kind") == LISTS).groupBy("key").applyInArrow(_meet(percent, lists), ROWS_DDL)
    near = written(components(_pairs_of(met.unionByName(cut.filter(F.col("kind") == EDGES)))), "candidates")
    sized = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64())])

    def sizes(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                doc_ids, n_grams = unpack(blob)[:2]
                yield rows(sized, doc_id=doc_ids, n_shingles=n_grams)

    every = made.filter(F.col("kind") == BATCH).select("blob").mapInArrow(sizes, "doc_id long, n_shingles long")
    full = near.join(every, near["node"] == every["doc_id"]).groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("grams"))
    clusters = full.select("component", F.ceil(F.greatest(F.col("docs") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    near = lookup_join(near, clusters, ["component"]).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "blocks")
    near = F.broadcast(near) if fits_broadcast(near) else near
    sets = own.join(near, "doc_id").mapInArrow(_sets(n), "cluster long, blocks int, doc_id long, grams binary")
    # a large cluster is cut into blocks, and each pair of blocks is searched on its own
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    sets = (sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "doc_id", "grams"))
    links = (sets.repartition(shuffle_parts(spark), "cluster", "one", "two").sortWithinPartitions("cluster", "one", "two")
             .mapInArrow(_links(percent), "a long, b long"))
    found = components(written(links, "links").unionByName(_pairs_of(made)))
    return every.join(found, every["doc_id"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that have the smallest doc_id of their component, one row each, with all columns.

    Of rows that repeat a doc_id one stays; rows without doc_id go.
    """
    first = similar(docs, n, percent).filter("doc_id = component_id").select("doc_id").distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id")).dropDuplicates(["doc_id"])
    return own.join(first, "doc_id", "left_semi").select("row.*")
