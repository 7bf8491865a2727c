"""SimHash fingerprints of texts, linked within a Hamming distance by a self-join of their binary trie.

The fingerprints of a corpus are the leaves of a binary trie of their bits. Two nodes of one depth differ in some of
the bits on their ways down; a pair of nodes goes on to its pairs of children as long as these bits are within the
error budget. The upper part of the trie is a table: nodes with more leaves than ``MOST`` are opened ``STEP`` bits
further, and pairs of nodes go down with them by joins. What is left are pairs of closed nodes, each of at most
``MOST`` distinct fingerprints, and a task walks each pair down to the leaves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import rows, shingle_hashes, steps, texts, written
from chronoweave.llm.components import components
from chronoweave.operators.skew import broadcast_if_small, lookup_join

BITS = 64
SEED = 42
#: Fingerprints of a closed node of the trie, and bits by which a crowded node is opened.
MOST = 1 << 15
STEP = 4
#: Bytes of a text that are hashed at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Pairs of nodes that a task takes one bit further at once.
WIDE = 1 << 16

_SPACE = re.compile(rb"[ \t-\r]")


# ---- fingerprints

def _bit_counts(parts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many of its shingles' hashes have each bit set (one column a bit), and its number of shingles."""
    hashes, shingles = shingle_hashes(parts, n, SEED)
    owner = np.repeat(np.arange(len(parts)), shingles)
    out = np.zeros((len(parts), BITS), np.int64)
    for some in range(0, len(hashes), WIDE):
        bits = np.unpackbits(hashes[some:some + WIDE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts_here, starts = np.unique(owner[some:some + WIDE], return_index=True)
        out[texts_here] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return out, shingles


def _pieces(text: bytes, n: int, size: int) -> Iterator[bytes]:
    """A long text in pieces that end at white space; each begins with the last n - 1 words of the one before.

    The shingles of the pieces are the shingles of the text, each once. A piece has at least n words unless the text has fewer.
    """
    at, tail, some = 0, b"", False
    while at < len(text):
        space = _SPACE.search(text, at + size - 1)
        end = space.end() if space else len(text)
        piece, at = tail + text[at:end], end
        own = piece.rsplit(None, n)
        if len(own) < n and (some or at < len(text)):
            tail = piece
            continue
        tail = b" ".join(own[-(n - 1):]) + b" " if n > 1 else b""
        some = True
        yield piece


def _prints(sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """A bit is 1 if more than half of the hashes have it."""
    return np.packbits(2 * sums > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def prints_of(parts: list[bytes], n: int, piece: int = PIECE) -> np.ndarray:
    """The fingerprints of some texts."""
    long = [i for i, p in enumerate(parts) if len(p) > piece]
    sums, totals = _bit_counts([b"" if len(p) > piece else p for p in parts], n)
    for i in long:
        for part in _pieces(parts[i], n, piece):
            more, count = _bit_counts([part], n)
            sums[i] += more[0]
            totals[i] += count[0]
    return _prints(sums, totals)


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, print (64 bits) of every document.

    Words are runs of other bytes than space and 9 to 13, A-Z in small. The hashes are XXH64 (seed 42) of the
    word n-grams, repeats included, joined by one space; of the whole sequence where a text has fewer words.
    Null, empty and wordless texts have print 0. Each row has its own; rows without doc_id are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, parts in steps(batch, "text"):
                yield rows(schema, doc_id=batch.column("doc_id").slice(first, end - first), print=prints_of(parts, n).view(np.int64))

    return texts(docs).mapInArrow(run, "doc_id long, print long")


# ---- the trie's upper part, as tables

def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("print", BITS - depth) if depth else F.lit(0).cast("long")


def _above(node: str, bits: Column) -> Column:
    """A node's ancestor, so many bits further up."""
    return F.call_function("shiftrightunsigned", F.col(node), bits)


def closed_nodes(prints: DataFrame, most: int = MOST, step: int = STEP) -> DataFrame:
    """depth, node (the first ``depth`` bits), prints (array): every fingerprint in one node with at most ``most``.

    The first cut is as deep as evenly spread fingerprints need; nodes still too full are opened ``step`` bits at a time.
    """
    n, depth = prints.count(), 0
    while n >> depth > most:
        depth += step
    left, parts = prints.select("print"), []
    while True:
        named = left.withColumns({"depth": F.lit(depth), "node": _prefix(depth)})
        crowded = written(named.groupBy("node").count().filter(F.col("count") > most).select("node", F.lit(True).alias("crowded")), "crowded")
        if crowded.isEmpty():
            parts.append(named)
            break
        marked = named.join(broadcast_if_small(crowded), "node", "left")
        parts.append(marked.filter("crowded is null").select("print", "depth", "node"))
        left = written(marked.filter("crowded").select("print"), "opened")
        depth += step
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out.groupBy("depth", "node").agg(F.collect_list("print").alias("prints")), "trie")


def node_pairs(nodes: DataFrame, budget: int, step: int = STEP) -> DataFrame:
    """Pairs (depth, node, other_depth, other) of closed nodes whose common bits differ in at most ``budget`` places, each once.

    From the pair of the root with itself, all pairs go down ``step`` bits a round; a closed node waits for the other.
    """
    spark = nodes.sparkSession
    own = nodes.select("depth", "node")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    pairs = spark.createDataFrame([(0, 0, 0, 0)], "depth int, node long, other_depth int, other long") if own.take(1) else None
    if pairs is None:
        return spark.createDataFrame([], "depth int, node long, other_depth int, other long")
    for depth in range(0, deepest, step):
        here = _above("node", F.col("depth") - depth)
        below = _above("node", F.col("depth") - depth - step)
        kids = (own.filter(F.col("depth") > depth).select(F.lit(depth).alias("from_depth"), here.alias("from"), F.lit(depth + step).alias("to_depth"), below.alias("to")).distinct()
                .unionByName(own.filter(F.col("depth") <= depth).select(F.col("depth").alias("from_depth"), F.col("node").alias("from"), F.col("depth").alias("to_depth"), F.col("node").alias("to"))))
        one = kids.toDF("depth", "node", "d1", "n1")
        two = kids.toDF("other_depth", "other", "d2", "n2")
        common = F.least("d1", "d2")
        differing = F.bit_count(_above("n1", F.col("d1") - common).bitwiseXOR(_above("n2", F.col("d2") - common)))
        same = (F.col("depth") == F.col("other_depth")) & (F.col("node") == F.col("other"))
        down = pairs.join(one, ["depth", "node"]).join(two, ["other_depth", "other"]).filter((differing <= budget) & (~same | (F.col("n1") <= F.col("n2"))))
        pairs = written(down.select(F.col("d1").alias("depth"), F.col("n1").alias("node"), F.col("d2").alias("other_depth"), F.col("n2").alias("other")), "node-pairs")
    return pairs


# ---- the trie's lower part, in a task

def _middle(values: np.ndarray, first: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the half with ``bit`` set begins in the nodes that begin at ``first``."""
    above = ~(bit | (bit - np.uint64(1)))
    return np.searchsorted(values, (values[first] & above) | bit)


def walk(one: np.ndarray, two: np.ndarray, depth: int, budget: int, wide: int = WIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in one, in two) of fingerprints that differ in at most ``budget`` bits.

    ``one`` and ``two`` are ascending, distinct, and each share their first ``depth`` bits; if they are the same array, each pair
    comes once and none with itself. A pair of nodes is a pair of ranges with the bits it differs in so far.
    """
    alike = one is two
    zero = np.zeros(1, np.int64)
    spent = np.bitwise_count((one[:1] ^ two[:1]) >> np.uint64(BITS - depth)).astype(np.int64) if depth else zero
    stack = [(depth, zero, zero + len(one), zero, zero + len(two), spent)]
    while stack:
        level, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > wide:
            half = len(a0) // 2
            stack += [(level, a0[:half], a1[:half], b0[:half], b1[:half], spent[:half]), (level, a0[half:], a1[half:], b0[half:], b1[half:], spent[half:])]
            continue
        # two leaves: the rest of both ways has no fork
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[leaf], b0[leaf]
        near = np.bitwise_count(one[x] ^ two[y]) <= budget
        if alike:
            near &= x != y
        if near.any():
            yield x[near], y[near]
        a0, a1, b0, b1, spent = (v[~leaf] for v in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit = np.uint64(1 << (BITS - 1 - level))
        am, bm = _middle(one, a0, bit), _middle(two, b0, bit)
        twin = (a0 == b0) & (a1 == b1) if alike else np.zeros(len(a0), bool)
        found = []
        for p0, p1, q0, q1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            keep = (p0 < p1) & (q0 < q1) & (spent + more <= budget)
            if more and p0 is am:
                keep &= ~twin
            found.append((p0[keep], p1[keep], q0[keep], q1[keep], spent[keep] + more))
        stack.append((level + 1, *(np.concatenate(c) for c in zip(*found))))


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give what the pairs join one label, the least."""
    while True:
        p, q = label[x], label[y]
        differ = p != q
        if not differ.any():
            return
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label[:] = label[label]


def _links(budget: int):
    """Components within a pair of nodes, as stars: no list of all links is kept."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sides = [np.sort(p.values.to_numpy(zero_copy_only=False).view(np.uint64)) for p in table.column("prints")]
        one, two = sides[0], sides[-1]
        depth = min(table.column("own_depth").to_pylist())
        every = one if one is two else np.concatenate([one, two])
        shift = 0 if one is two else len(one)
        label = np.arange(len(every))
        for x, y in walk(one, two, depth, budget):
            _unite(label, x, y + shift)
        some = np.flatnonzero(label != np.arange(len(every)))
        return pa.Table.from_batches([rows(schema, a=every[some].view(np.int64), b=every[label[some]].view(np.int64))])
    return run


def links(prints: DataFrame, budget: int = 2, most: int = MOST, step: int = STEP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``print``, each once) that reach as far as all links do."""
    nodes = closed_nodes(prints, most, step)
    pairs = node_pairs(nodes, budget, step)
    key = ["depth", "node", "other_depth", "other"]
    side = lambda d, n: F.struct(F.col(d).alias("own_depth"), F.col(n).alias("own_node"))
    sides = pairs.select(*key, F.explode(F.array_distinct(F.array(side("depth", "node"), side("other_depth", "other")))).alias("s")).select(*key, "s.*")
    met = sides.join(nodes.toDF("own_depth", "own_node", "prints"), ["own_depth", "own_node"])
    return met.groupBy(*key).applyInArrow(_links(budget), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, budget: int = 2, most: int = MOST, step: int = STEP) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document.

    Fingerprints (see ``fingerprints``) link at ``budget`` or fewer differing bits, those of wordless texts (0) like any other. A
    component is what links reach, named by its smallest doc_id. Equal fingerprints are one leaf of the trie, so copies cost
    nothing after the first grouping. Rows that repeat a doc_id are one document in links as far as their texts say so, and have a row
    each; rows without doc_id are left out; an empty table gives an empty result.
    """
    own = written(fingerprints(docs, n), "fingerprints")
    distinct = written(own.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    found = written(components(written(links(distinct, budget, most, step), "print-links")), "print-components")
    reached = distinct.join(found, F.col("print") == F.col("node"))
    smallest = reached.groupBy("component").agg(F.min("first").alias("smallest"))
    named = lookup_join(reached.select("print", "component"), smallest, ["component"]).select("print", "smallest")
    classes = distinct.join(named, "print", "left").select("print", F.coalesce("smallest", "first").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    return lookup_join(own, written(classes, "print-classes"), ["print"]).select("doc_id", shown.alias("fingerprint"), "component_id")
