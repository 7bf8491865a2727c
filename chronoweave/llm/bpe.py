"""Byte-level BPE with the tiktoken library: encoding, raw-byte decoding, digests."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.common import STEP_BYTES, rows, steps, texts
from chronoweave.llm.matches import Matches, gather, group_sums

_BOUNDARY = re.compile(r"\S(?=\s)")

DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """Cut a long text where the pattern always ends a match: between a character and white space after it.

    No alternative of the pattern holds white space after another character, and the look-ahead of
    its white-space runs never reaches back over such a place, so the pieces' matches are the text's.
    """
    at = 0
    while len(text) - at > limit:
        cut = _BOUNDARY.search(text, at + limit - 1)
        if not cut:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:]


class RankFile:
    """An encoding made from a local rank file, and the tables that decode its ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = Matches(lambda many: [self.library.encode_ordinary(x) for x in many])
        size = max(ranks.values()) + 1
        raw, decimal = [b""] * size, [b"%d," % i for i in range(size)]
        for k, i in ranks.items():
            raw[i] = k
        self.raw, self.decimal = self._table(raw), self._table(decimal)

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes

    def encode(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; long texts in pieces."""
        pieces = [list(safe_pieces(t, STEP_BYTES // 2)) if len(t) > STEP_BYTES // 2 else [t] for t in many]
        flat, ids, sizes, first = [p for own in pieces for p in own], [], [], 0
        while first < len(flat):
            end, size = first, 0
            while end < len(flat) and (end == first or size + len(flat[end]) <= STEP_BYTES):
                size += len(flat[end])
                end += 1
            a, b = self.matches(flat[first:end])
            ids.append(a)
            sizes.append(b)
            first = end
        return np.concatenate(ids), group_sums(np.concatenate(sizes), np.array([len(own) for own in pieces]))

    def spell(self, ids: np.ndarray, sizes: np.ndarray, table) -> tuple[memoryview, np.ndarray]:
        """The bytes that a table has for all ids, and where each text ends in them."""
        data, first, lengths = table
        return memoryview(gather(data, first[ids], lengths[ids])), np.cumsum(group_sums(lengths[ids], sizes))


@lru_cache(1)
def rank_file(path: str, pattern: str) -> RankFile:
    """Kept, with the matches it has encoded, for the tasks of a worker."""
    return RankFile(path, pattern)


def _encoder(path: str, pattern: str, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_file(path, pattern)
        for batch in batches:
            for first, end, many in steps(batch, "text", kind=pa.string()):
                ids, sizes = codec.encode(many)
                yield emit(codec, batch.column("doc_id").slice(first, end - first), ids, sizes)
    return run


def _digests(codec: RankFile, doc_ids, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    decimal, to = codec.spell(ids, sizes, codec.decimal)
    raw, raw_to = codec.spell(ids, sizes, codec.raw)
    hashes, decoded, a, b = [], [], 0, 0
    for x, y in zip(to.tolist(), raw_to.tolist(), strict=True):
        hashes.append(hashlib.sha256(decimal[a:max(a, x - 1)]).hexdigest())
        decoded.append(hashlib.sha256(raw[b:y]).hexdigest())
        a, b = x, y
    return rows(DIGESTS, doc_id=doc_ids, n_tokens=sizes, ids_sha256=hashes, decoded_sha256=decoded)


def _lists(codec: RankFile, doc_ids, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], schema=TOKENS)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every whole text: doc_id, ids. Null text: no ids; rows without doc_id are left out; repeated rows stay."""
    return texts(docs).mapInArrow(_encoder(path, pattern, _lists), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of every list of ids: doc_id, bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        codec = rank_file(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            ids = np.array([i for x in lists if x.is_valid for i in x.as_py()], np.int64)
            raw, to = codec.spell(ids, sizes, codec.raw)
            ends = [0, *to.tolist()]
            yield rows(schema, doc_id=batch.column("doc_id"), bytes=[bytes(raw[a:b]) for a, b in zip(ends, ends[1:])])
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode its ids again; digests of both, so no list of ids leaves its task.

    Null or empty text: no ids, the hashes of nothing. Rows without doc_id are left out, repeated rows
    each have a result, further columns are ignored. A very long text is encoded in pieces.
    """
    return texts(docs).mapInArrow(_encoder(path, pattern, _digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
