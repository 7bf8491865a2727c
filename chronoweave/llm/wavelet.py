"""Token ids as wavelet matrices: one compressed file part per range of documents, with access, counting and occurrence lookup."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import rows, shuffle_parts, steps, texts, work_folder
from chronoweave.llm.matches import Matches

MAGIC = b"WVMX1"
#: Ids of a shard at which the next document starts a new one.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """Bit-planes of a sequence, most significant bit first; each plane orders the next one stably, zeros before ones."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], size: int):
        self.planes, self.zeros, self.size = planes, zeros, size
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> values.dtype.type(b)) & values.dtype.type(1) == 1
            planes.append(np.packbits(bit, bitorder="little"))
            # by places: much faster than by a mask of unforeseeable bits
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            values = np.concatenate([values[low], values[high]])
        return cls(planes, zeros, len(values))

    def to_bytes(self) -> bytes:
        packed = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in self.planes]
        head = struct.pack("<QB", self.size, len(packed)) + b"".join(struct.pack("<QI", z, len(p)) for z, p in zip(self.zeros, packed, strict=True))
        return MAGIC + head + b"".join(packed)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:5] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size, bits = struct.unpack_from("<QB", blob, 5)
        at, planes, zeros = 14 + 12 * bits, [], []
        for i in range(bits):
            z, n = struct.unpack_from("<QI", blob, 14 + 12 * i)
            raw = zstandard.ZstdDecompressor().decompress(blob[at:at + n], max_output_size=size // 8 + 1)
            planes.append(np.frombuffer(raw, np.uint8))
            zeros.append(z)
            at += n
        return cls(planes, zeros, size)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a plane, from a directory of ones before each byte."""
        if self._ranks is None:
            self._ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in self.planes]
        byte, rest = at >> 3, at & 7
        plane = np.append(self.planes[level], np.uint8(0))
        return self._ranks[level][byte] + np.bitwise_count(plane[byte] & ((1 << rest) - 1).astype(np.uint8))

    def access(self, at) -> np.ndarray:
        """The values at some positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = out * 2 + bit
        return out

    def _range(self, value: int, first: int, end: int) -> tuple[int, int]:
        a = np.array([first, end], np.int64)
        for level in range(len(self.planes)):
            ones = self._ones(level, a)
            a = self.zeros[level] + ones if value >> (len(self.planes) - 1 - level) & 1 else a - ones
        return int(a[0]), int(a[1])

    def count(self, value: int, first: int = 0, end: int | None = None) -> int:
        """Occurrences of a value in [first, end)."""
        if value < 0 or value >> len(self.planes):
            return 0
        a, b = self._range(value, first, self.size if end is None else end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a value; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        at = self._range(value, 0, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.size)
            one = value >> (len(self.planes) - 1 - level) & 1
            at = int(np.flatnonzero(bit == 1)[at - self.zeros[level]]) if one else int(np.flatnonzero(bit == 0)[at])
        return at

    def values(self) -> np.ndarray:
        """The whole sequence, undoing the stable splits from the last plane to the first."""
        out = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.size).view(bool)
            ones = np.flatnonzero(bit)
            before = np.empty_like(out)
            before[np.flatnonzero(~bit)] = out[:self.zeros[level]]
            before[ones] = out[self.zeros[level]:] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = before
        return out


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return dict(zip(own, own, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}


SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("matrix", pa.binary())])


@lru_cache(1)
def _tokenizer(path: str, added: bool) -> tuple:
    """The library's tokenizer and the matches it has encoded, kept for the tasks of a worker.

    With ``added`` the library is left as it is: the contents of added tokens, in texts, are these tokens, and
    texts that hold one go to the library whole. Otherwise they are spelled as ordinary characters."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not added
    contents = [t.content for t in library.get_added_tokens_decoder().values()] if added else []
    model, spelled = library.model, str.maketrans(byte_letters())
    return library, Matches(lambda many: [x.ids for x in library.encode_batch_fast(many, add_special_tokens=False)],
                            lambda many: [[t.id for t in model.tokenize(m.encode().decode("latin-1").translate(spelled))] for m in many],
                            contents)


def _write(path: str, end_id: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, matches = _tokenizer(path, added)
        bits = max(1, (max(library.get_vocab_size(), end_id + 1) - 1).bit_length())
        part, seq, before, held, held_ids = TaskContext.get().partitionId(), 0, 0, [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            matrix = WaveletMatrix.build(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
            return rows(SHARDS, part=[part], seq=[seq], before=[before], n_ids=[len(ids)], doc_ids=[np.concatenate([h[0] for h in held]).tobytes()], sizes=[sizes.tobytes()], matrix=[matrix.to_bytes()])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, end, many in steps(batch, "text", kind=pa.string()):
                ids, sizes = matches(many)
                own = np.insert(ids, np.cumsum(sizes), end_id)
                held.append((doc_ids[first:end], own, sizes + 1))
                held_ids += len(own)
                if held_ids >= SHARD_IDS:
                    yield shard()
                    seq, before, held, held_ids = seq + 1, before + held_ids, [], 0
        if held:
            yield shard()
    return run


def write(docs: DataFrame, path: str, end_id: int, folder: str, added: bool = False) -> None:
    """Encode every whole text, append ``end_id``, and write matrices in ascending doc_id order.

    Documents are dealt out by ranges of doc_id; each range writes one file, a row a shard. Repeated
    doc_ids stay together, ordered by text. Null text: the end id alone. Rows without doc_id are left out.
    """
    parts = shuffle_parts(docs.sparkSession)
    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(path, end_id, added), "part int, seq int, before long, n_ids long, doc_ids binary, sizes binary, matrix binary").write.option("compression", "none").parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(folder)
    # one row for each part of the range partitioning
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offset, at = {}, 0
    for part, n in sums:
        offset[part] = at
        at += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, doc_ids, sizes, blob = (batch.column(c)[i].as_py() for c in ("part", "before", "doc_ids", "sizes", "matrix"))
                sizes = np.frombuffer(sizes, np.int64)
                data = memoryview(WaveletMatrix.from_bytes(blob).values().astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield rows(schema, doc_id=np.frombuffer(doc_ids, np.int64), start=starts + (before + offset[part]), n_tokens=sizes, ids_crc32=crc)
    return shards.select("part", "before", "doc_ids", "sizes", "matrix").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, end_id: int, added: bool = False) -> DataFrame:
    """Write the files to the shared folder and describe each document from them; ``added``: added tokens in texts are tokens."""
    folder = work_folder(docs.sparkSession, "wavelet")
    write(docs, path, end_id, folder, added)
    return read(docs.sparkSession, folder)
