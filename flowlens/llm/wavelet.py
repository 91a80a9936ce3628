"""Token ids in wavelet matrix files.

A block holds the ids of consecutive documents as bit-planes, highest bit
first.  After each plane the ids are dealt stably by its bit, zeros first, so a
rank in a plane leads to the place in the next.  A directory of counts per
``_STEP`` bits gives rank by one lookup and a short count, and select by
search.  Planes, directory, document ids and lengths are one compressed blob;
a shard is a Parquet file whose rows are such blobs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import materialize, new_path
from .tokens import encoder, vocabulary

MAGIC = b"WMX1"
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
BLOCK_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sBIII")
_STEP = 2048  # bits per directory entry
_NULL = np.iinfo(np.int64).min


class WaveletMatrix:
    """Bit-planes of a sequence of ids, with access, rank, count and select."""

    def __init__(self, n: int, planes: list[np.ndarray], directories: list[np.ndarray]):
        self.n, self.planes, self.directories = n, planes, directories
        self.zeros = [n - int(d[-1]) for d in directories]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids)
        ids = ids.astype(np.uint16 if not len(ids) or int(ids.max()) < 1 << 16 else np.uint32)
        planes, directories = [], []
        for bit in range(max(1, int(ids.max()).bit_length() if len(ids) else 1) - 1, -1, -1):
            ones = (ids >> ids.dtype.type(bit)) & ids.dtype.type(1) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            directories.append(cls._directory(packed))
            ids = np.concatenate([ids[~ones], ids[ones]])
        return cls(len(ids), planes, directories)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each ``_STEP`` bits, and of all."""
        counts = np.bitwise_count(packed)
        sums = np.add.reduceat(counts, np.arange(0, len(counts), _STEP // 8), dtype=np.uint32) if len(counts) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def _rank(self, level: int, at: int) -> int:
        """Ones in the first ``at`` bits of a plane."""
        entry = at // _STEP
        start = entry * _STEP // 8
        count = int(self.directories[level][entry]) + int(np.bitwise_count(self.planes[level][start : at // 8]).sum())
        if at % 8:
            count += (int(self.planes[level][at // 8]) & ((1 << at % 8) - 1)).bit_count()
        return count

    def _select(self, level: int, one: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        ones = self.directories[level].astype(np.int64)
        before = ones if one else np.minimum(np.arange(len(ones)) * _STEP, self.n) - ones
        entry = int(np.searchsorted(before, k, side="right")) - 1
        start = entry * _STEP
        bits = np.unpackbits(self.planes[level][start // 8 : (start + _STEP) // 8], bitorder="little")[: self.n - start]
        return start + int(np.flatnonzero(bits == one)[k - int(before[entry])])

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ids = np.zeros(self.n, dtype=np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = self._bits(level)
            back = np.empty_like(ids)
            back[~ones] = ids[: self.zeros[level]]
            back[ones] = ids[self.zeros[level] :] | ids.dtype.type(1 << (len(self.planes) - 1 - level))
            ids = back
        return ids

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            one = int(self.planes[level][at // 8]) >> (at % 8) & 1
            ones = self._rank(level, at)
            at = self.zeros[level] + ones if one else at - ones
            value = value << 1 | one
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank(level, lo), self._rank(level, hi)
            one = token >> (len(self.planes) - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token occurs from ``lo`` to before ``hi``."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th (from 0) occurrence."""
        first, past = self._range(token, 0, self.n)
        if not 0 <= k < past - first:
            raise IndexError(f"token {token} occurs {past - first} times")
        at = first + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def to_blob(ids: np.ndarray, documents: list[int | None], lengths: list[int]) -> bytes:
    matrix = WaveletMatrix.build(ids)
    head = _HEAD.pack(MAGIC, len(matrix.planes), matrix.n, len(documents), _STEP)
    named = np.array([_NULL if d is None else d for d in documents], dtype="<i8")
    parts = [named.tobytes(), np.array(lengths, dtype="<u4").tobytes(), *(p.tobytes() for p in matrix.planes), *(d.astype("<u4").tobytes() for d in matrix.directories)]
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def from_blob(blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """Matrix, document ids (the least 64-bit integer for null) and their numbers of ids."""
    magic, planes, n, documents, step = _HEAD.unpack_from(blob)
    if magic != MAGIC or step != _STEP:
        raise ValueError("not a wavelet matrix block")
    body, at = zstandard.ZstdDecompressor().decompress(blob[_HEAD.size :]), 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    ids, lengths = take("<i8", documents), take("<u4", documents)
    bits = [take("u1", -(-n // 8)) for _ in range(planes)]
    return WaveletMatrix(n, bits, [take("<u4", -(-n // step) + 1) for _ in range(planes)]), ids, lengths


def _build(path: str, end_id: int, block_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, words_only=False).encode, TaskContext.get().partitionId()
        documents, lengths, held, tokens, block = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_tokens": pa.array([len(ids)], pa.int64()),
                "content": pa.array([to_blob(ids, documents, lengths)], pa.binary()),
            })

        for batch in batches:
            for document, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                documents.append(document)
                lengths.append(len(ids) // 4)
                held.append(ids)
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield row()
                    documents, lengths, held, tokens, block = [], [], [], 0, block + 1
        if documents:
            yield row()

    return work


def write_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode documents in ascending id order (equal ids by text, null first) and write one file per shard."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    blocks = rows.mapInArrow(_build(tokenizer or vocabulary(VOCABULARY), end_id, block_tokens), "part int, block int, n_tokens bigint, content binary")
    blocks.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "content"))):
            matrix, documents, lengths = from_blob(blob)
            raw = matrix.all().astype("<u4").tobytes()
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            n = len(documents)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(n, part, np.int32)), "block": pa.array(np.full(n, block, np.int32)),
                "id": pa.array(documents, mask=documents == _NULL), "within": pa.array(starts), "n_tokens": pa.array(lengths.astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
            })


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, before): ids before each block; one row per part and then per block of a part is summed in a task."""
    blocks = spark.read.parquet(path).select("part", "block", "n_tokens")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return blocks.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files."""
    rows = spark.read.parquet(path).mapInArrow(_documents, "part int, block int, id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    starts = materialize(block_starts(spark, path), "block-starts")
    return rows.join(starts, ["part", "block"]).select("id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the files and read every document's ids back from them."""
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, id_column, text_column, tokenizer, block_tokens=block_tokens)
    return read_documents(docs.sparkSession, path)
