"""Packing of documents into sequences by shortest-pack-first over the length histogram.

Documents become pieces of at most one sequence.  The histogram of piece
lengths has at most ``capacity`` rows and is all that the driver sees.  From the
longest length down, all pieces of a length are placed at once into the packs
that are shortest so far, as changes of pattern counts.  The patterns then meet
the pieces again by the piece's rank within its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from .order import ranked
from .tokens import encoder, vocabulary

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
])
_PIECE_TYPE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full sequences, then the rest.  Null text: the end id alone."""
    path = path or vocabulary(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, words_only=True).encode
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                out.extend((doc, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, _PIECE_TYPE)


def patterns_of(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, times), ...]) by shortest-pack-first, longest lengths first.

    Packs with equal contents are one group with a count, so the work depends
    on the different lengths, not on the pieces.
    """
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    packs: list[tuple[int, int, int, tuple]] = []  # -space left, order, packs, contents
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not packs or -packs[0][0] < length:
                full, rest = divmod(left, capacity // length)
                made = [(full, capacity // length), (1 if rest else 0, rest)]
                left = 0
                grown = [(capacity - times * length, count, ((length, times),)) for count, times in made if count]
            else:
                space, _, count, runs = heapq.heappop(packs)
                space, take = -space, min(count, left)
                left -= take
                more = (*runs[:-1], (length, runs[-1][1] + 1)) if runs[-1][0] == length else (*runs, (length, 1))
                grown = [(space - length, take, more)]
                if take < count:
                    grown.append((space, count - take, runs))
            for space, count, runs in grown:
                order += 1
                heapq.heappush(packs, (-space, order, count, runs))
    return [(count, list(runs)) for _, _, count, runs in sorted(packs, reverse=True)]


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: ranks from ``rank`` on fill ``times`` places in each pack from ``sequence`` on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, runs in patterns:
        offset = 0
        for length, times in runs:
            rank = used.get(length, 0)
            rows.append((length, rank, times, sequence, offset))
            used[length] = rank + count * times
            offset += length * times
        sequence += count
    rows.sort()
    columns = list(zip(*rows)) if rows else [[]] * 5
    return {k: np.array(c, dtype=np.int64) for k, c in zip(("length", "rank", "times", "sequence", "offset"), columns)}


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows that share an id, or all columns, are pieces of their own.  An empty
    table gives no sequence.
    """
    cut = materialize(pieces(docs, id_column, text_column, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = slots_of(patterns_of(histogram, capacity))
    shift = np.int64(1 << 44)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots["length"] * shift + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            ahead = rank - slots["rank"][at]
            pack, turn = ahead // slots["times"][at], ahead % slots["times"][at]
            columns = [*batch.columns[:-1], pa.array(slots["sequence"][at] + pack), pa.array(slots["offset"][at] + turn * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = ranked(cut, "length", ["doc_id", "start", "doc_tokens", "ids_crc32"], "rank")
    return numbered.mapInArrow(place, _PIECE_TYPE + ", sequence_id bigint, offset bigint")
