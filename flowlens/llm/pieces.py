"""SentencePiece encoding and decoding with N-best segmentations.

The lattice of a text has a node between any two characters and an edge for
every piece of the vocabulary.  Forward Viterbi gives the best score of every
node; from the end backwards these scores are exact estimates, so A* reaches
the start in order of score and does no more work than the N paths need.

No piece spans the place before a word mark that follows another character, or
a line end, so the lattice falls into segments there.  Each task keeps the best
path of recurring segments and the distance to its second best in a memo of
bounded size.  The N best paths of a text change at most the N - 1 segments of
least distance; only these are searched.

Scores are whole millionths, so that sums are exact.  A unigram vocabulary
gives its own scores; a merge vocabulary ranks its pieces, and a piece of rank
r scores -ln(r + 2).  Characters without a piece become byte pieces, at a
price above any piece.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary
from .words import mix

VOCABULARY = "piece_bpe_32k.model"
BEST = 4
MEMO_SEGMENTS = 400_000
MARK = "▁"
_UNIT = 1_000_000
_BYTE_SCORE = -20 * _UNIT
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")
_NONE = -(1 << 61)
_ALONE = 1 << 61  # distance where there is no second path
_DONE = -2
_CELLS = 1 << 20
_TEXT_CHARS = 1 << 22
_HASH_BASE = np.uint64(0xD1342543DE82EF95)
_loss = itemgetter(0)


def _hash(piece: str) -> int:
    key = 0
    for c in piece:
        key = (key * int(_HASH_BASE) + ord(c) + 1) % (1 << 64)
    return int(mix(np.array([key], dtype=np.uint64))[0])


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceModel:
    """Pieces, scores and segmentations of one vocabulary."""

    def __init__(self, path: str, memo_segments: int = MEMO_SEGMENTS):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.get_piece_size()
        scores = [processor.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) or processor.is_byte(i))]
        ranked = all(scores[i] == int(scores[i]) for i in plain)
        order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-scores[i], i)))}
        #: piece -> (id, score); None for a string that only begins pieces
        self.table: dict[str, tuple[int, int] | None] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        for i in plain:
            piece = processor.id_to_piece(i)
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} spans segments")
            self.table[piece] = (i, -round(_UNIT * math.log(order[i] + 2)) if ranked else round(_UNIT * scores[i]))
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
            for k in range(1, len(piece)):
                self.table.setdefault(piece[:k], None)
        self._fill_slots()
        self.memo_segments = memo_segments
        self._forget()

    def _fill_slots(self) -> None:
        """Open-addressed copy of the table for lookups of many strings by hash."""
        entries = list(self.table.items())
        keys = np.array([_hash(s) for s, _ in entries], dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.mask = (1 << max(8, (4 * len(entries)).bit_length())) - 1
        self.slot_keys = np.zeros(self.mask + 1, dtype=np.uint64)
        self.slot_ids = np.full(self.mask + 1, -1, dtype=np.int32)
        self.slot_scores = np.zeros(self.mask + 1, dtype=np.int64)
        for key, place, (_, found) in zip(keys, (keys & np.uint64(self.mask)).tolist(), entries):
            while self.slot_keys[place]:
                place = (place + 1) & self.mask
            self.slot_keys[place] = key
            if found:
                self.slot_ids[place], self.slot_scores[place] = found

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 for none."""
        place = (keys & np.uint64(self.mask)).astype(np.int64)
        held = self.slot_keys[place]
        out = np.where(held == keys, place, -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            held = self.slot_keys[place[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = place[open_[hit]]
            open_ = open_[~hit & (held != 0)]
        return out

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def _edge(self, char: str) -> tuple[tuple[int, ...], int]:
        """Byte pieces of a character without a piece."""
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw), _BYTE_SCORE * len(raw)

    def best(self, segments: list[str]) -> dict[str, tuple[bytes, int, int]]:
        """(ids, score, distance to the second best) of each segment; a distance of 2^61 where there is one path only."""
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        out: dict[str, tuple[bytes, int, int]] = {}
        for length, group in by_length.items():
            step = max(1, _CELLS // length)
            for at in range(0, len(group), step):
                self._best_of_length(group[at : at + step], length, out)
        return out

    def _best_of_length(self, group: list[str], n: int, out: dict[str, tuple[bytes, int, int]]) -> None:
        """Forward Viterbi with the two best scores of each node, over segments of one length at a time."""
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(group), n).T.astype(np.uint64) + np.uint64(1)
        first, second = np.full((n + 1, len(group)), _NONE), np.full((n + 1, len(group)), _NONE)
        back_at, back_id = np.zeros((n + 1, len(group)), np.int32), np.zeros((n + 1, len(group)), np.int32)
        first[0] = 0

        def offer(rows: np.ndarray, i: int, j: int, ids, scores) -> None:
            best, next_best = first[i, rows] + scores, second[i, rows] + scores
            old = first[j, rows]
            better = best > old
            second[j, rows] = np.maximum(np.where(better, old, np.maximum(second[j, rows], best)), next_best)
            won = rows[better]
            first[j, won] = best[better]
            back_at[j, won] = i
            back_id[j, won] = ids if np.isscalar(ids) else ids[better]

        for i in range(n):
            live, keys = np.arange(len(group)), np.zeros(len(group), dtype=np.uint64)
            own = np.zeros(len(group), dtype=bool)
            for j in range(i + 1, n + 1):
                keys = keys * _HASH_BASE + chars[j - 1, live]
                slot = self._find(mix(keys))
                known = slot >= 0
                live, keys, slot = live[known], keys[known], slot[known]
                if not len(live):
                    break
                ids = self.slot_ids[slot]
                whole = ids >= 0
                rows = live[whole]
                if len(rows):
                    if j == i + 1:
                        own[rows] = True
                    offer(rows, i, j, ids[whole], self.slot_scores[slot[whole]])
            lost = np.flatnonzero(~own)
            if len(lost):
                price = {c: self._edge(chr(c - 1))[1] for c in set(chars[i, lost].tolist())}
                offer(lost, i, i + 1, -1, np.array([price[c] for c in chars[i, lost].tolist()]))
        rows, at, walked = np.arange(len(group)), np.full(len(group), n), []
        while at.any():
            walked.append(np.where(at > 0, back_id[at, rows], _DONE))
            at = back_at[at, rows]  # stays 0 at the start
        paths = np.array(walked[::-1]).T
        counts = (paths != _DONE).sum(axis=1)
        flat, ends = paths[paths != _DONE].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        distance = np.where(second[n] > _NONE // 2, first[n] - second[n], _ALONE).tolist()
        start = 0
        for segment, end, score, d in zip(group, ends, first[n].tolist(), distance):
            out[segment] = (flat[start:end], score, d)
            start = end
        for row in np.flatnonzero((paths == -1).any(axis=1)).tolist():  # byte pieces take the place of their characters
            ids, at = [], n
            while at:
                piece, before = int(back_id[at, row]), int(back_at[at, row])
                ids.extend(reversed(self._edge(group[row][before])[0]) if piece < 0 else (piece,))
                at = before
            out[group[row]] = (_pack(ids[::-1]), *out[group[row]][1:])

    def n_best(self, segment: str, n_best: int = BEST) -> list[tuple[int, bytes]]:
        """(score, ids) of the best paths, best first, by backward A* on forward scores."""
        n, get = len(segment), self.table.get
        first = [_NONE] * (n + 1)
        first[0] = 0
        ending: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            own = False
            for j in range(i + 1, n + 1):
                found = get(segment[i:j], 0)
                if found == 0:
                    break
                if found is not None:
                    own = own or j == i + 1
                    ending[j].append((i, (found[0],), found[1]))
                    first[j] = max(first[j], first[i] + found[1])
            if not own:
                ids, score = self._edge(segment[i])
                ending[i + 1].append((i, ids, score))
                first[i + 1] = max(first[i + 1], first[i] + score)
        heap, turn, out = [(-first[n], 0, n, 0, None)], 0, []
        while heap and len(out) < n_best:
            estimate, _, at, behind, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((-estimate, _pack(ids)))
                continue
            for start, ids, score in ending[at]:
                turn += 1
                heapq.heappush(heap, (-(first[start] + score + behind), turn, start, behind + score, (ids, path)))
        return out

    def encode(self, texts: list[str], n_best: int = BEST) -> list[list[tuple[int, bytes]]]:
        """(score, ids) of the N best segmentations of whole texts, best first; an empty text has one without ids."""
        cut = [self.segments(t) for t in texts]
        if len(self.memo) > self.memo_segments:
            self._forget()
        memo = self.memo
        missing = {s for segments in cut for s in segments if s not in memo}
        for segment, (ids, score, distance) in self.best(list(missing)).items():
            memo[segment] = len(self.ids)
            self.ids.append(ids)
            self.scores.append(score)
            self.distances.append(distance)
        codes = np.fromiter((memo[s] for segments in cut for s in segments), dtype=np.int64)
        scores, distances = np.array(self.scores, dtype=np.int64)[codes], np.array(self.distances, dtype=np.int64)[codes]
        out, start = [], 0
        for segments in cut:
            end = start + len(segments)
            out.append(self._paths(segments, codes[start:end], int(scores[start:end].sum()), distances[start:end], n_best))
            start = end
        return out

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.scores: list[int] = []
        self.distances: list[int] = []
        self.few: dict[str, list[tuple[int, bytes]]] = {}

    def _paths(self, segments: list[str], codes: np.ndarray, total: int, distances: np.ndarray, n_best: int) -> list[tuple[int, bytes]]:
        held = self.ids
        parts = [held[c] for c in codes.tolist()]
        options: list[tuple[int, tuple]] = [(0, ())]  # (loss, changes)
        near = np.argpartition(distances, n_best - 2)[: n_best - 1] if len(distances) >= n_best > 1 else np.arange(len(distances) if n_best > 1 else 0)
        for at in sorted(near.tolist(), key=lambda i: (int(distances[i]), i)):
            if distances[at] >= _ALONE:
                break
            segment = segments[at]
            if segment not in self.few:
                self.few[segment] = self.n_best(segment, n_best)
            paths = self.few[segment]
            others = [(paths[0][0] - score, ((at, ids),) if k else ()) for k, (score, ids) in enumerate(paths)]
            options = heapq.nsmallest(n_best, [(a + b, x + y) for a, x in options for b, y in others], key=_loss)
        out = []
        for loss, changes in options:
            row = parts
            if changes:
                row = parts.copy()
                for at, ids in changes:
                    row[at] = ids
            out.append((total - loss, b"".join(row)))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids; the mark of the first word is dropped."""
        table = self.bytes_of
        text = b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[str, PieceModel] = {}


def piece_model(path: str | None = None) -> PieceModel:
    """One model per worker process and vocabulary."""
    path = path or vocabulary(VOCABULARY)
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


_ENCODED = "id bigint, n_chars bigint, n_pieces bigint, ids_crc32 bigint, scores array<bigint>, paths_crc32 array<bigint>, decoded_equal boolean"


def encoded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, n_best: int = BEST) -> DataFrame:
    """N best segmentations of every whole text, as digests.

    ids_crc32 and n_pieces are of the best one, scores (millionths) and
    paths_crc32 of all, best first (fewer if the lattice has fewer paths).
    decoded_equal: the best one decodes to the text, in which the word mark
    itself reads as a space.  Null texts are empty: one path without pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            paths, at = [], 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TEXT_CHARS, side="right")))
                paths.extend(model.encode(texts[at:to], n_best))
                at = to
            out = []
            for id_, text, found in zip(batch.column(0).to_pylist(), texts, paths):
                ids = found[0][1]
                same = model.decode(ids) == text.replace(MARK, " ")
                out.append((id_, len(text), len(ids) // 4, zlib.crc32(ids), [s for s, _ in found], [zlib.crc32(p) for _, p in found], same))
            if out:
                names = ["id", "n_chars", "n_pieces", "ids_crc32", "scores", "paths_crc32", "decoded_equal"]
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).mapInArrow(work, _ENCODED)
