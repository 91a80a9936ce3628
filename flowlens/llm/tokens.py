"""Token ids of public tokenizers, with a memo of recurring pieces.

The vocabularies split texts at spaces before they merge anything, so a text's
ids are the ids of its pieces in a row.  Texts are cut together by Arrow; each
task encodes a different piece once with the tokenizers library and keeps its
ids in a memo of bounded size; where a vocabulary's ids follow its merges,
another public library finds the same ids several times faster.  A piece that holds the string of an added token
is encoded by itself, as the library does it.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .units import cut, gathered_ids
from .vocabularies import vocabulary_ranks

MEMO_PIECES = 800_000
_TOGETHER_BYTES = 4 << 20
_ROW_PIECES = 20_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, words_only: bool, memo_pieces: int = MEMO_PIECES):
        """words_only: the vocabulary drops white space, so pieces are words without their space."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda piece: None
        self.words_only = words_only
        self.memo_pieces = memo_pieces
        self.fast = None
        with open(path, encoding="utf-8") as file:
            ranks = None if words_only else vocabulary_ranks(json.load(file))
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.sizes[list(ranks.values())] = list(map(len, ranks))
        # pieces used since half the memo filled up, and those used before
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces(self, texts: pa.Array) -> tuple[list[np.ndarray], list[str]]:
        """(places of each text's pieces, different pieces)."""
        if not self.words_only:
            return cut(texts, led=False)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        edges = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        return np.split(words.indices.to_numpy(zero_copy_only=False), edges[:-1]), words.dictionary.to_pylist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= _TOGETHER_BYTES):
                size += len(texts[to])
                to += 1
            out.extend(self._encode(texts[at:to]))
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        rows, pieces = self._pieces(pa.array(texts, pa.string()))
        if len(self.memo) > self.memo_pieces // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        missing = []
        for piece in pieces:
            if piece not in memo:
                if piece in older:
                    memo[piece] = older[piece]
                else:
                    missing.append(piece)
        if missing:
            self._learn(missing)
        ids = [memo[p] for p in pieces]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)]).astype(np.int64)
        return [gathered_ids(flat, edges, row).tobytes() for row in rows]

    def _learn(self, missing: list[str]) -> None:
        """Encode new pieces: in a row as one text, where spaces keep them apart, else one by one."""
        if self.words_only:
            row = [p for p in missing if p and not p.isspace() and not self.holds_added(p)]
        else:
            row = [p for p in missing if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() and not self.holds_added(p)]
        for at in range(0, len(row), _ROW_PIECES):
            part = row[at : at + _ROW_PIECES]
            if self.fast:  # the pieces' bytes tell which ids are theirs
                ids = np.array(self.fast("".join(part)), dtype="<u4")
                ends = np.cumsum([len(p.encode()) for p in part])
                edges = np.concatenate([[0], np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")]) * 4
                raw = ids.tobytes()
                self.memo.update((p, raw[s:e]) for p, s, e in zip(part, edges[:-1].tolist(), edges[1:].tolist()))
                continue
            gap = 1 if self.words_only else 0
            encoding = self.tokenizer.encode((" " * gap).join(part), add_special_tokens=False)
            ids = np.array(encoding.ids, dtype="<u4")
            first = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            ends = np.cumsum([len(p) + gap for p in part])
            edges = np.concatenate([[0], np.searchsorted(first, ends)]) * 4
            raw = ids.tobytes()
            self.memo.update((p, raw[s:e]) for p, s, e in zip(part, edges[:-1].tolist(), edges[1:].tolist()))
        single = list(set(missing).difference(row))
        for piece, encoding in zip(single, self.tokenizer.encode_batch(single, add_special_tokens=False)):
            self.memo[piece] = np.array(encoding.ids, dtype="<u4").tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words_only: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (path, words_only)
    if key not in _encoders:
        _encoders[key] = Encoder(path, words_only)
    return _encoders[key]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
