"""Byte-level BPE by replaying the merges over all different words of a corpus.

``word_counts`` finds the different words of all texts.  ``Replay`` lays words
out as one linked row of tokens with an inverted index from the rank of a
token pair to the places that hold it.  Ranks are taken in order; a rank's
places are merged together and only the pairs beside them are looked up anew.
The words that many blocks of text share are replayed once for the corpus, in
Spark partitions, and reach the tasks as a lexicon of bounded size; the other
words of a block are replayed by the same code where the block is, so texts
never move.

Defined results: a null text is empty and has no ids; every row keeps its own
result, whatever its id (null and repeated ids included); equal texts have
equal ids; an empty table gives an empty one.  A text of any length is held
whole, its words by place.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..workspace import discard, materialize
from .batches import bounded_batches, gathered
from .units import cut, gathered_ids

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The lexicon holds at most this many words of at most so many bytes: 32 MB as a proven bound.
LEXICON_WORDS = 1 << 18
LEXICON_WORD_BYTES = 64
BLOCK_BYTES = 8 << 20
_BLOCK_ROWS = 1 << 14
_OUT_BYTES = 4 << 20
_REPLAY_BYTES = 2 << 20
_NO_RANK = np.int64(1) << 40

_split: Callable[[str], list[str]] | None = None


def splitter() -> Callable[[str], list[str]]:
    """Matches of the public pattern, as the libraries find them.

    The regex module knows newer characters than the libraries' engines, which
    class them as neither letter nor number.  Texts that hold such a character
    are split by the tokenizers library, whose pattern and classes are the same.
    """
    global _split
    if _split is None:
        from tokenizers import pre_tokenizers

        library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        # characters that this Python's older tables know are classed alike by all
        points = itertools.chain(range(0x80, 0xD800), range(0xE000, 0x110000))
        everything = "".join(c for c in map(chr, points) if unicodedata.category(c) == "Cn")
        newer = []
        for sort, lead in ((r"\p{L}", "a"), (r"\p{N}", "1")):
            found = regex.findall(sort, everything)
            # a row of "letter, character" pairs: a character that joins its letter is no word of its own
            joined = {piece[1] for piece in _pieces(library, "\n".join(lead + c for c in found)) if len(piece) == 2 and piece[0] == lead}
            newer.extend(c for c in found if c not in joined)
        match = regex.compile(public_tokenizers.PATTERN).findall
        sure = frozenset(newer).isdisjoint
        _split = lambda text: match(text) if text.isascii() or sure(text) else _pieces(library, text)
    return _split


def _pieces(library, text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


class Replay:
    """Merges of one vocabulary of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_ranks = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_RANK)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, offset of each word's ids and the end)."""
        parts, counts, at = [], [], 0
        while at < len(words):
            size, to = 0, at
            while to < len(words) and (to == at or size + len(words[to]) <= _REPLAY_BYTES):
                size += len(words[to])
                to += 1
            found, number = self._replay(words[at:to])
            parts.append(found)
            counts.append(number)
            at = to
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        number = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return flat.astype("<u4"), np.concatenate([[0], np.cumsum(number)]).astype(np.int64)

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        n = int(starts[-1])
        token = self.byte_ranks[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        # one place more than tokens: the last one stands for "no neighbour"
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[starts[1:] - 1] = n
        before[starts[:-1][lengths > 0]] = n
        rank = np.full(n + 1, _NO_RANK)
        inside = np.flatnonzero(after[:n] < n)
        rank[inside] = self._rank_of(token[inside], token[inside + 1])
        token = np.append(token, 0)
        alive = np.ones(n, dtype=bool)
        irregular: set[int] = set()

        index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> places of its left token
        order: list[int] = []

        def add(places: np.ndarray) -> None:
            ranks = rank[places]
            known = ranks < _NO_RANK
            places, ranks = places[known], ranks[known]
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                key = int(ranks[a])
                if key not in index:
                    index[key] = []
                    heapq.heappush(order, key)
                index[key].append(places[a:b])

        add(inside)
        while order:
            now = heapq.heappop(order)
            places = np.concatenate(index.pop(now))
            places = np.sort(places[rank[places] == now])
            places = places[np.diff(places, prepend=-1) > 0]  # a place may have been noted twice
            if not len(places):
                continue
            # of a run of pairs that share tokens, the first, third, fifth ... are merged
            linked = np.concatenate([[False], after[places[:-1]] == places[1:]])
            if linked.any():
                ordinal = np.arange(len(places))
                head = np.maximum.accumulate(np.where(linked, 0, ordinal))
                places = places[(ordinal - head) % 2 == 0]
            gone = after[places]
            beyond = after[gone]
            # one by one from the left, a merge meets its right neighbour before that is merged itself
            close = np.flatnonzero(beyond[:-1] == places[1:])
            met = self._rank_of(np.full(len(close), now), token[beyond[close]]) < now
            irregular.update(word[places[close[met]]].tolist())
            token[places] = now
            alive[gone] = False
            rank[gone] = _NO_RANK
            after[places] = beyond
            before[beyond] = places
            ahead = before[places]
            touched = np.concatenate([places, ahead[ahead < n]])
            right = after[touched]
            rank[touched] = np.where(right < n, self._rank_of(token[touched], token[right]), _NO_RANK)
            early = rank[touched] < now
            if early.any():
                irregular.update(word[touched[early]].tolist())
            add(touched)

        # a whole token is its own id; a merge that made a pair of lower rank has to be taken before others of its word
        own = {i: [self.ranks[w]] for i, w in enumerate(words) if w in self.ranks}
        own |= {i: self._one_by_one(words[i]) for i in irregular if i not in own}
        counts = np.bincount(word[alive], minlength=len(words))
        flat = token[:n][alive]
        if own:
            at = np.concatenate([[0], np.cumsum(counts)])
            changed = [i for i, ids in own.items() if len(ids) != counts[i] or not np.array_equal(flat[at[i] : at[i + 1]], ids)]
            if changed:
                pieces, last = [], 0
                for i in sorted(changed):
                    pieces += [flat[last : at[i]], np.array(own[i], dtype=np.int64)]
                    last = at[i + 1]
                    counts[i] = len(own[i])
                flat = np.concatenate([*pieces, flat[last:]])
        return flat, counts

    def _one_by_one(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, _NO_RANK) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == _NO_RANK:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


_replays: dict[str, Replay] = {}


def replay(path: str) -> Replay:
    """One per worker process and vocabulary."""
    if path not in _replays:
        _replays[path] = Replay(path)
    return _replays[path]


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, n): every different word of all texts with its number of occurrences, for words a lexicon can hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in gathered(batches, _BLOCK_ROWS, BLOCK_BYTES):
            counts: defaultdict[str, int] = defaultdict(int)
            rows, units = cut(batch.column(0), led=False)
            times = np.bincount(np.concatenate(rows), minlength=len(units)).tolist()
            for unit, n in zip(units, times):
                for word in split(unit) if n else ():
                    counts[word] += n
            words = pa.array(counts.keys(), pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
            yield out.filter(pa.compute.less_equal(pa.compute.binary_length(words), LEXICON_WORD_BYTES))

    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    found = docs.select(F.col(text_column).alias("__text")).mapInArrow(work, schema)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, words: int = LEXICON_WORDS) -> DataFrame:
    """The words above the least count that at most ``words`` words reach.

    Counts are cut into eight steps a doubling, so the histogram that reaches
    the driver has a few hundred rows however large the table is.
    """
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    histogram = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for number, found in histogram:
        total += found
        if total > words:
            break
        least = number
    return counts.where(step >= least) if least is not None else counts.limit(0)


def replayed(words: DataFrame, path: str) -> DataFrame:
    """(word, ids): the merges replayed over the words of each partition; ids as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1 << 20, _REPLAY_BYTES):
            raw = [w.as_buffer().to_pybytes() for w in batch.column(0)]
            ids, edges = replay(path).ids(raw)
            data, edges = ids.tobytes(), (edges * 4).tolist()
            column = pa.array([data[a:b] for a, b in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["word", "ids"])

    schema = StructType([StructField("word", StringType()), StructField("ids", BinaryType())])
    return words.select("word").mapInArrow(work, schema)


class _Lexicon:
    """Ids of the words of a block: from the corpus' lexicon, else replayed."""

    def __init__(self, path: str, words: pa.Table):
        self.path = path
        self.place = {w: i for i, w in enumerate(words["word"].to_pylist())}
        column = words["ids"].combine_chunks() if words.num_rows else pa.array([], pa.binary())
        sizes = np.array([len(x) // 4 for x in column.to_pylist()], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(column.to_pylist()), dtype="<u4")
        self.edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def block(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text: of different words, put together to units and then to texts."""
        split, known, place = splitter(), self.place.get, dict[str, int]()
        base = len(self.place)
        rows, units = cut(texts, led=False)
        words, sizes = [], []
        for unit in units:
            found = split(unit)
            sizes.append(len(found))
            for w in found:
                at = known(w)
                words.append(at if at is not None else place.setdefault(w, base + len(place)))
        ids, edges = replay(self.path).ids([w.encode() for w in place])
        flat = np.concatenate([self.flat, ids])
        edges = np.concatenate([self.edges, self.edges[-1] + edges[1:]])
        words = np.array(words, dtype=np.int64)
        counts = edges[words + 1] - edges[words]
        upto = np.concatenate([[0], np.cumsum(counts)])
        flat = gathered_ids(flat, edges, words)
        edges = upto[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        for row in rows:
            yield gathered_ids(flat, edges, row).tobytes()


def encoded(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS, decode: bool = False
) -> DataFrame:
    """(id, n_tokens, ids): each text's ids as little-endian unsigned 32-bit integers, one row per row.

    With ``decode`` also ``bytes``, what the ids spell; ``decoded`` does the same for stored ids.
    """
    path = public_tokenizers.path(vocabulary)
    spark = docs.sparkSession
    with bounded_batches(spark):
        counts = materialize(word_counts(docs, text_column), "words")
        words = replayed(frequent(counts, lexicon_words), path).toArrow()
    discard(counts)
    lexicon = spark.sparkContext.broadcast(words)
    held: list[_Lexicon] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(_Lexicon(path, lexicon.value))
        for batch in gathered(batches, _BLOCK_ROWS, BLOCK_BYTES):
            at = 0
            found, size = [], 0
            for ids in held[0].block(batch.column(1)):
                found.append(ids)
                size += len(ids)
                if size >= _OUT_BYTES:
                    yield rows(batch.column(0).slice(at, len(found)), found)
                    at, found, size = at + len(found), [], 0
            if found:
                yield rows(batch.column(0).slice(at, len(found)), found)

    def rows(ids: pa.Array, found: list[bytes]) -> pa.RecordBatch:
        columns = [ids, pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())]
        if decode:
            columns.append(pa.array(_spelled(found, path), pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    fields = [StructField("id", docs.schema[id_column].dataType), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    schema = StructType(fields + [StructField("bytes", BinaryType())] * decode)
    names = schema.names
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("__text")).mapInArrow(work, schema)


def _spelled(ids: list[bytes], path: str) -> list[bytes]:
    token_of = replay(path).token_of
    return [b"".join(map(token_of.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in ids]


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``tokens`` with ``bytes``: the token bytes of the binary column ``ids`` in a row."""
    path = public_tokenizers.path(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("ids")
            texts = _spelled([x.as_py() or b"" for x in batch.column(place)], path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "bytes"])

    return tokens.mapInArrow(work, StructType([*tokens.schema.fields, StructField("bytes", BinaryType())]))
