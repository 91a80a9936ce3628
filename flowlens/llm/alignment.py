"""Two tokenizers aligned by bytes, with corpus-wide counts of linked tokens.

Both vocabularies cut texts at a space between two other characters, so a text
is a row of units whose alignments do not depend on each other, and each
different unit of a block of texts is encoded and aligned once.  Byte offsets
where tokens of both end cut the tokens into groups; all pairs of tokens in a
group are linked.

The first pass counts, per block, the documents that hold each pair.  The
different pairs get numbers by minimal perfect hashing; the blocks' counts are
added up as dense vectors under these numbers, in two tree levels.  The second
pass aligns the texts again and looks the counts up, checking every key.

Defined results: texts that are null, empty, or whose tokens do not spell a
space and the text have no tokens, zeros and an empty string, and count for no
pair.  Every row is a document of its own, whatever its id: repeated rows count
twice, null ids are kept.  Equal texts have equal results.  An empty table
gives an empty one.  A text is held whole, its units by place; other columns
are not read.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..workspace import discard, materialize
from .batches import bounded_batches, gathered
from .perfect import PerfectHash, chunked, number_of_shards, shard_column, shards
from .units import cut, gathered_ids
from .vocabularies import byte_values, vocabulary_ranks

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
_BLOCK_ROWS = 1 << 13
_OUT_BYTES = 4 << 20
_UNITS = 1 << 14
_TOGETHER = 256
#: Pairs whose hash, keys and counts a task holds at once: 70 MB. More pairs are looked up part by part.
SLICE_PAIRS = 1 << 22
_CHUNK = 1 << 16
_FAN = 16

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Units:
    """Alignments of some units: numbers, texts of their groups, and their pairs with the times each is linked."""

    def __init__(self, count: int, with_texts: bool):
        self.ok = np.zeros(count, dtype=bool)
        self.numbers = np.zeros((len(_NUMBERS), count), dtype=np.int64)
        self.texts = [""] * count if with_texts else None
        self._pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, places: np.ndarray, ok: np.ndarray, numbers: np.ndarray, texts: list[str] | None, unit: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        self.ok[places], self.numbers[:, places] = ok, numbers
        if texts is not None:
            for place, text in zip(places.tolist(), texts):
                self.texts[place] = text
        self._pairs.append((places[unit], key, times))

    def finish(self) -> None:
        unit, key, times = (np.concatenate(x) if self._pairs else np.zeros(0, np.int64) for x in (zip(*self._pairs) if self._pairs else ((), (), ())))
        order = np.argsort(unit, kind="stable")
        self.unit, self.times = unit[order], times[order]
        #: different keys of the block, and the place of each pair's key among them
        self.keys, place = np.unique(key, return_inverse=True)
        self.key = place[order]
        self.edges = np.searchsorted(self.unit, np.arange(len(self.ok) + 1))
        self._pairs = []


class Aligner:
    def __init__(self, first: str, second: str):
        import sentencepiece

        with open(first, encoding="utf-8") as file:
            described = json.load(file)
        ranks = vocabulary_ranks(described)
        if ranks:
            import tiktoken

            fast = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode_a = lambda texts: [fast.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(first)
            library.encode_special_tokens = True
            self._encode_a = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        values = byte_values()
        by_id = {i: t for t, i in described["model"]["vocab"].items()} | {t["id"]: t["content"] for t in described["added_tokens"]}
        # an added token's entry is plain text; it is never an id of a text here
        self.a_bytes = [bytes(values.get(c, 0) for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} spans units")
        self.a_size = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)

    def align(self, units: list[str], with_texts: bool = True) -> Units:
        """Units that a space keeps apart are encoded in rows, the others one by one."""
        out = Units(len(units), with_texts)
        odd = np.array([len(u) < 2 or u[1].isspace() or u[-1].isspace() for u in units], dtype=bool)
        for places, together in ((np.flatnonzero(~odd), True), (np.flatnonzero(odd), False)):
            for at in range(0, len(places), _UNITS):
                part = places[at : at + _UNITS]
                out.add(part, *self._align([units[i] for i in part.tolist()], together, with_texts))
        out.finish()
        return out

    def _ids(self, units: list[str], size: np.ndarray, together: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids in a row, ids of each unit) of both tokenizers."""
        if together:
            row = "".join(units)
            ends, out = np.cumsum(size), []
            for ids, sizes in ((self._encode_a([row])[0], self.a_size), (self.b.encode(row[1:]), self.b_size)):
                ids = np.array(ids, dtype=np.int64)
                upto = np.cumsum(sizes[ids])
                edges = np.searchsorted(upto, ends, side="right")
                if not len(upto) or upto[-1] != ends[-1] or not np.array_equal(upto[edges - 1], ends):
                    break  # some unit is spelled otherwise
                out.append((ids, np.diff(edges, prepend=0)))
            if len(out) == 2:
                return out[0], out[1]
        found = self._encode_a(units), self.b.encode([u[1:] for u in units], num_threads=1)
        a, b = ((np.array(list(itertools.chain.from_iterable(x)), dtype=np.int64), np.array(list(map(len, x)), dtype=np.int64)) for x in found)
        return a, b

    def _align(self, units: list[str], together: bool, with_texts: bool) -> tuple:
        n = len(units)
        raw = [u.encode() for u in units]
        size = np.array(list(map(len, raw)), dtype=np.int64)
        (a, na), (b, nb) = self._ids(units, size, together)
        unit_a, unit_b = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
        ok = np.bincount(unit_a, weights=self.a_size[a], minlength=n) == size
        ok &= np.bincount(unit_b, weights=self.b_size[b], minlength=n) == size
        spelled_a = b"".join(map(self.a_bytes.__getitem__, a[ok[unit_a]].tolist()))
        spelled_b = b"".join(map(self.b_bytes.__getitem__, b[ok[unit_b]].tolist()))
        want = b"".join(itertools.compress(raw, ok.tolist()))
        if spelled_a != want or spelled_b != want:
            at = 0
            for i in np.flatnonzero(ok):
                part = slice(at, at + int(size[i]))
                ok[i] = spelled_a[part] == raw[i] == spelled_b[part]
                at += int(size[i])
        if not ok.all():
            keep_a, keep_b = ok[unit_a], ok[unit_b]
            a, b, unit_a, unit_b = a[keep_a], b[keep_b], unit_a[keep_a], unit_b[keep_b]
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        edge_a = np.concatenate([[0], np.searchsorted(end_a, common, side="right")])
        edge_b = np.concatenate([[0], np.searchsorted(end_b, common, side="right")])
        unit = unit_a[edge_a[:-1]] if len(common) else np.zeros(0, np.int64)
        count_a, count_b = np.diff(edge_a), np.diff(edge_b)
        numbers = np.stack([
            np.where(ok, na, 0), np.where(ok, nb, 0), np.bincount(unit, minlength=n),
            np.bincount(unit, weights=count_a * count_b, minlength=n).astype(np.int64),
        ])
        texts = self._texts(a, b, edge_a, edge_b, unit, n) if with_texts else None
        return ok, numbers, texts, *self._links(a, b, edge_a, edge_b, unit)

    def _texts(self, a: np.ndarray, b: np.ndarray, edge_a: np.ndarray, edge_b: np.ndarray, unit: np.ndarray, n: int) -> list[str]:
        words_a, words_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cuts_a, cuts_b = edge_a.tolist(), edge_b.tolist()
        groups = [
            f"{words_a[i] if j - i == 1 else ','.join(words_a[i:j])}|{words_b[k] if m - k == 1 else ','.join(words_b[k:m])}"
            for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        cuts = np.searchsorted(unit, np.arange(n + 1)).tolist()
        return [groups[i] if j - i == 1 else ";".join(groups[i:j]) for i, j in zip(cuts, cuts[1:])]

    def _links(self, a: np.ndarray, b: np.ndarray, edge_a: np.ndarray, edge_b: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, times): different tokens of each group and side, each with all of the other side, added up per unit."""
        groups = len(unit)
        sides = []
        for ids, edges, width in ((a, edge_a, len(self.a_size)), (b, edge_b, len(self.b_size))):
            group = np.repeat(np.arange(groups), np.diff(edges))
            if len(ids) > groups:  # some group has several tokens
                found, times = np.unique(group * width + ids, return_counts=True)
                group, ids = found // width, found % width
            else:
                times = np.ones(len(ids), np.int64)
            sides.append((group, ids, times))
        (group, left, left_times), (right_group, right, right_times) = sides
        edge = np.searchsorted(right_group, np.arange(groups + 1))
        fan = np.diff(edge)[group]
        source = np.repeat(np.arange(len(group)), fan)
        target = np.arange(len(source)) + np.repeat(edge[group] - np.cumsum(fan) + fan, fan)
        key = left[source] * len(self.b_size) + right[target]
        times = left_times[source] * right_times[target]
        span = len(self.a_size) * len(self.b_size)
        both, place = np.unique(unit[group[source]] * span + key, return_inverse=True)
        return both // span, both % span, np.bincount(place, weights=times, minlength=len(both)).astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def _blocks(batches: Iterator[pa.RecordBatch], tokenizers: Aligner, with_texts: bool) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], Units]]:
    """Blocks of rows, the units of each row's text (none where it has no tokens), and the alignments of all their units."""
    for batch in gathered(batches, _BLOCK_ROWS, BLOCK_BYTES):
        rows, units = cut(batch.column(batch.schema.get_field_index("__text")), led=True)
        found = tokenizers.align(units, with_texts)
        if not found.ok.all():
            rows = [r if found.ok[r].all() else r[:0] for r in rows]
        yield batch, rows, found


def _pair_counts(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    for _, rows, units in _blocks(batches, aligner(first, second), False):
        number, pairs = max(1, len(units.ok)), max(1, len(units.keys))
        total = np.zeros(len(units.keys), dtype=np.int64)
        for at in range(0, len(rows), _TOGETHER):  # documents whose pairs are made different together
            part = rows[at : at + _TOGETHER]
            held = np.unique(np.repeat(np.arange(len(part)), list(map(len, part))) * number + np.concatenate(part))
            document, unit = held // number, held % number
            sizes = units.edges[unit + 1] - units.edges[unit]
            different = np.unique(np.repeat(document, sizes) * pairs + gathered_ids(units.key, units.edges, unit))
            total += np.bincount(different % pairs, minlength=len(total))[: len(total)]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(units.keys[held], pa.int64()), pa.array(total[held])], ["key", "n"])


def _vector_parts(batches: Iterator[pa.RecordBatch], perfect: Broadcast) -> Iterator[pa.RecordBatch]:
    """The task's counts as one dense vector, in chunks."""
    table: PerfectHash = perfect.value
    vector = np.zeros(len(table), dtype=np.int64)
    for batch in batches:
        number = table.numbers(batch.column(0).to_numpy(zero_copy_only=False))
        mine = number >= 0
        np.add.at(vector, number[mine], batch.column(1).to_numpy(zero_copy_only=False)[mine])
    for chunk, at in enumerate(range(0, len(vector), _CHUNK)):
        part = vector[at : at + _CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["chunk", "vector"])


def _add_vectors(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for part in parts:
        for value in part.column(part.schema.get_field_index("vector")):
            vector = np.frombuffer(value.as_py(), dtype=np.int64)
            total = vector.copy() if total is None else total + vector
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["chunk", "vector"])


def tree_sum(counts: DataFrame, perfect: Broadcast, tasks: int) -> np.ndarray:
    """Counts by number: a dense vector per task, added up in groups of tasks and then over all."""
    schema = StructType([StructField("chunk", LongType()), StructField("vector", BinaryType())])
    vectors = counts.coalesce(tasks).mapInArrow(lambda batches: _vector_parts(batches, perfect), schema)
    groups = vectors.groupBy("chunk", F.pmod(F.spark_partition_id(), F.lit(max(1, tasks // _FAN))).alias("branch")).applyInArrow(_add_vectors, schema)
    chunks = groups.groupBy("chunk").applyInArrow(_add_vectors, schema).toArrow()
    out = np.zeros(len(perfect.value), dtype=np.int64)
    for chunk, vector in zip(chunks["chunk"].to_pylist(), chunks["vector"].to_pylist()):
        values = np.frombuffer(vector, dtype=np.int64)
        out[chunk * _CHUNK : chunk * _CHUNK + len(values)] = values
    return out


def _counts_of(keys: np.ndarray, slices: list[Broadcast]) -> np.ndarray:
    out = np.zeros(len(keys), dtype=np.int64)
    open_ = np.ones(len(keys), dtype=bool)
    for part in slices:
        table, counts = part.value
        number = table.numbers(keys)
        mine = number >= 0
        out[mine] = counts[number[mine]]
        open_ &= ~mine
        if len(slices) > 1:
            del part._value  # a worker holds one part at a time; it is read again from the executor's disk
    if open_.any():
        raise ValueError("a pair of the second pass was not counted in the first")
    return out


def aligned(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", first: str = FIRST, second: str = SECOND, slice_pairs: int = SLICE_PAIRS
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): one row per row."""
    spark = docs.sparkSession
    paths = public_tokenizers.path(first), public_tokenizers.path(second)
    width = len(aligner(*paths).b_size)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("__text"))
    pair_schema = StructType([StructField("key", LongType()), StructField("n", LongType())])
    with bounded_batches(spark):
        counts = materialize(texts.select("__text").mapInArrow(lambda batches: _pair_counts(batches, *paths), pair_schema), "pairs")
    keys = materialize(counts.select("key").distinct(), "keys")
    number = keys.count()
    parts = number_of_shards(number)
    built = materialize(shards(keys, parts), "shards")
    # as many vectors as are together no longer than the rows they add up
    tasks = max(1, counts.count() // max(1, min(number, slice_pairs)))
    slices, best = [], np.zeros(0, dtype=np.int64)
    for start, count in chunked(keys, parts, slice_pairs) if number else ():
        table = PerfectHash(built.where(shard_column(start, count)).toArrow(), parts, start, count)
        perfect = spark.sparkContext.broadcast(table)
        total = tree_sum(counts, perfect, tasks)
        perfect.destroy()
        left = table.keys.astype(np.int64) // width
        if len(left):
            best = np.concatenate([best, np.zeros(max(0, int(left.max()) + 1 - len(best)), np.int64)])
            np.maximum.at(best, left, total)
        slices.append(spark.sparkContext.broadcast((table, total)))
    highest = spark.sparkContext.broadcast(best)
    discard(counts, keys, built)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, units in _blocks(batches, aligner(*paths), True):
            # texts without tokens may hold units, and pairs, that no counted text has
            used = np.zeros(len(units.ok), dtype=bool)
            used[np.concatenate(rows)] = True
            held = np.unique(units.key[used[units.unit]])
            found = np.zeros(len(units.keys), dtype=np.int64)
            found[held] = _counts_of(units.keys[held], slices)
            top = np.zeros(len(units.keys), dtype=bool)
            top[held] = found[held] == highest.value[units.keys[held] // width]
            n = len(units.ok)
            sums = np.stack([
                *units.numbers,
                np.add.reduceat(np.append(units.times * top[units.key], 0), units.edges[:-1]) * (np.diff(units.edges) > 0) if n else np.zeros(0, np.int64),
                np.add.reduceat(np.append(units.times * found[units.key], 0), units.edges[:-1]) * (np.diff(units.edges) > 0) if n else np.zeros(0, np.int64),
            ]).astype(np.int64)
            at, texts, values, size = 0, [], [], 0
            for k, row in enumerate(rows):
                texts.append(";".join([units.texts[u] for u in row.tolist()]))
                values.append(sums[:, row].sum(axis=1))
                size += len(texts[-1])
                if size >= _OUT_BYTES or k + 1 == len(rows):
                    columns = [pa.array(c) for c in np.stack(values, axis=1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns, pa.array(texts, pa.string())], names=names)
                    at, texts, values, size = k + 1, [], [], 0

    fields = [StructField(c, LongType()) for c in (*_NUMBERS, "n_best", "count_sum")]
    schema = StructType([texts.schema["id"], *fields, StructField("groups", StringType())])
    names = schema.names
    return texts.mapInArrow(work, schema)
