"""Removal of long passages that repeat across documents.

A window is ``window`` consecutive words.  Its minimiser is the least hash of
its runs of ``gram`` words.  Consecutive windows with one minimiser form a
super-k-mer; it travels as one string to the bucket of its minimiser, where
sorting the windows finds equal ones exactly.  Equal windows have the same
minimiser, so three exact reductions come first:

* a minimiser that occurs in one document only holds no repeat;
* if all super-k-mers of a minimiser are equal, their first document is known
  without looking at windows (copies, whatever their number);
* equal super-k-mers are combined before they travel.

A bucket of more than ``BUCKET_WINDOWS`` windows in different super-k-mers (one
passage with thousands of variants) is never held by one task: its windows are
counted one by one, combined before the shuffle.

Rows: null ids neither remove nor lose words; null and empty texts have no
words; rows that share an id do not remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import discard, materialize
from .words import Block, blocks, gram_hashes, mix, places_in_documents, sliding_minimum

WINDOW = 50
GRAM = 5
RUN_WINDOWS = 256  # longer runs are cut, with overlap
BUCKET_WINDOWS = 1 << 17
_SEGMENT = 1 << 18
_STEP = 0xD1342543DE82EF95
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        size = _SEGMENT + RUN_WINDOWS + 4096
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables.append(np.cumprod(steps, dtype=np.uint64))
    return _tables


class Runs:
    """Super-k-mers of a block: document row, first word, windows, minimiser and a hash of the words."""

    def __init__(self, block: Block, window: int, gram: int):
        words = block.hashes()
        keys = sliding_minimum(gram_hashes(words, gram), window - gram + 1)
        doc, place = places_in_documents(block.docs)
        whole = np.flatnonzero(place[: len(keys)] + window <= np.diff(block.docs)[doc[: len(keys)]])
        key, owner = keys[whole], doc[whole]
        change = np.ones(len(whole), dtype=bool)
        change[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(whole)))
        pieces = -(-count // RUN_WINDOWS)
        if len(pieces) and pieces.max() > 1:
            part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + part * RUN_WINDOWS
            count = np.minimum(np.repeat(count, pieces) - part * RUN_WINDOWS, RUN_WINDOWS)
        self.word = whole[first]
        self.row = owner[first]
        self.first = place[self.word]
        self.windows = count
        self.key = key[first].view(np.int64)
        self.hash = self._hashes(words, self.word, self.word + count + window - 1)

    @staticmethod
    def _hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        up, down = _powers()
        at = 0
        while at < len(start):
            base = int(start[at])
            to = max(at + 1, int(np.searchsorted(start, base + _SEGMENT)))
            last = int(end[at:to].max()) - base
            sums = np.zeros(last + 1, dtype=np.uint64)
            np.cumsum(words[base : base + last] * up[:last], out=sums[1:])
            out[at:to] = (sums[end[at:to] - base] - sums[start[at:to] - base]) * down[start[at:to] - base]
            at = to
        return mix(out).view(np.int64)


def _batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


_LIGHT = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("id", pa.int64()), ("body", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])


def _light_rows(window: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, body = batch.column("id").to_numpy(zero_copy_only=False), batch.column("body").to_numpy()
            for block in blocks(batch.column("text")):
                runs = Runs(block, window, gram)
                rows = block.first + runs.row
                yield _batch({"key": runs.key, "run": runs.hash, "id": ids[rows], "body": body[rows], "first": runs.first, "windows": runs.windows}, _LIGHT)

    return work


_PACKED = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("words", pa.binary()), ("windows", pa.int32()), ("id", pa.int64())])


def _packed_rows(window: int, gram: int):
    """Strings of the super-k-mers whose minimiser is in the row's ``keys``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            wanted = batch.column("keys")
            for block in blocks(batch.column("text")):
                runs = Runs(block, window, gram)
                keep = np.zeros(len(runs.key), dtype=bool)
                edges = np.searchsorted(runs.row, np.arange(block.rows + 1))
                texts: list[bytes] = []
                for row in range(block.rows):
                    lo, hi = int(edges[row]), int(edges[row + 1])
                    keys = wanted[block.first + row].values
                    if lo == hi or keys is None or not len(keys):
                        continue
                    keep[lo:hi] = np.isin(runs.key[lo:hi], keys.to_numpy())
                    if not keep[lo:hi].any():
                        continue
                    split = block.text_of(row).split()
                    for k in (lo + np.flatnonzero(keep[lo:hi])).tolist():
                        start = int(runs.first[k])
                        texts.append(b" ".join(split[start : start + int(runs.windows[k]) + window - 1]))
                yield _batch({"key": runs.key[keep], "run": runs.hash[keep], "words": texts, "windows": runs.windows[keep], "id": ids[block.first + runs.row[keep]]}, _PACKED)

    return work


def _windows_of(words: bytes, window: int) -> list[bytes]:
    split = words.split(b" ")
    ends, at = [], -1
    for word in split:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [words[starts[i] : ends[i + window - 1]] for i in range(len(split) - window + 1)]


_STRETCH = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("least", pa.int64())])
_SPANS = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("stretches", pa.list_(_STRETCH))])
_SPANS_TYPE = "key bigint, run bigint, stretches array<struct<lo: int, hi: int, least: bigint>>"


def _sorted_bucket(rows: list[tuple[int, bytes, int, int]], key: int, window: int, out: list[tuple]) -> None:
    """Windows of one bucket, sorted; for each super-k-mer the stretches whose first document is smaller than its last."""
    listed = sorted((text, first, at, place) for at, (_, words, first, _) in enumerate(rows) for place, text in enumerate(_windows_of(words, window)))
    least: list[dict[int, int]] = [{} for _ in rows]
    last, smallest = None, 0
    for text, first, at, place in listed:
        if text != last:
            last, smallest = text, first
        least[at][place] = smallest
    for (run, _, _, latest), found in zip(rows, least):
        lo, n, stretches = 0, len(found), []
        while lo < n:
            hi = lo + 1
            while hi < n and found[hi] == found[lo]:
                hi += 1
            if found[lo] < latest:
                stretches.append((lo, hi, found[lo]))
            lo = hi
        if stretches:
            out.append((key, run, [dict(zip(("lo", "hi", "least"), s)) for s in stretches]))


def _bucket_rows(window: int):
    """Reads rows in the order of their minimiser."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for k, run, words, first, latest in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "words", "first", "latest"))):
                if k != key:
                    if rows:
                        _sorted_bucket(rows, key, window, out)
                    key, rows = k, []
                rows.append((run, words, first, latest))
                if len(out) >= 20_000:
                    yield _batch(dict(zip(_SPANS.names, zip(*out))), _SPANS)
                    out = []
        if rows:
            _sorted_bucket(rows, key, window, out)
        if out:
            yield _batch(dict(zip(_SPANS.names, zip(*out))), _SPANS)

    return work


_WINDOWS = pa.schema([("window", pa.binary()), ("key", pa.int64()), ("run", pa.int64()), ("lo", pa.int32()), ("first", pa.int64()), ("latest", pa.int64())])


def _window_rows(window: int):
    """Every window of a super-k-mer, as a 128-bit digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, run, words, first, latest in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "words", "first", "latest"))):
                out.extend((hashlib.blake2b(text, digest_size=16).digest(), key, run, place, first, latest) for place, text in enumerate(_windows_of(words, window)))
                if len(out) >= 20_000:
                    yield _batch(dict(zip(_WINDOWS.names, zip(*out))), _WINDOWS)
                    out = []
            if out:
                yield _batch(dict(zip(_WINDOWS.names, zip(*out))), _WINDOWS)

    return work


def _spark_type(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(id, body, spans) with the word ranges [lo, hi) to remove, and (id, body, text, keys) of the documents that may have some.

    ``body`` is a hash of the text; it tells rows that share an id apart.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(F.col(text_column)).alias("body"), F.col(text_column).alias("text"))
    docs = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    light = materialize(docs.mapInArrow(_light_rows(window, gram), _spark_type(_LIGHT)), "superkmers")

    shared = light.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("run").alias("a"), F.max("run").alias("b"))
    shared = materialize(shared.where("least < most").select("key", "least", (F.col("a") != F.col("b")).alias("varied")), "shared-minimisers")
    runs = materialize(light.join(shared, "key"), "shared-runs")
    discard(light, shared)

    direct = runs.where("not varied and id > least").select("id", "body", F.col("first").alias("lo"), (F.col("first") + F.col("windows") + (window - 1)).alias("hi"))
    wanted = runs.where("varied or id > least").groupBy("id", "body").agg(F.collect_set(F.when(F.col("varied"), F.col("key"))).alias("keys"))
    texts = materialize(docs.join(wanted, ["id", "body"]), "texts-with-repeats")

    packed = texts.where("size(keys) > 0").mapInArrow(_packed_rows(window, gram), _spark_type(_PACKED))
    different = materialize(packed.groupBy("key", "run", "words", "windows").agg(F.min("id").alias("first"), F.max("id").alias("latest")), "different-runs")
    sizes = different.groupBy("key").agg(F.sum("windows").alias("n"))
    large = materialize(sizes.where(F.col("n") > bucket_windows).select("key"), "large-buckets")
    columns = ["key", "run", "words", "first", "latest"]
    small = different.join(large, "key", "left_anti").select(columns)
    found = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_rows(window), _SPANS_TYPE)
    if not large.isEmpty():
        listed = materialize(different.join(large, "key").select(columns).mapInArrow(_window_rows(window), _spark_type(_WINDOWS)), "windows")
        least = materialize(listed.groupBy("window").agg(F.min("first").alias("least"), F.max("latest").alias("l")).where("least < l").drop("l"), "first-windows")
        one_by_one = listed.join(least, "window").where("least < latest")
        stretch = F.struct("lo", (F.col("lo") + 1).alias("hi"), "least")
        found = found.unionByName(one_by_one.groupBy("key", "run").agg(F.collect_list(stretch).alias("stretches")))
    found = materialize(found, "bucket-spans")
    discard(different, large)

    varied = runs.where("varied").select("key", "run", "id", "body", "first").join(found, ["key", "run"])
    place = F.transform(
        F.filter("stretches", lambda s: s["least"] < F.col("id")),
        lambda s: F.struct((F.col("first") + s["lo"]).alias("lo"), (F.col("first") + s["hi"] + (window - 1)).alias("hi")),
    )
    direct = direct.select("id", "body", F.array(F.struct("lo", "hi")).alias("spans"))
    spans = direct.unionByName(varied.select("id", "body", place.alias("spans"))).where("size(spans) > 0")
    spans = spans.groupBy("id", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = materialize(spans, "spans")
    discard(runs, found)
    return spans, texts


def covered(spans: list[dict], n_words: int) -> np.ndarray:
    """Flag of each word that lies in one of the spans."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    for span in spans:
        step[span["lo"]] += 1
        step[span["hi"]] -= 1
    return np.cumsum(step[:-1]) > 0


def kept_words(text: str, spans: list[dict]) -> tuple[int, bytes]:
    """Number of removed words, and the other words joined by one space."""
    split = text.encode().split()
    gone = covered(spans, len(split))
    return int(gone.sum()), b" ".join(w for w, g in zip(split, gone.tolist()) if not g)


_REMOVED = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _removed_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            removed, kept = kept_words(text, spans)
            digests.append((removed, hashlib.sha256(kept).hexdigest()))
        columns = {"id": batch.column("id"), "body": batch.column("body"), "n_removed": [d[0] for d in digests], "kept_sha256": [d[1] for d in digests]}
        yield _batch(columns, _REMOVED)


_WHOLE = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string())])


def _whole_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(text or "").encode().split() for text in batch.column("text").to_pylist()]
        columns = {
            "id": batch.column("id"), "body": batch.column("body"), "n_words": [len(w) for w in words],
            "whole_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
        }
        yield _batch(columns, _WHOLE)


def removal_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document; only light rows are joined back."""
    spans, texts = repeated_spans(docs, id_column, text_column, window, gram, bucket_windows)
    removed = texts.drop("keys").join(spans, ["id", "body"]).mapInArrow(_removed_digest, _spark_type(_REMOVED)).dropDuplicates(["id", "body"])
    light = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(F.col(text_column)).alias("body"), F.col(text_column).alias("text"))
    whole = light.mapInArrow(_whole_digest, _spark_type(_WHOLE))
    return whole.join(removed, ["id", "body"], "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents without their repeated words; texts that lose nothing stay as they are."""
    spans, texts = repeated_spans(docs, id_column, text_column, window)
    discard(texts)
    spans = spans.toDF("__id", "__body", "__spans")
    same = (F.col(id_column).cast("bigint") == F.col("__id")) & (F.xxhash64(F.col(text_column)) == F.col("__body"))
    joined = docs.join(spans, same, "left").drop("__id", "__body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            kept = [t if not s else kept_words(t, s)[1].decode() for t, s in zip(batch.column(at).to_pylist(), batch.column("__spans").to_pylist())]
            arrays = [pa.array(kept, type=pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return joined.mapInArrow(cut, docs.schema)
