"""Document fingerprints by randomised edit embedding.

Shared random walks read a text: at each step of time the walk writes the
current character and, by a random bit that depends on the time and the
character only, stays or moves on.  Texts that differ by few edits fall back
into step, so their embeddings differ in few places: edit distance becomes
Hamming distance.  The fingerprint samples the embedding in ``SAMPLES`` bins of
time per walk.  Each bin takes the time of least random priority below the
text's end, which texts of similar length share, and keeps a byte of the
characters written from there on.  Likeness is the share of equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from .linking import Comparison, linked
from .words import mix

WALKS = 2
SAMPLES = 128
SPAN = 4  # characters kept at a sampled time
_CLASSES, _PERIOD = 64, 1 << 14
_CELLS = 1 << 22
_EMPTY = 0

_steps: dict[int, np.ndarray] = {}
_times: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _stay(walk: int) -> np.ndarray:
    """Steps from arriving at a character class at a time (modulo the period) to leaving it."""
    if walk not in _steps:
        rng = np.random.Generator(np.random.Philox(7_000 + walk))
        move = rng.random((_PERIOD, _CLASSES)) < 0.5
        move[0] = True  # bounds every stay by the period
        stay = np.zeros((_PERIOD, _CLASSES), dtype=np.int32)
        left = np.zeros(_CLASSES, dtype=np.int32)
        for at in range(2 * _PERIOD - 1, -1, -1):
            left = np.where(move[at % _PERIOD], 1, left + 1)
            if at < _PERIOD:
                stay[at] = left
        _steps[walk] = stay.ravel()
    return _steps[walk]


def _records(walk: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Times that are of least priority in their bin up to themselves, by bin, and each bin's first entry."""
    limit = 1 << max(12, int(end).bit_length())
    key = (walk, limit)
    if key not in _times:
        draw = mix(np.arange(limit, dtype=np.uint64) + np.uint64((walk + 1) << 48))
        box, priority = (draw % np.uint64(SAMPLES)).astype(np.int64), draw >> np.uint64(8)
        found = []
        for b in range(SAMPLES):
            at = np.flatnonzero(box == b)
            least = np.minimum.accumulate(priority[at])
            new = np.ones(len(at), dtype=bool)
            new[1:] = least[1:] < least[:-1]
            found.append(at[new])
        firsts = np.cumsum([0, *map(len, found)])
        _times[key] = (np.concatenate([f + b * (1 << 40) for b, f in enumerate(found)]), firsts)
    return _times[key]


def _sampled_times(walk: int, end: int) -> np.ndarray:
    """The sampled time of each bin for an embedding that ends before ``end``; -1 for none."""
    keys, firsts = _records(walk, end)
    at = np.searchsorted(keys, np.arange(SAMPLES) * (1 << 40) + end) - 1
    return np.where(at >= firsts[:-1], keys[np.maximum(at, 0)] & ((1 << 40) - 1), -1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _walked(points: list[np.ndarray], start: np.ndarray, walk: int) -> np.ndarray:
    """Arrival times (text x place, the start first) of texts in the order of falling length, from the given times on."""
    longest = len(points[0]) if points else 0
    chars = np.zeros((longest, len(points)), dtype=np.int32)
    for column, p in enumerate(points):
        chars[: len(p), column] = (p * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.int32)
    # texts longer than each place
    live = np.searchsorted(-np.array([len(p) for p in points], dtype=np.int64), -np.arange(longest), side="left")
    stay = _stay(walk)
    arrival = np.zeros((longest + 1, len(points)), dtype=np.int32)
    now = start.astype(np.int32)
    arrival[0] = now
    for place in range(longest):
        n = live[place]
        head = now[:n]
        head += stay[(head & (_PERIOD - 1)) * _CLASSES + chars[place, :n]]
        arrival[place + 1] = now
    return np.ascontiguousarray(arrival.T)


def _sampled(out: np.ndarray, walk: int, points: np.ndarray, arrival: np.ndarray) -> None:
    """The bytes of one walk: what stands at the sampled times."""
    size = len(points)
    times = _sampled_times(walk, int(arrival[size]))
    has = np.flatnonzero(times >= 0)
    place = np.searchsorted(arrival[:size], times[has], side="right") - 1
    value = times[has].astype(np.uint64)
    for k in range(SPAN):
        inside = place + k < size
        value = value * np.uint64(0xD1342543DE82EF95) + np.where(inside, points[np.minimum(place + k, size - 1)], 0).astype(np.uint64)
    out[walk * SAMPLES + has] = (mix(value) % np.uint64(255)).astype(np.uint8) + 1


def fingerprints(texts: list[str]) -> list[bytes]:
    """WALKS * SAMPLES bytes for each text; a byte is 0 where the text is too short for the bin."""
    return fingerprints_with_edits(texts, [None] * len(texts))[0]


def fingerprints_with_edits(texts: list[str], edits: list[tuple[int, str] | None]) -> tuple[list[bytes], list[bytes]]:
    """Fingerprints of texts, and of the texts that keep so many first characters and go on otherwise.

    An edited text's walk starts where its own text's walk stands at the cut.
    """
    points = [_points(t) for t in texts]
    out, edited = (np.full((len(texts), WALKS * SAMPLES), _EMPTY, dtype=np.uint8) for _ in range(2))
    order = sorted((i for i in range(len(points)) if len(points[i])), key=lambda i: -len(points[i]))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, _CELLS // len(points[order[at]]))]
        at += len(group)
        tails = {i: (column, edits[i][0], _points(edits[i][1])) for column, i in enumerate(group) if edits[i] is not None}
        later = sorted(tails, key=lambda i: -len(tails[i][2]))
        for walk in range(WALKS):
            arrival = _walked([points[i] for i in group], np.zeros(len(group)), walk)
            for column, i in enumerate(group):
                _sampled(out[i], walk, points[i], arrival[column])
            begin = np.array([arrival[tails[i][0], tails[i][1]] for i in later], dtype=np.int32)
            beyond = _walked([tails[i][2] for i in later], begin, walk)
            for row, i in enumerate(later):
                column, kept, tail = tails[i]
                if kept + len(tail):
                    whole = np.concatenate([arrival[column, : kept + 1], beyond[row, 1 : len(tail) + 1]])
                    _sampled(edited[i], walk, np.concatenate([points[i][:kept], tail]), whole)
    return [row.tobytes() for row in out], [row.tobytes() for row in edited]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bytes among the bins that either text fills; 1 for two empty texts."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    filled = (x != _EMPTY) | (y != _EMPTY)
    return float((x == y)[filled].mean()) if filled.any() else 1.0


def bit_samples(fingerprint: bytes, bands: int, rows: int) -> list[int]:
    """Bands of sampled bytes, as 64-bit keys; none for an empty text."""
    x = np.frombuffer(fingerprint, np.uint8).astype(np.uint64)
    if not x.any():
        return []
    chosen = np.random.Generator(np.random.Philox(99)).permutation(len(x))[: bands * rows].reshape(bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + x[chosen[:, k]])
    return key.view(np.int64).tolist()


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7, bands: int = 24, rows: int = 6) -> DataFrame:
    """(fingerprint, id, class_id): documents whose fingerprints are linked by a likeness of ``threshold`` or more.

    Equal fingerprints are one node.  class_id is the least id of the class;
    null texts are left out.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text").to_pylist())
            node = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in prints]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "node": node, "fingerprint": prints, "bands": pa.array([bit_samples(p, bands, rows) for p in prints], pa.list_(pa.int64()))})

    texts = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    found = materialize(texts.mapInArrow(signed, "id bigint, node bigint, fingerprint binary, bands array<bigint>"), "fingerprints")
    nodes = materialize(found.groupBy("node", "fingerprint").agg(F.min("id").alias("least")), "nodes")
    buckets = materialize(found.select("node", F.explode("bands").alias("bucket")).distinct(), "bands")

    def prepare(_: DataFrame):
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [likeness(x, y) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def verify(pairs: DataFrame, _: bool) -> DataFrame:
            left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("fingerprint").alias("x")), "a")
            both = left.join(nodes.select(F.col("node").alias("b"), F.col("fingerprint").alias("y")), "b")
            return materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "verified")

        return Comparison(verify)

    linked_nodes, _ = linked(buckets, prepare)
    placed = nodes.join(linked_nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = placed.join(least, "component").select("node", "class_id")
    return found.select("fingerprint", "id", "node").join(classes, "node").drop("node")


def _edges(docs: DataFrame, id_column: str, parts: int) -> list[int]:
    """The largest id of each of at most ``parts`` ranges of ids, in descending order; ids alone are read."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((max(b.column(0).to_pylist()) for b in batches if b.num_rows), default=None)
        if most is not None:
            yield pa.RecordBatch.from_pydict({"id": [most]})

    ids = docs.select(_order_id(id_column).alias("id"))
    return sorted({r["id"] for r in ids.repartitionByRange(parts, "id").mapInArrow(largest, "id bigint").collect()}, reverse=True)


def _order_id(column: str):
    """Null ids come last in descending order."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(-(1 << 63)))


_EDITED = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following text (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of bucket, own rows before guests, descending id; the first guest follows the bucket's last row."""
    held: list[tuple] = []  # the last own row of the bucket so far: (bucket, id, text, fingerprint)

    def result(done: list[tuple[tuple, str, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "id": pa.array([r[1] for r, *_ in done], pa.int64()), "n_chars": [len(r[2]) for r, *_ in done],
            "edited_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text, _, _ in done], "fingerprint": [r[3].hex() for r, *_ in done],
            "edited_fingerprint": [e.hex() for _, _, e, _ in done], "near_edited": [likeness(r[3], e) for r, _, e, _ in done],
            "near_next": [likeness(r[3], f) for r, _, _, f in done],
        })

    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            buckets, guests = batch.column("bucket").to_pylist(), batch.column("guest").to_pylist()
            # own rows with their follower in the batch: the edit is known, and walks on from the own text's walk
            known = [not guests[k] and k + 1 < len(texts) and buckets[k + 1] == buckets[k] for k in range(len(texts))]
            edits = [(len(t) - len(t) // 2, texts[k + 1][: len(t) // 2]) if known[k] else None for k, t in enumerate(texts)]
            prints, edited = fingerprints_with_edits(texts, edits)
            rows = list(zip(buckets, batch.column("id").to_pylist(), texts, prints))
            done = []
            for k, row in enumerate(rows):
                if held and held[0][0] == row[0]:
                    text = edited_text(held[0][2], row[2])
                    own = edited[k - 1] if k and known[k - 1] else fingerprints([text])[0]
                    done.append((held[0], text, own, row[3]))
                    held = []
                if not guests[k]:
                    held = [row]
            if done:
                yield result(done)


def edit_comparison(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edit with the next document, by descending id; the first follows the last.

    Equal ids are in the order of their texts, null ids come last, null texts
    are empty.  Each range of ids goes to one task, with the first row of the range
    after it as a guest, so no text is moved twice; a task reads several ranges.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = _edges(docs, id_column, 8 * tasks)
    ascending = np.array(edges[::-1], dtype=np.int64)
    n = len(edges)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        """Own bucket, and the bucket before it (or the last) for the rows at an edge."""
        values = ids.to_numpy(dtype=np.int64)
        up = np.searchsorted(ascending, values)
        own = n - 1 - up
        edge = ascending[np.minimum(up, n - 1)] == values
        return pd.Series([[int(o), int((o - 1) % n)] if e else [int(o)] for o, e in zip(own, edge)])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), _order_id(id_column).alias("order"), F.col(text_column).alias("text"))
    dealt = rows.withColumn("ranges", ranges("order")).select("id", "order", "text", F.posexplode("ranges").alias("guest", "bucket"))
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "guest", F.desc("order"), "text")
    return dealt.mapInArrow(_compared, _EDITED)
