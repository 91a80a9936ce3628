"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

A gram is up to ``ORDER`` characters of a lower-cased word, from its start mark
on.  Toxic and ordinary training documents have gram counts of their own; both
back off to one chain of continuation counts (different left neighbours) taken
over the words of all documents, so expressions that are rare in a class are
smoothed by what the whole corpus holds.  A word's evidence is the difference
of its toxic and ordinary log-likelihoods; a document is compared by evidence
normalised by its length and by its strongest words.

Texts are read once: each batch of documents, bounded in characters, becomes a
list of different words, the counts of them in each document, and its different
grams.  Grams are counted from these, and documents are scored by them: only the
values of a batch's grams go back to it, where they are summed per word, and no
text is stored or moved.  All grams and histories stay in Spark.  Weights are
set on a bounded sample of training documents, each scored by counts from the
other training fold, so that no document vouches for itself.  Labels, language,
source and id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import broadcast_if_small, discard, materialize
from .batches import bounded_batches, passing_shuffles
from .labelled import SAMPLE_ROWS, labelled_sample
from .words import mix

ORDER = 6
DISCOUNT = 0.75
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
_START, _END = "\x02", "\x03"
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…¿¡–—·"
_BASE = np.uint64(0xD1342543DE82EF95)
_CUTS = (4.0, 7.0, 10.0)
# a batch ends after so many documents, characters, or characters of different words
_BATCH_DOCS, _BATCH_CHARS, _BATCH_WORD_CHARS = 1 << 16, 24 << 20, 4 << 20
_SENT_ROWS = 20_000
ROUNDS = 4
_GRAM_WORDS = 1 << 15  # words whose grams are made at once


class _Words(dict):
    """Numbers of the different words of a batch, lower-cased and stripped of marks, by the word as it stands."""

    def __init__(self):
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.chars = 0

    def __missing__(self, found: str) -> int:
        word = found.strip(_STRIP)
        number = self.numbers.get(word)
        if number is None:
            number = self.numbers[word] = len(self.numbers)
            self.chars += len(word) + 2
        self[found] = number
        return number

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the different words of a text, rising, and how often it has them."""
        split = (text or "").lower().split()
        return np.unique(np.fromiter(map(self.__getitem__, split), np.int64, len(split)), return_counts=True)


def _packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(numbers, prepend=0), times]).astype("<i4").tobytes(), 1)


def _unpacked(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(counts), dtype="<i4")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


class Grams:
    """All grams of a list of words: each character with up to ORDER - 1 before it."""

    def __init__(self, words: list[str], order: int = ORDER):
        marked = [_START + w + _END for w in words]
        text = "".join(marked)
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        self.word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code, power = points.copy(), np.uint64(1)
        for back in range(1, order):
            power = np.uint64((int(power) * int(_BASE)) % (1 << 64))
            has = np.flatnonzero(place >= back)
            code[has] += points[has - back] * power
        real = place > 0  # the start mark itself is no event
        self.code, self.word = mix(code[real]), self.word[real]
        self.end = np.flatnonzero(real) + 1
        self.start = self.end - np.minimum(place + 1, order)[real]


class BatchGrams:
    """Different grams of the words of a batch, in an order that follows from the words."""

    def __init__(self, words: list[str]):
        parts, self.texts, codes, self.spans = [], [], [], []
        for at in range(0, len(words), _GRAM_WORDS):
            grams = Grams(words[at : at + _GRAM_WORDS])
            different, first, place = np.unique(grams.code, return_index=True, return_inverse=True)
            parts.append(((grams.word + at).astype(np.int32), different, place))
            codes.append(different)
            self.spans.append(np.stack([np.full(len(first), len(self.texts)), grams.start[first], grams.end[first]]))
            self.texts.append(grams.text)
        self.codes, self.first = np.unique(np.concatenate(codes), return_index=True) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.n_words = len(words)
        #: the word and the gram of each character
        self.word = np.concatenate([word for word, _, _ in parts]) if parts else np.zeros(0, np.int32)
        self.gram = np.concatenate([np.searchsorted(self.codes, d).astype(np.int32)[p] for _, d, p in parts]) if parts else np.zeros(0, np.int32)

    def strings(self) -> list[str]:
        if not self.spans:
            return []
        part, start, end = np.concatenate(self.spans, axis=1)[:, self.first].tolist()
        return [self.texts[k][a:b] for k, a, b in zip(part, start, end)]

    def by_gram(self, of_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.gram, weights=of_word[self.word], minlength=len(self.codes)).astype(np.int64)

    def by_word(self, of_gram: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=of_gram[self.gram], minlength=self.n_words)


_COUNTS = ("t0", "o0", "t2", "o2")
_KINDS = {(0, 1): 0, (0, 0): 1, (2, 1): 2, (2, 0): 3}  # of a document's fold and label


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, of words and of grams of each batch of documents."""
    key, schema = TaskContext.get().partitionId() << 32, None

    def rows(n: int, **columns) -> pa.RecordBatch:
        columns["batch"] = pa.array(np.full(n, key))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def ended() -> Iterator[pa.RecordBatch]:
        words = list(different.numbers)
        per_kind = [np.zeros(len(words), np.int64) for _ in _COUNTS]
        for sums, parts in zip(per_kind, counted):
            for numbers, times in parts:
                sums[numbers] += times
        sampled = np.zeros(len(words), bool)
        for numbers in calibrating:
            sampled[numbers] = True
        for at in range(0, len(words), _SENT_ROWS):
            yield rows(1, words=pa.array([" ".join(words[at : at + _SENT_ROWS])]), first=pa.array([at], pa.int32()), calibrates=pa.array([bool(calibrating)]))
        grams = BatchGrams(words)
        columns = {c: pa.array(grams.by_gram(s)) for c, s in zip(_COUNTS, per_kind)}
        columns |= {"gram": pa.array(grams.strings(), pa.string()), "at": pa.array(np.arange(len(grams.codes), dtype=np.int32)), "calibrates": pa.array(grams.by_gram(sampled) > 0)}
        for at in range(0, len(grams.codes), _SENT_ROWS):
            yield rows(min(_SENT_ROWS, len(grams.codes) - at), **{c: x.slice(at, _SENT_ROWS) for c, x in columns.items()})

    different, counted, calibrating, docs, chars = _Words(), [[] for _ in _COUNTS], [], 0, 0
    for whole in batches:
        schema = schema or pa.schema([
            ("batch", pa.int64()), *[whole.schema.field(c) for c in _PASSED], ("counts", pa.binary()), ("words", pa.string()), ("first", pa.int32()),
            ("gram", pa.string()), ("at", pa.int32()), *[(c, pa.int64()) for c in _COUNTS],
        ])
        texts, label, fold, calibrates = (whole.column(c).to_pylist() for c in ("text", "label", "fold", "calibrates"))
        packed, since = [], 0
        for i, text in enumerate(texts):
            numbers, times = different.counted(text)
            packed.append(_packed(numbers, times))
            if (kind := _KINDS.get((fold[i], label[i]))) is not None:
                counted[kind].append((numbers, times))
            if calibrates[i]:
                calibrating.append(numbers)
            docs, chars = docs + 1, chars + len(text or "")
            full = docs >= _BATCH_DOCS or chars >= _BATCH_CHARS or different.chars >= _BATCH_WORD_CHARS
            if full or i + 1 == len(texts):
                part = whole.slice(since, i + 1 - since)
                yield rows(part.num_rows, **{c: part.column(c) for c in _PASSED}, counts=pa.array(packed, pa.binary()))
                packed, since = [], i + 1
            if full:
                yield from ended()
                key += 1
                different, counted, calibrating, docs, chars = _Words(), [[] for _ in _COUNTS], [], 0, 0
    if docs:
        yield from ended()


_PASSED = ("id", "digest", "label", "fold", "calibrates")


def _digest(text):
    """What stands for a text; null texts count as empty ones."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _batches(docs: DataFrame, sample: DataFrame | None, id_column: str | None, text_column: str) -> DataFrame:
    """Stored batches of documents: words, their counts in each document and their grams, with counts of grams in the sample by label and fold."""
    text = F.col(f"`{text_column}`")
    rows = docs.select((F.col(f"`{id_column}`") if id_column else F.lit(None).cast("bigint")).alias("id"), text.alias("text"), _digest(text).alias("digest"))
    if sample is None:
        rows = rows.select("*", F.lit(None).cast("int").alias("label"), F.lit(None).cast("int").alias("fold"), F.lit(False).alias("calibrates"))
    else:
        known = sample.select("id", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), (F.col("calibrates") if "calibrates" in sample.columns else F.lit(False)).alias("calibrates"))
        rows = rows.join(F.broadcast(known), "id", "left").withColumn("calibrates", F.coalesce("calibrates", F.lit(False)))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"batch bigint, id {kind}, digest binary, label int, fold int, calibrates boolean, counts binary, words string, first int, gram string, at int, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    return materialize(rows.mapInArrow(_read_batches, schema), "batches")


def _shared_chain(grams: DataFrame, order: int) -> list[DataFrame]:
    """Stored tables (gram, p) by size: shared probability of the last character after the others, for grams below the full order.

    Each order counts different left neighbours and backs off to the next
    shorter one, at last to an even chance for every character.
    """
    longer, continued = grams.where(F.length("gram") == order).select("gram"), {}
    for size in range(order - 1, 0, -1):
        # grams of this size with their left neighbours, from the grams one longer
        continued[size] = materialize(longer.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), f"continuations-{size}")
        longer = grams.where(F.length("gram") == size).select("gram").unionByName(continued[size].select("gram")).distinct()
    chain, found = None, []
    for size in range(1, order):
        own = continued[size].withColumn("history", F.expr(f"substring(gram, 1, {size - 1})"))
        stats = own.groupBy("history").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = own.join(stats, "history").withColumn("tail", F.expr("substring(gram, 2)"))
        if chain is None:
            rows = rows.withColumn("lower", 1.0 / (F.col("kinds") + 1))
        else:
            rows = rows.join(chain.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
        p = (F.col("n") - F.lit(DISCOUNT)) / F.col("total") + F.lit(DISCOUNT) * F.col("kinds") / F.col("total") * F.col("lower")
        level = rows.select("gram", p.alias("p"))
        chain = materialize(level, f"chain-{size}")
        found.append(chain)
    discard(*continued.values())
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


_MODELS = ("all", "without0", "without2")


def fit_evidence(docs: DataFrame, sample: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Log-likelihood differences of known grams, and of the way down to the shared counts after known histories.

    Both from all training rows and without either fold, whole and written.
    """
    return _evidence(_batches(docs, sample, id_column, text_column))


def _evidence(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = batches.where("gram is not null")
    grams = materialize(rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "grams")
    chains = _shared_chain(grams, ORDER)
    shared = _union(chains)

    toxic = {"all": F.col("t0") + F.col("t2"), "without0": F.col("t2"), "without2": F.col("t0")}
    plain = {"all": F.col("o0") + F.col("o2"), "without0": F.col("o2"), "without2": F.col("o0")}
    counted = grams.where("t0 + o0 + t2 + o2 > 0").select(
        "gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("history"), F.expr("substring(gram, 2)").alias("tail"),
        *[f(m).alias(f"{k}_{m}") for k, f in (("t", toxic.get), ("o", plain.get)) for m in _MODELS],
    )
    stats = counted.groupBy("history").agg(*[x for m in _MODELS for k in "to" for x in (F.sum(f"{k}_{m}").alias(f"{k}_{m}_sum"), F.sum((F.col(f"{k}_{m}") > 0).cast("int")).alias(f"{k}_{m}_kinds"))])

    def down(k: str, m: str):
        return F.when(F.col(f"{k}_{m}_sum") > 0, DISCOUNT * F.col(f"{k}_{m}_kinds") / F.col(f"{k}_{m}_sum")).otherwise(F.lit(1.0))

    def chance(k: str, m: str):
        own = F.when(F.col(f"{k}_{m}") > 0, (F.col(f"{k}_{m}") - DISCOUNT) / F.col(f"{k}_{m}_sum")).otherwise(F.lit(0.0))
        return own + down(k, m) * F.col("p")

    ways = stats.select("history", *[F.log(down("t", m) / down("o", m)).alias(m) for m in _MODELS], *[f"{k}_{m}_{s}" for m in _MODELS for k in "to" for s in ("sum", "kinds")])
    ways = materialize(ways, "backoff-ways")
    known = counted.join(ways.drop(*_MODELS), "history").join(shared.withColumnRenamed("gram", "tail"), "tail")
    known = known.select("gram", *[F.log(chance("t", m) / chance("o", m)).alias(m) for m in _MODELS])

    known = materialize(known, "gram-evidence")
    histories = materialize(ways.select("history", *_MODELS), "histories")
    discard(grams, ways, *chains)
    return known, histories


def _gram_values(batches: DataFrame, grams: DataFrame, histories: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """(gram, evidence under each of the models) of all grams of the batches."""
    different = batches.where("gram is not null").select("gram").distinct().withColumn("history", F.expr("substring(gram, 1, length(gram) - 1)"))
    known = grams.select("gram", *[F.col(m).alias(f"g_{m}") for m in models])
    ways = histories.select("history", *[F.col(m).alias(f"h_{m}") for m in models])
    # a gram of no training document has the value of its history, and 0 if that is unknown too
    values = different.join(known, "gram", "left").join(ways, "history", "left").select("gram", *[F.coalesce(f"g_{m}", f"h_{m}", F.lit(0.0)).alias(m) for m in models])
    return materialize(values, "gram-values")


def _judged(batches: DataFrame, values: DataFrame, work: Callable[[pa.Table, dict[str, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """``work`` on the documents of each batch, with their features by the values of all grams under each model."""
    models = values.columns[1:]
    sent = batches.where("gram is not null").select("batch", "at", "gram").join(values, "gram").select(F.col("batch").alias("of"), "at", *models)
    rows = batches.where("gram is null").select("batch", *_PASSED[:-1], "counts", "words", "first")

    def judged_batch(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.filter(left.column("words").is_valid()).sort_by("first").column("words").to_pylist()
        words = BatchGrams([w for words in lists for w in words.split(" ")])
        sizes, at = words.by_word(np.ones(len(words.codes))), right.column("at").to_numpy()
        docs = left.filter(left.column("counts").is_valid())
        counted = [_unpacked(c) for c in docs.column("counts").to_pylist()]
        found = {}
        for m in models:
            value = np.zeros(len(words.codes))
            value[at] = right.column(m).to_numpy()
            found[m] = features(counted, words.by_word(value), sizes)
        return work(docs, found)

    return rows.groupBy("batch").cogroup(sent.groupBy("of")).applyInArrow(judged_batch, schema)


FEATURES = 4 + len(_CUTS)


def features(counted: list[tuple[np.ndarray, np.ndarray]], sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Evidence of each document by its words: mean per character, and by how much its strongest words exceed that mean, per word and in shares.

    ``counted`` has the numbers and counts of a document's different words, ``sums`` and ``sizes`` the evidence and characters of each word.
    """
    out = np.zeros((len(counted), FEATURES))
    kinds = np.array([len(numbers) for numbers, _ in counted], dtype=np.int64)
    if not kinds.sum():
        return out
    numbers, times = (np.concatenate(x) for x in zip(*counted))
    doc, n_docs = np.repeat(np.arange(len(counted)), kinds), len(counted)
    value, size = sums[numbers], sizes[numbers]
    n = np.maximum(np.bincount(doc, times, n_docs), 1)
    mean = np.bincount(doc, value * times, n_docs) / np.maximum(np.bincount(doc, size * times, n_docs), 1)
    above = value - size * mean[doc]
    out[:, 0] = mean
    filled = np.flatnonzero(kinds)
    starts = (np.cumsum(kinds) - kinds)[filled]
    out[filled, 1] = np.maximum.reduceat(value / size, starts)
    out[filled, 2] = np.maximum.reduceat(above, starts)
    out[filled, 3] = np.maximum.reduceat(above / size, starts)
    for k, cut in enumerate(_CUTS):
        out[:, 4 + k] = np.sqrt(np.bincount(doc, times * (above > cut), n_docs) / n)
    return out


@dataclass
class Toxicity:
    grams: DataFrame
    histories: DataFrame
    middle: np.ndarray
    width: np.ndarray
    weights: np.ndarray
    batches: DataFrame
    #: documents, id and text column that the batches were read from
    read: tuple[DataFrame, str, str]

    def scores(self) -> Callable[[np.ndarray], np.ndarray]:
        """Scores of documents by their features."""
        middle, width, weights = self.middle, self.width, self.weights
        return lambda found: 1 / (1 + np.exp(-np.clip((found - middle) / width @ weights[:-1] + weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, calibration_rows: int = CALIBRATION_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Toxicity | None:
    """Model from the training labels; None if they do not hold both classes."""
    with bounded_batches(docs.sparkSession), passing_shuffles(docs.sparkSession):
        return _fitted(docs, labels, sample_rows, calibration_rows, id_column, text_column)


def _fitted(docs: DataFrame, labels: DataFrame, sample_rows: int, calibration_rows: int, id_column: str, text_column: str) -> Toxicity | None:
    sample = materialize(labelled_sample(labels, "toxic", sample_rows), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    few = sample.orderBy(F.xxhash64("id"), "id").limit(calibration_rows).select("id", F.lit(True).alias("calibrates"))
    batches = _batches(docs, sample.join(F.broadcast(few), "id", "left"), id_column, text_column)
    grams, histories = _evidence(batches)

    def sample_features(rows: pa.Table, found: dict[str, np.ndarray]) -> pa.Table:
        first = rows.column("fold").to_numpy() == 0
        out = np.where(first[:, None], found["without0"], found["without2"])
        return pa.table({"id": rows.column("id"), "label": rows.column("label"), "digest": rows.column("digest"), "features": pa.array(out.tolist(), pa.list_(pa.float64()))})

    kind = batches.schema["id"].dataType.simpleString()
    few_batches = batches.where("calibrates")
    values = _gram_values(few_batches, grams, histories, _MODELS[1:])
    found = _judged(few_batches, values, sample_features, f"id {kind}, label int, digest binary, features array<double>")
    # rows that share an id count once: that of least digest
    found = found.groupBy("id").agg(F.min(F.struct("digest", "label", "features")).alias("row")).select("id", "row.label", "row.features").collect()
    discard(values)
    found.sort(key=lambda r: r["id"])
    if len({r["label"] for r in found}) < 2:
        return None
    x, y = np.array([r["features"] for r in found]), np.array([r["label"] for r in found], dtype=float)
    middle, width = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Toxicity(grams, histories, middle, width, _logistic((x - middle) / width, y), batches, (docs, id_column, text_column))


def _scores(docs: DataFrame, model: Toxicity, id_column: str | None, text_column: str) -> DataFrame:
    """(id, digest, score) of every document, stored; batches that the model has read are not read again.

    With batches enough for all cores they are scored in up to ROUNDS parts, one
    after another, so that the grams of one part are on their way at a time.
    """
    same = docs is model.read[0] and text_column == model.read[2] and id_column in (None, model.read[1])
    batches = model.batches if same else _batches(docs, None, id_column, text_column)
    scores = model.scores()

    def work(rows: pa.Table, found: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({"id": rows.column("id"), "digest": rows.column("digest"), "score": scores(found["all"])})

    kind, values = batches.schema["id"].dataType.simpleString(), _gram_values(batches, model.grams, model.histories, _MODELS[:1])
    rounds = max(1, min(ROUNDS, batches.where("first = 0").count() // docs.sparkSession.sparkContext.defaultParallelism))
    turn = F.expr(f"pmod(shiftright(batch, 32) + (batch & 4294967295), {rounds})")
    parts = [materialize(_judged(batches.where(turn == r), values, work, f"id {kind}, digest binary, score double"), "scores") for r in range(rounds)]
    discard(values, *([] if same else [batches]))
    return _union(parts)


def scored(docs: DataFrame, model: Toxicity | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every document; null texts score as empty ones, and 0 without a model."""
    if model is None:
        return docs.select(F.col(id_column).cast("bigint").alias("id"), F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"))
    with bounded_batches(docs.sparkSession), passing_shuffles(docs.sparkSession):
        found = _scores(docs, model, id_column, text_column)
    return found.select(F.col("id").cast("bigint").alias("id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Toxicity | None, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Only the documents below the threshold, with all their columns.

    Equal texts have equal scores, so the digests of toxic texts say which rows go.
    """
    if model is None:
        return docs.where(F.lit(0.0 < threshold))
    with bounded_batches(docs.sparkSession), passing_shuffles(docs.sparkSession):
        found = _scores(docs, model, None, text_column)
        toxic = broadcast_if_small(found.where(F.col("score") >= threshold).select("digest").distinct())
    return docs.join(toxic, _digest(docs[f"`{text_column}`"]) == toxic["digest"], "left_anti")
