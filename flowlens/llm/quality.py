"""Quality rules: boosted trees over document statistics.

Null texts count as empty.  Statistics come from whole texts; the trees are
fitted on a bounded sample of labelled rows whose ids are not held out.  A
document is kept if it passes the base rules and the trees' score reaches
``threshold``; without labels the base rules decide alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .labelled import labelled_sample

FIT_ROWS = 20_000
THRESHOLD = 0.5
LEAST_WORDS = 50

_SPACES = re.compile(r"[\x20\x09-\x0D]")
_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_NOT_ASCII = bytes(range(128, 256))

#: Each feature with its direction: -1, more of it never raises the score; 0, free.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "different_word_share": 0, "upper_share": -1, "digit_share": -1, "exclamations_per_word": -1, "stops_per_word": 0,
    "words_per_line": 0, "longest_word": 0, "not_ascii_share": 0, "top_word_share": -1, "bars_per_word": -1, "ellipses_per_line": -1,
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts, marked = Counter(grams), bytearray(len(words))
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            marked[at] = marked[at + 1] = marked[at + 2] = 1
    return sum(marked)


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the features of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [line for line in text.split("\n") if _SPACES.sub("", line)] if "\n" in text else ([text] if n else [])
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    seen = Counter(words)
    size = max(1, len(raw))
    some, rows = max(1, n), max(1, len(lines))
    features = (
        np.log1p(n), chars / some, symbols / some, dup_lines / rows, repeats / some, len(seen) / some,
        (len(raw) - len(raw.translate(None, _UPPER))) / size, (len(raw) - len(raw.translate(None, _DIGITS))) / size,
        text.count("!") / some, (text.count(".") + text.count(",")) / some, n / rows, max(map(len, seen), default=0),
        (len(raw) - len(raw.translate(None, _NOT_ASCII))) / size, max(seen.values(), default=0) / some, text.count("|") / some,
        (text.count("...") + text.count("…")) / rows,
    )
    return (n, chars, symbols, dup_lines, repeats), features


def base_failed(n_words: int, n_repeat_words: int, least_words: int = LEAST_WORDS) -> bool:
    return n_words < least_words or 100 * n_repeat_words > 50 * n_words


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [list(map(float, statistics(t)[1])) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "features": pa.array(rows, pa.list_(pa.float64()))})


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Trees | None:
    """Trees fitted on at most ``rows`` labelled documents; None without any."""
    sample = F.broadcast(labelled_sample(labels, "quality", rows, id_column))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(sample, "id")
    table = texts.mapInArrow(_sample_features, "id bigint, label int, features array<double>").dropDuplicates(["id"])
    found = sorted(table.collect(), key=lambda r: r["id"])
    if not found:
        return None
    return fit(np.array([r["features"] for r in found]), np.array([r["label"] for r in found]), list(FEATURES.values()))


def judged(docs: DataFrame, model: Trees | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            if not found:
                continue
            counts = np.array([f[0] for f in found], dtype=np.int64)
            failed = np.array([base_failed(c[0], c[4]) for c in counts.tolist()], dtype=bool)
            scores = model.scores(np.array([f[1] for f in found])) if model else np.where(failed, 0.0, 1.0)
            columns = {"id": batch.column("id")} | {name: counts[:, i] for i, name in enumerate(_COUNTS)}
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": failed, "score": scores, "kept": ~failed & (scores >= threshold)})

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(work, "id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: Trees | None, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Only the documents that pass, with all their columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(batch.schema.get_field_index(text_column)).to_pylist()]
            if not found:
                continue
            keep = np.array([not base_failed(c[0], c[4]) for c, _ in found], dtype=bool)
            if model:
                keep &= model.scores(np.array([f[1] for f in found])) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)
