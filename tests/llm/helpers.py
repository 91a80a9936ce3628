"""Small tables with the awkward cases, and plain restatements of the operators."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("key", IntegerType()), StructField("id", StringType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])

PASSAGE = " ".join(f"word{i}" for i in range(70))
#: nulls in every column, empty and long texts, ties, repeated rows, and columns with the operators' own names
ROWS = [
    (1, PASSAGE + " one tail", 1, "a"), (2, "lead in " + PASSAGE, 2, None), (3, PASSAGE + " one tail", None, "c"), (3, PASSAGE + " one tail", None, "c"),
    (4, None, 4, "d"), (5, "", 5, "e"), (6, " \n\t ", 6, "f"), (None, PASSAGE + " other", 7, "g"), (None, None, None, None),
    (7, "same " * 3000, 8, "h"), (8, "Ünïcode ▁ text\nline two\x0bthree", 9, "i"), (9, "x", 1, "j"), (9, "y z", 1, "k"),
    (10, " ".join(f"w{i % 997}q{i}" for i in range(6000)), 2, "l"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def removal(rows, window=50):
    """(id, n_words, n_removed, kept_sha256) of each row, as the contract words it."""
    first = {}
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            key = b" ".join(words[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if first[b" ".join(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def shingle_set(text, size=5):
    words = (text or "").encode().split()
    if len(words) >= size:
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)
