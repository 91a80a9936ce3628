import itertools
import re

import numpy as np
from helpers import LABELS

from flowlens.llm import audit

COLUMNS = "doc_id long, text string, source string, id string, part string, mask int, n long"


def plain(rows, labels):
    """Every order replayed document by document."""
    quality, toxic = {}, {}
    for doc, q, t in labels:
        if doc is not None:
            quality[doc], toxic[doc] = max(quality.get(doc, 0), q or 0), max(toxic.get(doc, 0), t or 0)
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    docs = []
    for doc, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and doc > least[text],
        }
        docs.append((source or "", fails, quality.get(doc) == 1, toxic.get(doc) == 1))
    out = {}
    for part in {d[0] for d in docs}:
        mine, removed = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        rows_of_part = {}
        for order in itertools.permutations("ABCDE"):
            kept = list(mine)
            gone = []
            for step, letter in enumerate(order, 1):
                here = [d for d in kept if d[1][letter]]
                redundant = sum(d[1][letter] for d in gone)
                kept = [d for d in kept if not d[1][letter]]
                gone += here
                unique = sum(d[1][letter] and sum(d[1].values()) == 1 for d in mine)
                removed[letter] += len(here)
                rows_of_part["".join(order), step] = [len(kept), len(here), redundant, unique, sum(d[2] for d in here), sum(d[3] for d in here)]
        for (order, step), numbers in rows_of_part.items():
            out[part, order, step] = (*numbers, removed[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, None, "a"), (5, "", "b"), (6, "same " * 60, "a"), (7, "same " * 60, None),
    (8, LONG.upper(), "a"), (9, LONG + " #", "a"), (None, LONG, "a"), (None, None, None), (10, "\x0b\f\r x y A", "b"), (11, "w " * 200_000 + "$", "c"),
    (0, LONG + " late", "c"), (12, LONG + " late", "c"), (12, LONG + " other", "c"),
]
LABEL_ROWS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 1), (8, None, 1), (None, 1, 1), (12, 1, None), (99, 1, 1)]


def test_audit_equals_plain_replay(spark):
    docs = spark.createDataFrame([(d, t, s, "x", "y", 7, 9) for d, t, s in ROWS], COLUMNS)
    got = audit.audited(docs, spark.createDataFrame(LABEL_ROWS, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(ROWS, LABEL_ROWS)
    assert len(got) == 4 * 600


def test_many_blocks_and_parts_of_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(audit, "_BLOCK_ROWS", 8)
    monkeypatch.setattr(audit, "PART_BLOCKS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i), f"text {rng.integers(0, 150)}" if i % 3 else "the hot text", f"s{i % 4}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = audit.audited(docs, spark.createDataFrame([], LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(rows, [])


def test_sketch_clears_unique_texts(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id % 15000) as h")
    cells = audit.sketch(rows, 5).collect()
    assert sorted(r.block for r in cells) == list(range(5)) and all(len(r.cells) == 2 * audit._BLOCK_CELLS // 8 for r in cells)
    docs = spark.range(20_000).selectExpr("id as doc_id", "string(id % 15000) as text", "'s' as source")
    masks = audit.mask_counts(docs, spark.createDataFrame([], LABELS)).collect()
    assert sum(r.n for r in masks if r["mask"] >= 16) == 5000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audited(docs, spark.createDataFrame([], LABELS)).count() == 0
