from collections import Counter

import helpers
import pytest

from flowlens.llm import linking, neardup, substring
from flowlens.workspace import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bucket_windows", [1 << 17, 10])
def test_removal_equals_brute_force(spark, bucket_windows):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + (d or 0), t) for d, t, *_ in helpers.ROWS]
    got = substring.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"), bucket_windows=bucket_windows)
    assert Counter(map(tuple, got.collect())) == helpers.removal(rows)


def test_removal_of_awkward_rows(spark):
    got = substring.removal_digest(helpers.docs(spark))
    assert Counter(map(tuple, got.collect())) == helpers.removal(helpers.ROWS)
    assert substring.removal_digest(helpers.docs(spark, [])).collect() == []


def test_remove_repeats_keeps_rows_and_columns(spark):
    got = substring.remove_repeats(helpers.docs(spark))
    assert got.columns == ["doc_id", "text", "key", "id"]
    rows = got.collect()
    assert len(rows) == len(helpers.ROWS)
    texts = {(r.doc_id, r.id): r.text for r in rows}
    assert texts[1, "a"] == helpers.PASSAGE + " one tail" and texts[2, None] == "lead in" and texts[3, "c"] == ""
    assert texts[4, "d"] is None and texts[6, "f"] == " \n\t " and texts[None, "g"] == helpers.PASSAGE + " other"


def test_near_classes_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets = {d: helpers.shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if helpers.jaccard(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d in sets}


def test_near_classes_of_a_large_group_of_variants(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = base.copy()
        words[k * 3] = f"edit{k}"
        rows.append((k, " ".join(words)))
    rows.append((99, " ".join(f"u{i}" for i in range(200))))
    got = {r.id: (r.class_id, r.class_size, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k][0] for k in range(60)} == {0} and got[99] == (99, 1, True) and got[0] == (0, 60, True)
    assert sum(v[2] for v in got.values()) == 2


def test_near_classes_of_awkward_rows(spark):
    got = neardup.near_duplicates(helpers.docs(spark)).collect()
    assert len(got) == len(helpers.ROWS)
    classes = {}
    for r in got:
        classes.setdefault(r.id, set()).add(r.class_id)
    assert classes[1] == classes[3] == {1} and classes[5] == classes[6] == {5} and classes[4] == {4}
    kept = neardup.keep_one(helpers.docs(spark))
    assert kept.columns == ["doc_id", "text", "key", "id"]
    assert Counter(r.doc_id for r in kept.collect())[3] == 0
    assert neardup.near_duplicates(helpers.docs(spark, [])).collect() == []


def _edited(base, places, mark):
    words = base.copy()
    for p in places:
        words[p] = f"{mark}{p}"
    return " ".join(words)


def test_near_classes_of_pairs_in_one_large_bucket(spark):
    """Separate pairs that all share a bucket: neither hub nor leaders are partners of most of them."""
    links = {(2 * k, 2 * k + 1) for k in range(40)}

    def prepare(_):
        def verify(pairs, _):
            rows = [(r.a, r.b) for r in pairs.collect() if (r.a, r.b) in links]
            return materialize(spark.createDataFrame(rows, "a long, b long"), "verified")

        return linking.Comparison(verify)

    buckets = materialize(spark.createDataFrame([(n, 7) for n in range(80)], "node long, bucket long"), "buckets")
    found, _ = linking.linked(buckets, prepare)
    assert {r.node: r.component for r in found.collect()} == {n: n - n % 2 for n in range(80)}


def test_near_classes_of_pairs_of_one_template(spark):
    """Pairs of variants that are near each other and to no other text, in buckets of all of them."""
    base, rows = [f"t{i}" for i in range(300)], []
    for k in range(30):
        own = [(k + 10 * j) % 300 for j in range(9)]
        rows += [(2 * k, _edited(base, own, f"e{k}x")), (2 * k + 1, _edited(base, [*own, own[0] + 1], f"e{k}x"))]
    sets = {d: helpers.shingle_set(t) for d, t in rows}
    true = {(a, b) for a in sets for b in sets if a < b and helpers.jaccard(sets[a], sets[b]) >= 0.8}
    assert true == {(2 * k, 2 * k + 1) for k in range(30)}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=2, rows=1).collect()
    assert {r.id: r.class_id for r in got} == {d: d - d % 2 for d in range(60)}


def test_near_classes_of_copies_said_several_times(spark):
    """Plain similarity of about 1, weighted of a third."""
    rows = []
    for k in range(40):
        text = " ".join(f"w{k}x{i}" for i in range(120))
        rows += [(2 * k, text), (2 * k + 1, "\n".join([text] * 3))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in got} == {d: d - d % 2 for d in range(80)}
