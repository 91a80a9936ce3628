import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.operators import sampling
from flowlens.operators.ranking import assign_segment, index_by_order


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds most rows."""
    rows = [(i, "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else "small")) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, Label string").repartition(5).cache()


def order(ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))


def expected_segments(df, cuts):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["Label"], []).append(r["id"])
    result = {}
    for label, ids in groups.items():
        for rank, i in enumerate(order(ids), 1):
            result[i] = sum(rank > c for c in cuts.get(label, []))
    return result


@pytest.mark.parametrize("bucket_rows", [3, 100, 1_000_000])
def test_segments_match_a_full_sort(spark, skewed, bucket_rows):
    cuts = {"big": [0, 1, 1000, 2099], "mid": [300, 300, 600], "small": []}
    table = spark.createDataFrame([(s, i, r) for s, ranks in cuts.items() for i, r in enumerate(ranks)], "stratum string, cut int, rank long")
    got = assign_segment(skewed, "Label", "id", lambda sizes: table, bucket_rows=bucket_rows)
    assert {r["id"]: r["segment"] for r in got.collect()} == expected_segments(skewed, cuts)


def test_balanced_sample_sizes_and_repeatability(skewed):
    plan = {r["Label"]: r["cap"] for r in sampling.balance_plan(skewed, target=1000, floor=100, cap=400).collect()}
    assert plan == {"big": 400, "mid": 200, "small": 100}
    a = sampling.balanced_sample(skewed, "id", target=1000, floor=100, cap=400, bucket_rows=50)
    b = sampling.balanced_sample(skewed.repartition(3), "id", target=1000, floor=100, cap=400)
    assert Counter(r["Label"] for r in a.collect()) == plan
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


def test_plan_rounds_half_to_even_and_never_oversamples(spark):
    rows = [("a",)] * 5 + [("b",)] * 7 + [("c",)] * 8
    df = spark.createDataFrame(rows, "Label string")
    plan = {r["Label"]: r["cap"] for r in sampling.balance_plan(df, target=10, floor=1, cap=100).collect()}
    assert plan == {"a": 2, "b": 4, "c": 4}
    plan = {r["Label"]: r["cap"] for r in sampling.balance_plan(df, target=10, floor=6, cap=100).collect()}
    assert plan == {"a": 5, "b": 6, "c": 6}


def test_split_is_exact_complete_and_disjoint(skewed):
    split = sampling.stratified_split(skewed, "id", bucket_rows=40).collect()
    assert len({r["id"] for r in split}) == len(split) == 3000
    assert Counter(r["split"] for r in split) == {"train": 2400, "val": 300, "test": 300}
    assert Counter(r["split"] for r in split if r["Label"] == "small") == {"train": 240, "val": 30, "test": 30}


def test_published_split_totals():
    for n, want in ((547_590, (438_072, 54_759, 54_759)), (4_297_838, (3_438_270, 429_784, 429_784))):
        counts = {"a": n // 3, "b": n // 7, "c": n - n // 3 - n // 7}
        quotas = sampling.split_quotas(counts)
        assert tuple(sum(q[i] for q in quotas.values()) for i in range(3)) == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=3), st.integers(2, 10**13), min_size=1, max_size=40))
def test_quotas_add_up_at_any_size(counts):
    quotas = sampling.split_quotas(counts)
    assert all(sum(q) == counts[s] and min(q) >= 0 for s, q in quotas.items())
    total = sum(counts.values())
    for s, q in quotas.items():
        assert abs(q[0] - counts[s] * (total - -(-total // 5)) / total) < 1 + 1e-3 * counts[s] / 10**9


def test_split_refuses_single_rows(spark):
    with pytest.raises(ValueError, match="too few"):
        sampling.stratified_split(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, Label string"), "id")


def test_subset_and_folds(skewed):
    subset = sampling.stratified_subset(skewed, "id", "Label", 1000, bucket_rows=30)
    assert Counter(r["Label"] for r in subset.collect()) == {"big": 700, "mid": 200, "small": 100}
    assert sampling.stratified_subset(skewed, "id", "Label", 5000).count() == 3000
    folds = Counter((r["Label"], r["fold"]) for r in sampling.stratified_folds(subset, "id", "Label", 3, bucket_rows=20).collect())
    totals = [sum(n for (_, f), n in folds.items() if f == k) for k in range(3)]
    assert max(totals) - min(totals) <= 1
    for label in ("big", "mid", "small"):
        sizes = [folds[(label, k)] for k in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_seeded_sample_is_in_row_order(skewed):
    ids = [r["id"] for r in sampling.seeded_sample(skewed, "id", 20).collect()]
    assert ids == sorted(order(range(3000))[:20])
    assert ids != [r["id"] for r in sampling.seeded_sample(skewed, "id", 20, seed=1).collect()]


def test_index_by_order(skewed):
    rows = index_by_order(skewed, ["Label", "id"]).collect()
    want = sorted((r["Label"], r["id"]) for r in rows)
    assert [(r["Label"], r["id"]) for r in sorted(rows, key=lambda r: r["index"])] == want
    assert sorted(r["index"] for r in rows) == list(range(3000))


def test_rows_without_a_stratum_are_dropped(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(600)], "flow_id long, Label string")
    split = sampling.stratified_split(df, "flow_id", "Label")
    assert split.count() == 400 and split.where("Label IS NULL").isEmpty()
    assert sampling.stratified_subset(df, "flow_id", "Label", 100).count() == 100
    assert sampling.stratified_subset(df, "flow_id", "Label", 1000).count() == 400
    folds = Counter(r["fold"] for r in sampling.stratified_folds(df, "flow_id", "Label", 4).collect())
    assert folds == {0: 100, 1: 100, 2: 100, 3: 100}


def test_classes_below_their_cap_stay_whole_beside_cut_ones(skewed):
    sample = sampling.balanced_sample(skewed, "id", target=1500, floor=500, cap=700)
    assert Counter(r["Label"] for r in sample.collect()) == {"big": 700, "mid": 500, "small": 300}


@pytest.mark.parametrize("counts", [{"a": 7, "b": 2, "c": 11}, {"x": 2}, {f"s{i:03d}": 2 + i * i % 37 for i in range(200)}, {"a": 10**12 + 7, "b": 3 * 10**12 + 1, "c": 5}])
def test_quota_tables_equal_plain_arithmetic(spark, counts):
    sizes = spark.createDataFrame(list(counts.items()), "stratum string, n long")
    got = {r["stratum"]: (r["train"], r["val"], r["n"] - r["train"] - r["val"]) for r in sampling.split_quota_table(sizes).collect()}
    assert got == sampling.split_quotas(counts)
    total = sum(counts.values())
    quotas = {r["stratum"]: r["quota"] for r in sampling.quota_table(sizes, total, total // 3).collect()}
    assert quotas == sampling.proportional_quota(counts, total // 3)
    if total < 10**6:
        ends = {}
        for r in sampling.fold_table(sizes, 3).orderBy("stratum", "cut").collect():
            ends.setdefault(r["stratum"], []).append(r["rank"])
        want = sampling.fold_sizes(dict(sorted(counts.items())), 3)
        assert ends == {s: [sum(f[:1]), sum(f[:2])] for s, f in want.items()}


def test_very_many_strata(spark):
    df = spark.range(60_000).selectExpr("id", "string(id % 20000) as Label")
    split = sampling.stratified_split(df, "id", "Label").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 48_000, "val": 6_000, "test": 6_000}
