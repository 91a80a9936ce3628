import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.labels import decode, derive_labels, encode
from flowlens.operators import cleaning
from flowlens.operators.medians import column_medians, key_value, order_keys
from flowlens.operators.transforms import (
    apply_log, apply_scaler, fit_log_shifts, fit_scaler, log_minimums, scaler_values, zero_variance_features,
)

INF = float("inf")


def test_medians_match_brute_force(spark):
    rng = random.Random(7)
    n = 3001
    columns = {
        "even": [rng.gauss(0, 1e6) for _ in range(n - 1)] + [None],
        "tied": [rng.choice([1.0, 2.0, 2.0, 2.0, 5.0]) for _ in range(n)],
        "third": [7.0 if i % 3 == 0 else rng.lognormvariate(0, 4) for i in range(n)],
        "edge": [1.0] * (n // 2) + [rng.random() + 2 for _ in range(n - n // 2)],
        "odd": [rng.random() if i % 50 else INF for i in range(n)],
        "signs": [rng.choice([-1.0, 1.0]) * rng.lognormvariate(-300, 200) for _ in range(n)],
        "zeros": [0.0 if i % 2 else -0.0 for i in range(n)],
        "minus": [-float(i) for i in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    want = {c: statistics.median([v for v in vs if v is not None and v != INF]) for c, vs in columns.items()}
    assert column_medians(df, list(columns)) == pytest.approx(want)
    assert column_medians(df.coalesce(1), list(columns)) == column_medians(df.repartition(11), list(columns))


def test_clean_imputes_and_drops_constants(spark):
    rows = [(1.0, None, 5.0, None, "a"), (2.0, 3.0, 5.0, None, "b"), (4.0, 3.0, INF, None, "b"), (INF, -INF, 5.0, None, "c"), (None, 9.0, 5.0, None, "c")]
    df = spark.createDataFrame(rows, "x double, `y z` double, k double, none double, Label string")
    result = cleaning.clean(df)
    assert result.medians == {"x": 2.0, "y z": 3.0, "k": 5.0, "none": None}
    assert result.constants == ["k", "none"]
    assert sorted(r["x"] for r in result.data.collect()) == [1.0, 2.0, 2.0, 2.0, 4.0]
    kept = cleaning.clean(df, drop_constants=False).data
    assert {r["none"] for r in kept.collect()} == {0.0}


def test_even_median_is_the_mean_of_both_middles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert column_medians(df, ["x"]) == {"x": 3.0}
    assert column_medians(df, []) == {} and column_medians(df.where("x > 9"), ["x"]) == {"x": None}


def test_keys_are_in_the_order_of_values():
    values = np.array([-1e308, -2.5, -5e-324, 0.0, 5e-324, 1.0, 2.0, 1.7e308])
    keys = order_keys(values)
    assert (keys[1:] > keys[:-1]).all() and [key_value(int(k)) for k in keys] == values.tolist()
    assert order_keys(np.array([-0.0]))[0] == order_keys(np.array([0.0]))[0]


def test_cell_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), INF), (None, 1.0), (1.0, -INF)], "a double, b double")
    rows = {r["feature"]: (r["nulls"], r["infs"]) for r in cleaning.cell_profile(df).collect()}
    assert rows == {"a": (2, 0), "b": (0, 2)}


def test_duplicates_keep_the_lowest_id(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", None), (4, "b", None)], "id long, s string, v double")
    assert sorted(r["id"] for r in cleaning.drop_duplicate_rows(df, "id").collect()) == [1, 3]
    s = cleaning.duplicate_summary(df, "id").first()
    assert (s["rows_before"], s["rows_removed"], s["removed_pct"]) == (4, 2, 50.0)


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (8.0, 5.0)], "a double, b double")
    values = scaler_values(fit_scaler(df, ["a", "b"]))
    assert values["a"] == pytest.approx((3.75, 2.6809513))
    assert values["b"] == (5.0, 1.0)
    new = spark.createDataFrame([(3.75, 7.0)], "a double, b double")
    assert apply_scaler(new, values).first()["b"] == 2.0
    assert [r[0] for r in zero_variance_features(apply_scaler(df, values), ["a", "b"]).collect()] == ["b"]


def test_log_shifts_negative_columns(spark):
    df = spark.createDataFrame([(-3.0, 0.0), (1.0, 1.0)], "Min double, Rate double")
    minimums = log_minimums(fit_log_shifts(df))
    assert minimums == {"Min": -3.0, "Rate": 0.0}
    row = apply_log(df, minimums).orderBy("Min").collect()
    assert [r["Min"] for r in row] == pytest.approx([0.6931472, 1.7917595])
    assert [r["Rate"] for r in row] == pytest.approx([0.0, 0.6931472])


def test_labels(spark):
    df = spark.createDataFrame([("XSS",), ("BENIGN",), ("DDOS-SYN_FLOOD",)], "Label string")
    rows = {r["Label"]: (r["Label_8"], r["Label_2"]) for r in derive_labels(df).collect()}
    assert rows == {"XSS": ("Web", "Attack"), "BENIGN": ("Benign", "Benign"), "DDOS-SYN_FLOOD": ("DDoS", "Attack")}
    odd = spark.createDataFrame([("XSS",), ("NEW",)], "Label string")
    with pytest.raises(ValueError, match="NEW"):
        derive_labels(odd)
    with pytest.raises(Exception, match="unseen label"):
        odd.select(encode(F.col("Label"), ["XSS"])).collect()
    both = df.select("Label", encode(F.col("Label"), ["BENIGN", "DDOS-SYN_FLOOD", "XSS"]).alias("i"))
    assert both.where(decode(F.col("i"), ["BENIGN", "DDOS-SYN_FLOOD", "XSS"]) != F.col("Label")).count() == 0


def test_class_order_is_by_code_point():
    from flowlens.schema import CLASSES_FINE, FEATURES_COARSE, FEATURES_FINE, LOG_FEATURES

    assert len(CLASSES_FINE) == 34 and len(FEATURES_FINE) == 39 and len(FEATURES_COARSE) == 28 and len(LOG_FEATURES) == 37
    assert CLASSES_FINE.index("DDOS-SYNONYMOUSIP_FLOOD") + 1 == CLASSES_FINE.index("DDOS-SYN_FLOOD")
