"""Steps whose work or largest task has to follow the rows."""

import glob

import pytest
from pyspark.sql import functions as F

from flowlens.functions.probabilities import top_classes
from flowlens.operators import cleaning
from flowlens.operators.linear_training import FILE_ROWS, files_of, stored_batches
from flowlens.queries import common, scores, storage
from flowlens.schema import FEATURES_FINE
from flowlens.sources.records import record_features
from flowlens.sources.tables import move_ordered_files
from flowlens.sources.csv_files import read_scoring_csv
from flowlens.workspace import new_path

from data import SF


def test_a_filter_on_the_note_parses_each_line_once(spark):
    lines = spark.createDataFrame([('{"Rate": "1"}',), ('{"Rate": "inf"}',), ("no record",)], "value string")
    rows = record_features(lines, FEATURES_FINE).where(F.col("input_adjustments").isNotNull())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert rows.count() == 3


def test_text_files_are_packed_and_bounded(spark):
    for folder in (common.json_folder(spark, SF), common.csv_folder(spark, SF) + "/Merged01.csv", scores._lines_folder(spark, SF)):
        assert glob.glob(f"{folder}/part-*.gz") and not [f for f in glob.glob(f"{folder}/part-*") if not f.endswith(".gz")]
    assert int(common.PACKED["maxRecordsPerFile"]) <= 500_000


def test_ordered_files_keep_their_order_in_many_files(spark):
    folder = new_path(spark, "parts") + ".csv"
    rows = spark.range(1000).select(F.format_string("%05d", F.col("id") % 500).alias("k"), F.col("id").cast("string").alias("v"))
    for name, low in (("b", 500), ("a", 0)):
        part = rows.where(F.col("id").between(low, low + 499))
        move_ordered_files(part.repartitionByRange(5, "k").sortWithinPartitions("k"), f"{folder}/{name}")
    assert len(glob.glob(f"{folder}/*.csv.gz")) == 10
    found = [(r["index"], int(r["v"])) for r in read_scoring_csv(spark, folder, "index").collect()]
    assert sorted(found) == [(i, i) for i in range(1000)]


def test_ordered_parts_have_more_files_for_more_rows(spark):
    folder = storage._ordered_parts(spark, SF, part_rows=200)
    rows = read_scoring_csv(spark, folder, "index")
    assert len(glob.glob(f"{folder}/*.csv.gz")) >= rows.count() // 400
    ids = [r["flow_id"] for r in rows.orderBy("index").collect()]
    first = [i for i in ids if i.split("-")[1] == "1"]
    assert ids[: len(first)] == sorted(first)


def test_duplicates_are_counted_by_digests_alone(spark):
    rows = [(1, 0.0, None, "a"), (2, -0.0, None, "a"), (3, None, 0.0, "a"), (4, float("nan"), 1.0, "1:b"), (5, float("nan"), 1.0, "1:b"), (6, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, s string")
    found = cleaning.duplicate_summary(df, "id")
    assert tuple(found.first())[:2] == (6, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.split("\n") if "Aggregate" in line]
    assert not any("min(x" in line or "min(s#" in line for line in aggregates)


def test_rows_that_share_a_digest_but_not_their_values_fail(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "row_digest", lambda df, columns: [F.lit(1).alias("__digest"), F.lit(2).alias("__digest2")])
    df = spark.createDataFrame([(1, 1.0, 12.0), (2, 11.0, 2.0)], "id long, x double, y double")
    with pytest.raises(Exception, match="share a 128-bit digest"):
        cleaning.duplicate_summary(df, "id").collect()


def test_arriving_files_follow_the_rows():
    assert scores._files_of(6_000) == 4
    assert scores._files_of(216_000_000) * 4 * scores._ARRIVAL_ROWS >= 216_000_000


def test_a_batch_has_a_file_for_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(80_000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit("b").alias("c"), F.lit(1.0).alias("w"))
    batches = stored_batches(rows, "id", ["x"], "c", ["a", "b"], "w", batch_rows=40_000)
    assert batches.batches == 2
    assert len([f for f in batches.data.where("batch = 0").inputFiles()]) >= min(cores, 40_000 // 8_192)
    assert files_of(10 * FILE_ROWS, 4) == 10 and files_of(100, 8) == 1


def _write_flow_tables(spark, folder):
    lines = spark.range(60).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "CAST(id + 1 AS DOUBLE) AS l_quantity",
        "id * 10.5D AS l_extendedprice", "(id % 5) / 100D AS l_discount", "(id % 3) / 100D AS l_tax", "DATE'2020-01-01' AS l_shipdate")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    spark.range(60).selectExpr("id AS o_orderkey", "id * 3D AS o_totalprice").write.parquet(f"{folder}/orders.parquet")
    spark.range(7).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size", "id * 2D AS p_retailprice").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_top_classes_run_the_model_once(spark, tmp_path):
    found = scores.top_classes(spark, _write_flow_tables(spark, tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("UDF(" in line for line in plan.splitlines()) == 1 and "size(" not in plan.replace("size(fine_proba", "")
    assert found.count() == 180 and found.groupBy("flow_id").agg(F.min("probability").alias("low")).where("low IS NULL").isEmpty()


def test_top_classes_of_tied_and_odd_probabilities(spark):
    nan = float("nan")
    given = [[0.1, 0.4, 0.3, 0.2], [0.4, 0.1, 0.4, 0.1], [0.25] * 4, [0.1, 0.2, 0.2, 0.5], [0.3, 0.1, 0.3, 0.3], [nan, 0.5, nan, 0.1], [0.0, 0.2, 0.0, 0.0], [0.5, None, 0.2, 0.1]]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)] + [(99, None)], "id int, p array<double>")
    found = {r["id"]: r["top"] and [(t["class"], t["probability"]) for t in r["top"]] for r in rows.select("id", top_classes(F.col("p"), list("abcd")).alias("top")).collect()}
    assert found.pop(99) is None

    def rank(pair):
        return (pair[1] is not None, pair[1] != pair[1], 0 if pair[1] is None or pair[1] != pair[1] else pair[1], pair[0])

    for i, p in enumerate(given):
        wanted = sorted(zip("abcd", p), key=rank, reverse=True)[:3]
        assert str(found[i]) == str(wanted), p
    two = spark.createDataFrame([([0.3, 0.7],)], "p array<double>").select(top_classes(F.col("p"), ["x", "y"]).alias("top")).first()["top"]
    assert [t["class"] for t in two] == ["y", "x"]


def test_rejected_lines_are_found_before_values_are_parsed(spark):
    lines = spark.createDataFrame([('{"Rate": 1}',), ('{"Rate": ',), ('{"foo": 1}',), ("[1]",), ('{"Rate": "2d", "AVG": "0x1p3"}',)], "value string")
    rows = record_features(lines, ["Rate", "AVG"])
    plan = rows.where("rejected")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("Filter")
    assert sorted(r["line"] for r in rows.where("rejected").collect()) == sorted(['{"Rate": ', '{"foo": 1}', "[1]"])
    good = {r["Rate"]: (r["AVG"], r["input_adjustments"]["invalid_values_replaced"]) for r in rows.where("NOT rejected").collect()}
    assert good == {1.0: (None, 1), None: (None, 2)}


def test_mixed_lines_read_the_flows_once(spark, tmp_path, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(i):
        read.add(1)
        return f"f{i}"

    table = spark.range(1, 5).select(
        counted.asNondeterministic()("id").alias("flow_id"), F.col("id").cast("int").alias("l_linenumber"), *[F.lit(1.5).alias(f) for f in FEATURES_FINE])
    monkeypatch.setattr(scores, "flows", lambda spark, sf_dir: table)
    found = sorted(r["value"] for r in spark.read.text(scores._lines_folder(spark, str(tmp_path))).collect())
    assert read.value == 4
    assert len(found) == 6 and '{"Rate": f1' in found and '{"foo":"f2"}' in found
    assert [v for v in found if v.startswith('{"flow_id":"f3"')]
