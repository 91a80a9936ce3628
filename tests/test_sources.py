import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowlens.operators.sanitize import COARSE_LABELS, FINE_LABELS, adjustment_summary, sanitize
from flowlens.sources.csv_files import (
    csv_fields, load_coarse_flows, load_fine_flows, read_files, read_scoring_csv, rows_per_file,
)
from flowlens.sources.records import read_records, record_features


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_columns_are_matched_by_name(spark, tmp_path):
    write(tmp_path, "Merged01.csv", "Rate,IAT,Label\n1,10,XSS\n2,20,BENIGN\n")
    write(tmp_path, "Merged02.csv", "Label,IAT,Rate\nXSS,30,3\n")
    write(tmp_path, "Other.csv", "Rate,IAT,Label\n9,9,XSS\n")
    df = load_fine_flows(spark, str(tmp_path))
    assert sorted((r["Rate"], r["IAT"], r["Label"]) for r in df.collect()) == [
        (1.0, 10.0, "XSS"), (2.0, 20.0, "BENIGN"), (3.0, 30.0, "XSS")]
    counts = {r["source_file"]: r["rows"] for r in rows_per_file(df).collect()}
    assert counts == {"Merged01.csv": 2, "Merged02.csv": 1, None: 3}


def test_union_keeps_every_column_when_asked(spark, tmp_path):
    write(tmp_path, "Merged01.csv", "A,Label\n1,XSS\n")
    write(tmp_path, "Merged02.csv", "B,Label\n2,XSS\n")
    df = read_files(spark, str(tmp_path), "Merged*.csv").data
    assert sorted((r["A"] or "", r["B"] or "") for r in df.collect()) == [("", "2"), ("1", "")]


def test_label_tokens_and_number_tokens(spark, tmp_path):
    write(tmp_path, "Merged01.csv", "Rate,Label\n1,NA\n2,\n3,None\n4,N/A\n1.5f,XSS\n\"1,2\",XSS\ninf,XSS\n-Infinity,XSS\nabc,XSS\n 7 ,XSS\n0x1p3,XSS\n")
    rows = [r["Rate"] for r in load_fine_flows(spark, str(tmp_path)).collect()]
    assert rows == [None, None, float("inf"), float("-inf"), None, 7.0, None]


def test_over_long_record_skips_or_fails_the_file(spark, tmp_path):
    write(tmp_path, "Merged01.csv", "Rate,IAT,Label\n1,10,XSS\n")
    write(tmp_path, "Merged02.csv", "Rate,IAT,Label\n2,20,XSS\n3,30,40,Y\n")
    write(tmp_path, "Merged03.csv", "Rate,IAT,Label\n4,40,XSS\n5,50,XSS,\n")
    with pytest.warns(UserWarning, match="longer than the header"):
        df = load_fine_flows(spark, str(tmp_path))
    assert [r["Rate"] for r in df.collect()] == [1.0]
    with pytest.raises(PySparkException, match="longer than the header"):
        load_coarse_flows(spark, str(tmp_path)).count()


def test_short_record_is_padded_and_quotes_are_kept(spark, tmp_path):
    write(tmp_path, "Merged01.csv", 'Label,Rate,IAT\nXSS,1\n"BENIGN",2,"3"\n')
    df = load_fine_flows(spark, str(tmp_path))
    assert sorted((r["Label"], r["Rate"], r["IAT"]) for r in df.collect()) == [("BENIGN", 2.0, 3.0), ("XSS", 1.0, None)]


def test_empty_and_unlabelled_files(spark, tmp_path):
    write(tmp_path, "Merged01.csv", "Rate,Label\n1,XSS\n")
    write(tmp_path, "Merged02.csv", "")
    write(tmp_path, "Merged03.csv", "Rate\n1\n")
    with pytest.warns(UserWarning):
        assert load_fine_flows(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError, match="unreadable"):
        load_coarse_flows(spark, str(tmp_path))


def test_coarse_pattern(spark, tmp_path):
    for name in ("Merged01.csv", "Merged06.csv", "Merged07.csv", "Merged10.csv"):
        write(tmp_path, name, "Rate,Label\n1,XSS\n")
    assert load_coarse_flows(spark, str(tmp_path)).count() == 2


def test_scoring_csv_rules(spark, tmp_path):
    with pytest.raises(ValueError, match="only .csv"):
        read_scoring_csv(spark, str(tmp_path / "a.txt"))
    with pytest.raises(ValueError, match="empty"):
        read_scoring_csv(spark, write(tmp_path, "empty.csv", ""))
    with pytest.raises(ValueError, match="empty"):
        read_scoring_csv(spark, write(tmp_path, "header.csv", "Rate,IAT\n"))
    path = write(tmp_path, "good.CSV", "﻿Rate , IAT,LABEL,rate\n1,2,XSS,9\n\n3,x,XSS,9\n")
    df = read_scoring_csv(spark, path)
    assert df.columns == ["Rate", "IAT", "LABEL", "rate"]
    tidy = sanitize(df, ["IAT", "Rate", "Min"], FINE_LABELS)
    assert tidy.missing == ["Min"]
    assert [tuple(r) for r in tidy.data.collect()] == [(2.0, 1.0, None), (None, 3.0, None)]
    summary = adjustment_summary(tidy).first()
    assert (summary["rows_adjusted"], summary["invalid_values_replaced"], summary["missing_features_filled"]) == (2, 3, ["Min"])


def test_scoring_csv_with_over_long_record_fails(spark, tmp_path):
    path = write(tmp_path, "long.csv", "Rate,IAT\n1,2\n1,2,3\n")
    with pytest.raises((ValueError, PySparkException)):
        read_scoring_csv(spark, path).collect()


def test_sanitize_refuses_foreign_tables_and_drops_labels(spark):
    with pytest.raises(ValueError, match="no expected feature"):
        sanitize(spark.createDataFrame([(1.0,)], "rate double"), ["Rate"])
    df = spark.createDataFrame([(1.0, "a", "b", float("inf"))], "Rate double, label string, Label_2 string, IAT double")
    tidy = sanitize(df, ["Rate", "IAT"], COARSE_LABELS)
    assert [tuple(r) for r in tidy.data.collect()] == [(1.0, None)]


def test_json_records(spark, tmp_path):
    folder = tmp_path / "json"
    write(folder, "a.json", json.dumps({"Rate": 1.5}) + "\n" + json.dumps({"IAT": None, "x": 3}) + "\n")
    df = read_records(spark, str(folder))
    tidy = sanitize(df, ["Rate", "IAT", "Min"])
    assert tidy.missing == ["Min"]
    assert sorted((r["Rate"] or 0) for r in tidy.data.collect()) == [0, 1.5]
    write(tmp_path, "list.json", json.dumps([{"Rate": 1}, {"Rate": 2}]))
    assert read_records(spark, str(tmp_path / "list.json"), multi_line=True).count() == 2
    write(tmp_path, "none.json", "")
    with pytest.raises(ValueError, match="no records"):
        read_records(spark, str(tmp_path / "none.json"))


def test_record_adjustments(spark):
    lines = [{"id": "a", "Rate": 1, "IAT": 2}, {"id": "b", "Rate": "x"}, {"id": "c", "Rate": None, "IAT": 1}, {"id": "d", "rate": 1}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("not json",)], "value string")
    rows = {r["id"]: r for r in record_features(df, ["Rate", "IAT"], keep=["id"]).collect()}
    assert rows["a"]["input_adjustments"] is None and not rows["a"]["rejected"]
    b = rows["b"]["input_adjustments"]
    assert (b["invalid_values_replaced"], b["missing_features_filled"]) == (2, ["IAT"])
    c = rows["c"]["input_adjustments"]
    assert (c["invalid_values_replaced"], c["missing_features_filled"]) == (1, [])
    assert rows["d"]["rejected"] and rows[None]["rejected"]


def test_index_follows_file_position(spark, tmp_path):
    from flowlens.operators.ranking import index_file_rows

    path = write(tmp_path, "many.csv", "v\n" + "\n".join(str(i) for i in range(20_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        df = index_file_rows(spark.read.schema("v long").option("header", True).csv(path))
        assert df.rdd.getNumPartitions() > 1
        assert df.where(F.col("v") != F.col("index")).count() == 0 and df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["34 classes", "a%20b", "x+y"])
def test_over_long_files_are_skipped_in_any_folder(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "Merged 01.csv").write_text("IAT,Label\n1,BENIGN\n")
    (folder / "Merged02.csv").write_text("IAT,Label\n1,BENIGN\n2,BENIGN,40\n")
    files = read_files(spark, str(folder), "Merged*.csv")
    rows = files.data.collect()
    assert len(rows) == 1 and rows[0]["source_file"] == "Merged 01.csv"
    assert [r["path"][-12:] for r in files.files.where("reason is not null").collect()] == ["Merged02.csv"]


def test_fields_of_a_line(spark):
    lines = ['a,b', ',a,', '"x,y",1', '"he said ""no""",2,', '"",b"c', 'a,"' + "q," * 20_000 + '"', '"open,1']
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    got = [r["f"] for r in df.select("i", csv_fields(F.col("line")).alias("f")).orderBy("i").collect()]
    assert got[:5] == [["a", "b"], [None, "a", None], ["x,y", "1"], ['he said "no"', "2", None], [None, 'b"c']]
    assert got[5] == ["a", "q," * 20_000]


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    jobs = {}
    for n in (2, 12):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            write(folder, f"Merged{i:02d}.csv", ("Rate,Label\n1,XSS\n" if i % 2 else "Label,Rate\nXSS,2\n"))
        spark.sparkContext.setJobGroup(f"load {n}", "")
        assert load_fine_flows(spark, str(folder)).count() == n
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"load {n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] == jobs[12]


def test_scored_folder_is_numbered_in_file_order(spark, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    sizes, n = {"a.csv": 30, "b.csv": 4000, "c.csv": 1}, 0
    for name, size in sizes.items():
        write(folder, name, "Rate,IAT\n" + "".join(f"{n + i},0\n" for i in range(size)))
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        df = read_scoring_csv(spark, str(folder), "index")
        assert df.count() == n and df.where("cast(Rate as long) <> index").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
