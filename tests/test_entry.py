import duckdb
import pytest

import __spark_entry__ as entry
from data import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "a01_class_distribution", "a05_cell_profile", "a07_balance_plan", "a17_class_report", "a19_overfitting", "a28_family_predictions",
    "a34_health", "f05_encoded_labels", "m09_fine_scoring", "m10_coarse_scoring", "a33_weighted_loss", "j05_prediction_vs_truth", "j06_missing_classes", "p05_constant_columns", "p14_numbers_from_text", "s08_catalog",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 34
    assert df.columns == ["Label", "rows", "total", "pct", "Label_8"]


def test_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    ids = {name.split("_")[0] for name in queries}
    wanted = {f"{k}{i:02d}" for k, n in {"s": 14, "p": 17, "f": 9, "a": 35, "o": 10, "j": 8, "m": 11, "t": 3}.items() for i in range(1, n + 1)}
    assert wanted <= ids


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted((tuple(map(str, r)) for r in cur.fetchall()))
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_plans_prune_columns_and_use_no_python(spark):
    df = entry.queries()["a01_class_distribution"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "Python" not in plan and "CartesianProduct" not in plan
