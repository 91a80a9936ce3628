"""Queries over sampling, splitting and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.ranking import index_by_order
from ..plans.flows import ROW_ID, flows
from ..schema import FAMILY_LABEL, LABEL, TUNE_FOLDS
from .aggregates import PLAN_CTE
from .common import SUBSET_SHARE, balance_limits, labelled
from .registry import query
from .sqltext import over_flows

def _ranked(stratum: str, name: str = "ranked", source: str = "flows") -> str:
    return (
        f'{name} AS (SELECT *, {stratum} AS stratum, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(\'42:\' || flow_id), flow_id) AS rn,'
        f" count(*) OVER (PARTITION BY {stratum}) AS n FROM {source})"
    )


def _quota(total: str, draws: str, counts: str, name: str) -> str:
    """Largest-remainder quota per stratum, ties by name."""
    return (
        f"{name}_raw AS (SELECT stratum, n, n * {draws} // {total} AS base, n * {draws} % {total} AS rest FROM {counts}),\n"
        f"{name} AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= "
        f"{draws} - (SELECT sum(base) FROM {name}_raw) THEN 1 ELSE 0 END AS q FROM {name}_raw)"
    )


def split_ctes(stratum: str) -> list[str]:
    return [
        _ranked(stratum),
        "sizes AS (SELECT stratum, count(*) AS n FROM ranked GROUP BY stratum)",
        "held AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST((sum(n) + 4) // 5 AS BIGINT) AS held, CAST(((sum(n) + 4) // 5 + 1) // 2 AS BIGINT) AS test FROM sizes)",
        _quota("(SELECT total FROM held)", "(SELECT total - held FROM held)", "sizes", "train_q"),
        "rest AS (SELECT s.stratum, s.n - t.q AS n FROM sizes s JOIN train_q t USING (stratum))",
        _quota("(SELECT held FROM held)", "(SELECT held - test FROM held)", "rest", "val_q"),
        """assigned AS (SELECT r.flow_id, r.stratum, CASE WHEN rn <= t.q THEN 'train' WHEN rn <= t.q + v.q THEN 'val' ELSE 'test' END AS part
  FROM ranked r JOIN train_q t USING (stratum) JOIN val_q v USING (stratum))""",
    ]


@query("o01_balanced_sample", over_flows(
    'SELECT r.flow_id, r."Label" FROM ranked r JOIN plan USING ("Label") WHERE rn <= cap', _ranked('"Label"'), PLAN_CTE))
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(ROW_ID, LABEL)
    return sampling.balanced_sample(df, ROW_ID, LABEL, *balance_limits(df))


@query("j02_cap_lookup", over_flows("""
SELECT r."Label", plan.cap, count(*) AS rows FROM ranked r JOIN plan USING ("Label") WHERE rn <= cap GROUP BY ALL""", _ranked('"Label"'), PLAN_CTE))
def cap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(ROW_ID, LABEL)
    limits = balance_limits(df)
    plan = sampling.balance_plan(df, LABEL, *limits).select(LABEL, "cap")
    sampled = sampling.balanced_sample(df, ROW_ID, LABEL, *limits).groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"))
    return sampled.join(plan, LABEL)


@query("o02_shuffled", over_flows("""
SELECT CAST(row_number() OVER (ORDER BY md5('42:' || flow_id), flow_id) - 1 AS BIGINT) AS position, flow_id FROM flows"""))
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select(ROW_ID).withColumn("key", sampling.seeded_key(ROW_ID))
    return index_by_order(df, ["key", ROW_ID], "position").drop("key")


@query("o03_stratified_split", over_flows('SELECT flow_id, stratum AS "Label", part AS split FROM assigned', *split_ctes('"Label"')))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(flows(spark, sf_dir).select(ROW_ID, LABEL), ROW_ID, LABEL)


@query("o04_family_split", over_flows("""
SELECT a.flow_id, a.stratum AS "Label_8", CASE WHEN f."Label" = 'BENIGN' THEN 'Benign' ELSE 'Attack' END AS "Label_2", a.part AS split
FROM assigned a JOIN flows f USING (flow_id)""", *split_ctes("family")))
def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir).select(ROW_ID, FAMILY_LABEL, "Label_2")
    return sampling.stratified_split(df, ROW_ID, FAMILY_LABEL)


@query("o05_tuning_subset", over_flows(
    'SELECT r.flow_id, r.stratum AS "Label_8" FROM ranked r JOIN sub_q q USING (stratum) WHERE rn <= q.q', _ranked("family"),
    "sizes AS (SELECT stratum, count(*) AS n FROM ranked GROUP BY stratum)",
    _quota("(SELECT CAST(sum(n) AS BIGINT) FROM sizes)", f"(SELECT CAST(sum(n) // {SUBSET_SHARE} AS BIGINT) FROM sizes)", "sizes", "sub_q")))
def tuning_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir).select(ROW_ID, FAMILY_LABEL)
    return sampling.stratified_subset(df, ROW_ID, FAMILY_LABEL, df.count() // SUBSET_SHARE)


_FOLD_SIZES = """sizes AS (SELECT stratum, count(*) AS n FROM ranked GROUP BY stratum),
starts AS (SELECT stratum, n, CAST(sum(n) OVER (ORDER BY stratum) - n AS BIGINT) AS start FROM sizes),
dealt AS (SELECT stratum, n, (n - ((0 - start) % 3 + 3) % 3 + 2) // 3 AS f0, (n - ((1 - start) % 3 + 3) % 3 + 2) // 3 AS f1 FROM starts)"""


@query("o06_stratified_folds", over_flows("""
SELECT r.flow_id, r.stratum AS "Label_8", CASE WHEN rn <= f0 THEN 0 WHEN rn <= f0 + f1 THEN 1 ELSE 2 END AS fold
FROM ranked r JOIN dealt USING (stratum)""", _ranked("family"), _FOLD_SIZES))
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir).select(ROW_ID, FAMILY_LABEL)
    return sampling.stratified_folds(df, ROW_ID, FAMILY_LABEL, TUNE_FOLDS)


@query("o07_seeded_sample", over_flows("""
SELECT flow_id, "Label" FROM (SELECT * FROM flows ORDER BY md5('42:' || flow_id), flow_id LIMIT 20)"""))
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(flows(spark, sf_dir).select(ROW_ID, LABEL), ROW_ID, 20)


@query("o10_row_index", over_flows("""
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS "index", flow_id, predicted FROM flows"""))
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = flows(spark, sf_dir).select(*keys, ROW_ID, "predicted")
    return index_by_order(df, keys).select("index", ROW_ID, "predicted")
