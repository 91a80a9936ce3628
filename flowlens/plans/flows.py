"""Labelled flow table derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import decode
from ..schema import CLASSES_FINE, FEATURES_FINE, LABEL

ROW_ID = "flow_id"

# Below this size a table may sit in one row group, which only one task reads.
SMALL_BYTES = 1 << 30

_sizes: dict[tuple[str, str], int] = {}


def _bytes(spark: SparkSession, path: str) -> int:
    key = (spark.sparkContext.applicationId, path)
    if key not in _sizes:
        _sizes[key] = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return _sizes[key]


def spread(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Deal the rows of a small file to all cores; leave a large table alone.

    A large table has enough row groups to read in parallel, and shuffling it
    only to spread it would cost more than it gains.
    """
    spark = df.sparkSession
    if _bytes(spark, path) > SMALL_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, *keys)


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow features, class, prediction, confidence, split and event time.

    One row per line item. All columns are plain expressions over one
    three-way join, so a query reads only the columns it asks for.
    """
    path = f"{sf_dir}/lineitem.parquet"
    lineitem = spread(spark.read.parquet(path), path, ["l_orderkey", "l_linenumber"])
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    c = F.col
    keys = joined.withColumns({
        "h": (c("l_orderkey") * 31 + c("l_partkey") * 17 + c("l_suppkey") * 7 + c("l_linenumber")) % 997,
        "g": (c("l_orderkey") + c("l_linenumber") * 3) % 10,
        "e": (c("l_partkey") + c("l_linenumber")) % 5,
    })
    part_of = c("h").cast("double") / 997
    classed = keys.withColumn("class_idx", ((F.floor(34 * part_of * part_of).cast("int") + 1) % 34).cast("int"))
    h, k = c("h"), c("class_idx")
    pred_idx = F.when(c("e") == 0, (k + 1) % 34).otherwise(k)
    number = c("l_linenumber").cast("double")
    values = {
        "Header_Length": k * 8 + c("l_quantity"),
        "Protocol Type": number,
        "Time_To_Live": c("p_size").cast("double"),
        "Rate": F.when(h % 53 == 0, float("inf")).otherwise(c("l_extendedprice") / c("l_quantity")),
        "fin_flag_number": c("l_discount"),
        "syn_flag_number": c("l_tax"),
        "rst_flag_number": (h % 29).cast("double"),
        "psh_flag_number": (h % 2).cast("double"),
        "ack_flag_number": (h % 3).cast("double"),
        "ece_flag_number": (h % 5).cast("double"),
        "cwr_flag_number": (h % 7).cast("double"),
        "ack_count": (k % 5).cast("double"),
        "syn_count": (k % 3).cast("double"),
        "fin_count": (k % 2).cast("double"),
        "rst_count": (c("l_linenumber") % 4).cast("double"),
        "HTTP": _one_if(k % 4 == 0),
        "HTTPS": _one_if(k % 4 == 1),
        "DNS": _one_if(k % 4 == 2),
        "Telnet": F.lit(0.0),
        "SMTP": F.lit(0.0),
        "SSH": _one_if(h % 11 == 0),
        "IRC": _one_if(h % 13 == 0),
        "TCP": (h % 2).cast("double"),
        "UDP": (1 - h % 2).cast("double"),
        "DHCP": _one_if(h % 17 == 0),
        "ARP": _one_if(h % 19 == 0),
        "ICMP": _one_if(k % 7 == 0),
        "IGMP": _one_if(h % 23 == 0),
        "IPv": F.lit(1.0),
        "LLC": F.lit(1.0),
        "Tot sum": c("l_extendedprice"),
        "Min": c("l_discount") * 100 - 3,
        "Max": c("l_quantity") * 2,
        "AVG": F.when(h % 41 == 0, None).otherwise(c("l_quantity")),
        "Std": c("l_tax") * 100,
        "Tot size": c("p_retailprice"),
        "IAT": c("o_totalprice"),
        "Number": number,
        "Variance": c("l_tax") * c("l_quantity"),
    }
    split = F.when(c("g") < 8, "train").when(c("g") == 8, "val").otherwise("test")
    return classed.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(c("l_extendedprice") * 100).cast("long")).alias(ROW_ID),
        c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"),
        c("l_shipdate").cast("timestamp").alias("ts"),
        decode(k, CLASSES_FINE).alias(LABEL), decode(pred_idx, CLASSES_FINE).alias("predicted"),
        ((50 + h % 50).cast("double") / 100).alias("confidence"), split.alias("split"),
        *[values[f].alias(f) for f in FEATURES_FINE],
    )
