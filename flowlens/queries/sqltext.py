"""SQL building blocks that restate the queries for a check in another engine."""

from __future__ import annotations

from ..schema import CLASSES_FINE, FAMILY_OF_CLASS, FEATURES_FINE


def quoted(name: str) -> str:
    return '"' + name + '"'


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CLASS_ROWS = ", ".join(
    f"({i}, {text(c)}, {text(FAMILY_OF_CLASS[c])})" for i, c in enumerate(CLASSES_FINE)
)


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


_FEATURE_SQL = {
    "Header_Length": "class_idx * 8 + l_quantity",
    "Protocol Type": "CAST(l_linenumber AS DOUBLE)",
    "Time_To_Live": "CAST(p_size AS DOUBLE)",
    "Rate": "CASE WHEN h % 53 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice / l_quantity END",
    "fin_flag_number": "l_discount",
    "syn_flag_number": "l_tax",
    "rst_flag_number": "CAST(h % 29 AS DOUBLE)",
    "psh_flag_number": "CAST(h % 2 AS DOUBLE)",
    "ack_flag_number": "CAST(h % 3 AS DOUBLE)",
    "ece_flag_number": "CAST(h % 5 AS DOUBLE)",
    "cwr_flag_number": "CAST(h % 7 AS DOUBLE)",
    "ack_count": "CAST(class_idx % 5 AS DOUBLE)",
    "syn_count": "CAST(class_idx % 3 AS DOUBLE)",
    "fin_count": "CAST(class_idx % 2 AS DOUBLE)",
    "rst_count": "CAST(l_linenumber % 4 AS DOUBLE)",
    "HTTP": _flag("class_idx % 4 = 0"),
    "HTTPS": _flag("class_idx % 4 = 1"),
    "DNS": _flag("class_idx % 4 = 2"),
    "Telnet": "CAST(0 AS DOUBLE)",
    "SMTP": "CAST(0 AS DOUBLE)",
    "SSH": _flag("h % 11 = 0"),
    "IRC": _flag("h % 13 = 0"),
    "TCP": "CAST(h % 2 AS DOUBLE)",
    "UDP": "CAST(1 - h % 2 AS DOUBLE)",
    "DHCP": _flag("h % 17 = 0"),
    "ARP": _flag("h % 19 = 0"),
    "ICMP": _flag("class_idx % 7 = 0"),
    "IGMP": _flag("h % 23 = 0"),
    "IPv": "CAST(1 AS DOUBLE)",
    "LLC": "CAST(1 AS DOUBLE)",
    "Tot sum": "l_extendedprice",
    "Min": "l_discount * 100 - 3",
    "Max": "l_quantity * 2",
    "AVG": "CASE WHEN h % 41 = 0 THEN NULL ELSE l_quantity END",
    "Std": "l_tax * 100",
    "Tot size": "p_retailprice",
    "IAT": "o_totalprice",
    "Number": "CAST(l_linenumber AS DOUBLE)",
    "Variance": "l_tax * l_quantity",
}

_FEATURE_LIST = ",\n  ".join(f"{_FEATURE_SQL[f]} AS {quoted(f)}" for f in FEATURES_FINE)

FLOWS_CTE = f"""classes(idx, label, family) AS (VALUES {_CLASS_ROWS}),
base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS flow_id,
    (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 997 AS h,
    (l_orderkey + l_linenumber * 3) % 10 AS g, (l_partkey + l_linenumber) % 5 AS e, *
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
cls AS (
  SELECT *, (CAST(floor(34 * (CAST(h AS DOUBLE) / 997) * (CAST(h AS DOUBLE) / 997)) AS INT) + 1) % 34 AS class_idx
  FROM base),
flows AS (
  SELECT flow_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts,
  t.label AS "Label", t.family AS family, p.label AS predicted, p.family AS predicted_family,
  class_idx, p.idx AS pred_idx, CAST(50 + h % 50 AS DOUBLE) / 100 AS confidence,
  CASE WHEN g < 8 THEN 'train' WHEN g = 8 THEN 'val' ELSE 'test' END AS split,
  {_FEATURE_LIST}
  FROM cls JOIN classes t ON t.idx = class_idx
  JOIN classes p ON p.idx = CASE WHEN e = 0 THEN (class_idx + 1) % 34 ELSE class_idx END)"""


def over_flows(body: str, *ctes: str) -> str:
    """A statement over the flows table, with further named tables in between."""
    return "WITH " + ",\n".join([FLOWS_CTE, *ctes]) + "\n" + body


def stacked(features: list[str], source: str, columns: dict[str, str]) -> str:
    """One row per feature: ``columns`` maps a result name to an expression in
    which ``{c}`` stands for the feature column."""
    selects = []
    for f in features:
        exprs = ", ".join(f"{e.replace('{c}', quoted(f))} AS {n}" for n, e in columns.items())
        selects.append(f"SELECT {text(f)} AS feature, {exprs} FROM {source}")
    return "\nUNION ALL ".join(selects)
