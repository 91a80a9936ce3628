"""Fixed vocabulary of the flow tables: features, classes, families, tokens."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They define the data contract and must match input files and
# saved models, so they are spelled out in their natural order.
# ---------------------------------------------------------------------------

FEATURES_FINE = [
    "Header_Length", "Protocol Type", "Time_To_Live", "Rate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number",
    "psh_flag_number", "ack_flag_number", "ece_flag_number",
    "cwr_flag_number", "ack_count", "syn_count", "fin_count", "rst_count",
    "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP",
    "DHCP", "ARP", "ICMP", "IGMP", "IPv", "LLC", "Tot sum", "Min", "Max",
    "AVG", "Std", "Tot size", "IAT", "Number", "Variance",
]

# Features dropped by the coarse plan: strongly correlated ones, then ones of
# low value.
CORRELATED_FEATURES = [
    "fin_flag_number", "rst_flag_number", "fin_count", "psh_flag_number",
    "syn_flag_number", "IPv", "LLC", "Tot size",
]
LOW_VALUE_FEATURES = ["ARP", "Telnet", "SMTP"]

# Features that are not log-transformed by the coarse plan.
UNLOGGED_FEATURES = ["Header_Length", "TCP"]

FAMILY_OF_CLASS = {
    "BACKDOOR_MALWARE": "Web",
    "BENIGN": "Benign",
    "BROWSERHIJACKING": "Web",
    "COMMANDINJECTION": "Web",
    "DDOS-ACK_FRAGMENTATION": "DDoS",
    "DDOS-HTTP_FLOOD": "DDoS",
    "DDOS-ICMP_FLOOD": "DDoS",
    "DDOS-ICMP_FRAGMENTATION": "DDoS",
    "DDOS-PSHACK_FLOOD": "DDoS",
    "DDOS-RSTFINFLOOD": "DDoS",
    "DDOS-SLOWLORIS": "DDoS",
    "DDOS-SYNONYMOUSIP_FLOOD": "DDoS",
    "DDOS-SYN_FLOOD": "DDoS",
    "DDOS-TCP_FLOOD": "DDoS",
    "DDOS-UDP_FLOOD": "DDoS",
    "DDOS-UDP_FRAGMENTATION": "DDoS",
    "DICTIONARYBRUTEFORCE": "BruteForce",
    "DNS_SPOOFING": "Spoofing",
    "DOS-HTTP_FLOOD": "DoS",
    "DOS-SYN_FLOOD": "DoS",
    "DOS-TCP_FLOOD": "DoS",
    "DOS-UDP_FLOOD": "DoS",
    "MIRAI-GREETH_FLOOD": "Mirai",
    "MIRAI-GREIP_FLOOD": "Mirai",
    "MIRAI-UDPPLAIN": "Mirai",
    "MITM-ARPSPOOFING": "Spoofing",
    "RECON-HOSTDISCOVERY": "Recon",
    "RECON-OSSCAN": "Recon",
    "RECON-PINGSWEEP": "Recon",
    "RECON-PORTSCAN": "Recon",
    "SQLINJECTION": "Web",
    "UPLOADING_ATTACK": "Web",
    "VULNERABILITYSCAN": "Recon",
    "XSS": "Web",
}

# Texts that a flow file uses for "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

BENIGN_CLASS = "BENIGN"
BENIGN_FAMILY = "Benign"
ATTACK = "Attack"

# Sampling, splitting and checking defaults.
SEED = 42
TARGET_TOTAL = 1_000_000
MIN_SAMPLES = 2_000
MAX_CAP = 40_000
HELD_OUT_SHARE = 0.2
TEST_SHARE_OF_HELD_OUT = 0.5
TUNE_SUBSET_ROWS = 150_000
TUNE_FOLDS = 3
TUNE_DRAWS = 12
SHIFT_TOLERANCE = 0.02
SIZE_RATIO_RANGE = (0.85, 1.15)
OVERFIT_GAP = 0.05
WEIGHT_CLIP = (0.1, 10.0)
FINE_FILE_PATTERN = "Merged*.csv"
COARSE_FILE_PATTERN = "Merged0[1-6].csv"

# ---------------------------------------------------------------------------
# Derived names
# ---------------------------------------------------------------------------

LABEL = "Label"
FAMILY_LABEL = "Label_8"
BINARY_LABEL = "Label_2"
SPLIT = "split"
SPLITS = ["train", "val", "test"]

CLASSES_FINE = sorted(FAMILY_OF_CLASS)
FAMILIES = sorted(set(FAMILY_OF_CLASS.values()))
BINARY_CLASSES = [ATTACK, BENIGN_FAMILY]

REDUNDANT_FEATURES = CORRELATED_FEATURES + LOW_VALUE_FEATURES
FEATURES_COARSE = [f for f in FEATURES_FINE if f not in REDUNDANT_FEATURES]
LOG_FEATURES = [f for f in FEATURES_FINE if f not in UNLOGGED_FEATURES]


def flow_schema(label: str | None = LABEL) -> T.StructType:
    """Typed schema of a raw flow table, with an optional label column."""
    fields = [T.StructField(f, T.DoubleType()) for f in FEATURES_FINE]
    if label:
        fields.append(T.StructField(label, T.StringType()))
    return T.StructType(fields)


def text_schema(names: list[str]) -> T.StructType:
    """Every column as text: the safe way to read files with odd tokens."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def ident(name: str) -> str:
    """Column reference that survives spaces and dots in a name."""
    return "`" + name.replace("`", "``") + "`"
