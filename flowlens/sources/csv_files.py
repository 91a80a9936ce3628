"""CSV input: many files with differing headers, and single scoring files."""

from __future__ import annotations

import csv
import warnings
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import text_or_null, to_number
from ..operators.ranking import index_file_rows
from ..operators.sanitize import clean_names
from ..schema import COARSE_FILE_PATTERN, FEATURES_FINE, FINE_FILE_PATTERN, LABEL, ident, text_schema
from ..workspace import materialize

SOURCE_FILE = "source_file"
_CORRUPT = "__corrupt"


def read_header(spark: SparkSession, path: str) -> list[str] | None:
    """Column names in the first line of a file; None for an empty file."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return None
    return next(csv.reader([first[0]["value"].replace("﻿", "")]))


def fields_in(line: Column) -> Column:
    """Number of fields of a CSV line: separators outside quotes, plus one."""
    return F.size(F.split(F.regexp_replace(line, r'"[^"]*"', "q"), ",", -1))


def over_long(width: int) -> Column:
    """True for a record with more fields than its header.

    Spark flags every record of a wrong width; shorter ones are legitimate
    (their missing fields are null), so only flagged records are counted. The
    first column takes part because Spark refuses to read the record text
    without any data column.
    """
    flagged = F.col(_CORRUPT).isNotNull() & (F.length(F.concat_ws("", F.col("c0"), F.col(_CORRUPT))) > 0)
    return flagged & (fields_in(F.col(_CORRUPT)) > width)


def file_path() -> Column:
    """Path of the row's file as the listing spells it; the metadata escapes spaces and other characters."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, path: str, width: int, index: str | None = None) -> DataFrame:
    """Text scan of a file or a folder of parts that share a header, with positional column names.

    Every field of every record is parsed, whatever columns a query needs: with
    column pruning Spark would not see a wrong width. With ``index`` rows also
    carry their position in the file, or in all parts by path.
    """
    names = [*[f"c{i}" for i in range(width)], _CORRUPT]
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", _CORRUPT).option("columnPruning", False)
    rows = reader.schema(text_schema(names)).csv(path)
    if index:
        return index_file_rows(rows.withColumn(SOURCE_FILE, _file_name()), index)
    return rows.withColumn(SOURCE_FILE, _file_name())


def _file_name() -> Column:
    return F.regexp_extract(file_path(), r"(?i)([^/]+\.csv)(/|$)", 1)


def reject_over_long(df: DataFrame, width: int) -> DataFrame:
    """Fail the job at the first over-long record."""
    message = F.concat(F.lit("record longer than the header in "), F.col(SOURCE_FILE))
    return df.where(F.when(over_long(width), F.raise_error(message).cast("boolean")).otherwise(True))


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line as an array: separators inside quotes belong to their field, a doubled quote is one.

    Empty fields are null.
    """
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), F.lit(1))
    bare = F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_extract(x, r'^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"'))).otherwise(x))
    every = F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, ",", -1))
    return F.transform(every, lambda x: F.nullif(x, F.lit("")))


@dataclass
class FlowFiles:
    """Union by name of many files, all columns as text; ``files`` tells why a file was left out (null: it was read)."""

    data: DataFrame
    files: DataFrame


# Files whose column places every task gets whole: paths and places of 100,000 files are some 40 MB.
MAX_FILES = 100_000
# Names in a warning or an error; the table of files has all of them.
_SHOWN = 20


def _file_table(spark: SparkSession, source: str, parsed: DataFrame, label: str) -> DataFrame:
    """(path, header, header_start, header_at, reason) of every matching file.

    The header is the first line of a file's first block; all come from one
    aggregate over the stored rows, however many files there are.
    """
    first = F.struct("start", "at")
    headers = parsed.where("start = 0").groupBy("path").agg(F.min_by("fields", first).alias("header"), F.min(first).alias("place"))
    widest = parsed.groupBy("path").agg(F.max("width").alias("widest"))
    listed = spark.read.format("binaryFile").load(source).select("path")
    header = F.transform("header", lambda x: F.replace(x, F.lit("\ufeff"), F.lit("")))
    table = listed.join(headers, "path", "left").join(widest, "path", "left").withColumn("header", header)
    reason = (
        F.when(F.col("header").isNull(), "empty file").when(~F.array_contains("header", label), f"no column {label}")
        .when(F.col("widest") > F.size("header"), "record longer than the header")
    )
    return table.select("path", "header", F.col("place.start").alias("header_start"), F.col("place.at").alias("header_at"), reason.alias("reason"))


def read_files(
    spark: SparkSession, folder: str, pattern: str, label: str = LABEL, columns: list[str] | None = None, on_bad: str = "skip",
) -> FlowFiles:
    """Read CSV files whose columns may differ in order and presence.

    The text is read and split once and stored; headers, widths and the union
    by name come from that table, in a number of jobs that does not depend on
    the number of files. A file is bad when it is empty, lacks the label or
    holds a record longer than its header: ``on_bad="skip"`` leaves the whole
    file out with a warning, ``on_bad="raise"`` fails.
    """
    source = f"{folder}/{pattern}"
    lines = spark.read.text(source).select(
        "value", file_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    fields = lines.where(F.trim("value") != "").select("path", "start", "at", csv_fields(F.col("value")).alias("fields"))
    parsed = materialize(fields.withColumn("width", F.size("fields")), "lines")
    files = materialize(_file_table(spark, source, parsed, label), "files")
    early = F.col("reason").isNotNull() if on_bad == "skip" else F.col("reason").isNotNull() & (F.col("reason") != "record longer than the header")
    bad = files.where(early)
    shown = {r["path"]: r["reason"] for r in bad.orderBy("path").limit(_SHOWN).collect()}
    if shown and on_bad == "raise":
        raise ValueError(f"{bad.count()} unreadable files, among them: {shown}")
    for path, reason in shown.items():
        warnings.warn(f"skipped {path}: {reason}", stacklevel=2)
    if len(shown) == _SHOWN:
        warnings.warn(f"skipped {bad.count()} files", stacklevel=2)
    good = files.where(~early)
    wanted = columns
    if wanted is None:
        places = good.select("path", F.posexplode("header").alias("place", "name")).where("name is not null")
        names = places.groupBy("name").agg(F.min(F.struct("path", "place")).alias("first")).orderBy("first")
        wanted = [r["name"] for r in names.collect()]
    if good.isEmpty():
        raise ValueError("no readable file")
    # where each wanted column lies in the file, found once per file; 0 where it has none
    places = F.array(*[F.array_position("header", F.lit(c)).cast("int") for c in wanted])
    known = good.select("path", "header_start", "header_at", F.size("header").alias("columns"), places.alias("places"))
    rows = parsed.join(F.broadcast(known) if good.count() <= MAX_FILES else known, "path")
    rows = rows.where((F.col("start") != F.col("header_start")) | (F.col("at") != F.col("header_at")))
    name = F.regexp_extract("path", r"(?i)([^/]+\.csv)(/|$)", 1)
    if on_bad == "raise":
        message = F.concat(F.lit("record longer than the header in "), name)
        rows = rows.where(F.when(F.col("width") > F.col("columns"), F.raise_error(message).cast("boolean")).otherwise(True))
    found = [F.get("fields", F.get("places", F.lit(i)) - 1).alias(c) for i, c in enumerate(wanted)]
    return FlowFiles(rows.select(*found, name.alias(SOURCE_FILE)), files.select("path", "reason"))


def typed_flows(df: DataFrame, features: list[str] = FEATURES_FINE, label: str = LABEL) -> DataFrame:
    """Declared types on text columns: features as doubles (absent or bad ones
    null), the label with its "no value" tokens as null."""
    columns = [
        (to_number(F.col(ident(f))) if f in df.columns else F.lit(None).cast("double")).alias(f)
        for f in features
    ]
    extra = [SOURCE_FILE] if SOURCE_FILE in df.columns else []
    return df.select(*columns, text_or_null(F.col(ident(label))).alias(label), *extra)


def load_fine_flows(spark: SparkSession, folder: str, pattern: str = FINE_FILE_PATTERN) -> DataFrame:
    """All matching files, bad ones skipped, unlabelled rows dropped."""
    files = read_files(spark, folder, pattern, columns=[*FEATURES_FINE, LABEL], on_bad="skip")
    return typed_flows(files.data).where(F.col(LABEL).isNotNull())


def load_coarse_flows(spark: SparkSession, folder: str, pattern: str = COARSE_FILE_PATTERN) -> DataFrame:
    """As the fine loader, over the coarse file pattern; bad files are errors."""
    files = read_files(spark, folder, pattern, columns=[*FEATURES_FINE, LABEL], on_bad="raise")
    return typed_flows(files.data).where(F.col(LABEL).isNotNull())


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows of each input file and, in the row without a file, of all of them."""
    return df.rollup(SOURCE_FILE).agg(F.count(F.lit(1)).alias("rows"))


def read_scoring_csv(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """One CSV file or folder of parts for scoring, as text under its own header.

    Only ``.csv`` names are accepted; an empty input is an error, and a record
    longer than the header fails the job that reads it. ``index`` names a
    column with the zero-based position of each record.
    """
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files are accepted")
    header = read_header(spark, path)
    if not header:
        raise ValueError("the CSV file is empty")
    rows = reject_over_long(scan(spark, path, len(header), index), len(header))
    try:
        empty = rows.isEmpty()
    except PySparkException as e:
        raise ValueError(f"could not parse CSV: {e}") from e
    if empty:
        raise ValueError("the CSV file is empty")
    names = _unique(clean_names(header))
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *([index] if index else []))


def _unique(names: list[str]) -> list[str]:
    """Repeated header names get a numbered suffix."""
    seen: dict[str, int] = {}
    result = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        result.append(n if k == 0 else f"{n}.{k}")
    return result
