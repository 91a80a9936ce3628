"""Command line: prepare tables, train models, score files, report health.

    python -m flowlens prepare fine   --input CSV_FOLDER --output TABLE
    python -m flowlens train   fine   --input TABLE --output BUNDLE --model logistic
    python -m flowlens score          --input FILE.csv --bundle BUNDLE --output RESULT
    python -m flowlens health         --input RESULT --output REPORT

Submit with spark-submit on a cluster; the session settings are taken from there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators.linear_training import epoch_table
from .operators.metrics import confusion_shares, metrics_table
from .operators.models import importance
from .operators.monitoring import class_predictions, family_predictions, health, prediction_summary
from .plans.prepare import ROW_ID, Prepared, coarse_checks, fine_checks, prepare_coarse, prepare_fine
from .plans.score import score_csv, score_json
from .plans.train import (
    coarse_search_rows, evaluate, train_coarse_forest, train_coarse_minibatch, train_fine_forest, train_fine_logistic,
)
from .schema import BINARY_CLASSES, BINARY_LABEL, CLASSES_FINE, FAMILIES, FAMILY_LABEL, LABEL, SPLIT
from .sources import tables
from .sources.csv_files import SOURCE_FILE, load_coarse_flows, load_fine_flows
from .workspace import tune


def _write_reports(reports: dict[str, DataFrame], path: str) -> None:
    for name, df in reports.items():
        tables.write_report(df, f"{path}/{name}")


def prepare(spark: SparkSession, kind: str, source: str, output: str, drop_duplicates: bool = False, fit_scope: str = "all") -> None:
    if kind == "fine":
        table = prepare_fine(load_fine_flows(spark, source).drop(SOURCE_FILE), fit_scope=fit_scope)
        classes = {"class_names": CLASSES_FINE}
        tables.write_splits(table.data, f"{output}/splits", table.features)
        _write_reports(fine_checks(table, CLASSES_FINE), f"{output}/checks")
    else:
        table = prepare_coarse(load_coarse_flows(spark, source).drop(SOURCE_FILE), drop_duplicates=drop_duplicates, fit_scope=fit_scope)
        _write_reports(coarse_checks(table), f"{output}/checks")
        classes = {"class_names_8": FAMILIES, "class_names_2": BINARY_CLASSES}
        tables.write_splits(table.data, f"{output}/splits")
    tables.write_preprocessing(table.prep, f"{output}/preprocessing", spark)
    tables.write_catalog(tables.catalog(table.data, table.features, classes, {"source_data": source}), f"{output}/catalog")


def _prepared(spark: SparkSession, path: str) -> Prepared:
    prep = tables.read_preprocessing(spark, f"{path}/preprocessing")
    data = tables.read_splits(spark, f"{path}/splits")
    return Prepared(data, data, prep.features, prep, {}, [])


def train(spark: SparkSession, kind: str, model: str, source: str, output: str) -> None:
    table = _prepared(spark, source)
    if kind == "fine":
        fitted = train_fine_forest(table) if model == "forest" else train_fine_logistic(table)[0]
        models = {"fine": (fitted, LABEL, CLASSES_FINE)}
    else:
        models, search = {}, coarse_search_rows(table) if model == "forest" else None
        for name, label, classes in (("binary", BINARY_LABEL, BINARY_CLASSES), ("family", FAMILY_LABEL, FAMILIES)):
            if model == "forest":
                fitted = train_coarse_forest(table, label, ROW_ID, binned_rows=search)
            else:
                fitted, trained = train_coarse_minibatch(table, label)
                tables.write_report(epoch_table(spark, trained), f"{output}/reports/{name}/epochs")
            models[name] = (fitted, label, classes)
    bundle = tables.Bundle(table.prep, {n: m[0] for n, m in models.items()}, {n: m[2] for n, m in models.items()})
    tables.save_bundle(bundle, output, spark)
    for name, (fitted, label, classes) in models.items():
        result = evaluate(fitted, table, label, classes)
        _write_reports(
            {"metrics": metrics_table(result.by_split), "gap": result.gap, "test_classes": result.test_report, "confusion": result.counts,
             "shares": confusion_shares(result.counts, [SPLIT], 4), "importance": importance(spark, fitted, table.features)}, f"{output}/reports/{name}")


def report_health(spark: SparkSession, source: str, output: str) -> None:
    scored = spark.read.parquet(f"{source}/predictions")
    if "predicted_class" in scored.columns:
        reports = {"health": health(scored), "classes": class_predictions(scored)}
    else:
        reports = {
            "health": health(scored, "attack_family"), "summary": prediction_summary(scored), "families": family_predictions(scored),
        }
    _write_reports(reports, output)


def main() -> None:
    parser = argparse.ArgumentParser(prog="flowlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("prepare", "train"):
        c = commands.add_parser(name)
        c.add_argument("kind", choices=["fine", "coarse"])
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        if name == "prepare":
            c.add_argument("--drop-duplicates", action="store_true", help="coarse: keep one of each set of equal rows")
            c.add_argument("--fit-scope", choices=["all", "train"], default="all", help="rows that medians and log minimums are fitted on")
        if name == "train":
            c.add_argument("--model", choices=["logistic", "forest"], default="logistic")
    for name in ("score", "health"):
        c = commands.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        if name == "score":
            c.add_argument("--bundle", required=True)
    args = parser.parse_args()
    spark = tune(SparkSession.builder.appName(f"flowlens-{args.command}").getOrCreate())
    if args.command == "prepare":
        prepare(spark, args.kind, args.input, args.output, args.drop_duplicates, args.fit_scope)
    elif args.command == "train":
        train(spark, args.kind, args.model, args.input, args.output)
    elif args.command == "score":
        score = score_csv if args.input.rstrip("/").lower().endswith(".csv") else score_json
        score(spark, args.input, tables.load_bundle(spark, args.bundle), args.bundle.rstrip("/").rsplit("/", 1)[-1], args.output)
    else:
        report_health(spark, args.input, args.output)
    spark.stop()


if __name__ == "__main__":
    main()
