"""From raw flows to scaled, split training tables.

Each plan has a few barriers where one row per class or feature comes back to
the driver (medians, class sizes, scaler). Before the passes that re-read the
data, it is written once as Parquet, so every pass scans only its columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import derive_labels
from ..operators import checks
from ..operators.cleaning import (
    clean, drop_duplicate_rows, drop_incomplete_rows, drop_redundant_features, split_features_label,
)
from ..operators.ranking import index_stored_rows
from ..operators.sampling import balanced_sample, stratified_split
from ..operators.scoring import Preprocessing
from ..operators.transforms import (
    apply_log, apply_scaler, fit_log_shifts, fit_scaler, log_minimums, scaler_values, zero_variance_features,
)
from ..schema import (
    BINARY_LABEL, FAMILY_LABEL, LABEL, MAX_CAP, MIN_SAMPLES, SEED, SPLIT, TARGET_TOTAL, ident,
)
from ..workspace import discard, is_stored, materialize, tune

ROW_ID = "row_id"


@dataclass
class Prepared:
    """Scaled table with labels and a split column, and its fitted transforms."""

    data: DataFrame
    unscaled: DataFrame
    features: list[str]
    prep: Preprocessing
    medians: dict[str, float | None]
    dropped: list[str]


def _indexed(raw: DataFrame, row_id: str | None, name: str) -> tuple[DataFrame, str]:
    """Store the labelled rows, unless they have an id and lie stored; number them when the caller has no row id."""
    tune(raw.sparkSession)
    df = raw.where(F.col(LABEL).isNotNull())
    if row_id:
        return (df if is_stored(raw) else materialize(df, name)), row_id
    return index_stored_rows(materialize(df, name), ROW_ID), ROW_ID


def prepare_fine(
    raw: DataFrame, row_id: str | None = None, features: list[str] | None = None,
    target: int = TARGET_TOTAL, floor: int = MIN_SAMPLES, cap: int = MAX_CAP, seed: int = SEED, fit_scope: str = "all",
) -> Prepared:
    """Clean, balance the classes, split 80/10/10 by class and scale.

    ``raw`` holds the features and the label (rows without one are dropped).
    ``fit_scope="train"`` fits medians, and finds constant features, on the
    training rows of the sample only; the default uses all rows.
    """
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope is all or train")
    stored, row_id = _indexed(raw, row_id, "raw")
    features = features or split_features_label(stored, [LABEL, row_id])[0]
    narrow = stored.select(row_id, LABEL, *[F.col(ident(f)) for f in features])
    if fit_scope == "all":
        cleaned = clean(narrow, features)
        # At most cap rows per class from here on.
        sample = materialize(balanced_sample(cleaned.data, row_id, LABEL, target, floor, cap, seed), "balanced")
        split = materialize(stratified_split(sample, row_id, LABEL, seed=seed), "split", [SPLIT])
    else:
        sample = materialize(balanced_sample(narrow, row_id, LABEL, target, floor, cap, seed), "balanced")
        dealt = materialize(stratified_split(sample, row_id, LABEL, seed=seed), "dealt", [SPLIT])
        cleaned = clean(dealt, features, fit_on=dealt.where(F.col(SPLIT) == "train"))
        split = materialize(cleaned.data, "split", [SPLIT])
    kept = [f for f in features if f not in cleaned.constants]
    train = split.where(F.col(SPLIT) == "train")
    scaler = scaler_values(fit_scaler(train, kept))
    prep = Preprocessing(kept, scaler)
    return Prepared(apply_scaler(split, scaler), split, kept, prep, cleaned.medians, cleaned.constants)


def prepare_coarse(
    raw: DataFrame, row_id: str | None = None, features: list[str] | None = None,
    drop_duplicates: bool = False, fit_scope: str = "all", seed: int = SEED, last_read: Callable[[], None] | None = None,
) -> Prepared:
    """Clean, derive family and binary labels, log, reduce, split by family, scale.

    ``fit_scope="train"`` fits medians and log minimums on the training rows
    only; the default uses all rows.  ``last_read`` is called once ``raw`` is
    not read any more, before its rows are stored for the last time.
    """
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope is all or train")
    stored, row_id = _indexed(raw, row_id, "raw")
    features = features or split_features_label(stored, [LABEL, row_id])[0]
    narrow = stored.select(row_id, LABEL, *[F.col(ident(f)) for f in features])
    if drop_duplicates:
        narrow = materialize(drop_duplicate_rows(narrow, row_id), "distinct")
    labelled = derive_labels(narrow, LABEL)
    if fit_scope == "train":
        labelled = materialize(stratified_split(labelled, row_id, FAMILY_LABEL, seed=seed), "split", [SPLIT])
        cleaned = clean(labelled, features, drop_constants=False, fit_on=labelled.where(F.col(SPLIT) == "train"))
    else:
        cleaned = clean(labelled, features, drop_constants=False)
    complete = drop_incomplete_rows(cleaned.data)
    fit_rows = complete if fit_scope == "all" else complete.where(F.col(SPLIT) == "train")
    reduced = [c for c in drop_redundant_features(complete).columns if c in features]
    minimums = log_minimums(fit_log_shifts(fit_rows.select(*[F.col(ident(c)) for c in reduced])))
    keep = [row_id, LABEL, FAMILY_LABEL, BINARY_LABEL] + ([SPLIT] if fit_scope == "train" else [])
    slim = apply_log(complete.select(*keep, *[F.col(ident(c)) for c in reduced]), minimums)
    if fit_scope == "all":
        # a split reads its rows three times: they are cleaned once for all of them
        logged = materialize(slim, "logged")
        if last_read:
            last_read()
        split = materialize(stratified_split(logged, row_id, FAMILY_LABEL, seed=seed), "split", [SPLIT])
        discard(logged)
    else:
        split = materialize(slim, "split", [SPLIT])
        if last_read:
            last_read()
    scaler = scaler_values(fit_scaler(split.where(F.col(SPLIT) == "train"), reduced))
    prep = Preprocessing(reduced, scaler, minimums)
    return Prepared(apply_scaler(split, scaler), split, reduced, prep, cleaned.medians, [])


def fine_checks(prepared: Prepared, classes: list[str], target: int = TARGET_TOTAL) -> dict[str, DataFrame]:
    """The checks a fine table should pass; size and shift only warn."""
    return {
        "clean": checks.clean_splits(prepared.data, prepared.features),
        "size": checks.size_ratio(prepared.data, target),
        "presence": checks.class_presence(prepared.data, classes),
        "shift": checks.split_shift(prepared.data),
    }


def coarse_checks(prepared: Prepared) -> dict[str, DataFrame]:
    """The checks a coarse table should pass before it is used: cells, shift of both labels, features without variance."""
    train = prepared.data.where(F.col(SPLIT) == "train")
    return {
        "clean": checks.clean_splits(prepared.data, prepared.features),
        "shift_family": checks.split_shift(prepared.data, FAMILY_LABEL), "shift_binary": checks.split_shift(prepared.data, BINARY_LABEL),
        "zero_variance": zero_variance_features(train, prepared.features),
    }
