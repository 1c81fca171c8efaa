"""The dataset jobs: prepare a labelled file, then train and judge a classifier on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.config import DatasetSettings
from talkgauge.operators import classify, countmodel, evaluate, prepare, profile
from talkgauge.session import materialize
from talkgauge.sources import datasets


@dataclass(frozen=True)
class Prepared:
    """A cleaned, split dataset and the tables that describe it."""

    splits: DataFrame
    stats: DataFrame
    report: DataFrame
    labels: DataFrame | None


def validated(df: DataFrame, settings: DatasetSettings) -> tuple[DataFrame, DataFrame | None]:
    """Required columns, a row id, and integer labels (text labels are numbered in sorted order)."""
    datasets.require_columns(df, settings.text_column, settings.label_column)
    key = settings.id_column
    if key:
        datasets.require_columns(df, key)
    rows = df.select(
        (F.col(key) if key else F.monotonically_increasing_id()).alias("id"),
        F.col(settings.text_column).alias("text"),
        F.col(settings.label_column).alias("label"),
    )
    if dict(rows.dtypes)["label"] != "string":
        return rows, None
    mapping = prepare.label_map(rows)
    encoded = prepare.encode_labels(rows, mapping).drop("label").withColumnRenamed("label_id", "label")
    return encoded, mapping


def prepare_rows(df: DataFrame, settings: DatasetSettings) -> Prepared:
    """Validate, profile, clean, drop copies, split.

    Without an id column, ids come from the file order and are fixed by writing
    the cleaned rows before anything depends on them.
    """
    rows, mapping = validated(df, settings)
    cleaned = prepare.cleaned(
        rows, "text", settings.min_text_length, settings.replace_urls, settings.replace_emails
    )
    settled = materialize(cleaned, "cleaned")
    stats = profile.stats_record(settled, "text", "label", settings.max_length)
    kept = prepare.drop_empty(settled)
    if settings.remove_duplicates:
        kept = prepare.first_copies(kept, "id")
    dataset = materialize(prepare.as_dataset(kept, key="id"), "dataset")
    splits = prepare.split(dataset, "id", "label", settings.train_ratio, settings.val_ratio, settings.seed)
    return Prepared(splits, stats, profile.cleaning_report(settled), mapping)


def prepare_file(spark: SparkSession, settings: DatasetSettings, schema=None) -> Prepared:
    """The same from a file, with splits, label map and statistics written out."""
    prepared = prepare_rows(datasets.read_dataset(spark, settings.data_path, schema), settings)
    out = settings.output_dir.rstrip("/")
    datasets.write_splits(prepared.splits, f"{out}/splits")
    datasets.write_json(prepared.stats, f"{out}/data_statistics")
    if prepared.labels is not None:
        datasets.write_json(prepared.labels, f"{out}/label_mapping")
    return prepared


def tokenize_splits(prepared: Prepared, settings: DatasetSettings, make_tokenizer=None) -> DataFrame:
    tokens = prepare.tokenized(prepared.splits, settings.max_length, make_tokenizer=make_tokenizer)
    return tokens.select("split", "input_ids", "attention_mask", "label")


def train_and_judge(prepared: Prepared, settings: DatasetSettings, run: str = "run", **params) -> tuple[classify.Fitted, DataFrame]:
    """Fit on train, choose on val, report train, val and test metrics as tall rows."""
    rows = materialize(classify.text_features(prepared.splits).select("id", "split", "label", "features"), "features")
    parts = {s: rows.filter(F.col("split") == s) for s in prepare.SPLITS}
    fitted = classify.train(parts["train"], parts["val"], patience=settings.early_stopping_patience, **params)
    history = None
    for name, part in parts.items():
        cells = evaluate.confusion(classify.predictions(fitted.model, part))
        metrics = evaluate.metric_rows(cells, run, name)
        history = metrics if history is None else history.unionByName(metrics)
    return fitted, history


# Smoothing values tried by the count model.
ALPHAS = tuple(round(10 ** (-3 + i / 4), 6) for i in range(20))


def count_and_judge(prepared: Prepared, run: str = "run", alphas: tuple[float, ...] = ALPHAS) -> tuple[DataFrame, float, DataFrame]:
    """The same with the count model: smoothing chosen on val, metrics of all splits from one pass over the rows."""
    parts = {s: prepared.splits.filter(F.col("split") == s) for s in prepare.SPLITS}
    trials, fitted = countmodel.search(parts["train"], parts["val"], alphas)
    alpha = countmodel.best_alpha(trials)
    judged = countmodel.predict(prepared.splits, fitted, alpha=alpha)
    cells = materialize(evaluate.confusion(judged, by=["split"]), "cells")
    history = None
    for name in parts:
        metrics = evaluate.metric_rows(cells.filter(F.col("split") == name).drop("split"), run, name)
        history = metrics if history is None else history.unionByName(metrics)
    return fitted, alpha, history
