"""Labelled-text files in, splits and result tables out."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.sources.store import path_exists

CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Quoted CSV with a header.

    Quoted line breaks need ``multi_line``, which makes one task read one file;
    switch it off for large files that have none.  Without a schema, types are
    inferred by an extra pass.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


READERS = {".csv": read_csv, ".json": read_json_array, ".jsonl": read_json_lines, ".parquet": read_parquet}


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reader chosen by suffix; a missing path or an unknown suffix is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    suffix = PurePosixPath(path).suffix
    if suffix not in READERS:
        raise ValueError(f"unsupported file format: {suffix or path}")
    return READERS[suffix](spark, path, schema)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def write_splits(splits: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per split."""
    options = CSV_OPTIONS if fmt == "csv" else {}
    splits.write.mode("overwrite").partitionBy("split").options(**options).format(fmt).save(path)


def read_split(spark: SparkSession, path: str, split: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """One split only: the others are not listed or read."""
    options = {**CSV_OPTIONS, "multiLine": True} if fmt == "csv" else {}
    return spark.read.options(**options).schema(schema).format(fmt).load(f"{path.rstrip('/')}/split={split}")


def write_json(rows: DataFrame, path: str) -> None:
    """Label maps, statistics, reports and run histories: small tables as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_confusion(cells: DataFrame, path: str) -> None:
    """Confusion counts as a wide CSV, one column per predicted class."""
    wide = cells.groupBy("label").pivot("predicted").agg(F.first("n")).fillna(0)
    wide.orderBy("label").write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
