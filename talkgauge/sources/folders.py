"""Folders of a store, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = folder(spark, path)
    return fs.exists(hadoop)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    fs, hadoop = folder(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if it is not there."""
    fs, hadoop = folder(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.isFile())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    fs, hadoop = folder(spark, path)
    _, unfinished = folder(spark, f"{path}.tmp")
    stream = fs.create(unfinished, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if not fs.rename(unfinished, hadoop):
        raise RuntimeError(f"could not finish {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop = folder(spark, path)
    stream = fs.open(hadoop)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text
