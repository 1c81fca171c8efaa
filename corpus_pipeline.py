"""The corpus pipeline: filter by quality, drop near-duplicates and benchmark leaks, mix sources, write token files.

Each stage takes ``(spark, docs, folder)``, ``docs`` being what the stage before kept, and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes every result as Parquet and reads it again, so a lost
executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgauge.llm import decontaminate, mixing, quality, simhash, token_files
from talkgauge.llm.common import table
from talkgauge.session import materialize, scratch_path

TOKENIZER = "word_bpe_49k.json"


def accept_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.keep_accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    tokenizer = token_files.public_tokenizer(TOKENIZER)
    return token_files.encoded_documents(docs, scratch_path(spark, "token-files"), tokenizer)


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]

# A trained model, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
