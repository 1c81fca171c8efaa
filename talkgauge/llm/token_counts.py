"""Token totals kept up to date by signed deltas.

A batch of inserts, revisions and deletes is compared with what is known of its documents, and gives signed rows that
are summed per source, language and tokenizer version.  Totals are the sum of all committed batches.  A batch is written
under its number: documents first, deltas last; it counts once its delta folder has ``_SUCCESS``.  Committing a number
again does nothing, and a commit that broke off is written anew.

Defined results: of several changes of a document and tokenizer in a batch the last ``seq`` counts, on ties the greatest
row; deleting an unknown document changes nothing; null source or language is a group of its own; a document without an
id is its ``content``, a digest of source, language and text, and each copy of it in a batch counts, and revising it
ends the commit with an error (delete the old text and insert the new one); changes without a
tokenizer, or with neither id nor content, are left out; groups whose totals return to zero vanish; an empty batch is a valid one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm.common import no_null, slices
from talkgauge.llm.word_encoder import encoder
from talkgauge.sources.store import path_exists

CHANGES = "seq bigint, op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
_STATE = "doc_id bigint, content string, tokenizer string, batch int, live boolean, source string, lang string, n_tokens bigint, copies bigint"
_KEY = ["doc_id", "content", "tokenizer"]
_GROUP = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``' id, source, lang with ``n_tokens`` of each whole text, and ``content`` of those without an id."""
    kept = ["doc_id", "source", "lang", "content"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            n = pa.array(encoder(tokenizer).counts(batch.column("body")), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], n], [*kept, "n_tokens"])

    number, body = F.col(key).cast("bigint"), no_null(text)
    content = F.when(number.isNull(), F.sha2(F.to_json(F.struct("source", "lang", body.alias("body"))), 256))
    rows = docs.select(number.alias("doc_id"), "source", "lang", content.alias("content"), body.alias("body"))
    return rows.mapInArrow(work, "doc_id bigint, source string, lang string, content string, n_tokens bigint")


class TokenLedger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/{number:08d}"

    def committed(self) -> list[int]:
        """Numbers of the committed batches; they are given in order, without gaps."""
        n = 0
        while path_exists(self.spark, f"{self._path('delta', n + 1)}/_SUCCESS"):
            n += 1
        return list(range(1, n + 1))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        reader = self.spark.read.schema(_STATE) if kind == "state" else self.spark.read
        return reader.parquet(*[self._path(kind, n) for n in numbers]) if numbers else None

    def commit(self, number: int, changes: DataFrame) -> bool:
        """Apply batch ``number``, the next one; False if it was committed before."""
        done = self.committed()
        if number in done:
            return False
        if number != len(done) + 1:
            raise ValueError(f"batch {number} is not the next one after {len(done)}")
        if "content" not in changes.columns:
            changes = changes.withColumn("content", F.lit(None).cast("string"))
        keyed = changes.filter("(doc_id is not null or content is not null) and tokenizer is not null")
        # A revised text has another digest, so without an id nothing says which document it was.
        lost = F.col("doc_id").isNull() & (F.col("op") == "revise")
        keyed = keyed.withColumn("op", F.when(lost, F.raise_error(F.lit("a document without an id cannot be revised: delete and insert it"))).otherwise(F.col("op")))
        # Equal changes of a document without an id are its copies; other repeats say the same again.
        copies = F.when(F.col("doc_id").isNull(), F.count(F.lit(1))).otherwise(1).cast("bigint")
        keyed = keyed.groupBy(*_KEY, "seq", "op", "source", "lang", "n_tokens").agg(copies.alias("copies"))
        row = F.struct("seq", (F.col("op") != "delete").alias("live"), "source", "lang", "n_tokens", "copies")
        last = keyed.groupBy(*_KEY).agg(F.max(row).alias("r"))
        new = last.select(*_KEY, F.lit(number).alias("batch"), "r.live", "r.source", "r.lang", F.coalesce("r.n_tokens", F.lit(0)).alias("n_tokens"), "r.copies")
        new.write.mode("overwrite").parquet(self._path("state", number))
        new = self._read("state", [number])
        copies = F.coalesce("copies", F.lit(1))
        signed = new.filter("live").select(*_GROUP, copies.alias("sign"), "n_tokens")
        before = self._read("state", done)
        if before is not None:
            known = new.select(*[F.col(c).alias(f"_{c}") for c in _KEY])
            same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("content").eqNullSafe(F.col("_content"))
            touched = before.join(known, same & (F.col("tokenizer") == F.col("_tokenizer")), "left_semi")
            latest = touched.groupBy(*_KEY).agg(F.max_by(F.struct("live", "source", "lang", "n_tokens", "copies"), "batch").alias("r"))
            old = latest.filter("r.live").select("r.source", "r.lang", "tokenizer", (-F.coalesce("r.copies", F.lit(1))).alias("sign"), "r.n_tokens")
            signed = signed.unionByName(old)
        delta = signed.groupBy(*_GROUP).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(self._path("delta", number))
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches."""
        found = self._read("delta", self.committed())
        if found is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, documents bigint, tokens bigint")
        summed = found.groupBy(*_GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 or tokens <> 0")


def change_rows(rows: DataFrame, op: str, tokenizer: str, seq: int = 0) -> DataFrame:
    content = F.col("content") if "content" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), "doc_id", "source", "lang",
                       F.lit(tokenizer).alias("tokenizer"), F.col("n_tokens").cast("bigint").alias("n_tokens"), content.alias("content"))
