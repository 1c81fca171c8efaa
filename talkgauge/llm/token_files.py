"""Token-id files with fixed-width bit packing.

Documents are dealt to tasks by ranges of ids, sorted, encoded and written, one task to its own files.  Every id takes
as many bits as the largest id of the vocabulary needs; 64 ids fill as many 64-bit words, so packing and unpacking are
a few array operations.  A file holds

    header   ``IDPK``, version, bits, ids per block (unsigned 32-bit each)
    payload  blocks of packed ids
    index    document ids, whether each is there, first id of each document (n + 1), offset of each block (n + 1)
    end      documents, ids, position of the index (unsigned 64-bit each), ``IDPK``

all little-endian.  The block offsets give any document by reading its blocks alone.  Files carry unique names, and the
manifest, written once, names those of the tasks that succeeded: a task that ran twice leaves a file nobody reads.

Defined results: a null text is an empty document, which holds the end id alone; documents without an id come first;
rows that repeat an id are documents of their own, in the order of a hash of their text; an empty table gives no file
and an empty manifest.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.llm.common import no_null, slices
from talkgauge.llm.word_encoder import encoder
from talkgauge.session import materialize

MAGIC = b"IDPK"
VERSION = 1
LANES = 64
BLOCK_IDS = 8192
FILE_IDS = 1 << 26
END_ID = 1
READ_IDS = 1 << 20
MANIFEST = "part int, seq int, file string, n_docs bigint, n_ids bigint"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids in ``bits`` bits each, filled up to a multiple of 64 ids, as 64-bit words."""
    lanes = np.zeros(-(-len(ids) // LANES) * LANES, dtype=np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, LANES)
    words = np.zeros((len(lanes), bits), dtype="<u8")
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """The ids of whole groups of ``bits`` words."""
    words = words.reshape(-1, bits)
    lanes = np.empty((len(words), LANES), dtype=np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * bits, 64)
        lanes[:, lane] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lanes[:, lane] |= words[:, word + 1] << np.uint64(64 - shift)
    return (lanes & np.uint64((1 << bits) - 1)).astype(np.uint32).reshape(-1)


class TokenWriter:
    """One file; whole blocks are written as they fill."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK_IDS):
        system, path = fs.FileSystem.from_uri(uri)
        self.out = system.open_output_stream(path)
        self.uri, self.bits, self.block = uri, bits, block
        self.out.write(MAGIC + struct.pack("<III", VERSION, bits, block))
        self.at, self.rest, self.n_ids = 16, np.zeros(0, np.uint32), 0
        self.keys: list[np.ndarray] = []
        self.there: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.blocks: list[int] = []

    def _write(self, ids: np.ndarray) -> None:
        step = self.block * self.bits // 8
        packed = pack(ids, self.bits)
        self.blocks += range(self.at, self.at + packed.nbytes, step)
        self.out.write(packed)
        self.at += packed.nbytes

    def add(self, keys: np.ndarray, there: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.keys.append(keys)
        self.there.append(there)
        self.firsts.append(offsets[:-1] + self.n_ids)
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(self.rest) // self.block * self.block
        if whole:
            self._write(self.rest[:whole])
            self.rest = self.rest[whole:]

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._write(self.rest)
        keys = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        there = np.concatenate([*self.there, np.zeros(0, bool)])
        firsts = np.concatenate([*self.firsts, [self.n_ids]])
        for part, kind in ((keys, "<i8"), (there, "u1"), (firsts, "<u8"), ([*self.blocks, self.at], "<u8")):
            self.out.write(np.asarray(part).astype(kind).tobytes())
        self.out.write(struct.pack("<QQQ", len(keys), self.n_ids, self.at) + MAGIC)
        self.out.close()
        return len(keys), self.n_ids


class TokenFile:
    """Random access to one file: only the index and the blocks asked for are read."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(16, 0), self.file.read_at(28, size - 28)
        version, self.bits, self.block = struct.unpack("<III", head[4:])
        if head[:4] != MAGIC or tail[24:] != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is not a token file of version {VERSION}")
        n, self.n_ids, at = struct.unpack("<QQQ", tail[:24])
        index = self.file.read_at(size - 28 - at, at)
        self.keys = np.frombuffer(index, "<i8", n)
        self.there = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.firsts = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.blocks = np.frombuffer(index, "<u8", offset=9 * n + 8 * (n + 1))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        at, upto = int(self.blocks[first]), int(self.blocks[last + 1])
        words = np.frombuffer(self.file.read_at(upto - at, at), "<u8")
        skipped = first * self.block
        return unpack(words, self.bits)[start - skipped : end - skipped]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))

    def runs(self, most: int = READ_IDS) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents ``i`` to ``j`` with their ids: at most ``most`` ids, or one document."""
        i = 0
        while i < len(self.keys):
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + most, side="right")) - 1)
            j = min(j, len(self.keys))
            yield i, j, self.ids(int(self.firsts[i]), int(self.firsts[j]))
            i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                      end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write all documents in ascending order of ``key``; the manifest names the files in that order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        words = encoder(tokenizer)
        bits = max(width(words.vocabulary), end_id.bit_length())
        done: list[tuple] = []
        writer = None

        def close() -> None:
            done.append((task.partitionId(), len(done), writer.uri, *writer.close()))

        for batch in slices(batches, "body"):
            ids, offsets = words.encode(batch.column("body"))
            lengths = np.diff(offsets) + 1
            ends = np.cumsum(lengths)
            whole = np.full(int(ends[-1]), end_id, dtype=np.uint32)
            inside = np.ones(len(whole), dtype=bool)
            inside[ends - 1] = False
            whole[inside] = ids
            keys = batch.column("id")
            if writer is None:
                name = f"part-{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                writer = TokenWriter(f"{folder.rstrip('/')}/{name}", bits)
            there = keys.is_valid().to_numpy(zero_copy_only=False)
            writer.add(keys.fill_null(0).to_numpy(), there, whole, np.concatenate([[0], ends]))
            if writer.n_ids >= file_ids:
                close()
                writer = None
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seq", "file", "n_docs", "n_ids"]
        )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), no_null(text).alias("body"))
    rows = rows.withColumn("tie", F.xxhash64("body"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "body")
    return materialize(ordered.select("id", "body").mapInArrow(work, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, ``start``, ``n_tokens`` and ``ids_crc32``."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["file"])
                for i, j, ids in file.runs():
                    firsts = file.firsts[i : j + 1]
                    view, cuts = memoryview(ids.astype("<u4")).cast("B"), (firsts - firsts[0]) * 4
                    crcs = [zlib.crc32(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.keys[i:j], mask=~file.there[i:j]), pa.array(firsts[:-1] + row["before"]),
                         pa.array(np.diff(firsts)), pa.array(crcs, pa.int64())],
                        [key, "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return files.repartition(n).mapInArrow(work, schema)


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def encoded_documents(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Write token files and describe each document as it is read back from them."""
    return read_token_files(write_token_files(docs, folder, tokenizer, key, text), key)
