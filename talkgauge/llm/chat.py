"""Chat formatting on the level of tokens.

Every turn becomes ``start role separator text end``: the three marks are reserved ids beyond the vocabulary, role and text
are encoded apart, so no text can form a mark.  Marks written in a text are escaped as well (``<`` and ``|`` get one more
backslash between them).  The loss mask is the prefix sum of +1 and -1 at the borders of assistant texts.  Turns are
formatted where they lie; only the digest of a conversation, which is sequential, streams its turns in order.

Defined results: null role or text is empty; turns of equal number are ordered by role, then text; a null turn comes
first; rows without a conversation id are one conversation; an empty table gives no turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from talkgauge.llm.common import no_null, slices  # noqa: E402
from talkgauge.session import materialize  # noqa: E402

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LEARNED_ROLE = "assistant"
_TOKENIZERS: dict[str, Tokenizer] = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def format_turns(rows: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``conv_id, turn, ids, mask`` of every turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer)
        start, sep, end = range(own.get_vocab_size(), own.get_vocab_size() + 3)
        for batch in slices(batches, "body"):
            roles = batch.column("who").to_pylist()
            coded = own.encode_batch_fast([escape(r) for r in roles], add_special_tokens=False)
            bodies = own.encode_batch_fast([escape(t) for t in batch.column("body").to_pylist()], add_special_tokens=False)
            ids, masks = [], []
            for who, head, body in zip(roles, coded, bodies, strict=True):
                ids.append([start, *head.ids, sep, *body.ids, end])
                borders = np.zeros(len(ids[-1]) + 1, dtype=np.int8)
                if who == LEARNED_ROLE:
                    borders[len(head.ids) + 2] += 1
                    borders[len(ids[-1]) - 1] -= 1
                masks.append(np.cumsum(borders[:-1], dtype=np.int8).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("at"), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                ["conv_id", "turn", "ids", "mask"],
            )

    named = rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("at"),
                        no_null(role).alias("who"), no_null(text).alias("body"))
    return named.mapInArrow(work, "conv_id bigint, turn bigint, ids array<int>, mask array<boolean>")


def read_turns(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, role, text, learned, chars``: turns read back from ids and masks alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer)
        sep = own.get_vocab_size() + 1

        def decoded(lists: list) -> list[str]:
            return own.decode_batch(lists, skip_special_tokens=False)

        for batch in batches:
            ids, masks = batch.column("ids").to_pylist(), batch.column("mask").to_pylist()
            cuts = [x.index(sep) for x in ids]
            heads = decoded([x[1:c] for x, c in zip(ids, cuts, strict=True)])
            bodies = decoded([x[c + 1 : -1] for x, c in zip(ids, cuts, strict=True)])
            learned = decoded([[i for i, m in zip(x, y, strict=True) if m] for x, y in zip(ids, masks, strict=True)])
            fixed = sum(map(len, MARKS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(map(unescape, heads), pa.string()),
                 pa.array(map(unescape, bodies), pa.string()), pa.array(map(unescape, learned), pa.string()),
                 pa.array([fixed + len(a) + len(b) for a, b in zip(heads, bodies, strict=True)], pa.int64())],
                ["conv_id", "turn", "role", "text", "learned", "chars"],
            )

    return formatted.mapInArrow(work, "conv_id bigint, turn bigint, role string, text string, learned string, chars bigint")


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation; its turns stream through the digests, a bounded batch at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def out(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    close()
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{row['role']}\n{row['text']}\n".encode())
                state[2] += len(row["learned"])
                state[3].update(row["learned"].encode())
                state[4] += row["chars"]
            yield out(done)
            done.clear()
        close()
        yield out(done)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def formatted_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Format, write, read back and digest all conversations."""
    return digests(read_turns(materialize(format_turns(rows, tokenizer), "chat"), tokenizer))
