"""Token ids of whole texts, with every distinct piece of them encoded once.

For tokenizers that drop white space and cut words apart before anything else: there the ids of a text are the ids of
its blank-separated words in turn.  Such a tokenizer lower-cases ASCII words, and to it a trailing run of ASCII
punctuation behind an ASCII letter or digit is apart from the rest, so words are cut there and lower-cased first: far
fewer pieces are left.  Arrow tells the pieces of a batch apart, only new ones go through the tokenizer, and the ids are
put together by array operations.  What is remembered is bounded: beyond ``limit`` pieces it starts anew.
"""

from __future__ import annotations

import os
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from talkgauge.llm.common import BLANK, LOWER, text_bytes, word_spans  # noqa: E402

KNOWN_PIECES = 600_000
_FEW = 2048
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_PROBE = ("a", "the", "tokenizers", "abcxyzqj")


class WordEncoder:
    def __init__(self, path: str, limit: int = KNOWN_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        # Their strings in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.limit = limit
        # Lower-case ASCII letters reach the model as they are, so its own call, which is cheaper, gives their ids.
        self.plain = all(self._by_model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBE)
        self._forget()

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _by_model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool = array("I")
        self.starts = array("q", [0])

    def _remember(self, piece: bytes, ids: list[int]) -> None:
        self.slots[piece] = len(self.starts) - 1
        self.pool.extend(ids)
        self.starts.append(len(self.pool))

    def _learn(self, pieces: list[bytes]) -> None:
        tokenize, other = self.tokenizer.model.tokenize, []
        for piece in pieces:
            if self.plain and piece.isalpha() and piece.islower():
                self._remember(piece, [t.id for t in tokenize(piece.decode())])
            else:
                other.append(piece)
        for at in range(0, len(other), _FEW):
            few = other[at : at + _FEW]
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in few], add_special_tokens=False)
            for piece, one in zip(few, coded, strict=True):
                self._remember(piece, one.ids)

    @staticmethod
    def _pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All pieces in order, and the number of pieces before each row."""
        starts, ends, before = word_spans(raw, offsets)
        other = np.where(_PUNCTUATION[raw], -1, np.arange(len(raw)))
        tails = np.maximum.accumulate(other)[ends - 1] + 1 if len(ends) else ends
        # A word of punctuation alone, and one with a tail behind a letter beyond ASCII, stay whole.
        whole = (tails <= starts) | (raw[np.maximum(tails, 1) - 1] > 127) if len(ends) else np.zeros(0, bool)
        tails = np.where(whole, ends, tails)
        lengths = np.stack([tails - starts, ends - tails], axis=1)
        wide = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(raw > 127, out=wide[1:])
        letters = raw[~BLANK[raw]]
        ascii_only = np.repeat(wide[ends] == wide[starts], ends - starts)
        letters = np.where(ascii_only, LOWER[letters], letters)
        used = np.ones(lengths.shape, dtype=bool)
        used[:, 1] = lengths[:, 1] > 0
        count = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(used.sum(axis=1), out=count[1:])
        lengths = lengths[used]
        places = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=places[1:])
        buffers = [None, pa.py_buffer(places), pa.py_buffer(letters)]
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers), count[before]

    def _coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool slot of every piece, pieces before each row, and the pool place of each slot."""
        pieces, before = self._pieces(*text_bytes(column))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.slots]
        if len(self.slots) + len(new) > self.limit:
            self._forget()
            new = distinct
        self._learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return slots[coded.indices.to_numpy(zero_copy_only=False)], before, np.array(self.starts)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        slots, before, starts = self._coded(column)
        total = np.zeros(len(slots) + 1, dtype=np.int64)
        np.cumsum(np.diff(starts)[slots], out=total[1:])
        return np.diff(total[before])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and the ``n + 1`` offsets of its rows; null counts as empty."""
        slots, before, starts = self._coded(column)
        lengths = np.diff(starts)[slots]
        total = np.zeros(len(slots) + 1, dtype=np.int64)
        np.cumsum(lengths, out=total[1:])
        pool = np.array(self.pool, dtype=np.uint32)
        places = np.repeat(starts[slots] - total[:-1], lengths) + np.arange(total[-1])
        return pool[places], total[before]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps what it knows from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
