"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers (shares of byte classes, word and line shapes, repetition), each cut into bins.  Cyclic
boosting fits shallow trees on the bins of one feature after the other, then of the strongest pairs, and adds their
leaves up in one lookup table per feature and pair.  A score is the sum of the looked-up values, so scoring is a few
vectorised additions per text, wherever it lies.

Training sees at most ``TRAIN_ROWS`` labelled texts (the least by a hash of the id); everything else reads all texts.

Defined results: null and blank texts are scored like any other (all features zero); a text without a label, or with a
null one, is scored but not learned from; of several labels of one id the lowest counts; repeated rows are scored each;
without any label of either class the score is the share of the class that is there, or one half; empty tables give an
empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import slices, span_hashes, text_bytes, word_spans
from talkgauge.session import materialize

TRAIN_ROWS = 20_000
HELD_OUT_PART = 5
ACCEPT = 0.3
FEATURES = (
    "log_words", "letters_each_word", "upper", "digits", "beyond_ascii", "pause_marks", "other_marks", "bars", "exclaims",
    "words_each_line", "distinct_words", "distinct_lines", "marked_words", "upper_words", "short_words", "top_word",
)


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_PAUSE = _table(".,;:?'\"()-")
_BAR = _table("|")
_EXCLAIM = _table("!")
_MARK = _table("#$%&*+/<=>@[\\]^_`{}~")


def _per(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How many bytes of a class each span holds."""
    sums = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum(classes[raw], out=sums[1:])
    return sums[ends] - sums[starts]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of different hashes, and how often the most frequent one occurs."""
    rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(len(before) - 1, dtype=np.int64)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(h))))
    return np.bincount(r[at], minlength=len(before) - 1), most


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    raw, offsets = text_bytes(column)
    size = np.diff(offsets)
    starts, ends, before = word_spans(raw, offsets)
    words = np.diff(before)
    lengths = ends - starts

    def share(classes: np.ndarray) -> np.ndarray:
        return _share(_per(raw, offsets[:-1], offsets[1:], classes), size)

    def of_words(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flag) + 1, dtype=np.int64)
        np.cumsum(flag, out=sums[1:])
        return _share(sums[before[1:]] - sums[before[:-1]], words)

    marks = _per(raw, starts, ends, _MARK)
    capitals = _per(raw, starts, ends, _UPPER)
    breaks = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([offsets[1:], breaks + 1]))
    line_starts = np.concatenate([[0], cuts[:-1]])[: len(cuts)]
    filled = cuts > line_starts
    line_starts, line_ends = line_starts[filled], cuts[filled]
    lines_before = np.searchsorted(line_starts, offsets)
    lines = np.diff(lines_before)
    distinct_words, top = _distinct(span_hashes(raw, starts, ends), before)
    distinct_lines, _ = _distinct(span_hashes(raw, line_starts, line_ends), lines_before)
    return np.stack([
        np.log1p(words), _share(of_words(lengths) * words, words), share(_UPPER), share(_DIGIT),
        share(np.arange(256) > 127), share(_PAUSE), share(_MARK), share(_BAR), share(_EXCLAIM),
        np.log1p(_share(words, lines)), _share(distinct_words, words), _share(distinct_lines, lines),
        of_words(marks > 0), of_words((capitals == lengths) & (lengths > 1)), of_words(lengths < 4), _share(top, words),
    ], axis=1)


@dataclass(frozen=True)
class AdditiveModel:
    """Bin borders and lookup tables; ``pairs`` holds the two features and their table."""

    base: float
    borders: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, values[:, i], side="right") for i, b in enumerate(self.borders)], axis=1)

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        total = np.full(len(values), self.base)
        for i, t in enumerate(self.tables):
            total += t[bins[:, i]]
        for i, j, t in self.pairs:
            total += t[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-total))

    def to_json(self) -> str:
        return json.dumps({
            "features": FEATURES, "base": self.base, "borders": [b.tolist() for b in self.borders],
            "tables": [t.tolist() for t in self.tables], "pairs": [[i, j, t.tolist()] for i, j, t in self.pairs],
        })

    @classmethod
    def from_json(cls, text: str) -> AdditiveModel:
        x = json.loads(text)
        if tuple(x["features"]) != FEATURES:
            raise ValueError("the model was fitted on other features")
        return cls(x["base"], tuple(np.array(b) for b in x["borders"]), tuple(np.array(t) for t in x["tables"]),
                   tuple((i, j, np.array(t)) for i, j, t in x["pairs"]))


def _leaf(g: np.ndarray, h: np.ndarray, shrink: float) -> np.ndarray:
    return g / (h + shrink)


def _steps(g: np.ndarray, h: np.ndarray, shrink: float, cuts: int = 2) -> np.ndarray:
    """Leaf value of every bin for a tree of ``cuts`` cuts over gradient and weight sums per bin."""
    parts = [(0, len(g))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + shrink) + (all_g - left_g) ** 2 / (all_h - left_h + shrink) - all_g**2 / (all_h + shrink)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], part, a + at + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), shrink)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on each of two features, over sums per bin pair."""
    corner = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sums = [corner(g), corner(h)]
    quarters = []
    for s in sums:
        low = s[1:-1, 1:-1]
        right, down, everything = s[1:-1, -1:] - low, s[-1:, 1:-1] - low, s[-1, -1]
        quarters.append((low, right, down, everything - low - right - down))
    if quarters[0][0].size == 0:
        return 0.0, np.zeros(g.shape)
    gain = sum(a**2 / (b + shrink) for a, b in zip(*quarters, strict=True)) - sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + shrink)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [_leaf(a[i, j], b[i, j], shrink) for a, b in zip(*quarters, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


def fit(values: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, most_bins: int = 32, n_pairs: int = 8,
        pair_bins: int = 8, pair_rounds: int = 60, shrink: float = 2.0) -> AdditiveModel:
    """Fit tables on training rows; deterministic."""
    labels = np.asarray(labels, dtype=float)
    share = float(labels.mean()) if len(labels) else 0.5
    width = len(FEATURES)
    if not len(labels) or not 0 < share < 1:
        base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return AdditiveModel(base, (np.zeros(0),) * width, (np.zeros(1),) * width, ())
    quantiles = np.linspace(0, 1, most_bins + 1)[1:-1]
    borders = tuple(np.unique(np.quantile(values[:, i], quantiles)) for i in range(width))
    model = AdditiveModel(float(np.log(share / (1 - share))), borders, tuple(np.zeros(len(b) + 1) for b in borders), ())
    bins = model.bins(values)
    total = np.full(len(labels), model.base)

    def sums(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(place, labels - p, n), np.bincount(place, p * (1 - p), n)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            step = rate * _steps(*sums(bins[:, i], len(table)), shrink)
            table += step
            total += step[bins[:, i]]
    # Pairs use coarser bins; their tables are spread over the fine ones at the end.
    coarse = [(np.arange(len(t)) * pair_bins // len(t)) for t in model.tables]

    def pair_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        place = coarse[i][bins[:, i]] * pair_bins + coarse[j][bins[:, j]]
        return tuple(s.reshape(pair_bins, pair_bins) for s in sums(place, pair_bins**2))

    gains = {(i, j): _quadrants(*pair_sums(i, j), shrink)[0] for i, j in combinations(range(width), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    tables = {p: np.zeros((pair_bins, pair_bins)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            step = rate * _quadrants(*pair_sums(i, j), shrink)[1]
            tables[i, j] += step
            total += step[coarse[i][bins[:, i]], coarse[j][bins[:, j]]]
    pairs = tuple((i, j, tables[i, j][np.ix_(coarse[i], coarse[j])]) for i, j in chosen)
    return AdditiveModel(model.base, borders, model.tables, pairs)


def held_out(key: str | Column) -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 5, is 0."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % HELD_OUT_PART == 0, F.lit(False))


def feature_rows(docs: DataFrame, key: str, text: str, others: Sequence[str] = ()) -> DataFrame:
    """``id``, the other columns and the features of every text as an array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            values = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column("body")).reshape(-1)), len(FEATURES))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, values.cast(pa.list_(pa.float64()))], [*names, "x"])

    rows = docs.select(F.col(key).alias("id"), *others, F.col(text).cast("string").alias("body"))
    names = ["id", *others]
    schema = rows.drop("body").schema.add("x", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(work, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``most_rows`` labelled texts that are not held out."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    usable = usable.groupBy(F.col(key).alias("label_id")).agg(F.min(label).cast("int").alias("y"))
    sample = materialize(usable.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows), "labelled")
    wanted = docs.select(F.col(key).alias("doc"), F.col(text).alias("words"))
    # The sample has at most ``most_rows`` ids and labels.
    joined = wanted.join(F.broadcast(sample), F.col("doc") == F.col("label_id"))
    rows = feature_rows(joined, "doc", "words", ["y"]).groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    found = rows.orderBy("id").toArrow()
    values = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(values, found.column("y").to_numpy())


def score(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``held_out``, ``score``, ``predicted``."""
    packed = model.to_json()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AdditiveModel.from_json(packed)
        for batch in slices(batches, "body"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(own.scores(features(batch.column("body"))))],
                ["id", "held_out", "score"],
            )

    rows = docs.select(F.col(key).alias("id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("body"))
    scored = rows.mapInArrow(work, rows.select("id", "held_out").schema.add("score", T.DoubleType()))
    return scored.select(F.col("id").alias(key), "held_out", "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def keep_accepted(docs: DataFrame, model: AdditiveModel, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns; nothing is joined or shuffled."""
    packed = model.to_json()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AdditiveModel.from_json(packed)
        for batch in slices(batches, text):
            yield batch.filter(pa.array(own.scores(features(batch.column(text))) >= accept))

    return docs.mapInArrow(work, docs.schema)
