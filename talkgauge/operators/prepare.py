"""From raw labelled texts to clean, split, tokenised rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.functions import textclean
from talkgauge.functions.hashing import hash_place, row_seed, unit, units
from talkgauge.functions.scoring import content_key
from talkgauge.operators.scale import attach, before_cut, bounded, filter_after, hash_cuts, order_rank
from talkgauge.session import materialize

SPLITS = ("train", "val", "test")
PAD, UNKNOWN, FIRST_WORD_ID = 0, 1, 2
VOCABULARY = 30_000
TOKENIZER_TEXTS = 256


# --- labels ------------------------------------------------------------------------------


def _numbered(labels: DataFrame, order: str, tie: str) -> DataFrame:
    ranked = order_rank(labels.withColumn("_all", F.lit(0)), ["_all"], order, tie, "_rn")
    return ranked.withColumn("label_id", (F.col("_rn") - 1).cast("int")).drop("_all", "_rn")


def label_map(df: DataFrame, label: str = "label") -> DataFrame:
    """Ids by sorted label."""
    return _numbered(df.select(label).filter(F.col(label).isNotNull()).distinct(), label, label)


def label_map_by_appearance(df: DataFrame, label: str, order: str) -> DataFrame:
    """Ids by first appearance in ``order``."""
    first = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_first"))
    return _numbered(first, "_first", label).drop("_first")


def encode_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    return attach(df, mapping, label, "left")


# --- cleaning and copies -----------------------------------------------------------------


def cleaned(df: DataFrame, text: str = "text", least: int = textclean.MIN_WORDS, replace_urls: bool = True,
            replace_emails: bool = True, keep_empty: bool = True) -> DataFrame:
    """Add ``text_cleaned``; ``keep_empty=False`` drops emptied rows in the same step.

    A filter on the result would be pushed below the projection and clean every
    text a second time; a generator that yields nothing for an empty text is not.
    """
    result = textclean.clean_joint(F.col(text), least, replace_urls, replace_emails)
    if keep_empty:
        return df.withColumn("text_cleaned", result)
    return df.select("*", F.explode(F.filter(F.array(result), lambda t: t != "")).alias("text_cleaned"))


def drop_empty(df: DataFrame, text: str = "text_cleaned") -> DataFrame:
    """For cleaned rows that were already written."""
    return df.filter(F.length(text) > 0)


def first_copies(df: DataFrame, key: str, text: str = "text_cleaned") -> DataFrame:
    """Keep the row with the lowest ``key`` of every text.

    Only digests and keys are grouped, with map-side partials, so a text that
    makes up a third of the table costs no more than any other; the rows
    themselves meet the surviving keys by their unique key.  ``df`` is read
    twice: write it first when its text is expensive to compute.
    """
    kept = df.groupBy(F.unhex(F.sha2(text, 256)).alias("_d")).agg(F.min(key).alias(key)).select(key)
    return df.join(kept, key, "left_semi")


def as_dataset(df: DataFrame, text: str = "text_cleaned", label: str = "label", key: str | None = None) -> DataFrame:
    named = [F.col(text).alias("text"), F.col(label).alias("label")]
    return df.select(*([F.col(key).alias("id")] if key else []), *named)


# --- splits ------------------------------------------------------------------------------


def _rounded(share: float) -> Column:
    return F.floor(F.col("n") * F.lit(share) + F.lit(0.5))


def split(df: DataFrame, key: str = "id", label: str = "label", train: float = 0.70, val: float = 0.15,
          seed: int = 42) -> DataFrame:
    """Stratified train / val / test: each class is cut at rounded shares of its hash order.

    The same key always lands in the same split for a seed.  Rows are labelled
    by comparing their hash with two cuts per class; they are not shuffled.
    """
    cuts = hash_cuts(df, label, key, seed, {"_train_end": _rounded(train), "_val_end": _rounded(train + val)})
    joined = attach(df, cuts.drop("n"), label, null_safe=True)
    place = hash_place(key, seed)
    name = F.when(before_cut(place, "_train_end"), "train").when(before_cut(place, "_val_end"), "val").otherwise("test")
    return joined.withColumn("split", name).drop("_train_end", "_val_end")


def folds(df: DataFrame, k: int = 5, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """Stratified folds 0..k-1 of equal size per class (up to one row)."""
    names = {f"_f{i}": _rounded(i / k) for i in range(1, k)}
    joined = attach(df, hash_cuts(df, label, key, seed, names).drop("n"), label, null_safe=True)
    place = hash_place(key, seed)
    passed = [F.when(before_cut(place, c), 0).otherwise(1) for c in names]
    return joined.withColumn("fold", sum(passed, F.lit(0))).drop(*names)


def fold_summary(values: DataFrame, value: str) -> DataFrame:
    """Mean and spread of a metric over folds."""
    return values.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"), F.count(F.lit(1)).alias("folds"))


def split_sizes(splits: DataFrame, label: str = "label") -> DataFrame:
    """Rows per split and class, with totals per split and overall."""
    rolled = splits.rollup("split", label).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return rolled.select(
        F.when(F.col("_g") < 3, F.col("split")).otherwise("all").alias("split"),
        F.when(F.col("_g") < 1, F.col(label).cast("string")).otherwise("all").alias(label), "n",
    )


def shared_texts(splits: DataFrame, text: str = "text") -> DataFrame:
    """Texts found in more than one split."""
    grouped = splits.groupBy(content_key(F.col(text)).alias("text_key")).agg(
        F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n")
    )
    return grouped.filter(F.col("splits") > 1)


def contained_passages(df: DataFrame, passages: DataFrame, key: str, passage_key: str, text: str = "text",
                       window: int = 8) -> DataFrame:
    """Rows whose text holds a whole held-out passage, word for word.

    Each passage is looked up by the hash of its first words among all word
    windows of the texts, so no text is compared with a passage it cannot hold;
    the hits are then checked in full.
    """
    held = passages.select(passage_key, textclean.collapse_blanks(F.col(text)).alias("_passage"))
    held = held.withColumn("_p", F.split("_passage", " ")).filter(F.length("_passage") > 0)
    width = min(window, held.agg(F.coalesce(F.min(F.size("_p")), F.lit(window))).first()[0])

    def hashed(words: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(words), i + step) for step in range(width)])

    anchors = held.select(passage_key, "_passage", hashed("_p", F.lit(0)).alias("_h"))
    worded = df.select(key, F.split(textclean.collapse_blanks(F.col(text)), " ").alias("_w"))
    starts = F.sequence(F.lit(0), F.size("_w") - width)
    windows = worded.filter(F.size("_w") >= width).select(
        key, F.explode(F.array_distinct(F.transform(starts, lambda i: hashed("_w", i)))).alias("_h")
    )
    hits = attach(windows, anchors, "_h").select(key, passage_key, "_passage").distinct()
    whole = hits.join(df.select(key, F.concat(F.lit(" "), textclean.collapse_blanks(F.col(text)), F.lit(" ")).alias("_t")), key)
    return filter_after(whole, F.contains("_t", F.concat(F.lit(" "), F.col("_passage"), F.lit(" ")))).select(key, passage_key)


# --- balance -----------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``N / (classes * n)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    weighed = counts.withColumn("_t", totals)
    return weighed.select(label, "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("class_weight"))


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    return attach(df, class_weights(df, label).drop("n"), label, null_safe=True)


def _class_size(df: DataFrame, label: str, which: Callable[[str], Column]) -> Column:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(which("n")).scalar()


def undersample(df: DataFrame, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, in hash order."""
    cuts = hash_cuts(df, label, key, seed, {"_end": _class_size(df, label, F.min)})
    joined = attach(df, cuts.drop("n"), label, null_safe=True)
    return joined.filter(before_cut(hash_place(key, seed), "_end")).drop("_end")


def oversample(df: DataFrame, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """Every class repeated up to the size of the largest; ``copy`` numbers the repeats."""
    largest = _class_size(df, label, F.max)
    cuts = hash_cuts(df, label, key, seed, {"_extra": largest % F.col("n")})
    joined = attach(df, cuts, label, null_safe=True).withColumn("_largest", largest)
    whole = F.floor(F.col("_largest") / F.col("n")).cast("int")
    extra = F.when(before_cut(hash_place(key, seed), "_extra"), 1).otherwise(0)
    times = whole + F.when(F.col("_largest") % F.col("n") == 0, 0).otherwise(extra)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_extra", "_largest", "n")


# --- tokens ------------------------------------------------------------------------------


def hashed_ids(text: Column, max_length: int, vocabulary: int = VOCABULARY) -> Column:
    """Word ids by CRC-32, cut at ``max_length`` words; ids 0 and 1 stay reserved."""
    words = F.slice(F.array_remove(F.split(textclean.collapse_blanks(F.lower(text)), " "), ""), 1, max_length)
    room = F.lit(vocabulary - FIRST_WORD_ID)
    return F.transform(words, lambda w: (F.crc32(w) % room + FIRST_WORD_ID).cast("int"))


def pad(ids: Column, max_length: int) -> tuple[Column, Column]:
    """Fixed-length ids and their attention mask."""
    used = F.least(F.size(ids), F.lit(max_length))
    fill = F.array_repeat(F.lit(PAD), max_length)
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used))
    return F.slice(F.concat(F.slice(ids, 1, max_length), fill), 1, max_length), mask


def tokenized(df: DataFrame, max_length: int = 256, text: str = "text",
              make_tokenizer: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[int]]]] | None = None) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``.

    Without a tokenizer, words are hashed in the JVM.  ``make_tokenizer()`` is
    called once per task; its product maps a list of at most ``TOKENIZER_TEXTS``
    texts to sequences of ids.
    """
    if make_tokenizer is None:
        ids = df.withColumn("_ids", hashed_ids(textclean.present(F.col(text)), max_length))
    else:

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = make_tokenizer()
            for batch in batches:
                parts = [pa.array([], pa.list_(pa.int32()))]
                # A few texts at a time, cut at once: the ids of a batch are never whole in Python.
                for at in range(0, len(batch), TOKENIZER_TEXTS):
                    texts = ["" if t is None else t for t in batch.slice(at, TOKENIZER_TEXTS).to_pylist()]
                    parts.append(pa.array([list(x[:max_length]) for x in tokenizer(texts)], pa.list_(pa.int32())))
                yield pa.concat_arrays(parts)

        ids = df.withColumn("_ids", encode(F.col(text)))
    input_ids, mask = pad(F.col("_ids"), max_length)
    return ids.withColumns({"input_ids": input_ids, "attention_mask": mask}).drop("_ids")


# --- augmentation ------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.split(textclean.collapse_blanks(text), " ")


def _chances(words: Column, key: Column, seed: int | str) -> Column:
    """One reproducible number in [0, 1) per word."""
    return units(row_seed(key, seed), F.size(words))


def delete_words(words: Column, key: Column, share: float, seed: int = 42) -> Column:
    """Drop each word with the given chance; the first stays when all would go."""
    marked = F.zip_with(words, _chances(words, key, f"{seed}-delete"), lambda w, u: F.when(u >= share, w))
    kept = F.array_compact(marked)
    return F.coalesce(F.nullif(kept, F.array().cast("array<string>")), F.slice(words, 1, 1))


def insert_words(words: Column, key: Column, share: float, seed: int = 42) -> Column:
    """After a word, with the given chance, repeat another word of the same text."""

    def grow(w: Column, u: Column) -> Column:
        # Below the share, u / share is uniform again and picks the other word.
        other = F.floor(u / share * F.size(words)).cast("int")
        return F.when(u < share, F.array(w, F.get(words, other))).otherwise(F.array(w))

    return F.flatten(F.zip_with(words, _chances(words, key, f"{seed}-insert"), grow))


def replace_words(words: Column, synonyms: Column, key: Column, share: float, seed: int = 42) -> Column:
    """Swap a listed word for its synonym with the given chance; ``synonyms`` is a map."""

    def swap(w: Column, u: Column) -> Column:
        return F.when(u < share, F.coalesce(F.try_element_at(synonyms, w), w)).otherwise(w)

    return F.zip_with(words, _chances(words, key, f"{seed}-synonym"), swap)


def augmented(splits: DataFrame, method: Callable[[Column, Column], Column], name: str, key: str = "id",
              text: str = "text") -> DataFrame:
    """Original rows plus one altered copy of every training row; val and test are left alone.

    The words are a column of their own: inside a lambda, an expression would
    be evaluated again for every word.
    """
    train = splits.filter(F.col("split") == "train").withColumn("_words", _words(F.col(text)))
    altered = train.withColumn(text, F.array_join(method(F.col("_words"), F.col(key)), " ")).drop("_words")
    return splits.withColumn("variant", F.lit("original")).unionByName(altered.withColumn("variant", F.lit(name)))


def augmented_by_synonyms(splits: DataFrame, synonyms: DataFrame, share: float, seed: int = 42, key: str = "id",
                          text: str = "text", max_rows: int = 1_000) -> DataFrame:
    """Synonym replacement from a ``(word, synonym)`` table with one row per word.

    A short table becomes a map inside the row; a long one is joined with the words whose chance has come.  Rows are told
    apart by number, so keys may repeat.
    """
    table, is_small = bounded(synonyms.select("word", "synonym"), max_rows)
    if is_small:
        mapping = table.agg(F.map_from_entries(F.collect_list(F.struct("word", "synonym")))).scalar()
        with_map = splits.withColumn("_synonyms", mapping)
        both = augmented(with_map, lambda w, k: replace_words(w, F.col("_synonyms"), k, share, seed), "synonym", key, text)
        return both.drop("_synonyms")
    kept = [c for c in splits.columns if c != text]
    train = splits.filter(F.col("split") == "train").select(*kept, F.monotonically_increasing_id().alias("_row"), _words(F.col(text)).alias("_words"))
    train = materialize(train, "train-words")
    # Only words that are swapped leave their row, and come back by the number of the row.
    seeded = train.select("_row", "_words", F.explode(F.array(row_seed(key, f"{seed}-synonym"))).alias("_seed"))
    words = seeded.select("_row", "_seed", F.posexplode("_words").alias("_i", "word")).filter(unit(F.col("_seed"), F.col("_i")) < share)
    swaps = attach(words, synonyms.select("word", "synonym").filter(F.col("synonym").isNotNull()), "word")
    lists = swaps.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_i", "synonym"))).alias("_swaps"))

    def piece(swap: Column, j: Column) -> Column:
        """The words between the swap before and this one, and the synonym."""
        start = F.when(j == 0, 0).otherwise(F.get("_swaps", j - 1)["_i"] + 1)
        return F.concat(F.slice("_words", start + 1, swap["_i"] - start), F.array(swap["synonym"]))

    rest = F.slice("_words", F.element_at("_swaps", -1)["_i"] + 2, F.greatest(F.size("_words"), F.lit(1)))
    swapped = F.when(F.col("_swaps").isNull(), F.col("_words")).otherwise(F.concat(F.flatten(F.transform("_swaps", piece)), rest))
    altered = train.join(lists, "_row", "left").withColumn(text, F.array_join(swapped, " ")).select(splits.columns)
    return splits.withColumn("variant", F.lit("original")).unionByName(altered.withColumn("variant", F.lit("synonym")))


def with_typos(text: Column, key: Column, share: float, seed: int = 42) -> Column:
    """Swap the 2nd and 3rd character of a word with the given chance (words of four and more)."""
    words = F.split(text, " ")

    def scramble(w: Column, u: Column) -> Column:
        swapped = F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substr(w, F.lit(4)))
        return F.when((F.length(w) >= 4) & (u < share), swapped).otherwise(w)

    return F.array_join(F.zip_with(words, _chances(words, key, f"{seed}-typo"), scramble), " ")
