"""A classifier of texts by word counts: multinomial naive Bayes as grouped aggregates.

Words fall into ``BUCKETS`` buckets by their MD5.  Training counts words per class and bucket: one aggregate with map-side
partials, of at most classes x buckets rows whatever the input.  A class's score is its log prior plus the smoothed log
share of every word; both are kept in whole millionths, so sums are exact and do not depend on the order of rows.  Counts
add up, so models of folds come from one pass: a fold's model is the counts of all others.

Texts without words score by the priors; a class without rows keeps a smoothed prior; null texts have no words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions import textclean
from talkgauge.functions.vectors import argmax, softmax
from talkgauge.operators import evaluate, prepare
from talkgauge.session import materialize

BUCKETS = 1 << 16
_DIGITS = 4
MILLION = 1_000_000
ALPHA = 1.0
# Sums that a search keeps for each row in one pass: smoothings times classes.
TRIAL_SUMS = 64
_ROWS = -1  # the bucket in which a class's rows are counted


def word_buckets(text: str = "text") -> Column:
    """Bucket of every word of a text, in order and with repeats."""
    words = F.split(textclean.collapse_blanks(F.lower(F.coalesce(F.col(text), F.lit("")))), " ")
    digits = F.transform(F.array_remove(words, ""), lambda w: F.substring(F.md5(w), 1, _DIGITS))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int"))


def counts(rows: DataFrame, label: str = "label", text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``by, label, bucket, n``: words per class and bucket, and the rows of each class."""
    each = rows.select(*by, F.col(label).alias("label"), F.explode(F.concat(F.array(F.lit(_ROWS)), word_buckets(text))).alias("bucket"))
    return each.groupBy(*by, "label", "bucket").agg(F.count(F.lit(1)).alias("n"))


def model(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, label, prior, words, counts``: one row per class, with a count for every bucket."""
    by = list(by)
    spread = F.explode(F.when(F.col("bucket") == _ROWS, F.sequence(F.lit(_ROWS), F.lit(BUCKETS - 1))).otherwise(F.array("bucket"))).alias("at")
    filled = cells.select(*by, "label", "bucket", "n", spread)
    summed = filled.groupBy(*by, "label", "at").agg(F.sum(F.when(F.col("at") == F.col("bucket"), F.col("n")).otherwise(0)).alias("n"))
    # A class has BUCKETS + 1 entries, the number of its rows first.
    lists = summed.groupBy(*by, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda s: s["n"]).alias("all"))
    lists = lists.select(*by, "label", F.col("all")[0].alias("rows"), F.slice("all", 2, BUCKETS).alias("counts"))
    totals = lists.groupBy(*by).agg(F.sum("rows").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    joined = lists.join(totals, by) if by else lists.withColumns({c: totals.select(c).scalar() for c in ("_rows", "_classes")})
    prior = millionths(F.log(F.col("rows") + 1.0) - F.log((F.col("_rows") + F.col("_classes")).cast("double")))
    words = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)
    return joined.select(*by, "label", prior.alias("prior"), words.alias("words"), "counts")


def millionths(value: Column) -> Column:
    return F.floor(value * MILLION + 0.5).cast("bigint")


def fit(rows: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """The written model of all rows."""
    return materialize(model(counts(rows, label, text)), "count-model")


def fold_models(rows: DataFrame, k: int, label: str = "label", text: str = "text", fold: str = "fold") -> DataFrame:
    """The written models that leave out one fold each, from one count of all rows."""
    cells = counts(rows.withColumnRenamed(fold, "_own"), label, text, ["_own"])
    others = cells.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"), "_own", "label", "bucket", "n")
    kept = others.groupBy("fold", "label", "bucket").agg(F.sum(F.when(F.col("fold") != F.col("_own"), F.col("n")).otherwise(0)).alias("n"))
    return materialize(model(kept, ["fold"]), "fold-models")


def _share(n: Column, words: Column, alpha: float) -> Column:
    return millionths(F.log(n + alpha) - F.log(words + alpha * BUCKETS))


def _weighted(fitted: DataFrame, alpha: float) -> Column:
    return F.struct("label", "prior", F.transform("counts", lambda n: _share(n, F.col("words"), alpha)).alias("values"))


def _totals(classes: Column, buckets: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Score of each class, in the order of labels."""
    return F.transform(classes, lambda c: c["prior"] + F.aggregate(
        buckets, F.lit(0).cast("bigint"), lambda s, b: s + value(F.get(c["values"], b), c)))


def _placed(rows: DataFrame, text: str) -> DataFrame:
    # A generator keeps the buckets from being computed again for every class.
    return rows.select("*", F.explode(F.array(word_buckets(text))).alias("_buckets"))


def _judged(scored: DataFrame) -> DataFrame:
    """``predicted`` and ``probabilities``, tempered by length: words of a text are far from independent."""
    length = F.greatest(F.size("_buckets"), F.lit(1)) * float(MILLION)
    even = F.zip_with("_totals", F.array_repeat(length, F.size("_totals")), lambda t, n: t / n)
    best = F.get("_classes", argmax(F.col("_totals")))["label"]
    return scored.select("*", best.alias("predicted"), softmax(even).alias("probabilities")).drop("_classes", "_totals", "_buckets")


def predict(rows: DataFrame, fitted: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``rows`` with ``predicted`` (the first label on ties) and ``probabilities`` in the order of labels.

    The model, classes x buckets numbers, is a scalar subquery: no text is shuffled.
    """
    packed = fitted.agg(F.array_sort(F.collect_list(_weighted(fitted, alpha)))).scalar()
    placed = _placed(rows, text).withColumn("_classes", packed)
    return _judged(placed.withColumn("_totals", _totals(F.col("_classes"), F.col("_buckets"), lambda v, c: v)))


def predict_out_of_fold(rows: DataFrame, k: int = 5, key: str = "id", label: str = "label", text: str = "text", seed: int = 42,
                        alpha: float = ALPHA) -> DataFrame:
    """Predictions of every row from a model that never saw its fold."""
    folded = prepare.folds(rows, k, key, label, seed)
    fitted = fold_models(folded, k, label, text)
    per_fold = fitted.groupBy("fold").agg(F.array_sort(F.collect_list(_weighted(fitted, alpha))).alias("classes"))
    packed = per_fold.agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "classes"))), lambda f: f["classes"])).scalar()
    placed = _placed(folded, text).withColumn("_folds", packed).withColumn("_classes", F.get("_folds", F.col("fold"))).drop("_folds")
    return _judged(placed.withColumn("_totals", _totals(F.col("_classes"), F.col("_buckets"), lambda v, c: v)))


def _trials(rows: DataFrame, fitted: DataFrame, classes: int, alphas: Sequence[float], text: str) -> DataFrame:
    """``label, chosen``: the predicted label of every row for each smoothing.

    The shares of a bucket, one for each smoothing and class, are computed once and meet the words; sums go by row.
    """
    spread = fitted.select("label", "words", F.posexplode("counts").alias("bucket", "n"))
    shares = spread.select("bucket", "label", F.array(*[_share(F.col("n"), F.col("words"), a) for a in alphas]).alias("shares"))
    table = shares.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "shares"))), lambda s: s["shares"]).alias("of"))
    table = materialize(table, "shares")
    numbered = rows.select("label", F.monotonically_increasing_id().alias("_row"), word_buckets(text).alias("_buckets"))
    words = numbered.select("label", "_row", F.explode_outer("_buckets").alias("bucket"))
    places = [(a, c) for a in range(len(alphas)) for c in range(classes)]
    sums = [F.coalesce(F.sum(F.get(F.get("of", F.lit(c)), F.lit(a))), F.lit(0)).alias(f"s{a}_{c}") for a, c in places]
    summed = words.join(F.broadcast(table), "bucket", "left").groupBy("_row", "label").agg(*sums)
    packed = fitted.agg(F.array_sort(F.collect_list(F.struct("label", "prior")))).scalar()
    ready = summed.withColumn("_classes", packed)

    def best(a: int) -> Column:
        totals = F.zip_with("_classes", F.array(*[F.col(f"s{a}_{c}") for c in range(classes)]), lambda k, s: k["prior"] + s)
        return F.get("_classes", argmax(totals))["label"]

    return ready.select("label", F.array(*[best(a) for a in range(len(alphas))]).alias("chosen"))


def search(train_rows: DataFrame, val_rows: DataFrame, alphas: Sequence[float], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Validation macro F1 of each smoothing: ``trial, alpha, macro_f1``, and the model of counts.

    All trials share the counts of one pass over the training rows, and one pass over the validation rows serves as many
    as ``TRIAL_SUMS`` allows.
    """
    fitted = fit(train_rows, text=text)
    classes = max(1, fitted.count())
    step, parts = max(1, TRIAL_SUMS // classes), []
    for at in range(0, len(alphas), step):
        told = _trials(val_rows, fitted, classes, alphas[at : at + step], text)
        parts.append(told.select("label", F.posexplode("chosen").alias("trial", "predicted")).withColumn("trial", F.col("trial") + at))
    judged = reduce(DataFrame.unionByName, parts)
    scores = evaluate.averages(materialize(evaluate.confusion(judged, by=["trial"]), "trials"), ["trial"])
    alpha = F.get(F.array(*[F.lit(float(a)) for a in alphas]), F.col("trial"))
    return scores.select("trial", alpha.alias("alpha"), "macro_f1"), fitted


def best_alpha(trials: DataFrame) -> float:
    """The smoothing of the best trial, the first one on ties."""
    return trials.orderBy(F.round("macro_f1", 9).desc(), "trial").first().alpha


def robustness(rows: DataFrame, fitted: DataFrame, shares: Sequence[float] = (0.0, 0.1, 0.3), key: str = "id", text: str = "text",
               seed: int = 42, alpha: float = ALPHA) -> DataFrame:
    """Accuracy under typos of growing share, next to its change from clean text; each row is read once."""
    variants = F.array(*[F.struct(F.lit(s).alias("typo_share"), (prepare.with_typos(F.col(text), F.col(key), s, seed) if s else F.col(text)).alias("said"))
                         for s in shares])
    noisy = rows.select("label", F.explode(variants).alias("v")).select("label", "v.typo_share", "v.said")
    judged = predict(noisy, fitted, "said", alpha)
    scores = evaluate.accuracy(materialize(evaluate.confusion(judged, by=["typo_share"]), "typos"), ["typo_share"])
    clean = scores.filter(F.col("typo_share") == 0.0).select("accuracy").scalar()
    return scores.withColumn("change", F.col("accuracy") - clean)
