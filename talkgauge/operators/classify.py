"""Training, choosing and applying a classifier with Spark ML."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from talkgauge.functions import textclean
from talkgauge.functions.vectors import argmax, softmax
from talkgauge.operators import evaluate, prepare
from talkgauge.sources.store import load_version, save_version

FEATURES = 1 << 14


def text_features(df: DataFrame, text: str = "text", size: int = FEATURES) -> DataFrame:
    """Hashed word counts as ``features``."""
    words = df.withColumn("_words", F.split(textclean.collapse_blanks(F.lower(F.col(text))), " "))
    return HashingTF(numFeatures=size, inputCol="_words", outputCol="features").transform(words).drop("_words")


def vector_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column)))


def classifier(**params) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", **params)


def predictions(model: Model, df: DataFrame) -> DataFrame:
    """Add ``probabilities`` (array) and ``predicted`` (first class on ties)."""
    scored = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    return scored.drop("rawPrediction", "probability", "prediction").withColumn("predicted", argmax(F.col("probabilities")))


def predict_with(df: DataFrame, make_model: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]],
                 text: str = "text", return_probs: bool = False) -> DataFrame:
    """Batch inference with any model: ``make_model()`` runs once per task and maps texts to logits.

    Adds ``predicted``, or ``probabilities`` with ``return_probs``.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            yield pd.Series([[float(x) for x in row] for row in model(batch.fillna("").tolist())], dtype=object)

    scored = df.withColumn("logits", infer(F.col(text)))
    if return_probs:
        return scored.withColumn("probabilities", softmax(F.col("logits"))).drop("logits")
    return scored.withColumn("predicted", argmax(F.col("logits")))


def macro_f1(scored: DataFrame) -> float:
    row = evaluate.averages(evaluate.confusion(scored)).select("macro_f1").first()
    return float(row[0]) if row is not None and row[0] is not None else 0.0


@dataclass(frozen=True)
class Fitted:
    """A chosen model and what led to it."""

    model: Model
    score: float
    history: list[dict]


def train(train_rows: DataFrame, val_rows: DataFrame, steps: Sequence[int] = (5, 10, 20, 40, 80), patience: int = 3,
          **params) -> Fitted:
    """Train in growing numbers of iterations, keep the model with the best validation macro F1.

    Stops after ``patience`` checks without improvement, or once a fit has converged: more steps would give it again.
    """
    best: Fitted | None = None
    history, waited = [], 0
    for step in steps:
        model = classifier(maxIter=step, **params).fit(train_rows)
        score = macro_f1(predictions(model, val_rows))
        history.append({"iterations": step, "val_macro_f1": score})
        if best is None or score > best.score:
            best, waited = Fitted(model, score, []), 0
        else:
            waited += 1
            if waited >= patience:
                break
        if model.hasSummary and model.summary.totalIterations < step:
            break
    return Fitted(best.model, best.score, history)


FITTED_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("history", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
])


def save_fitted(spark: SparkSession, fitted: Fitted, root: str) -> int:
    """Save a model as a new version.

    The model is written first, then the record that names it: a failed run leaves the version before in place.
    """
    name = uuid.uuid4().hex
    fitted.model.write().save(f"{root}/models/{name}")
    history = [{k: float(v) for k, v in step.items()} for step in fitted.history]
    return save_version(spark.createDataFrame([(name, fitted.score, history)], FITTED_SCHEMA), f"{root}/versions")


def load_fitted(spark: SparkSession, root: str, version: int | None = None) -> Fitted:
    """The newest saved model, or that of ``version``."""
    row = load_version(spark, f"{root}/versions", FITTED_SCHEMA, version).first()
    if row is None:
        raise ValueError(f"no saved model under {root}")
    return Fitted(LogisticRegressionModel.load(f"{root}/models/{row.model}"), row.score, row.history)


def sample_params(estimator: LogisticRegression, trials: int = 20, seed: int = 42) -> list[dict[Param, object]]:
    """Reproducible trial settings: regularisation on a log scale, mixing, iterations."""
    rng = random.Random(seed)
    low, high = math.log(1e-4), math.log(1e-1)
    return [
        {
            estimator.regParam: math.exp(rng.uniform(low, high)),
            estimator.elasticNetParam: rng.uniform(0.0, 0.5),
            estimator.maxIter: rng.choice([10, 20, 40]),
        }
        for _ in range(trials)
    ]


def search(estimator: Estimator, trials: list[dict[Param, object]], train_rows: DataFrame, val_rows: DataFrame,
           parallelism: int = 4) -> tuple[Fitted, DataFrame]:
    """Fit every trial, ``parallelism`` at a time, and rank by validation macro F1.

    Returns the best (the first one on ties) and one row per trial.
    """
    fits = estimator.fitMultiple(train_rows, trials)

    def judged(_: int) -> tuple[int, Model, float]:
        number, model = next(fits)
        return number, model, macro_f1(predictions(model, val_rows))

    with ThreadPool(parallelism) as pool:
        done = sorted(pool.map(inheritable_thread_target(train_rows.sparkSession)(judged), range(len(trials)), chunksize=1), key=lambda d: d[0])
    best: Fitted | None = None
    rows = []
    for number, model, score in done:
        rows.append((number, score, {p.name: float(v) for p, v in trials[number].items()}))
        if best is None or score > best.score:
            best = Fitted(model, score, [])
    table = train_rows.sparkSession.createDataFrame(sorted(rows), "trial int, macro_f1 double, settings map<string,double>")
    return best, table


def out_of_fold(df: DataFrame, k: int = 5, key: str = "id", label: str = "label", seed: int = 42, **params) -> DataFrame:
    """Probabilities of every row from a model that never saw it."""
    folded = prepare.folds(df, k, key, label, seed)
    parts = []
    for i in range(k):
        model = classifier(**params).fit(folded.filter(F.col("fold") != i))
        parts.append(predictions(model, folded.filter(F.col("fold") == i)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def robustness(model: Model, test_rows: DataFrame, features: Callable[[DataFrame], DataFrame], shares: Sequence[float] = (0.0, 0.1, 0.3),
               key: str = "id", text: str = "text", seed: int = 42) -> DataFrame:
    """Accuracy under typos of growing share, next to its change from clean text."""
    parts = []
    for share in shares:
        noisy = test_rows.withColumn(text, prepare.with_typos(F.col(text), F.col(key), share, seed)) if share else test_rows
        parts.append(predictions(model, features(noisy)).select(F.lit(share).alias("typo_share"), "label", "predicted"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    scores = evaluate.accuracy(evaluate.confusion(rows, by=["typo_share"]), ["typo_share"])
    clean = scores.filter(F.col("typo_share") == 0.0).select("accuracy").scalar()
    return scores.withColumn("change", F.col("accuracy") - clean)
