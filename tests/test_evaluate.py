import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgauge.functions.vectors import argmax, softmax
from talkgauge.operators import classify, evaluate

Y = [0, 0, 1, 1, 2, 2]
P = [0, 1, 1, 1, 2, 0]


@pytest.fixture
def cells(spark):
    rows = spark.createDataFrame(list(zip(Y, P)), "label int, predicted int")
    return evaluate.confusion(rows)


def test_small_confusion(cells):
    grid = {(r.label, r.predicted): r.n for r in evaluate.full_confusion(cells).collect()}
    assert [[grid[(i, j)] for j in range(3)] for i in range(3)] == [[1, 1, 0], [0, 2, 0], [1, 0, 1]]
    assert evaluate.accuracy(cells).first()[0] == pytest.approx(4 / 6)
    f1 = {r["class"]: r.f1 for r in evaluate.per_class(cells).collect()}
    assert (f1[0], f1[1], f1[2]) == (pytest.approx(0.5), pytest.approx(0.8), pytest.approx(0.666667, abs=1e-6))
    mean = evaluate.averages(cells).first()
    assert mean.macro_f1 == pytest.approx(0.655556, abs=1e-6) == mean.weighted_f1


def test_undefined_metrics_are_zero_and_empty_rows_null(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 1), (1, 3)], "label int, predicted int")
    cells = evaluate.confusion(rows)
    per = {r["class"]: r for r in evaluate.per_class(cells).collect()}
    assert per[0].precision == per[0].f1 == 0.0 and per[3].recall == 0.0 and per[3].support == 0
    shares = {(r.label, r.predicted): r for r in evaluate.row_shares(cells).collect()}
    assert shares[(3, 0)].share is None and shares[(0, 1)].percent == 100 and shares[(1, 1)].percent == 50


def test_percent_is_cut_not_rounded(spark):
    rows = spark.createDataFrame([(0, 0)] * 2 + [(0, 1)], "label int, predicted int")
    shares = {(r.label, r.predicted): r.percent for r in evaluate.row_shares(evaluate.confusion(rows)).collect()}
    assert shares[(0, 0)] == 66 and shares[(0, 1)] == 33


def test_argmax_and_softmax(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0, 3.0]), (2, [1000.0, 0.0, -1000.0]), (3, [-5.0])], "id int, z array<double>")
    got = {r.id: r for r in rows.select("id", argmax(F.col("z")).alias("a"), softmax(F.col("z")).alias("p")).collect()}
    assert [got[i].a for i in (1, 2, 3)] == [1, 0, 0]
    e = np.exp(np.array([1.0, 3.0, 3.0]) - 3)
    assert got[1].p == pytest.approx(list(e / e.sum())) and got[2].p == pytest.approx([1.0, 0.0, 0.0]) and got[3].p == [1.0]


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("kind", ["ties", "spread", "crowded"])
def test_auc_against_pairs(spark, kind):
    rng = random.Random(3)
    draw = {"ties": lambda: float(rng.randint(1, 10)), "spread": rng.random,
            "crowded": lambda: 0.5 if rng.random() < 0.4 else 0.5 + rng.random() * 1e-9}[kind]
    pairs = [(draw(), rng.random() < 0.3) for _ in range(900)]
    got = evaluate.roc_auc(spark.createDataFrame(pairs, "score double, positive boolean")).first()
    assert got.auc == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_needs_both_classes(spark):
    assert evaluate.roc_auc(spark.createDataFrame([(1.0, True)], "score double, positive boolean")).first().auc is None


def test_threshold_table(spark):
    rows = spark.createDataFrame([(1, False), (3, False), (8, True), (2, True)], "score int, positive boolean")
    got = {r.threshold: r for r in evaluate.threshold_table(rows).collect()}
    assert len(got) == 10 and (got[1].tpr, got[1].fpr) == (1.0, 1.0) and (got[4].tpr, got[4].fpr) == (0.5, 0.0) and got[9].tp == 0


def test_noise_plan(spark):
    """Ninety percent noise below the threshold, ten percent signal: only the signal remains."""
    rows = spark.createDataFrame([(1 + i % 2, 1.0) for i in range(90)] + [(8 + i % 3, 1.0) for i in range(10)], "score int, weight double")
    snr = evaluate.signal_to_noise(rows, 8, 3).first()
    assert snr.before == pytest.approx(10 / 90) and snr.after is None
    means = {r.variant: r.mean_score for r in evaluate.ablation(rows, 3).collect()}
    assert means["decay+threshold"] == means["threshold"] == pytest.approx(8.9) and means["none"] < 3


def test_bootstrap_covers_the_accuracy(spark):
    rows = spark.range(400).select("id", F.lit(1).alias("label"), F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("predicted"))
    got = evaluate.bootstrap(rows, "id", 200).first()
    assert got.low < 0.75 < got.high and got.mean == pytest.approx(0.75, abs=0.01) and 0.05 < got.high - got.low < 0.12


def test_votes_agree(spark):
    rows = spark.createDataFrame([(1, [0.6, 0.4], [0.1, 0.9]), (2, [0.5, 0.5], [0.5, 0.5])], "id int, a array<double>, b array<double>")
    wide = {r.id: r.m for r in rows.select("id", evaluate.vote([F.col("a"), F.col("b")], [3, 1]).alias("m")).collect()}
    assert wide[1] == pytest.approx([0.475, 0.525])
    tall = rows.selectExpr("id", "3.0D as weight", "a as probabilities").union(rows.selectExpr("id", "1.0D", "b"))
    got = {r.id: r for r in evaluate.vote_tall(tall, "id").collect()}
    assert got[1].probabilities == pytest.approx(wide[1]) and (got[1].predicted, got[2].predicted) == (1, 0)


def test_label_errors_find_a_planted_flip(spark):
    rows = [(i, i % 2, [0.9, 0.1] if i % 2 == 0 else [0.2, 0.8]) for i in range(40)] + [(99, 0, [0.05, 0.95])]
    got = evaluate.label_errors(spark.createDataFrame(rows, "id int, label int, probabilities array<double>")).collect()
    assert [(r.id, r.suggested) for r in got] == [(99, 1)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        label = i % 3
        rows.append((i, [float(x) for x in rng.normal(label * 2.0, 0.6, 4)], label))
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, label int")


def test_training_keeps_the_best_and_predicts(blobs):
    rows = classify.vector_features(blobs)
    fitted = classify.train(rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"), steps=(2, 10, 30))
    assert fitted.score == max(h["val_macro_f1"] for h in fitted.history) > 0.9
    out = classify.predictions(fitted.model, rows)
    assert all(sum(r.probabilities) == pytest.approx(1.0) for r in out.collect())


def test_training_stops_without_improvement(blobs):
    rows = classify.vector_features(blobs)
    fitted = classify.train(rows, rows, steps=(30, 31, 32, 33, 34, 35), patience=2)
    assert len(fitted.history) < 6


def test_search_ranks_trials(blobs):
    rows, estimator = classify.vector_features(blobs), classify.classifier()
    trials = classify.sample_params(estimator, 4, seed=1)
    assert [str(t) for t in classify.sample_params(estimator, 4, seed=1)] == [str(t) for t in trials]
    best, table = classify.search(estimator, trials, rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"))
    scores = {r.trial: r.macro_f1 for r in table.collect()}
    assert len(scores) == 4 and best.score == max(scores.values())


def test_out_of_fold_covers_every_row_once(blobs):
    rows = classify.vector_features(blobs).withColumn("label", F.when(F.col("id") == 30, 2).otherwise(F.col("label")))
    judged = classify.out_of_fold(rows, 3, maxIter=20)
    assert judged.count() == 240 and judged.select("id").distinct().count() == 240
    assert 30 in {r.id for r in evaluate.label_errors(judged).collect()}


def test_predict_with_any_model(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, ""), (3, None)], "id int, text string")
    got = classify.predict_with(rows, lambda: lambda texts: [[len(t), 1] for t in texts])
    assert {r.id: r.predicted for r in got.collect()} == {1: 0, 2: 1, 3: 1}
    probs = classify.predict_with(rows, lambda: lambda texts: [[0.0, 0.0] for _ in texts], return_probs=True)
    assert "logits" not in probs.columns and all(r.probabilities == [0.5, 0.5] for r in probs.collect())


def test_robustness_reports_the_change(spark):
    texts = [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", i % 2) for i in range(60)]
    rows = spark.createDataFrame(texts, "id bigint, text string, label int")
    model = classify.classifier(maxIter=20).fit(classify.text_features(rows))
    got = {r.typo_share: r for r in classify.robustness(model, rows, classify.text_features, (0.0, 1.1)).collect()}
    assert got[0.0].accuracy == 1.0 and got[0.0].change == 0.0 and got[1.1].change < 0


def test_class_auc_has_a_row_per_class_and_their_mean(spark):
    rows = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (1, [0.4, 0.6, 0.0]), (0, [0.3, 0.7, 0.0]), (1, [0.2, 0.8, 0.0])], "label int, probabilities array<double>")
    got = {r["class"]: r for r in evaluate.class_auc(rows).collect()}
    assert got[0].auc == got[1].auc == 0.75 and got[2].auc is None and got[2].mean_auc == 0.75
    assert got[2].positives == 0 and got[2].negatives == 4


def test_poisson_steps_reach_double_precision():
    steps = evaluate.POISSON_ONE
    assert all(a < b for a, b in zip(steps, steps[1:])) and 1 - steps[-1] < 2**-50


def test_fitted_models_are_versions(spark, tmp_path):
    from talkgauge.operators import classify

    rows = classify.vector_features(spark.createDataFrame([(i % 2, [float(i % 2), 1.0]) for i in range(20)], "label int, embedding array<double>"))
    root = f"file://{tmp_path}/models"
    with pytest.raises(ValueError):
        classify.load_fitted(spark, root)
    first, second = (classify.train(rows, rows, steps=(n,), regParam=0.01) for n in (1, 5))
    assert [classify.save_fitted(spark, f, root) for f in (first, second)] == [1, 2]
    newest, oldest = classify.load_fitted(spark, root), classify.load_fitted(spark, root, 1)
    assert newest.model.coefficientMatrix == second.model.coefficientMatrix and newest.history == [{"iterations": 5.0, "val_macro_f1": second.score}]
    assert oldest.model.coefficientMatrix == first.model.coefficientMatrix and oldest.score == first.score


def test_metric_intervals_hold_the_metrics(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 3 if i % 5 else (i + 1) % 3) for i in range(300)], "id bigint, label int, predicted int")
    cells = evaluate.confusion(rows)
    want = {"accuracy": evaluate.accuracy(cells).first().accuracy, **evaluate.averages(cells).drop("support").first().asDict()}
    got = {r.metric: r for r in evaluate.metric_intervals(rows, "id", 50).collect()}
    assert got.keys() == want.keys()
    assert all(got[m].low <= want[m] <= got[m].high and abs(got[m].mean - want[m]) < 0.02 for m in want)
