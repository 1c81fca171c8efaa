"""The count model against plain Python, on texts with nulls, empty ones, ties and repeats."""

import hashlib
import math
import random
from collections import Counter

import pytest

from talkgauge.operators import countmodel, evaluate, prepare

ROWS = "id bigint, text string, label int, fold int"


def made(n=120):
    rng = random.Random(4)
    own = [["alpha", "beta", "Gamma"], ["delta", "epsilon", "beta"], ["zeta", "éta"]]
    rows = [(i, " ".join(rng.choices(own[i % 3] + ["the", "of"], k=rng.randrange(1, 9))), i % 3, i % 4) for i in range(n)]
    return rows + [(n, None, 0, 0), (n + 1, "", 1, 1), (n + 2, " \t ", 2, 2), (n + 3, "unseen words only", 0, 3), (n + 4, "the " * 30_000, 1, 0)]


def buckets(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in (text or "").lower().split()]


def whole(x):
    return math.floor(x * 1_000_000 + 0.5)


def plain_totals(train, texts, alpha):
    labels = sorted({r[2] for r in train})
    rows = Counter(r[2] for r in train)
    words = {c: Counter(b for r in train if r[2] == c for b in buckets(r[1])) for c in labels}
    prior = {c: whole(math.log(rows[c] + 1.0) - math.log(len(train) + len(labels))) for c in labels}

    def share(c, b):
        return whole(math.log(words[c][b] + alpha) - math.log(sum(words[c].values()) + alpha * 65536))

    return [[prior[c] + sum(n * share(c, b) for b, n in Counter(buckets(t)).items()) for c in labels] for t in texts]


def first_best(totals):
    return totals.index(max(totals))


@pytest.mark.parametrize("alpha", [0.01, 1.0])
def test_predictions(spark, alpha):
    rows = made()
    df = spark.createDataFrame(rows, ROWS)
    got = {r.id: r for r in countmodel.predict(df, countmodel.fit(df), alpha=alpha).collect()}
    for row, totals in zip(rows, plain_totals(rows, [r[1] for r in rows], alpha), strict=True):
        assert got[row[0]].predicted == first_best(totals)
        even = [t / 1_000_000 / max(1, len(buckets(row[1]))) for t in totals]
        want = [math.exp(x - max(even)) for x in even]
        assert got[row[0]].probabilities == pytest.approx([w / sum(want) for w in want])


def test_models_of_folds_leave_their_rows_out(spark):
    rows = made()
    folded = prepare.folds(spark.createDataFrame(rows, ROWS).drop("fold"), 3)
    fold = {r.id: r.fold for r in folded.collect()}
    judged = {r.id: r.predicted for r in countmodel.predict_out_of_fold(spark.createDataFrame(rows, ROWS).drop("fold"), 3).collect()}
    for f in range(3):
        inside = [r for r in rows if fold[r[0]] == f]
        totals = plain_totals([r for r in rows if fold[r[0]] != f], [r[1] for r in inside], 1.0)
        assert [judged[r[0]] for r in inside] == [first_best(t) for t in totals]


def test_a_class_of_one_fold_keeps_its_place(spark):
    rows = [*made(60), (900, "odd one", 7, 0)]
    judged = countmodel.predict_out_of_fold(spark.createDataFrame(rows, ROWS).drop("fold"), 2).collect()
    assert len(judged) == len(rows) and {len(r.probabilities) for r in judged} == {4}
    assert next(r for r in judged if r.id == 900).predicted != 7


def test_search_scores_every_trial_as_a_fit_of_its_own(spark):
    df = spark.createDataFrame(made(), ROWS)
    train, val = df.filter("id % 3 <> 1 or id % 2 = 0"), df.filter("id % 3 = 1 and id % 2 = 1 or id > 100")
    alphas = (0.001, 0.5, 30.0)
    trials, fitted = countmodel.search(train, val, alphas)
    for row in trials.collect():
        cells = evaluate.confusion(countmodel.predict(val, fitted, alpha=alphas[row.trial]))
        assert row.alpha == alphas[row.trial] and row.macro_f1 == pytest.approx(evaluate.averages(cells).first().macro_f1)
    assert countmodel.best_alpha(trials) in alphas


def test_search_in_several_passes(spark, monkeypatch):
    """More smoothings than one pass holds, texts without words, rows without a label, and no row at all to learn from."""
    df = spark.createDataFrame([*made(), (900, "", 0, 0), (901, None, 1, 0), (902, "new words only", None, 0)], ROWS)
    alphas = (0.001, 0.1, 0.5, 2.0, 30.0)
    whole = sorted(countmodel.search(df.filter("id < 900"), df, alphas)[0].collect())
    monkeypatch.setattr(countmodel, "TRIAL_SUMS", 4)
    assert sorted(countmodel.search(df.filter("id < 900"), df, alphas)[0].collect()) == whole and len(whole) == 5
    assert countmodel.search(df.limit(0), df, alphas)[0].count() == 5


def test_typos_lower_accuracy(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", i % 2) for i in range(60)], "id bigint, text string, label int")
    got = {r.typo_share: r for r in countmodel.robustness(df, countmodel.fit(df), (0.0, 1.1)).collect()}
    assert got[0.0].accuracy == 1.0 and got[0.0].change == 0.0 and got[1.1].change < 0


def test_training_moves_counts_and_no_text(spark):
    plan = countmodel.counts(spark.createDataFrame(made(9), ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan and "text#" not in plan[: plan.index("Exchange")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert countmodel.fit(none).count() == 0
    fitted = countmodel.fit(spark.createDataFrame(made(9), ROWS))
    assert countmodel.predict(none, fitted).count() == 0
