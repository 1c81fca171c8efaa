"""Evaluation queries: logits and predictions of the embedding classes, word scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.config import DatasetSettings
from talkgauge.functions import scoring
from talkgauge.functions.textclean import collapse_blanks
from talkgauge.functions.vectors import argmax, mean_logits, softmax
from talkgauge.operators import classify, countmodel, evaluate, prepare
from talkgauge.plans import dataset_jobs
from talkgauge.plans.chat_queries import CENTROID_SQL, SCORE_SQL, SCORED_SQL, bundle_rows
from talkgauge.plans.data_queries import CHANCE_SQL, CLEAN_SQL, KEPT_SQL, LABELLED_SQL, r6, seed_sql, split_sql, unit_sql
from talkgauge.plans.registry import register
from talkgauge.plans.tables import labelled, table, texts
from talkgauge.plans.text_queries import blanks_sql
from talkgauge.session import materialize, scratch_path
from talkgauge.sources import datasets

LOGITS_SQL = f"""{CENTROID_SQL}, means AS (SELECT list(c ORDER BY label) AS m FROM clist),
lg AS MATERIALIZED (SELECT vec_id, label, list_transform((SELECT m FROM means), lambda c: list_dot_product(c, embedding::DOUBLE[])) AS z FROM embeddings),
pr AS (SELECT vec_id, label, z, (list_position(z, list_max(z))-1)::INTEGER AS predicted,
       list_transform(z, lambda x: exp(x-list_max(z))/list_sum(list_transform(z, lambda y: exp(y-list_max(z))))) AS p FROM lg),
cm AS (SELECT label, predicted, count(*) AS n FROM pr GROUP BY 1,2)"""
CLASS_SQL = """cl AS (SELECT label AS c FROM cm UNION SELECT predicted FROM cm),
pc AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE label=c AND predicted=c),0) AS tp, coalesce((SELECT sum(n) FROM cm WHERE label=c),0) AS support,
       coalesce((SELECT sum(n) FROM cm WHERE predicted=c),0) AS called FROM cl),
rt AS (SELECT c, support, CASE WHEN called>0 THEN tp/called ELSE 0 END AS precision, CASE WHEN support>0 THEN tp/support ELSE 0 END AS recall,
       CASE WHEN called+support>0 THEN 2.0*tp/(called+support) ELSE 0 END AS f1 FROM pc)"""


def _logits(spark: SparkSession, folder: str) -> DataFrame:
    return mean_logits(table(spark, folder, "embeddings"), "embedding", "label")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _logits(spark, folder).withColumn("predicted", argmax(F.col("logits")))
    return rows.withColumn("probabilities", softmax(F.col("logits")))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(_logits(spark, folder).withColumn("predicted", argmax(F.col("logits"))))


@register(f"WITH {LOGITS_SQL} SELECT vec_id, predicted, round(list_max(z),6) AS top FROM pr")
def predicted_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder).select("vec_id", "predicted", F.round(F.array_max("logits"), 6).alias("top"))


@register(f"WITH {LOGITS_SQL}, e AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p,1)-1 AS class FROM pr) SELECT vec_id, class::INTEGER AS class, round(p,6) AS p FROM e")
def class_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder).select("vec_id", F.posexplode("probabilities").alias("class", "p")).withColumn("p", F.round("p", 6))


@register(f"WITH {LOGITS_SQL} SELECT round(sum(CASE WHEN label=predicted THEN n ELSE 0 END)/sum(n),6) AS accuracy FROM cm")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.accuracy(_cells(spark, folder)), "accuracy")


@register(f"WITH {LOGITS_SQL}, {CLASS_SQL} SELECT c AS class, support::BIGINT AS support, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM rt")
def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.per_class(_cells(spark, folder)), "precision", "recall", "f1")


@register(
    f"""WITH {LOGITS_SQL}, {CLASS_SQL} SELECT round(avg(precision),6) AS macro_precision, round(avg(recall),6) AS macro_recall, round(avg(f1),6) AS macro_f1,
    round(sum(precision*support)/sum(support),6) AS weighted_precision, round(sum(recall*support)/sum(support),6) AS weighted_recall,
    round(sum(f1*support)/sum(support),6) AS weighted_f1, sum(support)::BIGINT AS support FROM rt"""
)
def average_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.averages(_cells(spark, folder))
    return r6(rows, *[c for c in rows.columns if c != "support"])


GRID_SQL = """cl AS (SELECT label AS c FROM cm UNION SELECT predicted FROM cm),
gr AS (SELECT a.c AS label, b.c AS predicted, coalesce(cm.n,0) AS n FROM cl a CROSS JOIN cl b LEFT JOIN cm ON cm.label=a.c AND cm.predicted=b.c)"""


@register(f"WITH {LOGITS_SQL}, {GRID_SQL} SELECT * FROM gr")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.full_confusion(_cells(spark, folder))


@register(
    f"""WITH {LOGITS_SQL}, {GRID_SQL}, t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS s FROM gr)
    SELECT label, predicted, n, round(CASE WHEN s>0 THEN n/s END,6) AS share, CASE WHEN s>0 THEN floor(n/s*100)::INTEGER END AS percent FROM t"""
)
def confusion_shares(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.row_shares(_cells(spark, folder)), "share")


_WIDE_SQL = ", ".join(f'sum(CASE WHEN predicted={i} THEN n ELSE 0 END)::BIGINT AS "p{i}"' for i in range(10))


@register(f"WITH {LOGITS_SQL} SELECT label, {_WIDE_SQL} FROM cm GROUP BY label")
def confusion_file(spark: SparkSession, folder: str) -> DataFrame:
    """The wide CSV written and read back."""
    path = scratch_path(spark, "confusion")
    datasets.write_confusion(evaluate.full_confusion(_cells(spark, folder)), path)
    wide = datasets.read_csv(spark, path, multi_line=False)
    return wide.select(F.col("label").cast("int"), *[F.col(c).cast("bigint").alias(f"p{c}") for c in wide.columns if c != "label"])


@register(
    f"""WITH {LOGITS_SQL}, {CLASS_SQL} SELECT 'class ' || c AS entry, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, support::BIGINT AS support FROM rt
    UNION ALL SELECT 'macro avg', round(avg(precision),6), round(avg(recall),6), round(avg(f1),6), sum(support)::BIGINT FROM rt
    UNION ALL SELECT 'weighted avg', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6), round(sum(f1*support)/sum(support),6), sum(support)::BIGINT FROM rt
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp)/sum(support),6), sum(support)::BIGINT FROM pc"""
)
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.report(_cells(spark, folder)), "precision", "recall", "f1")


@register(
    f"""WITH {LOGITS_SQL}, {CLASS_SQL}, rp AS (SELECT 'class ' || c AS class, precision, recall, f1, support FROM rt
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rt
      UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM rt
      UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp)/sum(support), sum(support) FROM pc),
    u AS (SELECT class, 'precision' AS metric, precision AS value FROM rp UNION ALL SELECT class, 'recall', recall FROM rp
      UNION ALL SELECT class, 'f1', f1 FROM rp UNION ALL SELECT class, 'support', support FROM rp)
    SELECT 'class means' AS run, 'test' AS phase, metric, class, round(value,6) AS value FROM u WHERE value IS NOT NULL"""
)
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows of a run, stored as JSON and read back."""
    path = scratch_path(spark, "history")
    rows = evaluate.metric_rows(_cells(spark, folder), "class means", "test")
    datasets.write_json(rows, path)
    return r6(datasets.read_json_lines(spark, path, rows.schema), "value")


SLICE_SQL = f"""{LOGITS_SQL}, bm AS (SELECT vec_id%4 AS slice, label, predicted, count(*) AS n FROM pr GROUP BY 1,2,3),
bc AS (SELECT slice, label AS c FROM bm UNION SELECT slice, predicted FROM bm),
bp AS (SELECT slice, c, coalesce((SELECT sum(n) FROM bm x WHERE x.slice=bc.slice AND x.label=c AND x.predicted=c),0) AS tp,
  coalesce((SELECT sum(n) FROM bm x WHERE x.slice=bc.slice AND x.label=c),0) AS support, coalesce((SELECT sum(n) FROM bm x WHERE x.slice=bc.slice AND x.predicted=c),0) AS called FROM bc),
br AS (SELECT slice, support, CASE WHEN called+support>0 THEN 2.0*tp/(called+support) ELSE 0 END AS f1, tp FROM bp)"""


@register(f"WITH {SLICE_SQL} SELECT slice, round(sum(tp)/sum(support),6) AS accuracy, round(avg(f1),6) AS macro_f1, round(sum(f1*support)/sum(support),6) AS weighted_f1 FROM br GROUP BY slice")
def sliced_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The same metrics per slice of the rows."""
    rows = _logits(spark, folder).withColumn("predicted", argmax(F.col("logits"))).withColumn("slice", F.col("vec_id") % 4)
    cells = evaluate.confusion(rows, by=["slice"])
    both = evaluate.accuracy(cells, ["slice"]).join(evaluate.averages(cells, ["slice"]).select("slice", "macro_f1", "weighted_f1"), "slice")
    return r6(both, "accuracy", "macro_f1", "weighted_f1")


TWO_SQL = f"""{LOGITS_SQL}, p2 AS (SELECT vec_id, p, list_transform(p, lambda x: x*x/list_sum(list_transform(p, lambda y: y*y))) AS q FROM pr)"""


def _two_models(spark: SparkSession, folder: str) -> DataFrame:
    """Class probabilities and a sharper second opinion."""
    rows = _predictions(spark, folder).select("vec_id", "probabilities")
    return rows.withColumn("sharper", softmax(F.transform("probabilities", lambda p: 2 * F.log(p))))


@register(
    f"""WITH {TWO_SQL}, v AS (SELECT vec_id, list_transform(p, lambda x, i: (3*x+q[i])/4) AS m FROM p2)
    SELECT vec_id, (list_position(m, list_max(m))-1)::INTEGER AS predicted, round(list_max(m),6) AS confidence FROM v"""
)
def soft_vote(spark: SparkSession, folder: str) -> DataFrame:
    rows = _two_models(spark, folder).withColumn("mixed", evaluate.vote([F.col("probabilities"), F.col("sharper")], [3, 1]))
    return rows.select("vec_id", argmax(F.col("mixed")).alias("predicted"), F.round(F.array_max("mixed"), 6).alias("confidence"))


@register(
    f"""WITH {TWO_SQL}, v AS (SELECT vec_id, list_transform(p, lambda x, i: (3*x+q[i])/4) AS m FROM p2)
    SELECT vec_id, (list_position(m, list_max(m))-1)::INTEGER AS predicted, round(list_max(m),6) AS confidence FROM v"""
)
def soft_vote_tall(spark: SparkSession, folder: str) -> DataFrame:
    """The same vote over one row per item and model."""
    rows = _two_models(spark, folder)
    tall = rows.select("vec_id", F.explode(F.array(
        F.struct(F.lit(3.0).alias("weight"), F.col("probabilities")), F.struct(F.lit(1.0).alias("weight"), F.col("sharper").alias("probabilities"))
    )).alias("m")).select("vec_id", "m.*")
    voted = evaluate.vote_tall(tall, "vec_id")
    return voted.select("vec_id", "predicted", F.round(F.array_max("probabilities"), 6).alias("confidence"))


@register(
    f"""WITH {LOGITS_SQL}, s AS (SELECT p[1] AS score, label=0 AS y FROM pr),
    r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0 AS rk FROM s)
    SELECT count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
      round((sum(rk) FILTER (y) - count(*) FILTER (y)*(count(*) FILTER (y)+1)/2.0)/count(*) FILTER (y)/count(*) FILTER (NOT y),6) AS auc FROM r"""
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Class 0 against the rest by its probability."""
    rows = _predictions(spark, folder).select(F.get("probabilities", F.lit(0)).alias("score"), (F.col("label") == 0).alias("positive"))
    return r6(evaluate.roc_auc(rows), "auc")


@register(
    f"""WITH {LOGITS_SQL}, k AS (SELECT unnest(range(0, (SELECT max(len(p)) FROM pr)))::INTEGER AS class),
    s AS (SELECT class, p[class+1] AS score, label=class AS y FROM pr, k),
    r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score)-1)/2.0 AS rk FROM s),
    a AS (SELECT class, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
      (sum(rk) FILTER (y) - count(*) FILTER (y)*(count(*) FILTER (y)+1)/2.0)/count(*) FILTER (y)/count(*) FILTER (NOT y) AS auc FROM r GROUP BY class)
    SELECT class, positives, negatives, round(auc,6) AS auc, round((SELECT avg(auc) FROM a),6) AS mean_auc FROM a"""
)
def roc_auc_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _predictions(spark, folder)
    return r6(evaluate.class_auc(rows), "auc", "mean_auc")


@register(
    f"""WITH {LABELLED_SQL}, s AS (SELECT {SCORE_SQL} AS score, quality=1 AS y FROM l),
    r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0 AS rk FROM s)
    SELECT count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
      round((sum(rk) FILTER (y) - count(*) FILTER (y)*(count(*) FILTER (y)+1)/2.0)/count(*) FILTER (y)/count(*) FILTER (NOT y),6) AS auc FROM r"""
)
def roc_auc_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Whole scores: many ties, each counted half."""
    rows = labelled(spark, folder).select(scoring.word_score(F.col("text")).alias("score"), (F.col("quality") == 1).alias("positive"))
    return r6(evaluate.roc_auc(rows), "auc")


@register(
    f"""WITH {LABELLED_SQL}, s AS (SELECT {SCORE_SQL} AS score, quality=1 AS y FROM l), th AS (SELECT unnest(range(1,11))::INTEGER AS threshold),
    g AS (SELECT threshold, count(*) FILTER (y AND score>=threshold) AS tp, count(*) FILTER (NOT y AND score>=threshold) AS fp,
      count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s, th GROUP BY threshold)
    SELECT threshold, tp, fp, round(tp/p,6) AS tpr, round(fp/n,6) AS fpr, round(tp/p-fp/n,6) AS youden FROM g"""
)
def threshold_calibration(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder).select(scoring.word_score(F.col("text")).alias("score"), (F.col("quality") == 1).alias("positive"))
    return r6(evaluate.threshold_table(rows), "tpr", "fpr", "youden")


_POISSON_SQL = "+".join(f"(u>={p})::INT" for p in evaluate.POISSON_ONE)


@register(
    f"""WITH {LOGITS_SQL}, sd AS (SELECT label, predicted, {seed_sql('42', 'vec_id')} AS s0 FROM pr),
    d AS (SELECT (label=predicted)::INT AS hit, r, {unit_sql('s0', 'r')} AS u FROM sd, (SELECT unnest(range(0,100)) AS r)),
    w AS (SELECT r, sum(({_POISSON_SQL})*hit)/sum({_POISSON_SQL}) AS a FROM d GROUP BY r)
    SELECT round(avg(a),6) AS mean, round(quantile_cont(a,0.025),6) AS low, round(quantile_cont(a,0.975),6) AS high FROM w"""
)
def accuracy_interval(spark: SparkSession, folder: str) -> DataFrame:
    rows = _logits(spark, folder).select("vec_id", "label", argmax(F.col("logits")).alias("predicted"))
    return r6(evaluate.bootstrap(rows, "vec_id"), "mean", "low", "high")


METRICS_SQL = {
    "accuracy": "sum(tp)/sum(support)", "macro_precision": "avg(precision)", "macro_recall": "avg(recall)", "macro_f1": "avg(f1)",
    "weighted_precision": "sum(precision*support)/sum(support)", "weighted_recall": "sum(recall*support)/sum(support)",
    "weighted_f1": "sum(f1*support)/sum(support)",
}


@register(
    f"""WITH {LOGITS_SQL}, sd AS (SELECT label, predicted, {seed_sql('42', 'vec_id')} AS s0 FROM pr),
    d AS (SELECT label, predicted, r, {unit_sql('s0', 'r')} AS u FROM sd, (SELECT unnest(range(0,100)) AS r)),
    bm AS (SELECT r, label, predicted, sum({_POISSON_SQL}) AS n FROM d GROUP BY ALL HAVING n > 0),
    v AS (SELECT r, label AS c, CASE WHEN label=predicted THEN n ELSE 0 END AS tp, n AS support, 0 AS called FROM bm
      UNION ALL SELECT r, predicted, 0, 0, n FROM bm),
    g AS (SELECT r, c, sum(tp) AS tp, sum(support) AS support, sum(called) AS called FROM v GROUP BY ALL),
    rt AS (SELECT r, tp, support, CASE WHEN called>0 THEN tp/called ELSE 0 END AS precision, CASE WHEN support>0 THEN tp/support ELSE 0 END AS recall,
      2.0*tp/(called+support) AS f1 FROM g),
    m AS ({" UNION ALL ".join(f"SELECT r, '{name}' AS metric, {sql} AS x FROM rt GROUP BY r" for name, sql in METRICS_SQL.items())})
    SELECT metric, round(avg(x),6) AS mean, round(quantile_cont(x,0.025),6) AS low, round(quantile_cont(x,0.975),6) AS high FROM m GROUP BY metric"""
)
def metric_intervals(spark: SparkSession, folder: str) -> DataFrame:
    rows = _logits(spark, folder).select("vec_id", "label", argmax(F.col("logits")).alias("predicted"))
    return r6(evaluate.metric_intervals(rows, "vec_id"), "mean", "low", "high")


@register(f"WITH {LOGITS_SQL} SELECT vec_id, predicted, round(list_max(p),6) AS confidence FROM pr ORDER BY list_max(p), vec_id LIMIT 20")
def least_certain(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluate.low_confidence(_predictions(spark, folder), "vec_id", 20)
    return rows.select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"))


@register(f"WITH {LOGITS_SQL} SELECT vec_id, label, predicted FROM pr WHERE label<>predicted")
def misclassified_rows(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.misclassified(_predictions(spark, folder)).select("vec_id", "label", "predicted")


@register(
    f"""WITH {LOGITS_SQL}, bar AS (SELECT label AS c, avg(p[label+1]) AS bar FROM pr GROUP BY label), bars AS (SELECT list(bar ORDER BY c) AS b FROM bar),
    q AS (SELECT vec_id, label, list_transform(p, lambda x, i: CASE WHEN x >= b[i] THEN x ELSE -1 END) AS c FROM pr, bars)
    SELECT vec_id, label, (list_position(c, list_max(c))-1)::INTEGER AS suggested FROM q WHERE list_max(c)>=0 AND list_position(c, list_max(c))-1<>label"""
)
def label_error_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Confident-learning candidates under the class-mean probabilities."""
    return evaluate.label_errors(_predictions(spark, folder)).select("vec_id", "label", "suggested")


@register(
    f"""WITH {SCORED_SQL}, a AS (SELECT sum(score*w)/sum(w) AS wm, avg(score) AS pm FROM s)
    SELECT round(wm,6) AS weighted_mean, round(pm,6) AS plain_mean, round(100.0*(wm-pm)/pm,6) AS shift_percent FROM a"""
)
def recency_shift(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.recency_shift(bundle_rows(spark, folder)), "weighted_mean", "plain_mean", "shift_percent")


@register(
    f"""WITH {SCORED_SQL} SELECT 'decay+threshold' AS variant, round(sum(score*w) FILTER (score>=3)/sum(w) FILTER (score>=3),6) AS mean_score FROM s
    UNION ALL SELECT 'threshold', round(avg(score) FILTER (score>=3),6) FROM s UNION ALL SELECT 'decay', round(sum(score*w)/sum(w),6) FROM s
    UNION ALL SELECT 'none', round(avg(score),6) FROM s"""
)
def ablation(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.ablation(bundle_rows(spark, folder), scoring.MIN_SCORE), "mean_score")


@register(
    f"""WITH {SCORED_SQL} SELECT round(sum(w) FILTER (score>=8)/sum(w) FILTER (score<8),6) AS before,
    round(sum(w) FILTER (score>=8)/sum(w) FILTER (score<8 AND score>=3),6) AS after FROM s"""
)
def signal_to_noise(spark: SparkSession, folder: str) -> DataFrame:
    return r6(evaluate.signal_to_noise(bundle_rows(spark, folder), 8, scoring.MIN_SCORE), "before", "after")


@register(
    f"""WITH b AS (SELECT doc_id, {blanks_sql('text')} AS t FROM documents), w AS (SELECT doc_id, t, string_split(t,' ') AS w FROM b),
    sd AS (SELECT *, {seed_sql('42-typo', 'doc_id')} AS s0 FROM w),
    x AS (SELECT doc_id, list_transform(w, lambda v, i: CASE WHEN length(v)>=4 AND {CHANCE_SQL} < 0.3 THEN v[1:1] || v[3:3] || v[2:2] || v[4:] ELSE v END) AS y FROM sd)
    SELECT doc_id, sha256(array_to_string(y,' ')) AS digest FROM x"""
)
def typo_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Perturbed texts for robustness checks."""
    rows = texts(spark, folder, "documents").select("doc_id", collapse_blanks(F.col("text")).alias("text"))
    return rows.select("doc_id", F.sha2(prepare.with_typos(F.col("text"), F.col("doc_id"), 0.3), 256).alias("digest"))


def _word_count_model():
    """Stands in for a served classifier: logits from the number of words."""

    def logits(texts):
        counts = [len([w for w in t.split(" ") if w]) for t in texts]
        return [[10.0, c / 4, c / 8 + 4] for c in counts]

    return logits


@register(
    """WITH c AS (SELECT conv_id, turn, len(list_filter(string_split(text,' '), lambda x: x<>'')) AS n FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN 10.0>=n/4 AND 10.0>=n/8+4 THEN 0 WHEN n/4>=n/8+4 THEN 1 ELSE 2 END AS INTEGER) AS predicted FROM c"""
)
def batch_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a plugged-in model over all turns."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return classify.predict_with(rows, _word_count_model).select("conv_id", "turn", "predicted")


# --- models ------------------------------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return materialize(prepare.split(classify.vector_features(rows).drop("embedding")), "vectors")


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed words of all documents, their language as label, in splits."""
    rows = texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang").filter("lang is not null")
    # Languages are few: their sorted list is a scalar subquery.
    numbered = rows.withColumn("label", (F.array_position(rows.agg(F.array_sort(F.collect_set("lang"))).scalar(), F.col("lang")) - 1).cast("int"))
    return prepare.split(materialize(classify.text_features(numbered, size=1 << 10).drop("text", "lang"), "features"))


LANGUAGES_SQL = f"""ds AS (SELECT doc_id AS id, dense_rank() OVER (ORDER BY lang)-1 AS label FROM documents WHERE lang IS NOT NULL), {split_sql('ds', 'id')}"""


@register(
    f"""WITH {LANGUAGES_SQL}, te AS (SELECT label, count(*) AS n FROM sp WHERE split='test' GROUP BY label)
    SELECT 'class ' || label AS entry, n::BIGINT AS support, true AS learnt FROM te
    UNION ALL SELECT unnest(['macro avg','weighted avg','accuracy']), sum(n)::BIGINT, true FROM te"""
)
def trained_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Best regression by validation macro F1: its report on the test split, and whether each figure beats a guess."""
    rows = _languages(spark, folder)
    fitted = classify.train(rows.filter("split = 'train'"), rows.filter("split = 'val'"), steps=(5, 10), regParam=0.01)
    test = rows.filter("split = 'test'")
    guess = test.agg(1.0 / F.count_distinct("label")).scalar()
    told = evaluate.report(evaluate.confusion(classify.predictions(fitted.model, test)))
    return told.select("entry", "support", (F.col("f1") > guess).alias("learnt"))


@register(
    f"""WITH ds AS (SELECT vec_id AS id, label FROM embeddings), {split_sql('ds', 'id')}
    SELECT split, count(*) AS n, count(*) AS same FROM sp GROUP BY split"""
)
def saved_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted model saved and loaded: rows of each split for which both predict the same."""
    rows, root = _vectors(spark, folder), scratch_path(spark, "models")
    fitted = classify.train(rows.filter("split = 'train'"), rows.filter("split = 'val'"), steps=(5, 10), regParam=0.01)
    classify.save_fitted(spark, fitted, root)
    fresh = classify.predictions(fitted.model, rows).withColumnsRenamed({"predicted": "fresh", "probabilities": "fresh_probabilities"})
    both = classify.predictions(classify.load_fitted(spark, root).model, fresh)
    same = (F.col("fresh") == F.col("predicted")) & (F.col("fresh_probabilities") == F.col("probabilities"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


def _told_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned labelled texts with their quality."""
    rows = prepare.cleaned(labelled(spark, folder), keep_empty=False)
    return materialize(prepare.as_dataset(rows, label="quality", key="doc_id"), "labelled")


TOLD_SQL = f"{CLEAN_SQL}, ds AS (SELECT doc_id AS id, t AS text, quality AS label FROM k WHERE t<>'')"


def buckets_sql(source: str, text: str = "text") -> str:
    return f"""(SELECT * REPLACE (CAST('0x' || substr(md5(w),1,4) AS INTEGER) AS w) FROM
      (SELECT *, unnest(list_filter(string_split({blanks_sql(f'lower({text})')},' '), lambda x: x<>'')) AS w FROM {source}))"""


def millionths_sql(x: str) -> str:
    return f"CAST(floor(({x})*1000000.0+0.5) AS BIGINT)"


def share_sql(alpha: str) -> str:
    return millionths_sql(f"ln(coalesce(n,0)+{alpha}) - ln(words+{alpha}*65536)")


# Counts of a training relation tr(id, label, text, ..), per model g; the rows to judge are te(id, label, text, g, ..).
COUNT_MODEL_SQL = f"""tc AS MATERIALIZED (SELECT g, label AS c, w, count(*) AS n FROM {buckets_sql('tr')} GROUP BY ALL),
cls AS (SELECT g, label AS c, {millionths_sql('ln(count(*)+1.0) - ln((sum(count(*)) OVER (PARTITION BY g) + count(*) OVER (PARTITION BY g))::DOUBLE)')} AS prior FROM tr GROUP BY g, label),
tot AS (SELECT *, coalesce((SELECT sum(n) FROM tc WHERE tc.g=cls.g AND tc.c=cls.c),0) AS words FROM cls)"""
# The label of the largest score, the first one on ties.
JUDGED_SQL = f"""db AS MATERIALIZED (SELECT v, g, id, label, w, count(*) AS m FROM {buckets_sql('te')} GROUP BY ALL),
sc AS (SELECT v, a, id, label, tot.c, any_value(prior) + sum(m*{share_sql('alpha')}) AS s, sum(m) AS len
  FROM db JOIN tot ON db.g=tot.g CROSS JOIN alphas LEFT JOIN tc ON tc.g=tot.g AND tc.c=tot.c AND tc.w=db.w GROUP BY ALL),
ju AS (SELECT v, a, id, label, arg_max(c, (s, -c)) AS predicted FROM sc GROUP BY ALL)"""
ONE_ALPHA_SQL = "alphas AS (SELECT 0 AS a, 1.0::DOUBLE AS alpha)"
ALPHAS_SQL = "alphas AS (SELECT * FROM (VALUES " + ",".join(f"({i},{a}::DOUBLE)" for i, a in enumerate(dataset_jobs.ALPHAS)) + ") t(a, alpha))"
# Macro F1 of judged rows per trial.
TRIALS_SQL = """cell AS (SELECT a, label, predicted, count(*) AS n FROM ju GROUP BY ALL),
side AS (SELECT a, label AS c, n AS support, 0 AS called, CASE WHEN label=predicted THEN n ELSE 0 END AS tp FROM cell
  UNION ALL SELECT a, predicted, 0, n, 0 FROM cell),
f AS (SELECT a, c, 2.0*sum(tp)/(sum(support)+sum(called)) AS f1 FROM side GROUP BY ALL),
trial AS (SELECT a, avg(f1) AS macro_f1 FROM f GROUP BY a)"""


@register(
    f"""WITH {TOLD_SQL}, {split_sql('ds', 'id')}, tr AS (SELECT 0 AS g, * FROM sp WHERE split='train'), te AS (SELECT 0 AS g, 0 AS v, id, label, text FROM sp WHERE split='val'),
    {COUNT_MODEL_SQL}, {ALPHAS_SQL}, {JUDGED_SQL}, {TRIALS_SQL} SELECT a AS trial, alpha, round(macro_f1,6) AS macro_f1 FROM trial JOIN alphas USING (a)"""
)
def parameter_search(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty smoothing values of the count model and their validation macro F1."""
    rows = prepare.split(_told_texts(spark, folder))
    trials, _ = countmodel.search(rows.filter("split = 'train'"), rows.filter("split = 'val'"), dataset_jobs.ALPHAS)
    return r6(trials, "macro_f1")


@register(f"WITH {LANGUAGES_SQL} SELECT range::INTEGER AS trial, (SELECT count(DISTINCT label) FROM sp WHERE split='val')>1 AS learnt FROM range(4)")
def regression_search(spark: SparkSession, folder: str) -> DataFrame:
    """Trials of the regression, fitted side by side: whether each tells the languages apart."""
    rows, estimator = _languages(spark, folder), classify.classifier()
    _, trials = classify.search(estimator, classify.sample_params(estimator, 4), rows.filter("split = 'train'"), rows.filter("split = 'val'"))
    return trials.select("trial", (F.col("macro_f1") > 0.5).alias("learnt"))


FOLD_SQL = "CAST((rk>=floor(n*0.3333333333333333+0.5))::INT + (rk>=floor(n*0.6666666666666666+0.5))::INT AS INTEGER)"


@register(
    f"""WITH {TOLD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || id))-1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM ds),
    fo AS (SELECT id, label, text, {FOLD_SQL} AS fold FROM r), tr AS (SELECT range AS g, fo.* FROM fo JOIN range(3) ON range<>fold),
    te AS (SELECT fold AS g, 0 AS v, id, label, text FROM fo), {COUNT_MODEL_SQL}, {ONE_ALPHA_SQL}, {JUDGED_SQL},
    z AS (SELECT id, label, list(s/(len*1000000.0) ORDER BY c) AS z FROM sc GROUP BY ALL),
    pr AS (SELECT id, label, list_transform(z, lambda x: exp(x-list_max(z))/list_sum(list_transform(z, lambda y: exp(y-list_max(z))))) AS p FROM z),
    bar AS (SELECT label AS c, avg(p[label+1]) AS bar FROM pr GROUP BY label), bars AS (SELECT list(bar ORDER BY c) AS b FROM bar),
    q AS (SELECT id, label, list_transform(p, lambda x, i: CASE WHEN x >= b[i] THEN x ELSE -1 END) AS c FROM pr, bars)
    SELECT id, label, (list_position(c, list_max(c))-1)::INTEGER AS suggested FROM q WHERE list_max(c)>=0 AND list_position(c, list_max(c))-1<>label"""
)
def out_of_fold_label_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels that models of the other folds argue against."""
    judged = countmodel.predict_out_of_fold(_told_texts(spark, folder), 3)
    return evaluate.label_errors(judged).select("id", "label", "suggested")


@register(
    f"""WITH {TOLD_SQL}, {split_sql('ds', 'id')}, tr AS (SELECT 0 AS g, * FROM sp WHERE split='train'),
    sd AS (SELECT id, label, text, string_split(text,' ') AS w, {seed_sql('42-typo', 'id')} AS s0 FROM sp WHERE split='test'),
    sh AS (SELECT unnest([0.1,0.3])::DOUBLE AS v),
    te AS (SELECT 0 AS g, 0.0::DOUBLE AS v, id, label, text FROM sd UNION ALL SELECT 0, v, id, label,
      array_to_string(list_transform(w, lambda x, i: CASE WHEN length(x)>=4 AND {CHANCE_SQL} < v THEN x[1:1] || x[3:3] || x[2:2] || x[4:] ELSE x END),' ') FROM sd, sh),
    {COUNT_MODEL_SQL}, {ONE_ALPHA_SQL}, {JUDGED_SQL}, ac AS (SELECT v, avg((label=predicted)::INT) AS acc FROM ju GROUP BY v)
    SELECT v AS typo_share, round(acc,6) AS accuracy, round(acc-(SELECT acc FROM ac WHERE v=0),6) AS change FROM ac"""
)
def typo_robustness(spark: SparkSession, folder: str) -> DataFrame:
    """Quality classifier on words: test accuracy as typos grow."""
    splits = prepare.split(_told_texts(spark, folder))
    fitted = countmodel.fit(splits.filter("split = 'train'"))
    return r6(countmodel.robustness(splits.filter("split = 'test'"), fitted), "accuracy", "change")


@register(
    f"""WITH {KEPT_SQL}, ds AS (SELECT doc_id AS id, t AS text, quality AS label FROM kept), {split_sql('ds', 'id')},
    tr AS (SELECT 0 AS g, * FROM sp WHERE split='train'), te AS (SELECT 0 AS g, split AS v, id, label, text FROM sp),
    {COUNT_MODEL_SQL}, {ALPHAS_SQL}, {JUDGED_SQL.replace('ju AS', 'al AS')}, ju AS (SELECT * FROM al WHERE v='val'), {TRIALS_SQL},
    chosen AS (SELECT a FROM trial ORDER BY round(macro_f1,9) DESC, a LIMIT 1),
    cm AS (SELECT v, label, predicted, count(*) AS n FROM al WHERE a=(SELECT a FROM chosen) GROUP BY ALL),
    cl AS (SELECT v, label AS c FROM cm UNION SELECT v, predicted FROM cm),
    pc AS (SELECT v, c, coalesce((SELECT sum(n) FROM cm WHERE cm.v=cl.v AND label=c AND predicted=c),0) AS tp, coalesce((SELECT sum(n) FROM cm WHERE cm.v=cl.v AND label=c),0) AS support,
      coalesce((SELECT sum(n) FROM cm WHERE cm.v=cl.v AND predicted=c),0) AS called FROM cl),
    rt AS (SELECT v, c, tp, support, CASE WHEN called>0 THEN tp/called ELSE 0 END AS precision, CASE WHEN support>0 THEN tp/support ELSE 0 END AS recall, 2.0*tp/(called+support) AS f1 FROM pc),
    rp AS (SELECT v, 'class ' || c AS class, precision, recall, f1, support FROM rt
      UNION ALL SELECT v, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rt GROUP BY v
      UNION ALL SELECT v, 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM rt GROUP BY v
      UNION ALL SELECT v, 'accuracy', NULL, NULL, sum(tp)/sum(support), sum(support) FROM rt GROUP BY v),
    u AS (SELECT v, class, 'precision' AS metric, precision AS value FROM rp UNION ALL SELECT v, class, 'recall', recall FROM rp
      UNION ALL SELECT v, class, 'f1', f1 FROM rp UNION ALL SELECT v, class, 'support', support FROM rp)
    SELECT 'quality' AS run, v AS phase, metric, class, round(value,6) AS value FROM u WHERE value IS NOT NULL"""
)
def dataset_job(spark: SparkSession, folder: str) -> DataFrame:
    """The whole dataset job on labelled documents: prepare, choose a smoothing, train, report all splits."""
    settings = DatasetSettings(id_column="doc_id", label_column="quality")
    prepared = dataset_jobs.prepare_rows(labelled(spark, folder), settings)
    _, _, history = dataset_jobs.count_and_judge(prepared, "quality")
    return r6(history, "value")
