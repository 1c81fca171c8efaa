"""Queries over splits by group, calibrated scores, slices and stored sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions import scoring
from talkgauge.functions.textclean import raw_word_count
from talkgauge.operators import calibrate, groups, sketches, slices
from talkgauge.plans.chat_queries import HITS_SQL, SCORE_SQL
from talkgauge.plans.data_queries import LABELLED_SQL, r6
from talkgauge.plans.registry import register
from talkgauge.plans.tables import labelled, texts
from talkgauge.plans.text_queries import blanks_sql, words_sql
from talkgauge.session import materialize

# --- splits by group ---------------------------------------------------------------------

# Near copies by comparing all pairs, components by walking all links, places by one window for each class.
GROUPS_SQL = f"""RECURSIVE b AS (SELECT doc_id, string_split({blanks_sql("coalesce(text,'')")}, ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w)-2, 1)+1), lambda i: coalesce(w[i],'') || ' ' || coalesce(w[i+1],'') || ' ' || coalesce(w[i+2],''))) AS s FROM b),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s=b.s AND a.doc_id>b.doc_id GROUP BY 1,2),
e AS MATERIALIZED (SELECT x, y FROM o JOIN z zx ON zx.doc_id=x JOIN z zy ON zy.doc_id=y WHERE c/(zx.n+zy.n-c)>0.95),
ee AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(a, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, ee.y FROM reach JOIN ee ON reach.v=ee.x),
gr AS (SELECT a AS id, min(v) AS grp FROM reach GROUP BY a),
rw AS (SELECT id, grp, lang FROM gr JOIN documents ON doc_id=id),
gc AS (SELECT grp, lang, count(*) AS c FROM rw GROUP BY 1,2),
un AS (SELECT grp, sum(c) AS size, first(lang ORDER BY c DESC, lang) AS class FROM gc GROUP BY grp),
nn AS (SELECT *, sum(size) OVER (PARTITION BY class) AS n FROM un),
pl AS (SELECT *, sum(size) OVER (PARTITION BY class ORDER BY (size > n*0.075::DOUBLE) DESC, sha256('42:' || grp), grp) - size AS before FROM nn),
sp AS (SELECT rw.id, rw.grp, rw.lang, CASE WHEN before < floor(n*0.70+0.5) THEN 'train' WHEN before < floor(n*0.85+0.5) THEN 'val' ELSE 'test' END AS split
  FROM rw JOIN pl USING (grp))"""


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    return groups.similar_groups(docs).drop("text")


@register(f'WITH {GROUPS_SQL} SELECT id, grp AS "group", lang AS label, split FROM sp')
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    """Copies and near copies stay on one side of the split."""
    return groups.split_groups(materialize(_grouped(spark, folder), "grouped")).select("id", "group", "label", "split")


@register(
    f"""WITH {GROUPS_SQL}, m AS (SELECT max(size) AS largest FROM un), t AS (SELECT lang, count(*) AS n FROM rw GROUP BY lang)
    SELECT lang AS label, split, count(*) AS rows, count(DISTINCT grp) AS groups, round(count(*)/any_value(n),6) AS share FROM sp JOIN t USING (lang) GROUP BY lang, split"""
)
def group_split_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and groups of each part and class, with the share of the class."""
    rows = groups.split_groups(materialize(_grouped(spark, folder), "grouped"))
    each = rows.groupBy("label", "split", "group").agg(F.count(F.lit(1)).alias("n"))
    parts = each.groupBy("label", "split").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))
    totals = parts.groupBy("label").agg(F.sum("rows").alias("_n"))
    return r6(parts.join(totals, "label").withColumn("share", F.col("rows") / F.col("_n")).drop("_n"), "share")


# --- calibrated probabilities ------------------------------------------------------------

STEPS = 100
# Monotone means as the largest, over steps before, of the least mean up to a later step.
ISOTONIC_SQL = f"""{LABELLED_SQL}, sw AS (SELECT doc_id, quality=1 AS y, least(1.0::DOUBLE, coalesce({HITS_SQL},0)/greatest({words_sql(blanks_sql("coalesce(text,'')"))},1)) AS score FROM l),
s AS MATERIALIZED (SELECT *, least(floor(score*{STEPS}), {STEPS - 1})::INTEGER AS step FROM sw),
ct AS MATERIALIZED (SELECT step, count(*) AS n, count(*) FILTER (y) AS pos FROM s WHERE doc_id%2=0 GROUP BY step),
iv AS (SELECT a.step AS a, b.step AS b, sum(c.pos)/sum(c.n) AS m FROM ct a JOIN ct b ON a.step<=b.step JOIN ct c ON c.step BETWEEN a.step AND b.step GROUP BY 1,2),
lo AS (SELECT i.step, iv.a, min(iv.m) AS m FROM ct i JOIN iv ON iv.a<=i.step AND iv.b>=i.step GROUP BY 1,2),
iso AS MATERIALIZED (SELECT step, max(m) AS share FROM lo GROUP BY step)"""
APPLIED_SQL = f"""{ISOTONIC_SQL}, pts AS (SELECT DISTINCT step FROM s),
ends AS (SELECT pts.step, max(iso.step) FILTER (iso.step<=pts.step) AS lo, min(iso.step) FILTER (iso.step>=pts.step) AS hi FROM pts, iso GROUP BY 1),
ap AS (SELECT ends.step, CASE WHEN lo IS NULL THEN h.share WHEN hi IS NULL OR lo=hi THEN l.share
  ELSE l.share + (h.share-l.share)*(ends.step-lo)/(hi-lo) END AS share
  FROM ends LEFT JOIN iso l ON l.step=lo LEFT JOIN iso h ON h.step=hi),
cal AS (SELECT doc_id, y, 'raw' AS kind, score AS p FROM s WHERE doc_id%2=1
  UNION ALL SELECT doc_id, y, 'calibrated', share FROM s JOIN ap USING (step) WHERE doc_id%2=1),
rb AS (SELECT kind, least(floor(round(p,9)*10),9)::INTEGER AS bin, count(*) AS n, avg(p) AS mean, avg(y::INT) AS share, abs(avg(y::INT)-avg(p)) AS gap FROM cal GROUP BY 1,2)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Share of common words as a first guess of quality."""
    text = F.col("text")
    hits = F.coalesce(scoring.word_hits(text), F.lit(0))
    share = F.least(F.lit(1.0), hits / F.greatest(raw_word_count(text), F.lit(1)))
    rows = labelled(spark, folder).select("doc_id", share.alias("score"), (F.col("quality") == 1).alias("positive"))
    return materialize(rows, "scored")


def _both_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the odd rows, as they are and calibrated on the even rows."""
    rows = _scored(spark, folder)
    model = calibrate.fit(calibrate.counted(rows.filter("doc_id % 2 = 0"), steps=STEPS))
    odd = calibrate.calibrated(rows.filter("doc_id % 2 = 1"), model, steps=STEPS)
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("score").alias("p")),
                    F.struct(F.lit("calibrated").alias("kind"), F.col("calibrated").alias("p")))
    return odd.select("doc_id", "positive", F.explode(kinds).alias("k")).select("doc_id", "positive", "k.*")


@register(f"WITH {ISOTONIC_SQL} SELECT step, n, pos, round(share,6) AS share FROM ct JOIN iso USING (step)")
def isotonic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Share of good documents by step of the score, made monotone."""
    counts = calibrate.counted(_scored(spark, folder).filter("doc_id % 2 = 0"), steps=STEPS)
    model = calibrate.fit(counts)
    steps = counts.withColumn("score", (F.col("step") + 0.5) / STEPS)
    return r6(calibrate.calibrated(steps, model, steps=STEPS, out="share").drop("score"), "share")


@register(f"WITH {APPLIED_SQL} SELECT kind, bin, n, round(mean,6) AS mean, round(share,6) AS share, round(gap,6) AS gap FROM rb")
def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _both_kinds(spark, folder).withColumn("p", F.round("p", 9))
    return r6(calibrate.reliability(rows, "p", by=["kind"]), "mean", "share", "gap")


@register(f"WITH {APPLIED_SQL} SELECT kind, round(sum(gap*n)/sum(n),6) AS error, round(max(gap),6) AS largest_gap FROM rb GROUP BY kind")
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out calibration error before and after."""
    rows = _both_kinds(spark, folder).withColumn("p", F.round("p", 9))
    return r6(calibrate.calibration_error(calibrate.reliability(rows, "p", by=["kind"]), ["kind"]), "error", "largest_gap")


# --- slices ------------------------------------------------------------------------------


@register(
    f"""WITH {LABELLED_SQL}, w AS (SELECT lang, source, {words_sql(blanks_sql("coalesce(text,'')"))} AS words, ({SCORE_SQL}>=5)=(quality=1) AS hit FROM l),
    s AS (SELECT lang, source, CASE WHEN words<50 THEN 'short' WHEN words<500 THEN 'medium' ELSE 'long' END AS length, hit FROM w),
    c AS (SELECT lang, source, length, grouping(lang) AS gl, grouping(source) AS gs, grouping(length) AS gn, count(*) AS n, count(*) FILTER (hit) AS h FROM s GROUP BY CUBE (lang, source, length)),
    a AS (SELECT *, (SELECT count(*) FROM s) AS tn, (SELECT count(*) FILTER (hit) FROM s) AS th FROM c),
    r AS (SELECT *, h/n AS accuracy, (th-h)/(tn-n) AS rest_accuracy FROM a WHERE gl+gs+gn>=1 AND n>=20 AND tn>n),
    f AS (SELECT *, sqrt((accuracy*(1-accuracy)+rest_accuracy*(1-rest_accuracy))/2) AS d FROM r)
    SELECT lang, source, length, concat_ws(',', CASE WHEN gl=1 THEN 'lang' END, CASE WHEN gs=1 THEN 'source' END, CASE WHEN gn=1 THEN 'length' END) AS free,
      n, round(accuracy,6) AS accuracy, round(rest_accuracy,6) AS rest_accuracy, round((rest_accuracy-accuracy)/d,6) AS effect FROM f WHERE d>0 AND (rest_accuracy-accuracy)/d>=0.1"""
)
def weak_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Languages, sources, length bands and their pairs on which word scores predict quality worse than elsewhere."""
    words = raw_word_count(F.col("text"))
    band = F.when(words < 50, "short").when(words < 500, "medium").otherwise("long")
    hit = (scoring.word_score(F.col("text")) >= 5) == (F.col("quality") == 1)
    rows = materialize(labelled(spark, folder).select("lang", "source", band.alias("length"), hit.alias("hit")), "hits")
    return r6(slices.slice_search(rows, ["lang", "source", "length"]), "accuracy", "rest_accuracy", "effect")


# --- profiles that add up ----------------------------------------------------------------


@register(
    f"""WITH w AS (SELECT source, {words_sql(blanks_sql("coalesce(text,'')"))} AS words FROM documents)
    SELECT coalesce(source,'all') AS part, count(*) AS n, round(avg(words),6) AS mean, min(words)::BIGINT AS shortest, max(words)::BIGINT AS longest,
      true AS median_inside, true AS p95_inside, true AS distinct_inside FROM w GROUP BY ROLLUP (source)"""
)
def sketched_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches by source and language, written, then merged by source and overall.

    Sums and extremes are exact; estimates are held to the exact ranks and counts of the same rows, a flag for each says
    whether it lies inside its bound.
    """
    docs = texts(spark, folder, "documents").select("source", "lang", "text")
    stored = materialize(sketches.part_sketches(docs, ["source", "lang"]), "sketches")
    both = [sketches.profile(stored, ["source"]).withColumnRenamed("source", "part"),
            sketches.profile(stored).withColumn("part", F.lit("all"))]
    estimates = both[0].unionByName(both[1])
    exact = docs.select(
        F.explode(F.array(F.col("source"), F.lit("all"))).alias("part"), raw_word_count(F.col("text")).alias("words"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    lengths = exact.groupBy("part", "words").agg(F.count(F.lit(1)).alias("c"))
    joined = lengths.join(F.broadcast(estimates), "part")

    def inside(name: str, share: float):
        # Ranks that the estimate covers: from the rows below it to the rows up to it.
        below = F.sum(F.when(F.col("words") < F.col(name), F.col("c")).otherwise(0)) / F.sum("c")
        upto = F.sum(F.when(F.col("words") <= F.col(name), F.col("c")).otherwise(0)) / F.sum("c")
        return (below - sketches.RANK_BOUND <= share) & (upto + sketches.RANK_BOUND >= share)

    names = ["part", "n", "mean", "shortest", "longest", "distinct_texts"]
    ranks = joined.groupBy(*names).agg(inside("p50", 0.5).alias("median_inside"), inside("p95", 0.95).alias("p95_inside"))
    held = exact.groupBy("part").agg(F.count_distinct("digest").alias("_d"))
    near = F.abs(F.col("distinct_texts") - F.col("_d")) <= sketches.DISTINCT_BOUND * F.col("_d")
    return r6(ranks.join(held, "part").withColumn("distinct_inside", near).drop("distinct_texts", "_d"), "mean")
