"""Queries over histories condensed to cells and over the difference of table versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions.decay import MICROS_PER_DAY, micros, to_micros
from talkgauge.operators import relevance, tiers
from talkgauge.operators.keys import PAIR
from talkgauge.plans.chat_queries import MESSAGES_SQL, SCORE_SQL, message_scores, r6
from talkgauge.plans.registry import register
from talkgauge.plans.tables import HALF_LIFE, table
from talkgauge.session import materialize, scratch_path
from talkgauge.sources import versions

# --- condensed history -------------------------------------------------------------------

DATES = ("2024-01-12", "2024-01-25", "2024-03-01")

# All cells computed anew from all messages before each date.
_DAY = MICROS_PER_DAY
_WEIGHT = f"exp(-ln(2) / 7 * (tm - {{}}) / {_DAY}.0)"
TIERS_SQL = f"""{MESSAGES_SQL},
t AS (SELECT epoch_us(v::TIMESTAMP) AS tm FROM (VALUES {", ".join(f"('{d}')" for d in DATES)}) AS x(v)),
r AS (SELECT tm, u1, u2, us, us // {_DAY} AS day, {SCORE_SQL} AS score FROM p JOIN t ON us < tm),
k AS (SELECT *, list_sum(list_transform(range(1, 21), lambda i: (tm // {_DAY} - (day - day % (1::BIGINT << i) + (1::BIGINT << i) - 1) >= (1::BIGINT << i))::INTEGER))::INTEGER AS tier FROM r),
ce AS (SELECT tm, u1, u2, tier, day - day % (1::BIGINT << tier) AS first_day, count(*) AS n_messages, count(*) FILTER (score>=3) AS n,
  coalesce(sum(score) FILTER (score>=3), 0) AS s, min(us) FILTER (score>=3) AS lo, max(us) FILTER (score>=3) AS hi,
  (sum(us) FILTER (score>=3) // count(*) FILTER (score>=3))::BIGINT AS mean FROM k GROUP BY 1,2,3,4,5),
ch AS (SELECT tm, u1, u2, sum(n_messages)::BIGINT AS n_messages, count(*) AS n_cells, sum(n) AS n,
  coalesce(sum(s*{_WEIGHT.format("mean")}),0) AS a, coalesce(sum(n*{_WEIGHT.format("mean")}),0) AS b,
  coalesce(sum(s*{_WEIGHT.format("lo")}),0) AS sl, coalesce(sum(n*{_WEIGHT.format("hi")}),0) AS nh,
  coalesce(sum(s*{_WEIGHT.format("hi")}),0) AS sh, coalesce(sum(n*{_WEIGHT.format("lo")}),0) AS nl FROM ce GROUP BY 1,2,3),
ex AS (SELECT tm, u1, u2, coalesce(sum(score*{_WEIGHT.format("us")}) FILTER (score>=3) / sum({_WEIGHT.format("us")}) FILTER (score>=3), 0) AS exact FROM r GROUP BY 1,2,3)"""


@register(
    f"""WITH {TIERS_SQL} SELECT tm // {_DAY} AS as_of_day, u1, u2, n_messages, n_cells,
    round(CASE WHEN n>0 THEN a/b ELSE 0 END, 6) AS score, round(CASE WHEN n>0 THEN sl/nh ELSE 0 END, 6) AS low,
    round(CASE WHEN n>0 THEN sh/nl ELSE 0 END, 6) AS high, round(exact, 6) AS exact, true AS inside
    FROM ch JOIN ex USING (tm, u1, u2)"""
)
def condensed_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Chat scores at three dates from cells that are written, aged and added to; each beside the score of the messages."""
    rows = message_scores(spark, folder).select(*PAIR, micros("ts").alias("mean_us"), "score", F.lit(1).cast("bigint").alias("n_messages"))
    before, cells, out = None, None, []
    for date in DATES:
        at = to_micros(date)
        known = rows.filter(F.col("mean_us") < at)
        added = known if before is None else known.filter(F.col("mean_us") >= before)
        cells = tiers.cells(added, at) if cells is None else tiers.advance(cells, added, at)
        cells = materialize(cells, "tiers")
        exact = relevance.with_score(relevance.chat_sums(relevance.weighted(known, at, HALF_LIFE)))
        scores = tiers.chat_scores(cells, at, HALF_LIFE).join(exact.select(*PAIR, F.col("raw_score").alias("exact")), PAIR)
        out.append(scores.withColumn("as_of_day", F.lit(at // MICROS_PER_DAY).cast("bigint")))
        before = at
    slack = 1e-9
    inside = F.col("exact").between(F.col("low") - slack, F.col("high") + slack)
    found = reduce(DataFrame.unionByName, out).withColumn("inside", inside)
    return found.select("as_of_day", *PAIR, "n_messages", "n_cells", *r6("score", "low", "high", "exact"), "inside")


# --- versions of a table -----------------------------------------------------------------

# The old version lacks long documents, the new one short ones, and in the new one mail signs are written out.
VERSIONS_SQL = """o AS (SELECT * FROM documents WHERE coalesce(n_chars, 0) < 4000),
n AS (SELECT * REPLACE (replace(text, '@', ' at ') AS text) FROM documents WHERE coalesce(n_chars, 0) >= 300)"""


def _written(spark: SparkSession, rows: DataFrame) -> str:
    path = scratch_path(spark, "version")
    versions.write_version(rows, path, "doc_id")
    return path


@register(
    f"""WITH {VERSIONS_SQL}, f AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, (o.doc_id IS NOT NULL)::BIGINT AS n_old,
      (n.doc_id IS NOT NULL)::BIGINT AS n_new, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
      WHEN (o.text, o.lang, o.source, o.n_chars) IS DISTINCT FROM (n.text, n.lang, n.source, n.n_chars) THEN 'changed' END AS change
      FROM o FULL JOIN n ON o.doc_id=n.doc_id)
    SELECT doc_id, change, n_old, n_new FROM f WHERE change IS NOT NULL"""
)
def version_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Added, removed and changed documents of two versions, from their hash trees alone."""
    docs = table(spark, folder, "documents")
    length = F.coalesce("n_chars", F.lit(0))
    old = _written(spark, docs.filter(length < 4000))
    new = _written(spark, docs.filter(length >= 300).withColumn("text", F.replace("text", F.lit("@"), F.lit(" at "))))
    return versions.difference(spark, old, new).withColumnRenamed("key", "doc_id")
