"""Report queries over the conversation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions import decay
from talkgauge.operators import bundling, relevance, reports
from talkgauge.plans.chat_queries import CHATS_SQL, USERS_SQL, bundle_rows, chat_state, message_scores, r6
from talkgauge.plans.registry import register
from talkgauge.plans.tables import AS_OF, HALF_LIFE, pairs, table
from talkgauge.session import scratch_path
from talkgauge.sources.store import append_log, load_log

VIEW_SQL = f"""{CHATS_SQL}, {USERS_SQL},
cs AS (SELECT u1,u2,CASE WHEN weight_sum>0 THEN weighted_sum/weight_sum ELSE 0 END AS raw,
         round(CASE WHEN weight_sum>0 THEN weighted_sum/weight_sum ELSE 0 END,1) AS score FROM c),
us AS (SELECT "user",CASE WHEN weight_sum>0 THEN weighted_sum/weight_sum ELSE 0 END AS raw,
         round(CASE WHEN weight_sum>0 THEN weighted_sum/weight_sum ELSE 0 END,1) AS score FROM u),
g AS (SELECT round(sum(weighted_sum)/sum(weight_sum),1) AS score FROM c)"""


def _chats(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.with_score(chat_state(spark, folder))


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.with_score(relevance.user_sums(chat_state(spark, folder)))


def _overall(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.overall(chat_state(spark, folder))


@register(f"{VIEW_SQL} SELECT u1,u2,u1||'-'||u2 AS label,score FROM cs ORDER BY score DESC,u1,u2 LIMIT 10")
def top_chat_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_chats(_chats(spark, folder), 10).drop("raw_score")


@register(f'{VIEW_SQL} SELECT "user",score FROM us ORDER BY score DESC,"user" LIMIT 8')
def top_user_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_users(_users(spark, folder), 8).drop("raw_score")


@register(f"{VIEW_SQL} SELECT u1,u2,score FROM cs WHERE score>=7")
def network_edge_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.network_edges(_chats(spark, folder), 7)


@register(
    f"""{VIEW_SQL}, e AS (SELECT * FROM cs WHERE score>=7), n AS (SELECT u1 AS "user" FROM e UNION SELECT u2 FROM e)
    SELECT n."user", coalesce(score,0) AS score, 300+50*coalesce(score,0) AS node_size FROM n LEFT JOIN us USING ("user")"""
)
def network_node_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.network_nodes(reports.network_edges(_chats(spark, folder), 7), _users(spark, folder))


@register(f"""{VIEW_SQL} SELECT u1 AS "user",u2 AS other,score FROM cs UNION ALL SELECT u2,u1,score FROM cs WHERE u1<>u2""")
def chat_matrix_cells(spark: SparkSession, folder: str) -> DataFrame:
    return reports.matrix_cells(_chats(spark, folder))


_COLUMNS_SQL = ", ".join(f'coalesce(max(CASE WHEN other={i} THEN score END),0) AS "{i}"' for i in range(23))


@register(
    f"""{VIEW_SQL}, t AS (SELECT u1 AS "user",u2 AS other,score FROM cs UNION ALL SELECT u2,u1,score FROM cs WHERE u1<>u2)
    SELECT "user", {_COLUMNS_SQL} FROM t GROUP BY "user\""""
)
def chat_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return reports.matrix_wide(_chats(spark, folder))


@register(f"{VIEW_SQL} SELECT msg_id, us AS ts_us, score FROM s WHERE score>=3")
def message_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return reports.timeline(message_scores(spark, folder))


@register(
    f"""{VIEW_SQL}, o AS (SELECT *, (row_number() OVER (PARTITION BY u1,u2 ORDER BY us,msg_id)-1)//3 AS bundle_id FROM p),
    h AS (SELECT u1,u2,bundle_id,least(10,1+len(list_filter(regexp_split_to_array(lower(string_agg(text,chr(10))),'\\s+'),
        lambda x: x IN ('the','and','of','en','de','der','la','que')))) AS score FROM o GROUP BY 1,2,3)
    SELECT msg_id, us AS ts_us, CAST(h.score AS INTEGER) AS score FROM o JOIN h USING (u1,u2,bundle_id) WHERE h.score>=3"""
)
def bundle_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Messages take the score of the bundle they belong to."""
    tagged = bundling.with_bundle_id(pairs(spark, folder), "count", 3).select(*bundling.BUNDLE, "msg_id", "ts")
    scores = bundle_rows(spark, folder, "count", 3).select(*bundling.BUNDLE, "score")
    return reports.timeline(tagged.join(scores, bundling.BUNDLE))


@register(
    f"""{VIEW_SQL}, f AS (SELECT u1,u2,count(*) AS n FROM s WHERE score>=5 GROUP BY 1,2),
    i AS (SELECT "user", row_number() OVER (ORDER BY "user")-1 AS idx FROM (SELECT u1 AS "user" FROM p UNION SELECT u2 FROM p))
    SELECT f.u1,f.u2,a.idx AS source,b.idx AS target,n FROM f JOIN i a ON a."user"=f.u1 JOIN i b ON b."user"=f.u2"""
)
def flow_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.flow_links(message_scores(spark, folder))


@register(
    f"""{VIEW_SQL}, ca AS (SELECT count(*) FILTER (score>0) AS active_chats, coalesce(avg(score) FILTER (score>0),0) AS a FROM cs),
    ua AS (SELECT count(*) AS users, avg(score) AS a FROM us), ma AS (SELECT count(*) AS n, count(*) FILTER (score>=3) AS r FROM s)
    SELECT g.score AS composite, active_chats, users, round(ca.a,6) AS avg_chat_score, round(ua.a,6) AS avg_user_score,
      n AS messages, r AS relevant_messages, round(100.0*r/n,6) AS relevance_rate FROM g,ca,ua,ma"""
)
def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    row = reports.summary(_chats(spark, folder), _users(spark, folder), _overall(spark, folder), message_scores(spark, folder))
    return row.withColumns({c: F.round(c, 6) for c in ("avg_chat_score", "avg_user_score", "relevance_rate")})


SNAPSHOT_SQL = f"""{VIEW_SQL} SELECT epoch_us(TIMESTAMP '2024-03-01 00:00:00') AS as_of_us, g.score AS composite,
    round((SELECT avg(score) FROM us),6) AS user_avg, round((SELECT avg(score) FROM cs WHERE score>0),6) AS chat_avg,
    (SELECT count(*) FROM cs WHERE score>0) AS active_chats, (SELECT count(*) FROM us) AS active_users FROM g"""


@register(SNAPSHOT_SQL)
def snapshot_row(spark: SparkSession, folder: str) -> DataFrame:
    row = reports.snapshot(_chats(spark, folder), _users(spark, folder), _overall(spark, folder), AS_OF)
    return row.withColumns({c: F.round(c, 6) for c in ("user_avg", "chat_avg")})


@register(
    f"""WITH d AS (SELECT unnest([0,10,20]) AS k), base AS ({SNAPSHOT_SQL})
    SELECT as_of_us+k*86400000000 AS as_of_us, composite, user_avg FROM base, d"""
)
def trend_series(spark: SparkSession, folder: str) -> DataFrame:
    """Three snapshots ten days apart, appended to the log and read back as a series."""
    log = scratch_path(spark, "log")
    state = relevance.as_state(chat_state(spark, folder), AS_OF)
    for day in (0, 10, 20):
        moment = AS_OF + day * decay.MICROS_PER_DAY
        faded = relevance.state_at(state, moment, HALF_LIFE)
        users = relevance.with_score(relevance.user_sums(faded))
        append_log(reports.snapshot(relevance.with_score(faded), users, relevance.overall(faded), moment), log)
    return reports.trend(load_log(spark, log)).withColumn("user_avg", F.round("user_avg", 6))


@register(
    f"""{VIEW_SQL} , hb AS (SELECT CASE WHEN floor(score+0.5)<=2 THEN '0-2' WHEN floor(score+0.5)<=4 THEN '3-4' WHEN floor(score+0.5)<=6 THEN '5-6'
      WHEN floor(score+0.5)<=8 THEN '7-8' ELSE '9-10' END AS bin FROM cs)
    SELECT x.bin, count(hb.bin) AS n FROM (VALUES ('0-2'), ('3-4'), ('5-6'), ('7-8'), ('9-10')) x(bin) LEFT JOIN hb USING (bin) GROUP BY 1"""
)
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return reports.histogram(_chats(spark, folder))


@register(
    f"""{VIEW_SQL} SELECT msg_id, CASE WHEN score<=3 THEN 'not relevant' WHEN score<=6 THEN 'moderate' ELSE 'high' END AS band FROM s"""
)
def message_bands(spark: SparkSession, folder: str) -> DataFrame:
    return reports.with_band(message_scores(spark, folder)).select("msg_id", "band")


@register(
    """WITH d AS (SELECT DISTINCT epoch_us(ts)//86400000000 AS day FROM events), a AS (SELECT day, (SELECT max(day) FROM d)-day AS age FROM d)
    SELECT age AS day, round(exp(-ln(2)/7*age),6) AS weight FROM a"""
)
def decay_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """The decay curve at the ages that occur among the event days."""
    days = table(spark, folder, "events").select(decay.day_number(F.col("ts").cast("timestamp")).alias("d")).distinct()
    ages = days.withColumn("_last", days.agg(F.max("d")).scalar()).select((F.col("_last") - F.col("d")).alias("day"))
    weight = F.exp(F.lit(-decay.rate(HALF_LIFE)) * F.col("day"))
    return ages.select("day", weight.alias("weight")).select("day", *r6("weight"))


@register(f"""{VIEW_SQL} SELECT round((SELECT sum(score) FROM us),6) AS sum_of_users, (SELECT count(*) FROM us) AS users, score AS overall_score FROM g""")
def double_count_report(spark: SparkSession, folder: str) -> DataFrame:
    row = reports.double_count(_users(spark, folder), _overall(spark, folder))
    return row.withColumn("sum_of_users", F.round("sum_of_users", 6))
