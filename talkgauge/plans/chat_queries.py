"""Conversation queries: keys, bundles, scores, decay, incremental updates, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions import decay, scoring
from talkgauge.operators import bundling, incremental, keys, relevance, scorer
from talkgauge.functions.vectors import class_means
from talkgauge.operators.keys import PAIR, with_pair
from talkgauge.operators.scale import order_rank
from talkgauge.plans import relevance_jobs as jobs
from talkgauge.plans.registry import register
from talkgauge.plans.tables import (
    AS_OF,
    EVENTS_AS_OF,
    HALF_LIFE,
    event_scores,
    event_stream,
    message_stream,
    messages,
    new_part,
    old_part,
    pairs,
    scored_events,
    table,
)
from talkgauge.session import scratch_path
from talkgauge.sources.messages import contact_messages, flatten_history, nest_history
from talkgauge.streaming import bundle_stream, decayed_stream

TOPIC = "Formula 1"
WORDS_SQL = "('the','and','of','en','de','der','la','que')"
HITS_SQL = f"len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x IN {WORDS_SQL}))"
SCORE_SQL = f"CAST(least(10, 1 + coalesce({HITS_SQL}, 0)) AS INTEGER)"
AS_OF_SQL = "epoch_us(TIMESTAMP '2024-03-01 00:00:00')"
WEIGHT_SQL = f"exp(-ln(2) / 7 * ({AS_OF_SQL} - us) / 86400000000.0)"
MESSAGES_SQL = """
m AS (SELECT conv_id*1000+turn AS msg_id,
        CASE WHEN role='user' THEN conv_id%23 ELSE (conv_id*5+1)%23 END AS sender,
        CASE WHEN role='user' THEN (conv_id*5+1)%23 ELSE conv_id%23 END AS receiver, text,
        epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (conv_id%60)*43200000000 + turn*300000000 AS us
      FROM conversations),
p AS (SELECT msg_id, least(sender,receiver) AS u1, greatest(sender,receiver) AS u2, text, us FROM m)"""
SCORED_SQL = f"""{MESSAGES_SQL},
s AS (SELECT *, {SCORE_SQL} AS score, {WEIGHT_SQL} AS w FROM p)"""


def chats_sql(threshold: int = 3, source: str = "s") -> str:
    return f"""c AS (SELECT u1, u2, count(*) AS n_messages,
        sum(CASE WHEN score>={threshold} THEN score*w ELSE 0 END) AS weighted_sum,
        sum(CASE WHEN score>={threshold} THEN w ELSE 0 END) AS weight_sum FROM {source} GROUP BY u1,u2)"""


CHATS_SQL = f"WITH {SCORED_SQL}, {chats_sql()}"
SCORE_OUT_SQL = "round(CASE WHEN weight_sum>0 THEN weighted_sum/weight_sum ELSE 0 END, 6)"


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def message_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with its own score (per-message mode)."""
    return pairs(spark, folder).withColumn("score", scoring.word_score(F.col("text")))


def bundle_rows(spark: SparkSession, folder: str, mode: str = "message", size: int = 1) -> DataFrame:
    rows = relevance.additive_bundle_scores(pairs(spark, folder), mode, size)
    return relevance.weighted(rows, AS_OF, HALF_LIFE)


def chat_state(spark: SparkSession, folder: str, min_score: float = scoring.MIN_SCORE) -> DataFrame:
    return relevance.chat_sums(bundle_rows(spark, folder), min_score)


# --- keys, merging, ordering -------------------------------------------------------------


@register(f"WITH {MESSAGES_SQL} SELECT u1, u2, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM p GROUP BY u1, u2")
def pair_keys(spark: SparkSession, folder: str) -> DataFrame:
    us = decay.micros("ts")
    return pairs(spark, folder).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


@register(
    f"""WITH {MESSAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY u1,u2 ORDER BY us,msg_id) AS rn FROM p)
    SELECT msg_id, u1, u2, rn FROM o"""
)
def chat_order(spark: SparkSession, folder: str) -> DataFrame:
    slim = pairs(spark, folder).drop("text")
    return order_rank(slim, PAIR, "ts", "msg_id").select("msg_id", *PAIR, "rn")


@register(
    f"""WITH {MESSAGES_SQL}, f AS (SELECT conv_id, text, turn FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS contact, count(*) AS n, sum(length(text))::BIGINT AS chars,
           max(turn) AS last_position, sha256(string_agg(text, '|' ORDER BY turn)) AS digest
    FROM f GROUP BY conv_id"""
)
def nested_history(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations nested to contact -> messages, flattened back, and summed up."""
    flat = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("contact"), F.col("turn").alias("position"), "text",
        F.timestamp_seconds(F.col("turn")).alias("ts"),
    )
    nested = nest_history(flat).select(F.create_map("contact", "messages").alias("history"))
    again = flatten_history(nested)
    return again.groupBy("contact").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("position").alias("last_position"),
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda m: m["text"]), "|"), 256
        ).alias("digest"),
    )


@register(
    f"""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS contact, {SCORE_SQL} AS score,
      exp(-ln(2)/7*({AS_OF_SQL} - (epoch_us(TIMESTAMP '2024-01-01 00:00:00') + turn*300000000))/86400000000.0) AS w FROM conversations)
    SELECT contact, count(*) AS n_messages, round(sum(CASE WHEN score>=3 THEN score*w ELSE 0 END),6) AS weighted_sum,
      round(sum(CASE WHEN score>=3 THEN w ELSE 0 END),6) AS weight_sum FROM s GROUP BY contact"""
)
def contact_chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Nested histories of single contacts, scored without a second user."""
    start = decay.to_micros("2024-01-01T00:00:00")
    flat = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("contact"), F.col("turn").alias("position"), "text",
        F.timestamp_micros(F.lit(start) + F.col("turn") * 300_000_000).alias("ts"),
    )
    nested = nest_history(flat).select(F.create_map("contact", "messages").alias("history"))
    chats = contact_messages(flatten_history(nested))
    sums = relevance.chat_sums(relevance.weighted(relevance.additive_bundle_scores(chats, "message"), AS_OF, HALF_LIFE))
    return sums.select(F.col("u1").alias("contact"), "n_messages", *r6("weighted_sum", "weight_sum"))


SPLIT_SQL = """
old AS (SELECT * FROM p WHERE us < epoch_us(TIMESTAMP '2024-01-25 00:00:00')),
new AS (SELECT * FROM p WHERE us >= epoch_us(TIMESTAMP '2024-01-25 00:00:00'))"""


@register(f"WITH {MESSAGES_SQL} SELECT u1, u2, count(*) AS n, sum(msg_id)::BIGINT AS ids FROM p GROUP BY u1, u2")
def merged_history(spark: SparkSession, folder: str) -> DataFrame:
    """Old part plus the whole view as a replay: every message is kept exactly once."""
    everything = pairs(spark, folder)
    merged = keys.merge_messages(old_part(everything), everything)
    return merged.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.sum("msg_id").alias("ids"))


@register(
    f"""WITH {MESSAGES_SQL},
    d AS (SELECT *, least(sender,receiver) AS u1, greatest(sender,receiver) AS u2 FROM m),
    f AS (SELECT u1,u2,min(us) AS first_new, count(*) AS n_new FROM d WHERE sender>receiver GROUP BY u1,u2),
    l AS (SELECT u1,u2,max(us) AS last_old FROM d WHERE sender<=receiver GROUP BY u1,u2)
    SELECT u1,u2,n_new,first_new,last_old,coalesce(first_new<last_old,false) AS out_of_order
    FROM f LEFT JOIN l USING (u1,u2)"""
)
def late_append_flags(spark: SparkSession, folder: str) -> DataFrame:
    """One direction of every chat is stored, the other arrives later: most chats need a re-sort."""
    rows = messages(spark, folder)
    upward = F.col("sender") <= F.col("receiver")
    return keys.late_appends(keys.with_pair(rows.filter(upward)), keys.with_pair(rows.filter(~upward)))


@register(
    f"""WITH {MESSAGES_SQL}, {SPLIT_SQL}
    SELECT u1,u2,count(*) AS n FROM p WHERE (u1,u2) IN (SELECT (u1,u2) FROM new) GROUP BY u1,u2"""
)
def affected_chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder)
    touched = keys.messages_of(rows, keys.affected_chats(new_part(rows)))
    return touched.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))


@register(
    f"""WITH {SCORED_SQL}, {SPLIT_SQL.replace("FROM p", "FROM s")}, {chats_sql(source="old")}
    SELECT n.u1, n.u2, round(coalesce(weighted_sum,0),6) AS weighted_sum, round(coalesce(weight_sum,0),6) AS weight_sum
    FROM (SELECT DISTINCT u1,u2 FROM new) n LEFT JOIN c ON n.u1=c.u1 AND n.u2=c.u2"""
)
def state_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = message_scores(spark, folder).withColumn("mean_us", decay.micros("ts")).withColumn("n_messages", F.lit(1))
    state = relevance.chat_sums(relevance.weighted(old_part(rows), AS_OF, HALF_LIFE)).withColumn("as_of", F.lit(AS_OF))
    found = keys.lookup_state(keys.affected_chats(new_part(rows)), state, F.lit(AS_OF))
    return found.select(*PAIR, *r6("weighted_sum", "weight_sum"))


@register(
    f"""WITH {MESSAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY u1,u2 ORDER BY us DESC,msg_id DESC) AS rn FROM p)
    SELECT u1,u2,count(*) AS n, sum(CASE WHEN rn=1 THEN msg_id END)::BIGINT AS last_id FROM o GROUP BY u1,u2"""
)
def appended_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The newest message of each chat taken off and appended again."""
    rows = pairs(spark, folder)
    last = bundling.trailing_messages(rows, 1)
    shorter = rows.join(last.select("msg_id"), "msg_id", "left_anti").select(rows.columns)
    whole = keys.append_message(shorter, last)
    return whole.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("msg_id", F.struct("ts", "msg_id")).alias("last_id")
    )


# --- bundles -----------------------------------------------------------------------------

NUMBERED_SQL = f"""{MESSAGES_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY u1,u2 ORDER BY us,msg_id) AS rn,
        row_number() OVER (PARTITION BY u1,u2 ORDER BY us DESC,msg_id DESC) AS back FROM p)"""
BUNDLE_OUT_SQL = """sha256(string_agg(text, chr(10) ORDER BY us,msg_id)) AS text_key, count(*) AS n_messages,
    (sum(us)//count(*))::BIGINT AS mean_us"""


def _bundle_digest(bundled: DataFrame) -> DataFrame:
    return bundling.with_key(bundled).select(*bundling.BUNDLE, "text_key", "n_messages", "mean_us")


@register(f"WITH {NUMBERED_SQL} SELECT u1,u2,(rn-1)//4 AS bundle_id, {BUNDLE_OUT_SQL} FROM o GROUP BY 1,2,3")
def count_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_digest(bundling.bundles(pairs(spark, folder), "count", 4))


@register(f"WITH {NUMBERED_SQL} SELECT u1,u2,(rn-1)//4 AS bundle_id, {BUNDLE_OUT_SQL} FROM o GROUP BY 1,2,3")
def count_bundles_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same bundles with every chat treated as too large for one task."""
    return _bundle_digest(bundling.bundles(pairs(spark, folder), "count", 4, hot_rows=8))


@register(f"WITH {MESSAGES_SQL} SELECT u1,u2,us//86400000000 AS bundle_id, {BUNDLE_OUT_SQL} FROM p GROUP BY 1,2,3")
def day_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_digest(bundling.bundles(pairs(spark, folder), "daily"))


@register(
    f"""WITH {MESSAGES_SQL} SELECT u1,u2,msg_id AS bundle_id, sha256(text) AS text_key, 1::BIGINT AS n_messages, us AS mean_us FROM p"""
)
def message_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_digest(bundling.bundles(pairs(spark, folder), "message"))


@register(f"WITH {NUMBERED_SQL} SELECT u1,u2,0::BIGINT AS bundle_id, {BUNDLE_OUT_SQL} FROM o WHERE back<=5 GROUP BY 1,2")
def trailing_bundles(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle_digest(bundling.trailing_bundle(pairs(spark, folder), 5))


def _streamed_bundles(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The message view in two deliveries, the stream stopped between them and started again from its checkpoint."""
    root = scratch_path(spark, "bundles")
    rows = pairs(spark, folder)
    for part in (old_part(rows), new_part(rows)):
        part.write.mode("append").parquet(f"{root}/messages")
        arriving = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1_000).parquet(f"{root}/messages")
        found = bundle_stream.run_bundles(arriving, 4, 5, root)
    found = found.filter(F.col("kind") == kind).withColumns({c: F.col(c).cast("bigint") for c in PAIR})
    return _bundle_digest(found)


@register(f"WITH {NUMBERED_SQL} SELECT u1,u2,(rn-1)//4 AS bundle_id, {BUNDLE_OUT_SQL} FROM o GROUP BY 1,2,3")
def count_bundles_streamed(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed_bundles(spark, folder, "count")


@register(f"WITH {NUMBERED_SQL} SELECT u1,u2,0::BIGINT AS bundle_id, {BUNDLE_OUT_SQL} FROM o WHERE back<=5 GROUP BY 1,2")
def trailing_bundles_streamed(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed_bundles(spark, folder, "trailing")


@register(
    f"""WITH {MESSAGES_SQL}, b AS (SELECT u1,u2,us//86400000000 AS bundle_id, string_agg(text, chr(10) ORDER BY us,msg_id) AS t
      FROM p GROUP BY 1,2,3)
    SELECT u1,u2,bundle_id, length(t)>2000 AS shortened, length(substr(t,1,2000)) AS chars, sha256(substr(t,1,2000)) AS digest FROM b"""
)
def shortened_bundles(spark: SparkSession, folder: str) -> DataFrame:
    cut = bundling.shorten(bundling.bundles(pairs(spark, folder), "daily"), 2000)
    return cut.select(*bundling.BUNDLE, "shortened", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"))


# --- scoring -----------------------------------------------------------------------------


@register(
    f"""WITH {MESSAGES_SQL} SELECT msg_id, sha256(chr(10) || 'On a scale of 1 to 10, rate how closely this message bundle relates to the topic of '
      || 'Formula 1' || ' (1 = completely unrelated, 10 = directly about it). Respond with only the integer score.' || chr(10)
      || 'Message bundle: ' || text || chr(10)) AS prompt_key FROM p"""
)
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("msg_id", F.sha2(scoring.render_prompt(F.col("text"), TOPIC), 256).alias("prompt_key"))


@register(f"WITH {MESSAGES_SQL} SELECT msg_id, {SCORE_SQL} AS score, sha256(text) AS text_key FROM p")
def word_scores(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("msg_id", scoring.word_score(F.col("text")).alias("score"), scoring.content_key(F.col("text")).alias("text_key"))


ANSWER_SQL = """CASE turn%6 WHEN 0 THEN ' ' || turn || ' ' WHEN 1 THEN '+' || (conv_id%12) WHEN 2 THEN '-' || turn
    WHEN 3 THEN turn || '/10' WHEN 4 THEN '8.5' ELSE left(text, 1) END"""


@register(
    f"""WITH a AS (SELECT conv_id, turn, trim({ANSWER_SQL}) AS raw FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN greatest(1, least(10, raw::BIGINT)) ELSE 5 END AS INTEGER) AS score FROM a"""
)
def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of many shapes made from the table, parsed and clamped."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id")
    kind = F.col("turn") % 6
    answer = (
        F.when(kind == 0, F.concat(F.lit(" "), turn, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("+"), (conv % 12).cast("string")))
        .when(kind == 2, F.concat(F.lit("-"), turn))
        .when(kind == 3, F.concat(turn, F.lit("/10")))
        .when(kind == 4, F.lit("8.5"))
        .otherwise(F.left("text", F.lit(1)))
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", scoring.parse_score(answer).alias("score"))


def _rating_answerer():
    """Stands in for a served model: rates a prompt by the blanks in its message."""

    def answer(batch):
        return [str(len(p.split("Message bundle: ", 1)[1].rstrip("\n").split(" ")) // 4) for p in batch]

    return answer


RATED_SQL = "CAST(greatest(1, least(10, len(string_split({t}, ' '))//4)) AS INTEGER)"


@register(
    f"""WITH {MESSAGES_SQL}, s AS (SELECT u1,u2,sha256(text) AS k, {RATED_SQL.format(t="rtrim(text, chr(10))")} AS score, {WEIGHT_SQL} AS w FROM p), {chats_sql()}
    SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum FROM c"""
)
def prompted_chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Chat sums through the memoised prompt scorer (a stand-in answers offline)."""
    settings = jobs.ScoringSettings(topic=TOPIC, scorer=scorer.PromptScorer(_rating_answerer, "stand-in"))
    sums = jobs.process_history(pairs(spark, folder), settings, AS_OF, scratch_path(spark, "cache"))
    return sums.select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum"))


@register(
    f"""WITH {NUMBERED_SQL}, b AS (SELECT u1,u2,(rn-1)//3 AS bundle_id, string_agg(text, chr(10) ORDER BY us,msg_id) AS t,
      count(*) AS n_messages, (sum(us)//count(*))::BIGINT AS mean_us FROM o GROUP BY 1,2,3)
    SELECT u1,u2,bundle_id,n_messages,mean_us,{RATED_SQL.format(t="rtrim(t, chr(10))")} AS score FROM b"""
)
def prompted_bundles(spark: SparkSession, folder: str) -> DataFrame:
    bundled = bundling.with_key(bundling.bundles(pairs(spark, folder), "count", 3))
    rated = scorer.score_bundles(bundled, scorer.PromptScorer(_rating_answerer, "stand-in"), TOPIC, scratch_path(spark, "cache"))
    return rated.select(*bundling.BUNDLE, "n_messages", "mean_us", "score")


@register(
    f"""WITH {MESSAGES_SQL}, {SPLIT_SQL}, k AS (SELECT sha256(text) AS k, count(*) AS n FROM (SELECT text FROM p UNION ALL SELECT text FROM old) GROUP BY 1),
    h AS (SELECT *, k IN (SELECT sha256(text) FROM old) AS known FROM k)
    SELECT sum(n)::BIGINT AS bundles, count(*) AS distinct_texts, count(*) FILTER (known) AS hits, count(*) FILTER (NOT known) AS misses,
      (sum(n) - count(*) FILTER (NOT known))::BIGINT AS calls_saved FROM h"""
)
def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The old part is scored first; then the whole view and a replay of the old part meet the cache."""
    rows = bundling.with_key(bundling.bundles(pairs(spark, folder), "message"))
    old = bundling.with_key(bundling.bundles(old_part(pairs(spark, folder)), "message"))
    cached = scorer.score_missing(old, scorer.WordListScorer(), TOPIC, scratch_path(spark, "cache"))
    return scorer.cache_report(rows.unionByName(old), cached)


def _yes_no_answerer():
    def answer(batch):
        bodies = [p.split("'No': ", 1)[1] for p in batch]
        return [" YES " if "the" in b.split(" ") else "No" for b in bodies]

    return answer


@register(f"WITH {MESSAGES_SQL} SELECT msg_id, u1, u2 FROM p WHERE list_contains(string_split(text, ' '), 'the')")
def on_topic_messages(spark: SparkSession, folder: str) -> DataFrame:
    return scorer.on_topic(pairs(spark, folder), _yes_no_answerer, TOPIC).select("msg_id", *PAIR)


CENTROID_SQL = """flat AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings),
cent AS (SELECT label, i, avg(v) AS v FROM flat GROUP BY label, i),
clist AS (SELECT label, list(v ORDER BY i) AS c FROM cent GROUP BY label)"""


@register(
    f"""WITH {CENTROID_SQL}, t AS (SELECT c FROM clist WHERE label=0),
    q AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT c FROM t)) AS sim FROM embeddings)
    SELECT vec_id, round(sim,6) AS similarity, round(1+9*greatest(0,sim),6) AS score FROM q"""
)
def cosine_topic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity to the mean vector of class 0, as a cheap topic score."""
    vectors = table(spark, folder, "embeddings")
    topic = class_means(vectors, "embedding", "label").filter("label = 0").select("mean")
    return scorer.cosine_scores(vectors, topic).select("vec_id", *r6("similarity", "score"))


# --- decayed sums ------------------------------------------------------------------------


@register(
    f"""{CHATS_SQL} SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum,
    {SCORE_OUT_SQL} AS raw_score, round(CASE WHEN weight_sum>0 THEN weighted_sum/weight_sum ELSE 0 END,1) AS score FROM c"""
)
def chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: decayed, thresholded topic score of every chat."""
    scored = relevance.with_score(chat_state(spark, folder))
    return scored.select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"), "score")


@register(
    f"""WITH {SCORED_SQL}, {chats_sql(10)} SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum, {SCORE_OUT_SQL} AS raw_score FROM c"""
)
def strict_chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold 10: chats without a qualifying message keep a zero row."""
    scored = relevance.with_score(chat_state(spark, folder, 10))
    return scored.select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"))


@register(
    f"""{CHATS_SQL} SELECT round(sum(weighted_sum),6) AS weighted_sum, round(sum(weight_sum),6) AS weight_sum,
    round(sum(weighted_sum)/sum(weight_sum),6) AS raw_score FROM c"""
)
def overall_score(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.overall(chat_state(spark, folder)).select(*r6("weighted_sum", "weight_sum", "raw_score"))


USERS_SQL = """x AS (SELECT u1 AS "user", weighted_sum, weight_sum FROM c UNION ALL SELECT u2, weighted_sum, weight_sum FROM c WHERE u1<>u2),
u AS (SELECT "user", sum(weighted_sum) AS weighted_sum, sum(weight_sum) AS weight_sum FROM x GROUP BY 1)"""


@register(f"""{CHATS_SQL}, {USERS_SQL} SELECT "user", round(weighted_sum,6) AS weighted_sum, round(weight_sum,6) AS weight_sum, {SCORE_OUT_SQL} AS raw_score FROM u""")
def user_scores(spark: SparkSession, folder: str) -> DataFrame:
    users = relevance.with_score(relevance.user_sums(chat_state(spark, folder)))
    return users.select("user", *r6("weighted_sum", "weight_sum", "raw_score"))


@register(f"""{CHATS_SQL}, {USERS_SQL.replace(" WHERE u1<>u2", "")} SELECT "user", round(weighted_sum,6) AS weighted_sum, round(weight_sum,6) AS weight_sum FROM u""")
def user_scores_self_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Parity flag: a self-chat counts twice for its user."""
    return relevance.user_sums(chat_state(spark, folder), count_self_twice=True).select("user", *r6("weighted_sum", "weight_sum"))


@register(
    f"""{CHATS_SQL} SELECT 'chat' AS level, u1 || '-' || u2 AS chat, round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum FROM c
    UNION ALL SELECT 'overall', '',round(sum(weighted_sum),6),round(sum(weight_sum),6) FROM c"""
)
def score_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.levels(chat_state(spark, folder))
    return rows.select("level", F.concat_ws("-", "u1", "u2").alias("chat"), *r6("weighted_sum", "weight_sum"))


@register(f"WITH {SCORED_SQL} SELECT msg_id, round(({AS_OF_SQL}-us)/86400000000.0,6) AS age_days, round(w,6) AS weight, score>=3 AS counts FROM s")
def message_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = message_scores(spark, folder)
    us = decay.micros("ts")
    return rows.select(
        "msg_id", F.round(decay.age_days(us, AS_OF), 6).alias("age_days"),
        F.round(decay.weight(us, AS_OF, HALF_LIFE), 6).alias("weight"), (F.col("score") >= scoring.MIN_SCORE).alias("counts"),
    )


MID_SQL = "epoch_us(TIMESTAMP '2024-01-15 00:00:00')"


@register(
    f"""WITH {MESSAGES_SQL}, a AS (SELECT msg_id, ({MID_SQL}-us)/86400000000.0 AS age FROM p)
    SELECT msg_id, round(exp(-ln(2)/7*age),6) AS plain, round(exp(-ln(2)/7*greatest(age,0)),6) AS clamped FROM a"""
)
def future_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Ages seen from the middle of the data: later messages weigh more than 1 unless clamped."""
    us, mid = decay.micros("ts"), decay.to_micros("2024-01-15T00:00:00")
    return pairs(spark, folder).select(
        "msg_id", F.round(decay.weight(us, mid, HALF_LIFE), 6).alias("plain"),
        F.round(decay.weight(us, mid, HALF_LIFE, clamp_future=True), 6).alias("clamped"),
    )


def _bundle_chats_sql(grouping: str, source: str) -> str:
    return f"""b AS (SELECT u1,u2,{grouping} AS bundle_id, string_agg(text, chr(10) ORDER BY us,msg_id) AS text, count(*) AS n,
      (sum(us)//count(*))::BIGINT AS us FROM {source} GROUP BY 1,2,3),
    s AS (SELECT *, {SCORE_SQL} AS score, {WEIGHT_SQL} AS w FROM b),
    c AS (SELECT u1,u2,sum(n)::BIGINT AS n_messages, sum(CASE WHEN score>=3 THEN score*w ELSE 0 END) AS weighted_sum,
      sum(CASE WHEN score>=3 THEN w ELSE 0 END) AS weight_sum FROM s GROUP BY u1,u2)
    SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum,{SCORE_OUT_SQL} AS raw_score FROM c"""


@register(f"WITH {NUMBERED_SQL}, {_bundle_chats_sql('(rn-1)//3', 'o')}")
def count_bundle_chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Chat scores over bundles of three; the twin scores the joined text."""
    sums = relevance.chat_sums(bundle_rows(spark, folder, "count", 3))
    return relevance.with_score(sums).select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"))


@register(f"WITH {MESSAGES_SQL}, {_bundle_chats_sql('us//86400000000', 'p')}")
def day_bundle_chat_scores(spark: SparkSession, folder: str) -> DataFrame:
    sums = relevance.chat_sums(bundle_rows(spark, folder, "daily"))
    return relevance.with_score(sums).select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"))


@register(
    f"""WITH {SCORED_SQL}, n AS (SELECT u1,u2,msg_id,score,row_number() OVER (PARTITION BY u1,u2 ORDER BY msg_id DESC)-1 AS age FROM s),
    z AS (SELECT u1,u2,score,exp(-ln(2)/10*age) AS w FROM n), {chats_sql(source="z")}
    SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum FROM c"""
)
def position_decay(spark: SparkSession, folder: str) -> DataFrame:
    """No times: the place counted from the end is the age, halving every ten messages."""
    rows = message_scores(spark, folder).drop("text", "ts").withColumn("n_messages", F.lit(1).cast("bigint"))
    return relevance.chat_sums(relevance.position_weighted(rows, 10)).select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum"))


@register(
    f"""WITH {SCORED_SQL}, q AS (SELECT *, us < {AS_OF_SQL}-45*86400000000 AS old FROM s),
    keep AS (SELECT u1,u2,us AS mean_us,score::DOUBLE AS score,w AS weight,1::BIGINT AS n_messages,false AS condensed FROM q WHERE NOT old),
    f AS (SELECT u1,u2,(sum(us)//count(*))::BIGINT AS mean_us, sum(CASE WHEN score>=3 THEN score*w ELSE 0 END) AS a,
       sum(CASE WHEN score>=3 THEN w ELSE 0 END) AS b, count(*) AS n FROM q WHERE old GROUP BY u1,u2)
    SELECT u1,u2,mean_us,round(score,6) AS score,round(weight,6) AS weight,n_messages,condensed FROM keep
    UNION ALL SELECT u1,u2,mean_us,round(CASE WHEN b>0 THEN a/b ELSE 0 END,6),round(b,6),n,true FROM f"""
)
def condensed_history(spark: SparkSession, folder: str) -> DataFrame:
    """Messages older than 45 days folded into one averaged row per chat."""
    rows = relevance.condense(bundle_rows(spark, folder), AS_OF, 45)
    return rows.select(*PAIR, "mean_us", *r6("score", "weight"), "n_messages", "condensed")


# --- incremental updates -----------------------------------------------------------------

UPDATED_SQL = f"{CHATS_SQL} SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum FROM c"
OLD_AS_OF = decay.to_micros("2024-01-25T00:00:00")


def _state_before(spark: SparkSession, folder: str) -> DataFrame:
    old = relevance.additive_bundle_scores(old_part(pairs(spark, folder)), "message")
    return relevance.as_state(relevance.chat_sums(relevance.weighted(old, OLD_AS_OF, HALF_LIFE)), OLD_AS_OF)


@register(UPDATED_SQL)
def update_by_addition(spark: SparkSession, folder: str) -> DataFrame:
    """Stored sums faded, new messages added: must equal the full run."""
    new = relevance.additive_bundle_scores(new_part(pairs(spark, folder)), "message")
    state = incremental.add_scored(_state_before(spark, folder), new, AS_OF, HALF_LIFE)
    return state.select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum"))


@register(UPDATED_SQL)
def update_by_recompute(spark: SparkSession, folder: str) -> DataFrame:
    """Chats with new messages recomputed, the others faded: must equal the full run."""
    rows = pairs(spark, folder)
    state = incremental.recompute_affected(
        rows, new_part(rows), _state_before(spark, folder),
        lambda touched: relevance.additive_bundle_scores(touched, "message"), AS_OF, HALF_LIFE,
    )
    return state.select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum"))


@register(UPDATED_SQL)
def update_by_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Messages arriving as a stream, added to versioned state: must equal the full run."""
    state = decayed_stream.run_chats(message_stream(spark, folder), AS_OF, HALF_LIFE, scratch_path(spark, "stream"))
    names = F.col("u1").cast("bigint"), F.col("u2").cast("bigint")
    return state.select(F.least(*names).alias("u1"), F.greatest(*names).alias("u2"), "n_messages", *r6("weighted_sum", "weight_sum"))


@register(f"WITH {MESSAGES_SQL}, {_bundle_chats_sql('us//86400000000', 'p')}")
def update_by_recompute_daily(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder)
    by_day = lambda part: relevance.additive_bundle_scores(part, "daily")
    old = relevance.chat_sums(relevance.weighted(by_day(old_part(rows)), OLD_AS_OF, HALF_LIFE))
    state = incremental.recompute_affected(
        rows, new_part(rows), relevance.as_state(old, OLD_AS_OF), by_day, AS_OF, HALF_LIFE
    )
    return relevance.with_score(state).select(*PAIR, "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"))


@register(
    f"""{CHATS_SQL} SELECT round(sum(weighted_sum),6) AS weighted_sum, round(sum(weight_sum),6) AS weight_sum,
    round(sum(weighted_sum)/sum(weight_sum),6) AS raw_score FROM c"""
)
def overall_by_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Overall sums moved by what the touched chats gained, all at one moment."""
    before = relevance.state_at(_state_before(spark, folder), AS_OF, HALF_LIFE)
    new = relevance.additive_bundle_scores(new_part(pairs(spark, folder)), "message")
    after = incremental.add_scored(_state_before(spark, folder), new, AS_OF, HALF_LIFE)
    touched = keys.affected_chats(new)
    moved = incremental.overall_delta(
        relevance.overall(before), keys.messages_of(before, touched), keys.messages_of(after, touched)
    )
    return moved.select(*r6("weighted_sum", "weight_sum", "raw_score"))


LATER_SQL = AS_OF_SQL.replace("03-01", "03-11")


@register(
    f"""{CHATS_SQL}, d AS (SELECT exp(-ln(2)/7*10) AS k) SELECT u1,u2,round(weighted_sum*k,6) AS weighted_sum,round(weight_sum*k,6) AS weight_sum,
    {SCORE_OUT_SQL} AS raw_score FROM c, d"""
)
def faded_state(spark: SparkSession, folder: str) -> DataFrame:
    """Stored sums seen ten days later: sums shrink, the ratio stays."""
    state = relevance.as_state(chat_state(spark, folder), AS_OF)
    later = relevance.state_at(state, "2024-03-11T00:00:00", HALF_LIFE)
    return relevance.with_score(later).select(*PAIR, *r6("weighted_sum", "weight_sum", "raw_score"))


@register(
    f"""{CHATS_SQL}, d AS (SELECT exp(-ln(2)/7*10) AS k) SELECT round(sum(weighted_sum*k),6) AS weighted_sum, round(sum(weight_sum*k),6) AS weight_sum,
    round(sum(weighted_sum)/sum(weight_sum),6) AS raw_score FROM c, d"""
)
def faded_overall(spark: SparkSession, folder: str) -> DataFrame:
    state = relevance.as_state(chat_state(spark, folder), AS_OF)
    return incremental.overall_at(state, "2024-03-11T00:00:00", HALF_LIFE).select(*r6("weighted_sum", "weight_sum", "raw_score"))


@register(f"{CHATS_SQL} SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum,{SCORE_OUT_SQL} AS raw_score FROM c")
def first_run_job(spark: SparkSession, folder: str) -> DataFrame:
    """The whole first-run job, read back from its stored state."""
    result = jobs.first_run(messages(spark, folder, True), jobs.ScoringSettings(), AS_OF, scratch_path(spark, "state"))
    chats = result.chats.select(F.col("u1").cast("bigint"), F.col("u2").cast("bigint"), "n_messages", "weighted_sum", "weight_sum", "raw_score")
    low, high = F.least("u1", "u2"), F.greatest("u1", "u2")
    return chats.select(low.alias("u1"), high.alias("u2"), "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"))


@register(f"""{CHATS_SQL}, {USERS_SQL} SELECT "user", {SCORE_OUT_SQL} AS raw_score FROM u""")
def daily_run_job(spark: SparkSession, folder: str) -> DataFrame:
    """First run on the old part, daily run with the new part, users from the new state."""
    root, settings = scratch_path(spark, "state"), jobs.ScoringSettings()
    rows = messages(spark, folder, True)
    jobs.first_run(old_part(rows), settings, OLD_AS_OF, root)
    result = jobs.daily_run(old_part(rows), new_part(rows), settings, AS_OF, root)
    return result.users.select(F.col("user").cast("bigint").alias("user"), *r6("raw_score"))


@register(f"{CHATS_SQL} SELECT u1,u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum,{SCORE_OUT_SQL} AS raw_score FROM c")
def daily_run_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The daily run over a message store, of which it reads the touched buckets; a day given twice changes nothing."""
    root, store, settings = scratch_path(spark, "state"), scratch_path(spark, "messages"), jobs.ScoringSettings()
    rows = messages(spark, folder, True)
    jobs.stored_first_run(old_part(rows), settings, OLD_AS_OF, store, root)
    jobs.stored_daily_run(new_part(rows), settings, AS_OF, store, root)
    chats = jobs.stored_daily_run(new_part(rows), settings, AS_OF, store, root).chats
    chats = chats.select(F.col("u1").cast("bigint"), F.col("u2").cast("bigint"), "n_messages", "weighted_sum", "weight_sum", "raw_score")
    low, high = F.least("u1", "u2"), F.greatest("u1", "u2")
    return chats.select(low.alias("u1"), high.alias("u2"), "n_messages", *r6("weighted_sum", "weight_sum", "raw_score"))


# --- missing values ----------------------------------------------------------------------

GAPS_SQL = f"""{MESSAGES_SQL},
g AS (SELECT msg_id, sender, CASE WHEN msg_id%11<>0 THEN receiver END AS receiver, CASE WHEN msg_id%7<>0 THEN text END AS text, us FROM m),
gp AS (SELECT least(sender,receiver) AS u1, CASE WHEN receiver IS NOT NULL THEN greatest(sender,receiver) END AS u2, coalesce(text,'') AS text, us FROM g)"""


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed messages, some without a text or a receiver."""
    rows = messages(spark, folder).withColumns({
        "receiver": F.when(F.col("msg_id") % 11 != 0, F.col("receiver")), "text": F.when(F.col("msg_id") % 7 != 0, F.col("text")),
    })
    return with_pair(rows)


@register(
    f"""WITH {GAPS_SQL}, s AS (SELECT *, {SCORE_SQL} AS score, {WEIGHT_SQL} AS w FROM gp), {chats_sql()}
    SELECT u1,coalesce(u2,-1) AS u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum FROM c"""
)
def chat_scores_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.weighted(relevance.additive_bundle_scores(_gaps(spark, folder), "message"), AS_OF, HALF_LIFE)
    return relevance.chat_sums(rows).select("u1", F.coalesce("u2", F.lit(-1)).alias("u2"), "n_messages", *r6("weighted_sum", "weight_sum"))


@register(
    f"""WITH {GAPS_SQL}, s AS (SELECT u1, u2, {RATED_SQL.format(t="rtrim(text, chr(10))")} AS score, {WEIGHT_SQL} AS w FROM gp), {chats_sql()}
    SELECT u1,coalesce(u2,-1) AS u2,n_messages,round(weighted_sum,6) AS weighted_sum,round(weight_sum,6) AS weight_sum FROM c"""
)
def prompted_scores_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    settings = jobs.ScoringSettings(topic=TOPIC, scorer=scorer.PromptScorer(_rating_answerer, "stand-in"))
    sums = jobs.process_history(_gaps(spark, folder), settings, AS_OF, scratch_path(spark, "cache"))
    return sums.select("u1", F.coalesce("u2", F.lit(-1)).alias("u2"), "n_messages", *r6("weighted_sum", "weight_sum"))


# --- events: forward decay and streaming -------------------------------------------------

EVENTS_SQL = """e AS (SELECT user_id, CAST(greatest(1, least(10, coalesce(floor(value), 0))) AS INTEGER) AS score, epoch_us(ts) AS us FROM events),
w AS (SELECT *, exp(-ln(2)/7*(epoch_us(TIMESTAMP '2024-02-01 00:00:00')-us)/86400000000.0) AS w FROM e)"""
EVENT_USERS_SQL = f"""WITH {EVENTS_SQL} SELECT user_id, round(sum(CASE WHEN score>=3 THEN score*w ELSE 0 END),6) AS weighted_sum,
  round(sum(CASE WHEN score>=3 THEN w ELSE 0 END),6) AS weight_sum, count(*) AS n FROM w GROUP BY user_id"""


@register(EVENT_USERS_SQL)
def event_user_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Backward decay of events per user."""
    rows = event_scores(spark, folder)
    wt = decay.weight(decay.micros("ts"), EVENTS_AS_OF, HALF_LIFE)
    return rows.groupBy("user_id").agg(
        *relevance.qualifying_sums(F.col("score"), wt, scoring.MIN_SCORE), F.count(F.lit(1)).alias("n")
    ).select("user_id", *r6("weighted_sum", "weight_sum"), "n")


@register(EVENT_USERS_SQL.replace("FROM events)", "FROM (SELECT user_id, ts, CASE WHEN event_id%7<>0 THEN value END AS value FROM events))"))
def event_user_sums_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events, some without a value."""
    rows = scored_events(table(spark, folder, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))))
    wt = decay.weight(decay.micros("ts"), EVENTS_AS_OF, HALF_LIFE)
    return rows.groupBy("user_id").agg(
        *relevance.qualifying_sums(F.col("score"), wt, scoring.MIN_SCORE), F.count(F.lit(1)).alias("n")
    ).select("user_id", *r6("weighted_sum", "weight_sum"), "n")


@register(EVENT_USERS_SQL)
def event_user_sums_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The same sums by forward decay, scaled back once per user."""
    sums = decayed_stream.forward_sums(event_scores(spark, folder), "user_id", HALF_LIFE)
    return decayed_stream.read_at(sums, "user_id", EVENTS_AS_OF, HALF_LIFE).select("user_id", *r6("weighted_sum", "weight_sum"), "n")


@register(EVENT_USERS_SQL)
def event_user_sums_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The same sums kept by a stream over the events file."""
    sums = decayed_stream.run_sums(event_stream(spark, folder), "user_id", HALF_LIFE, scratch_path(spark, "stream"))
    return decayed_stream.read_at(sums, "user_id", EVENTS_AS_OF, HALF_LIFE).select("user_id", *r6("weighted_sum", "weight_sum"), "n")


@register(
    f"""WITH {EVENTS_SQL}, d AS (SELECT user_id, us//86400000000 AS day, sum(score)::BIGINT AS score_sum, count(*) AS n FROM e GROUP BY 1,2)
    SELECT * FROM d"""
)
def event_days_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Day bundles of a stream, days that are still open too."""
    return decayed_stream.run_days(event_stream(spark, folder), "user_id", scratch_path(spark, "stream"))
