"""Tables behind the dashboard panels.  Drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions.decay import rate, to_micros
from talkgauge.functions.scoring import FLOW_MIN_SCORE, HISTOGRAM_BINS, MIN_SCORE, histogram_bin, score_band
from talkgauge.operators.keys import PAIR
from talkgauge.operators.scale import attach, order_rank


def top_chats(chats: DataFrame, n: int = 10) -> DataFrame:
    """Best chats with their label; ties go by name."""
    return (
        chats.select("u1", "u2", F.concat_ws("-", "u1", "u2").alias("label"), "raw_score", "score")
        .orderBy(F.desc("score"), "u1", "u2")
        .limit(n)
    )


def top_users(users: DataFrame, n: int = 15) -> DataFrame:
    return users.select("user", "raw_score", "score").orderBy(F.desc("score"), "user").limit(n)


def network_edges(chats: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    return chats.filter(F.col("u2").isNotNull() & (F.col("score") >= threshold)).select("u1", "u2", "score")


def network_nodes(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Users on a kept edge; drawn size grows with their score."""
    members = edges.select(F.explode(F.array("u1", "u2")).alias("user")).distinct()
    score = F.coalesce("score", F.lit(0.0))
    return members.join(users.select("user", "score"), "user", "left").select(
        "user", score.alias("score"), (F.lit(300) + F.lit(50) * score).alias("node_size")
    )


def matrix_cells(chats: DataFrame) -> DataFrame:
    """Symmetric matrix in tall form: only cells of existing chats; all others are 0."""
    pairs = chats.filter(F.col("u2").isNotNull()).select("u1", "u2", "score")
    swapped = pairs.filter(F.col("u1") != F.col("u2")).select(
        F.col("u2").alias("u1"), F.col("u1").alias("u2"), "score"
    )
    return pairs.unionByName(swapped).select(F.col("u1").alias("user"), F.col("u2").alias("other"), "score")


def matrix_wide(chats: DataFrame, max_users: int | None = None, names: list | None = None) -> DataFrame:
    """Matrix with zeros filled and one column for each of ``names``, by default for every user in a chat.

    A caller that can show only so many columns gives ``max_users`` and gets an error beyond it; ``matrix_cells`` has
    all cells as rows.
    """
    cells = matrix_cells(chats)
    if names is None:
        found = cells.select("other").distinct().orderBy("other")
        names = [r[0] for r in (found if max_users is None else found.limit(max_users + 1)).collect()]
    if max_users is not None and len(names) > max_users:
        raise ValueError(f"more than {max_users} users: use matrix_cells")
    return cells.groupBy("user").pivot("other", names).agg(F.max("score")).fillna(0.0)


def timeline(scored_messages: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    """Relevant messages over time; under bundling a message has its bundle's score."""
    return scored_messages.filter(F.col("score") >= threshold).select("msg_id", F.unix_micros("ts").alias("ts_us"), "score")


def flow_counts(scored_messages: DataFrame, threshold: int = FLOW_MIN_SCORE) -> DataFrame:
    """Relevant messages per pair; pairs without any do not appear."""
    return (
        scored_messages.filter(F.col("u2").isNotNull() & (F.col("score") >= threshold))
        .groupBy(*PAIR)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def node_index(users: DataFrame, column: str = "user") -> DataFrame:
    """0-based place of every user in sorted order; beyond one task's worth, ranked in cells."""
    distinct = users.select(column).distinct().withColumn("_all", F.lit(0))
    ranked = order_rank(distinct, ["_all"], column, column, "_rn")
    return ranked.select(column, (F.col("_rn") - 1).alias("idx"))


def flow_links(scored_messages: DataFrame, threshold: int = FLOW_MIN_SCORE) -> DataFrame:
    """Flow table with node numbers over all users of all pairs."""
    pairs = scored_messages.filter(F.col("u2").isNotNull()).select(*PAIR)
    index = node_index(pairs.select(F.explode(F.array("u1", "u2")).alias("user")))
    flows = flow_counts(scored_messages, threshold)
    source = index.select(F.col("user").alias("u1"), F.col("idx").alias("source"))
    target = index.select(F.col("user").alias("u2"), F.col("idx").alias("target"))
    linked = attach(attach(flows, source, "u1"), target, "u2")
    return linked.select("u1", "u2", "source", "target", "n")


def summary(chats: DataFrame, users: DataFrame, overall_row: DataFrame, scored_messages: DataFrame,
            threshold: float = MIN_SCORE) -> DataFrame:
    """One row of headline numbers; averages are 0 when there is nothing to average."""
    active = F.col("score") > 0
    chat_part = chats.agg(
        F.count_if(active).alias("active_chats"),
        F.coalesce(F.avg(F.when(active, F.col("score"))), F.lit(0.0)).alias("avg_chat_score"),
    )
    user_part = users.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg"))
    )
    message_part = scored_messages.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= threshold).alias("relevant"))
    )
    joined = (
        chat_part.withColumn("_u", user_part.scalar())
        .withColumn("_m", message_part.scalar())
        .withColumn("composite", overall_row.select("score").scalar())
    )
    rate_pct = F.when(F.col("_m.n") > 0, 100.0 * F.col("_m.relevant") / F.col("_m.n")).otherwise(0.0)
    return joined.select(
        "composite", "active_chats", F.col("_u.n").alias("users"), "avg_chat_score",
        F.col("_u.avg").alias("avg_user_score"), F.col("_m.n").alias("messages"),
        F.col("_m.relevant").alias("relevant_messages"), rate_pct.alias("relevance_rate"),
    )


def snapshot(chats: DataFrame, users: DataFrame, overall_row: DataFrame, as_of) -> DataFrame:
    """The daily log row."""
    active = F.col("score") > 0
    row = chats.agg(
        F.coalesce(F.avg(F.when(active, F.col("score"))), F.lit(0.0)).alias("chat_avg"),
        F.count_if(active).alias("active_chats"),
    )
    row = row.withColumn(
        "_u", users.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg"))).scalar()
    ).withColumn("_c", overall_row.select("score").scalar())
    return row.select(
        F.lit(to_micros(as_of)).alias("as_of_us"),
        F.coalesce("_c", F.lit(0.0)).alias("composite"),
        F.coalesce("_u.avg", F.lit(0.0)).alias("user_avg"),
        "chat_avg", "active_chats", F.col("_u.n").alias("active_users"),
    )


def trend(log: DataFrame) -> DataFrame:
    """The log in time order, missing scores as 0."""
    return log.select(
        "as_of_us",
        F.coalesce("composite", F.lit(0.0)).alias("composite"),
        F.coalesce("user_avg", F.lit(0.0)).alias("user_avg"),
    ).orderBy("as_of_us")


def histogram(chats: DataFrame) -> DataFrame:
    """Chats per bin, empty bins too."""
    own = chats.select(histogram_bin(F.col("score")).alias("bin"))
    counted = own.agg(*[F.count_if(F.col("bin") == name).alias(name) for _, name in HISTOGRAM_BINS])
    bins = F.array(*[F.struct(F.lit(name).alias("bin"), F.col(name).alias("n")) for _, name in HISTOGRAM_BINS])
    return counted.select(F.inline(bins))


def with_band(chats: DataFrame) -> DataFrame:
    return chats.withColumn("band", score_band(F.col("score")))


def decay_curve(spark: SparkSession, half_life_days: float = 7.0, days: int = 30) -> DataFrame:
    """Weight by age in whole days."""
    return spark.range(days + 1).select(
        F.col("id").alias("day"), F.exp(F.lit(-rate(half_life_days)) * F.col("id")).alias("weight")
    )


def double_count(users: DataFrame, overall_row: DataFrame) -> DataFrame:
    """Sum of user scores next to the overall score: shared chats count for both members."""
    return users.agg(F.sum("score").alias("sum_of_users"), F.count(F.lit(1)).alias("users")).withColumn(
        "overall_score", overall_row.select("score").scalar()
    )
