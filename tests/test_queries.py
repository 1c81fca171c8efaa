"""Every registered query against its SQL on the smallest tables, and the shape of key plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canonical
from conftest import SF
from pyspark.sql import functions as F

from talkgauge.operators import prepare, relevance
from talkgauge.plans import chat_queries, text_queries
from talkgauge.plans import queries as own_queries
from talkgauge.plans.tables import pairs, table

QUERIES, SQL = own_queries.QUERIES, own_queries.TWINS


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = canonical(got), canonical(want)
    assert a.equals(b), a[(a != b).any(axis=1)].head()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", ["chat_scores", "user_scores", "day_bundle_chat_scores", "update_by_recompute", "score_levels", "event_user_sums",
                                  "copies_dropped", "class_distribution", "confusion_shares", "flow_report", "chat_matrix_cells"])
def test_native_plans_have_no_cartesian_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_chat_scores_shuffle_once_and_never_move_text(spark):
    text = plan(relevance.chat_sums(chat_queries.bundle_rows(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text
    exchange = text[: text.index("Exchange hashpartitioning")]
    assert "text#" not in exchange


def test_day_bundles_of_the_word_scorer_never_move_text(spark):
    text = plan(relevance.additive_bundle_scores(pairs(spark, SF), "daily"))
    assert text.count("Exchange") == 1 and "collect_list" not in text


def test_trailing_bundle_prunes_before_the_shuffle(spark):
    from talkgauge.operators.bundling import trailing_messages

    assert "WindowGroupLimit" in plan(trailing_messages(pairs(spark, SF), 5))


def test_split_labels_rows_without_a_shuffle_of_text(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    text = plan(prepare.split(docs, "doc_id", "lang"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text.split("BroadcastExchange")[0]


def test_cleaning_evaluates_the_chain_once(spark):
    text = plan(table(spark, SF, "documents").select(text_queries.tc.clean(F.col("text")).alias("t")))
    assert text.count("http") == 1 and text.count("ArrowEvalPython") == 1


def test_dropping_emptied_texts_does_not_clean_twice(spark):
    rows = prepare.cleaned(table(spark, SF, "documents").select("doc_id", "text"), keep_empty=False)
    text = plan(rows.select("doc_id", "text_cleaned"))
    assert text.count("ArrowEvalPython") == 1 and "Filter (" not in text


def test_scans_read_needed_columns_only(spark):
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in plan(QUERIES["pair_keys"](spark, SF))
    assert "ReadSchema: struct<lang:string>" in plan(QUERIES["class_imbalance"](spark, SF))
