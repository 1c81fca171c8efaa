"""All registered queries."""

from talkgauge.plans import (  # noqa: F401  (register on import)
    chat_queries,
    data_queries,
    eval_queries,
    group_queries,
    history_queries,
    report_queries,
    text_queries,
)
from talkgauge.plans.chat_queries import chat_scores
from talkgauge.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS", "chat_scores"]
