"""Conversation history per thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loreweave.operators.ordered import with_running

PAGE = 64


def intent_history(intents: DataFrame, page: int = PAGE) -> DataFrame:
    """Each turn with the number of earlier turns and the earlier intents of its page.

    A thread of any length is cut into pages of ``page`` turns, so no row and no
    task holds more than a page.  The whole history of a turn is the pages before
    ``page_no`` (see :func:`history_pages`) followed by ``recent``.
    """
    ranked = with_running(intents, ["thread_id"], "turn", {"n": (F.lit(1), "sum")})
    rows = ranked.withColumn("n_prior", F.col("n") - 1).withColumn(
        "page_no", F.floor(F.col("n_prior") / page)
    )
    in_page = Window.partitionBy("thread_id", "page_no").orderBy("turn")
    earlier = in_page.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("recent", F.collect_list("intent").over(earlier)).select(
        "thread_id", "turn", "intent", "n_prior", "page_no", "recent"
    )


def history_pages(history: DataFrame, page: int = PAGE) -> DataFrame:
    """Full pages of each thread: ``thread_id, page_no, intents``."""
    full = history.where(F.col("n_prior") % page == page - 1)
    return full.select(
        "thread_id", "page_no", F.array_append("recent", F.col("intent")).alias("intents")
    )
