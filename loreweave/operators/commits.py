"""Commit history: the newest commits, batches and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import strip
from loreweave.operators.ordered import numbered
from loreweave.operators.skew import assemble


def commit_window(
    commits: DataFrame, n: int | None = None, sha_chars: int | None = None, diff_chars: int | None = None
) -> DataFrame:
    """Commits per repository, the newest first and numbered from 1.

    With limits only the newest ``n``, and the hash and difference cut to size.
    """
    if n is None:
        kept = numbered(commits, ["repo_id"], [F.desc("seq")], "rn")
    else:
        newest = Window.partitionBy("repo_id").orderBy(F.desc("seq"))
        kept = commits.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)

    def text(name: str, chars: int | None):
        whole = F.coalesce(name, F.lit(""))
        return (whole if chars is None else F.substring(whole, 1, chars)).alias(name)

    return kept.select(
        "repo_id",
        "seq",
        "rn",
        text("hexsha", sha_chars),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.coalesce(strip(F.col("message")), F.lit("")).alias("message"),
        text("diff", diff_chars),
    )


def commit_batches(window: DataFrame, size: int = K.COMMIT_BATCH) -> DataFrame:
    """Text of each batch of commits, newest first: ``repo_id, batch_id, digest``."""
    text = F.concat(
        F.lit("Commit: "), "hexsha", F.lit("\nAuthor: "), "author", F.lit("\nMessage: "), "message",
        F.lit("\nDiff:\n"), "diff", F.lit("\n\n"),
    )
    rows = window.select("repo_id", ((F.col("rn") - 1) / size).cast("int").alias("batch_id"), "rn", text.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rn", "text")))["text"]
    return rows.groupBy("repo_id", "batch_id").agg(F.array_join(ordered, "").alias("digest"))


def digest_rollup(batches: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Batch summaries of a repository in order, in parts; without a summary the offline sentence stands in.

    ``summaries``: ``repo_id, batch_id, reply``.
    """
    if summaries is None:
        rows = batches.withColumn("reply", F.lit(K.OFFLINE_SUMMARY))
    else:
        rows = batches.join(summaries, ["repo_id", "batch_id"], "left").withColumn(
            "reply", F.coalesce("reply", F.lit(K.OFFLINE_SUMMARY))
        )
    text = F.concat(F.lit("Batch "), F.col("batch_id") + 1, F.lit(" Summary:\n"), "reply")
    spaced = F.when(F.col("batch_id") > 0, F.concat(F.lit("\n"), text)).otherwise(text)
    return assemble(rows.withColumn("text", spaced), ["repo_id"], ["batch_id"], "text", "rollup")
