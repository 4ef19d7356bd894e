"""Job status: current state and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreweave.operators.ordered import with_running


def job_current(events: DataFrame) -> DataFrame:
    """Latest status, progress and message of each job."""
    latest = events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress", "message"), "seq").alias("s")
    )
    return latest.select("job_id", "s.status", "s.progress", "s.message")


def progress_monotone(events: DataFrame) -> DataFrame:
    """Scanner progress scaled into 30..50, never falling.  Events without progress are left out."""
    shown = events.where("p > 0")
    # Whole-number form of 30 + (p - 10) / 35 * 20, cut toward zero.
    scaled = F.when(F.col("p") >= 10, F.lit(30) + ((F.col("p") - 10) / 35 * 20).cast("int")).otherwise(30)
    out = with_running(shown, ["job_id"], "seq", {"top": (F.least(scaled, F.lit(50)), "max")})
    return out.select("job_id", "seq", F.greatest(F.col("top"), F.lit(30)).alias("progress"))


def progress_domains(results: DataFrame) -> DataFrame:
    """Progress after each domain: from 50 in equal whole steps per success, at most 95."""
    folds = {"done": (F.col("success").cast("int"), "sum"), "domains": (F.lit(1), "sum")}
    out = with_running(results, ["job_id"], "pos", folds)
    step = (F.lit(45) / F.col("domains_total")).cast("int")
    progress = F.least(F.lit(95), F.lit(50) + step * F.col("done"))
    return out.select("job_id", "pos", progress.cast("int").alias("progress"))
