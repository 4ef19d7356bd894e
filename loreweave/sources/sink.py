"""Specification sink: last writer wins per identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(existing: DataFrame | None, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Latest row per key; rows of ``new`` beat rows of ``existing``, then the last by ``order``."""
    rows = new.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    values = [c for c in rows.columns if c not in (*key, "_new")]
    latest = rows.groupBy(*key).agg(
        F.max_by(F.struct(*values), F.struct("_new", *order)).alias("row")
    )
    return latest.select(*key, *[F.col(f"row.{c}").alias(c) for c in values])


def upsert_parts(existing: DataFrame | None, new: DataFrame, key: list[str], order: list[str], part: str) -> DataFrame:
    """Rows of the winning document per key, all its parts: ``new`` beats ``existing``, then the last by ``order``.

    The winner is chosen from keys and orders alone; texts meet it afterwards.
    """
    rows = new.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return winning_parts(key, order)(rows).drop("_new")


def winning_parts(key: list[str], order: list[str]):
    """All parts of the winning document of each key, new documents (``_new`` = 1) before old ones; a fold for merges."""

    def fold(rows: DataFrame) -> DataFrame:
        won = rows.groupBy(*key).agg(F.max(F.struct("_new", *order)).alias("_won"))
        return rows.join(won, key).where(F.struct("_new", *order) == F.col("_won")).drop("_won")

    return fold


def write_documents(docs: DataFrame, path: str, id_col: str, body: str) -> None:
    """Write rows as JSON lines, one object per specification."""
    docs.select(id_col, body).write.mode("overwrite").json(path)
