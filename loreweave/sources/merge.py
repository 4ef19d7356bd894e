"""A table in hash buckets, of which a merge rewrites only those that it touches.

``<folder>/data/at=<version>/bucket=<b>`` holds the rows of a bucket as a version wrote
them, and ``<folder>/manifest/version=<version>`` which version of each bucket counts: one
file, there or not, so readers see whole versions only, also while one is being written.
Writing a version again, after a failure, starts from what stood before it and
replaces what was left of it.  ``<folder>/staged`` has the new rows of the last merge,
``<folder>/values`` their values of one column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Fold = Callable[[DataFrame], DataFrame]
MANIFEST = "bucket int, at long, version long"
FEW_VALUES = 1_000_000  # short values that are sent to every executor


def latest(key: list[str], order: list[str]) -> Fold:
    """The last row of each key by ``order``; of rows alike in it, a new one."""

    def fold(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*key, "_new")]
        won = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order, "_new")).alias("_row"))
        return won.select(*key, *[F.col(f"_row.{c}").alias(c) for c in values])

    return fold


def total(key: list[str], value: str) -> Fold:
    """The sum of ``value`` for each key."""
    return lambda rows: rows.groupBy(*key).agg(F.sum(value).alias(value))


def once(key: list[str]) -> Fold:
    """Each key once."""
    return lambda rows: rows.select(*key).distinct()


@dataclass(frozen=True)
class BucketTable:
    """``key`` columns choose the bucket; ``buckets`` stays as it is for the life of the table.

    ``within`` may name a column of the key that few values of come in one merge.
    """

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    buckets: int = 64
    within: str | None = None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket, as of the newest version (below ``before``)."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", "true").schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            rows = rows.where(F.col("version") < before)
        newest = rows.agg(F.max("version")).first()[0]
        return {} if newest is None else {r.bucket: r.at for r in rows.where(F.col("version") == newest).collect()}  # one row for each bucket

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The rows as of the newest version (below ``before``), or of some buckets; None if there are none."""
        paths = [f"{self.folder}/data/at={at}/bucket={b}" for b, at in sorted(self.manifest(before).items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def _apart(self, rows: DataFrame, old: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """``old`` by whether a row of ``rows`` has its value of ``column``; all of it if they have too many values to be sent."""
        values = rows.select(F.col(column).alias("_value")).distinct()
        path = f"{self.folder}/values"
        values.write.mode("overwrite").option("compression", "zstd").parquet(path)
        values = self.spark.read.schema(values.schema).parquet(path)
        if values.count() > FEW_VALUES:
            return old, old.limit(0)
        same, values = F.col(column).eqNullSafe(F.col("_value")), F.broadcast(values)
        return old.join(values, same, "left_semi"), old.join(values, same, "left_anti")

    def merge(self, rows: DataFrame, version: int, fold: Fold) -> set[int]:
        """Folds ``rows`` (``_new`` = 1) and the rows of their buckets (0) into a new version; returns the buckets.

        ``fold`` keeps a row of every key.  Versions grow, and a version is written by one
        writer at a time.  Old rows that no new row meets ``within`` are written anew, but not
        dealt for the fold.
        """
        # Written, not cached: it is read for the buckets and for the fold, and may be larger than memory.
        staged, schema = f"{self.folder}/staged", rows.schema
        rows.write.mode("overwrite").option("compression", "zstd").parquet(staged)
        rows = self.spark.read.schema(schema).parquet(staged)
        touched = {r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()}
        if not touched:
            return touched
        old = self.read(version, touched)
        both, others = rows.withColumn("_new", F.lit(1)), None
        if old is not None:
            if self.within is not None:
                old, others = self._apart(rows, old, self.within)
            both = both.unionByName(old.withColumn("_new", F.lit(0)))
        # The fold deals rows by their keys, so every task has rows of any bucket: a large one is written by several.
        folded = fold(both).drop("_new")
        if others is not None:
            folded = folded.unionByName(others)
        folded = folded.withColumn("bucket", self._bucket())
        folded.write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/data/at={version}")
        now = self.manifest(version) | {b: version for b in touched}
        listed = self.spark.createDataFrame([(b, at, version) for b, at in sorted(now.items())], MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return touched
