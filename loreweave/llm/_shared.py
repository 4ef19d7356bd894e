"""The folder that driver and executors share, and tables written there.

A written table cuts the lineage: a lost executor costs only the reading of it.
"""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid
from functools import lru_cache
from typing import Any, Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@lru_cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="loreweave-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loreweave-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a value; tasks call the result once.  Its classes travel with it: executors need not have the package."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs.

    Spark deletes them once the driver has collected the jobs' objects, which a large
    heap may put off for long; between steps with large shuffles that would add up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def packed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``_row`` (a struct of the columns to carry) and ``_text``, so that names can't clash."""
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    return df.select(carried.alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))


def unpacked(df: DataFrame, keep: list[str], results: list[str]) -> DataFrame:
    """Carried columns, then results; a carried column named like a result gives way to it."""
    taken = {r.lower() for r in results}
    carried = [F.col(f"_row.`{c}`").alias(c) for c in keep if c.lower() not in taken]
    return df.select(*carried, *results)
