"""Session helpers: construction for local runs, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loreweave", cores: str = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own.  ``shared`` is its checkpoint folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="loreweave-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` gets one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so that several consumers read the result.

    Used for narrow tables extracted from file text: without it every consumer
    would scan and match the text again.  Readers get column pruning and statistics.
    """
    path = f"{shared_dir(df.sparkSession)}/loreweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
