"""A bucket with many rows is written by several tasks."""

from pathlib import Path

from pyspark.sql import functions as F

from loreweave.sources.merge import BucketTable, once


def test_large_bucket_in_several_files(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "100k")
    try:
        store = BucketTable(spark, str(tmp_path / "t"), ("id",), buckets=1)
        store.merge(spark.range(0, 200_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("id")), 0, once(["id"]))
    finally:
        spark.conf.set(name, before)
    assert len(list(Path(tmp_path / "t/data/at=0/bucket=0").glob("*.parquet"))) > 1
    assert store.read().distinct().count() == store.read().count() == 200_000
