"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join on the
node, so no neighbourhood is ever collected; the edges of a step are written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreweave.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node of ``edges`` (``u, v``: alike, orderable).

    Nulls and loops carry no link; repeated edges count once.
    """
    links = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = larger.join(least, "u")
        smaller = joined.select("u", F.col("m").alias("v")).unionAll(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = written(smaller.distinct(), "links")
