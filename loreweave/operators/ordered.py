"""Ordered computations per key that stay bounded when one key holds most rows.

A plain window over a key puts all rows of that key into one task.  Here rows are
dealt by ranges of key and order, so chunks hold alike many rows whatever the order
values are; the table is written once, and what is carried from chunk to chunk of a
key is one row per chunk.  ``ties`` are further columns that fix the order of rows
with one order value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loreweave.session import materialise


def _chunked(df: DataFrame, by: list) -> DataFrame:
    """``df`` in ranges of ``by``, written once, with the number of each row's range."""
    return materialise(df.repartitionByRange(*by).withColumn("_chunk", F.spark_partition_id()))


def with_previous(df: DataFrame, keys: list[str], order: str, values: dict[str, str], ties: list[str] = []) -> DataFrame:
    """Add, per key, values of the preceding row; rows without one are dropped.

    ``values`` maps the new column to the column it is taken from.
    """
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(order, *ties)
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    packed = F.struct(*[F.col(src).alias(dst) for dst, src in values.items()])
    chunked = _chunked(df, [*keys, order, *ties])
    # The last row of a chunk is carried to the next chunk of the key; only its values travel.
    last = chunked.groupBy(*keys, "_chunk").agg(F.max_by(packed, F.struct(order, *ties)).alias("_carry"))
    carried = last.select(*keys, F.lead("_chunk").over(over_chunks).alias("_chunk"), "_carry").where("_chunk is not null")
    joined = chunked.withColumn("_prev", F.lag(packed).over(in_chunk)).join(carried, [*keys, "_chunk"], "left")
    out = joined.withColumn("_prev", F.coalesce(F.col("_prev"), F.col("_carry"))).where("_prev is not null")
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(c) for c in values])


def with_running(df: DataFrame, keys: list[str], order: str, folds: dict[str, tuple[Column, str]], ties: list[str] = []) -> DataFrame:
    """Add running sums or maxima per key, the current row included.

    ``folds`` maps the new column to (value, "sum" or "max").  For every sum a
    column ``<name>_total`` holds the sum over the whole key.
    """
    kinds = {"sum": F.sum, "max": F.max}
    upto = Window.partitionBy(*keys, "_chunk").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    chunked = _chunked(df, [*keys, order, *ties])
    sums = chunked.groupBy(*keys, "_chunk").agg(*[kinds[k](v).alias(n) for n, (v, k) in folds.items()])
    carried = sums.select(
        *keys,
        "_chunk",
        *[kinds[k](n).over(before).alias(f"_{n}") for n, (_, k) in folds.items()],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n, (_, k) in folds.items() if k == "sum"],
    )
    rows = chunked
    for name, (value, kind) in folds.items():
        rows = rows.withColumn(name, kinds[kind](value).over(upto))
    out = rows.join(carried, [*keys, "_chunk"], "left")
    for name, (_, kind) in folds.items():
        if kind == "sum":
            merged = F.coalesce(F.col(f"_{name}"), F.lit(0)) + F.col(name)
        else:
            merged = F.greatest(F.col(f"_{name}"), F.col(name))
        out = out.withColumn(name, merged).drop(f"_{name}")
    return out.drop("_chunk")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Add the place of each row within its key, from 1; rows with a null in a key are dropped.

    ``order`` may hold column expressions.  Ranges are written in order with the place of each
    row, so only where a key begins in each range has to meet the rows.
    """
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    by = [*keys, *order]
    # The id counts the rows of a range in its lower 33 bits; the range's number is above them.
    placed = materialise(known.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    chunked = placed.withColumn("_chunk", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    # Written, so that its size is known: with few keys no row is shuffled for it.
    starts = materialise(sizes.select(*keys, "_chunk", (F.col("_first") - F.coalesce(F.sum("_size").over(before), F.lit(0)) - 1).alias("_start")))
    out = chunked.join(starts, [*keys, "_chunk"])
    return out.withColumn(name, (F.col("_at") - F.col("_start")).cast("int")).drop("_at", "_start", "_chunk")
