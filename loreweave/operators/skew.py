"""Joins and text assembly that split heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreweave.operators.ordered import numbered
from loreweave.session import materialise

HOT_ROWS = 1_000_000   # a key with more rows than this is spread
SALTS = 64
PAIR_SIDE = 10_000     # rows of a key on either side of a join of many with many
PART_LINES = 1_000     # lines of a document part


def heavy_keys(counted: DataFrame, on: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The heavy keys of a table of counts: at most (all rows / ``hot_rows``) of them."""
    return counted.where(F.col(n) > hot_rows).select(*on)


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    heavy: DataFrame,
    spread_by: list[str],
    salts: int = SALTS,
) -> DataFrame:
    """Left join of many rows against one row per key.

    Rows of heavy keys are spread over ``salts`` tasks and their look-up rows
    copied as often; all other keys join as usual.
    """
    marks = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = left.join(marks, on, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), spread).otherwise(0)
    )
    copies = right.join(marks, on, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted.drop("_heavy").join(copies.drop("_heavy"), [*on, "_salt"], "left").drop("_salt")


def match(left: DataFrame, right: DataFrame, on: list[str], side: int = PAIR_SIDE) -> DataFrame:
    """Inner join of many rows with many: of a key, a task sees ``side`` rows of either at most, or about.

    Light keys are joined as usual.  The rows of a heavy one are dealt to a grid, left
    rows by its lines and right rows by its columns, so every pair meets once.
    """
    n = left.groupBy(*on).agg(F.count("*").alias("_n"))
    m = right.groupBy(*on).agg(F.count("*").alias("_m"))
    grid = n.join(m, on).where((F.col("_n") > side) | (F.col("_m") > side)).select(
        *on, F.ceil(F.col("_n") / side).cast("int").alias("_lines"), F.ceil(F.col("_m") / side).cast("int").alias("_columns")
    )
    grid = materialise(grid)  # heavy keys are few: with their size known, no row is shuffled to be marked

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row at one place of its side, and at every place of the other one."""
        marked = rows.join(grid, on, "left")
        place = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(own)), F.lit(0)).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return marked.withColumn(own, place).withColumn(other, F.explode(every))

    places = ["_lines", "_columns"]
    return dealt(left, *places).join(dealt(right, *places[::-1]), [*on, *places]).drop(*places)


def assemble(lines: DataFrame, keys: list[str], order: list[str], text: str, out: str, part_lines: int = PART_LINES) -> DataFrame:
    """Documents of each key in parts of ``part_lines`` lines: ``keys, part_no, out``.

    Items stand by ``order``; an item may have several lines.  Parts count from 0,
    and joining them by line breaks gives the document, whatever its size.
    """
    single = lines.select(*keys, *order, F.posexplode(F.split(text, "\n")).alias("_sub", "_line"))
    placed = numbered(single, keys, [*order, "_sub"], "_n").withColumn(
        "part_no", F.floor((F.col("_n") - 1) / part_lines).cast("int")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_line")))["_line"]
    return placed.groupBy(*keys, "part_no").agg(F.array_join(ordered, "\n").alias(out))
