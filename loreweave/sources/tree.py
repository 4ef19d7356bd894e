"""Source trees, specification stores and change records as DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loreweave.operators.treemap import walkable

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BYTES = 1 << 30  # of a text that is one value; larger files are read in parts
RECORDS = "seq long, commit_id string, path string, content string"


def list_source_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files a walk lists below ``root/<repo_id>/``, without their content: ``repo_id, path, url, length, oversized``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").split("://")[-1].strip("/") + "/"
    below = F.substr(F.col("path"), F.locate(base, F.col("path")) + len(base))
    listed = raw.select(
        F.substring_index(below, "/", 1).alias("repo_id"),
        F.substr(below, F.locate("/", below) + 1).alias("path"),
        F.col("path").alias("url"),
        "length",
        (F.col("length") > max_bytes).alias("oversized"),
    )
    return walkable(listed)


def _placed(raw: DataFrame, root: str, url: Column, *more) -> DataFrame:
    """``repo_id, path`` from a file's address below ``root``, with further columns."""
    base = root.rstrip("/").split("://")[-1].strip("/") + "/"
    below = F.substr(url, F.locate(base, url) + len(base))
    return raw.select(F.substring_index(below, "/", 1).alias("repo_id"), F.substr(below, F.locate("/", below) + 1).alias("path"), *more)


def read_source_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Listed files of up to ``max_bytes`` with their text: ``repo_id, path, content``.

    The content of ignored files is never read: the filters reach the reader's
    length and path columns.  Bytes that are no valid UTF-8 become replacement
    characters.  ``read_source_parts`` also has the files that are larger.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    named = _placed(raw, root, F.col("path"), "content")
    return walkable(named).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def _ranges(iterator):
    """Lines of each range of a file, joined."""
    import pyarrow as pa

    at, held = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array(["\n".join(held)], pa.string())], ["url", "start", "content"])

    for batch in iterator:
        for url, start, line in zip(*(batch.column(c).to_pylist() for c in ("url", "start", "line"))):
            if (url, start) != at:
                if at is not None:
                    yield out()
                at, held = (url, start), []
            held.append(line)
    if at is not None:
        yield out()


def read_source_parts(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All listed files, of any size: ``repo_id, path, start, content``.

    A file of up to ``max_bytes`` is one part with start 0.  A larger one is cut where Spark cuts
    files for its tasks, at ends of lines: its parts by ``start``, joined by line
    breaks, are its text (without a last line break).
    """
    whole = read_source_tree(spark, root, max_bytes).select("repo_id", "path", F.lit(0).cast("long").alias("start"), "content")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root).where(F.col("_metadata.file_size") > max_bytes)
    rows = lines.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("line"))
    parts = _placed(rows.mapInArrow(_ranges, "url string, start long, content string"), root, F.url_decode("url"), "start", "content")
    return whole.unionByName(walkable(parts))


def stream_changes(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Change records that arrive as files of JSON lines, as a stream: ``seq, commit_id, path, content``.

    A stopped stream goes on, from its checkpoint, with the files it has not taken in.
    """
    reader = spark.readStream.schema(RECORDS)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).json(folder)


def source_scan(files: DataFrame) -> DataFrame:
    """What a walk of limited depth keeps of a tree."""
    return walkable(files)


def normalised_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
