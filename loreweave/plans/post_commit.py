"""What follows a commit: oversized change sets, impacted specifications, renames and healed metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loreweave.operators import impact, renames
from loreweave.session import materialise
from loreweave.sources.merge import BucketTable, latest, once, total


def run(changes: DataFrame, versions: DataFrame, meta: DataFrame, commit_of: Column) -> DataFrame:
    """``kind, commit_id, item``; ``commit_of`` names the commit of a file version.

    Oversized commits are marked and treated like any other.
    """
    sizes = impact.deferred_commits(changes).select(F.lit("oversized").alias("kind"), "commit_id", F.lit("").alias("item"))
    hit = impact.impacted_specs(impact.changed_paths(changes), impact.tracked_files(meta), ["commit_id"])
    impacted = hit.select(F.lit("impacted").alias("kind"), "commit_id", F.col("spec_id").alias("item"))
    pairs = renames.pair_versions(renames.parse_versions(versions), ["path"])
    found = materialise(renames.renames(pairs, ["path", "commit_seq"]).withColumn("commit_id", commit_of))  # read per commit and over all
    mapping = renames.rename_map(found, ["commit_seq"], ["commit_id"])
    renamed = mapping.select(F.lit("renamed").alias("kind"), "commit_id", F.concat("old_name", F.lit(">"), "new_name").alias("item"))
    healed = renames.heal_dependencies(meta, renames.rename_map(found, ["commit_seq"])).select(
        F.lit("healed").alias("kind"), F.lit("").alias("commit_id"), F.col("spec_id").alias("item")
    )
    return sizes.unionByName(impacted).unionByName(renamed).unionByName(healed)


#: Tables of a running post-commit job, each in buckets of its key.
KEYS = {"sizes": ("commit_id",), "impacted": ("commit_id", "spec_id"), "renamed": ("commit_id", "old_name"), "healed": ("spec_id",), "heads": ("path",)}

#: A batch has few commits, next to the specifications they touch.
WITHIN = {"impacted": "commit_id"}


def tables(spark: SparkSession, folder: str, buckets: int = 64) -> dict[str, BucketTable]:
    return {name: BucketTable(spark, f"{folder}/{name}", key, buckets, WITHIN.get(name)) for name, key in KEYS.items()}


def commit_batch(records: DataFrame, meta: DataFrame, folder: str, version: int, buckets: int = 64) -> None:
    """Takes records into the tables of ``folder``, as version ``version``.

    ``records``: ``seq, commit_id, path, content``; a record without content is a changed
    path, one with it a file version.  Commits may go on in later batches: sizes add
    up, the newest version of each path is kept to be paired with the next one, and
    of a commit's renames of one name the last counts.  A batch that is taken in again,
    after a failure at any point, starts from the versions below its own.
    """
    store = tables(records.sparkSession, folder, buckets)
    changes = records.where("content is null").select("commit_id", "path")
    store["sizes"].merge(changes.groupBy("commit_id").agg(F.count("*").alias("n_files")), version, total(["commit_id"], "n_files"))
    hit = impact.impacted_specs(impact.changed_paths(changes), impact.tracked_files(meta), ["commit_id"], once=False)  # the merge does it
    store["impacted"].merge(hit, version, once(["commit_id", "spec_id"]))

    versions = records.where("content is not null").select("path", F.col("seq").alias("commit_seq"), "commit_id", "content")
    parsed = renames.parse_versions(versions).persist()
    try:
        heads = store["heads"].read(version)
        both = parsed if heads is None else parsed.unionByName(heads.join(parsed.select("path").distinct(), "path", "left_semi"))
        found = renames.renames(renames.pair_versions(both, ["path"]), ["path", "commit_seq", "commit_id"]).persist()
        try:
            last = found.groupBy("commit_id", "old_name").agg(F.max_by("new_name", "commit_seq").alias("new_name"), F.max("commit_seq").alias("seq"))
            store["renamed"].merge(last, version, latest(["commit_id", "old_name"], ["seq"]))
            names = found.select("old_name").distinct()
            used = meta.select("spec_id", F.explode(F.array_distinct("dependencies.name")).alias("old_name"))
            store["healed"].merge(used.join(names, "old_name", "left_semi").select("spec_id").distinct(), version, once(["spec_id"]))
        finally:
            found.unpersist()
        store["heads"].merge(parsed, version, latest(["path"], ["commit_seq"]))
    finally:
        parsed.unpersist()


def stream(records: DataFrame, meta: DataFrame, folder: str, checkpoint: str, buckets: int = 64):
    """Post-commit as a running job over streamed ``records``: each batch is a version of the tables, numbered as it."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            commit_batch(kept, meta, folder, number, buckets)
        finally:
            kept.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, commit_id, item`` as ``run`` gives them, from the tables of a running job."""
    store = {name: t.read() for name, t in tables(spark, folder).items()}
    empty = spark.createDataFrame([], "kind string, commit_id string, item string")
    chosen = {
        "sizes": lambda t: t.where(impact.over_limit("n_files")).select(F.lit("oversized").alias("kind"), "commit_id", F.lit("").alias("item")),
        "impacted": lambda t: t.select(F.lit("impacted").alias("kind"), "commit_id", F.col("spec_id").alias("item")),
        "renamed": lambda t: t.select(F.lit("renamed").alias("kind"), "commit_id", F.concat("old_name", F.lit(">"), "new_name").alias("item")),
        "healed": lambda t: t.select(F.lit("healed").alias("kind"), F.lit("").alias("commit_id"), F.col("spec_id").alias("item")),
    }
    out = empty
    for name, rows in chosen.items():
        if store[name] is not None:
            out = out.unionByName(rows(store[name]))
    return out
