"""Specification documents, metadata and curated seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

META = (
    "spec_id string, entry_files array<string>, related_files array<string>, "
    "dependencies array<struct<type:string,name:string,file:string>>, tags array<string>"
)


def read_texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Whole text files: ``key`` (file name) and ``body``."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder)
    return raw.select(
        F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("key"), F.col("value").alias("body")
    )


def spec_catalog(keys: DataFrame, key: str = "key") -> DataFrame:
    """Identifiers of the documents named ``<folder>/<SPEC-ID>.md``."""
    name = F.regexp_extract(key, r"([^/]+)\.md\z", 1)
    return keys.select(name.alias("spec_id")).where("spec_id <> ''").distinct()


def is_json(body: Column) -> Column:
    """True if the text parses as JSON."""
    return F.try_parse_json(body).isNotNull()


def parse_meta(meta: DataFrame, body: str = "meta_json") -> DataFrame:
    """Decoded metadata; texts that are no JSON object, or carry no identifier, are skipped."""
    parsed = meta.where(is_json(F.col(body))).select(F.from_json(body, META).alias("m")).select("m.*")
    empty = F.array()
    return parsed.where("spec_id is not null").select(
        "spec_id",
        F.coalesce("entry_files", empty).alias("entry_files"),
        F.coalesce("related_files", empty).alias("related_files"),
        F.coalesce("dependencies", empty).alias("dependencies"),
        F.coalesce("tags", empty).alias("tags"),
    )


def seed_kinds(entries: DataFrame) -> DataFrame:
    """Classify seed files (``key, body``): constitution, document or metadata; status valid or invalid."""
    key = F.col("key")
    kind = (
        F.when(key == "hot_memory.md", "constitution")
        .when(F.endswith(key, F.lit(".meta.json")), "metadata")
        .when(F.endswith(key, F.lit(".md")), "document")
    )
    valid = (F.col("kind") != "metadata") | is_json(F.col("body"))
    return entries.withColumn("kind", kind).where("kind is not null").withColumn(
        "status", F.when(valid, "valid").otherwise("invalid")
    )


def seed_load_summary(entries: DataFrame) -> DataFrame:
    """Seed files per kind and status."""
    return seed_kinds(entries).groupBy("kind", "status").agg(F.count("*").alias("n"))
