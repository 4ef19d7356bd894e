"""Tree listing of repositories with samples of their root manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import basename, in_directory
from loreweave.operators import skew


def _parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def pruned_directory(path: Column) -> Column:
    """True if a directory on the path is never entered by a walk."""
    ignored = F.array(*[F.lit(d) for d in K.TREE_IGNORED_DIRS])
    return F.exists(_parents(path), lambda d: F.startswith(d, F.lit(".")) | F.array_contains(ignored, d))


def dropped_file(path: Column) -> Column:
    """True for hidden files and for binary or lock files."""
    name = basename(path)
    out = F.startswith(name, F.lit("."))
    for suffix in K.TREE_IGNORED_SUFFIXES:
        out = out | F.endswith(name, F.lit(suffix))
    return out


def ignored_by(profile: str, path: Column) -> Column:
    """Whether a look-up profile ignores a path."""
    profiles = {
        "tree": lambda: pruned_directory(path) | dropped_file(path),
        "lookup": lambda: in_directory(path, K.LOOKUP_IGNORED_DIRS),
        "repair": lambda: in_directory(path, K.REPAIR_IGNORED_DIRS),
        "python": lambda: F.contains(path, F.lit(K.PYTHON_IGNORED_PARTS[0]))
        | F.contains(path, F.lit(K.PYTHON_IGNORED_PARTS[1])),
        "generic": lambda: F.startswith(path, F.lit("."))
        | (F.contains(path, F.lit("/")) & F.substring_index(path, "/", 1).isin(K.GENERIC_IGNORED_DIRS)),
    }
    return profiles[profile]()


def walkable(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files a walk lists, of limited depth if asked for."""
    path = F.col("path")
    listed = files.where(~pruned_directory(path) & ~dropped_file(path))
    return listed if max_depth is None else listed.where(F.size(F.split(path, "/")) <= max_depth + 1)


def config_samples(files: DataFrame, n: int | None = None) -> DataFrame:
    """Known root manifests, cut to their first ``n`` characters if asked for: ``repo_id, path, sample``."""
    rows = files.where(F.col("path").isin(K.CONFIG_FILES))
    if n is None:
        return rows.select("repo_id", "path", F.col("content").alias("sample"))
    cut = F.substring("content", 1, n)
    sample = F.when(F.length("content") >= n, F.concat(cut, F.lit("\n... [truncated]"))).otherwise(cut)
    return rows.select("repo_id", "path", sample.alias("sample"))


def tree_map(
    index: DataFrame,
    files: DataFrame,
    max_files: int | None = None,
    max_depth: int | None = None,
    sample_chars: int | None = None,
    part_lines: int = skew.PART_LINES,
) -> DataFrame:
    """Indented listing per repository, followed by the manifest samples, in parts.

    Listings come from the file index; ``files`` is read for root manifests only.
    """
    path = F.col("path")
    paths = index.select("repo_id", "path").where(~pruned_directory(path))
    dirs = _parents(path)
    depth_cap = F.size(dirs) if max_depth is None else F.least(F.size(dirs), F.lit(max_depth))
    own = paths.where(F.size(dirs) > 0).select("repo_id", F.slice(dirs, F.lit(1), depth_cap).alias("dirs")).distinct()
    every = own.select(
        "repo_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda n: F.slice("dirs", F.lit(1), n))).alias("dirs"),
    ).distinct()
    indent = F.repeat(F.lit("  "), F.size("dirs"))
    dir_lines = every.select(
        "repo_id", F.lit(0).alias("section"), "dirs", F.lit("").alias("name"),
        F.concat(indent, F.lit("[Dir] "), F.element_at("dirs", -1), F.lit("/")).alias("line"),
    )
    listed = walkable(index.select("repo_id", "path"), max_depth).select(
        "repo_id", dirs.alias("dirs"), basename(path).alias("name")
    )
    entry = F.concat(F.lit("- "), "name")
    capped = listed
    if max_files is not None:
        w = Window.partitionBy("repo_id").orderBy("dirs", "name")
        # One file more than the cap is kept: its place carries the marker.
        capped = listed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_files + 1)
        entry = F.when(F.col("n") <= max_files, entry).otherwise("... (max file limit reached)")
    file_lines = capped.select(
        "repo_id", F.lit(0).alias("section"), "dirs", "name", F.concat(indent, F.lit("  "), entry).alias("line")
    )
    no_dirs = F.array().cast("array<string>")
    repos = index.select("repo_id").distinct()
    gap = repos.select("repo_id", F.lit(1).alias("section"), no_dirs.alias("dirs"), F.lit("").alias("name"),
                       F.lit("").alias("line"))
    place = F.lpad(F.array_position(F.array(*[F.lit(c) for c in K.CONFIG_FILES]), F.col("path")).cast("string"), 2, "0")
    samples = config_samples(files, sample_chars).select(
        "repo_id", F.lit(2).alias("section"), no_dirs.alias("dirs"), place.alias("name"),
        F.concat(F.lit("\n--- Root Configuration File: "), "path", F.lit(" ---\n"), "sample").alias("line"),
    )
    without = repos.join(samples.select("repo_id"), "repo_id", "left_anti")
    # A listing without samples ends in a line break.
    lines = dir_lines.unionByName(file_lines).unionByName(samples).unionByName(
        gap.join(without, "repo_id", "left_semi")
    )
    return skew.assemble(lines, ["repo_id"], ["section", "dirs", "name"], "line", "tree", part_lines)
