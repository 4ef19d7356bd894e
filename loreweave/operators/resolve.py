"""Import specifiers resolved to repository files, and dependency classification.

Specifiers are reduced to their distinct values before they meet the file
index, so popular imports are resolved once.  Both sides of those joins then
have one row per key; only the way back to the edges can meet heavy keys, and
their counts are known from the reduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import (
    basename,
    extension,
    first_rule,
    has_dot_segment,
    in_directory,
    last_part,
    rank_in,
    rooted,
    stem,
    without_extension,
)
from loreweave.operators import skew
from loreweave.session import materialise

DEPENDENCY = "struct<type:string,name:string,file:string>"


def file_index(files: DataFrame) -> DataFrame:
    """``repo_id, path, ext`` of every file; the text is never read."""
    return files.select("repo_id", "path", extension(F.col("path")).alias("ext"))


def paths_by_root(index: DataFrame, extensions: list[str]) -> DataFrame:
    """One file per path without extension: the one whose extension comes first in the list."""
    path, ext = F.col("path"), F.col("ext")
    bare = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    ranked = index.select("repo_id", bare.alias("root"), rank_in(ext, extensions).alias("_rank")).where("_rank > 0")
    if "" in extensions:
        # The empty extension also accepts the exact path of any file or directory.
        exact = index.select("repo_id", "path").union(directories(index).select("repo_id", "dir"))
        ranked = ranked.union(exact.withColumn("_rank", F.lit(extensions.index("") + 1).cast("long")))
    # A root and the place of its extension are the file: only a number is reduced, by hash and before the shuffle.
    found = ranked.groupBy("repo_id", "root").agg(F.min("_rank").alias("_rank"))
    suffix = F.element_at(F.array(*[F.lit(e) for e in extensions]), F.col("_rank").cast("int"))
    return found.select("repo_id", "root", F.concat("root", suffix).alias("file"))


def directories(index: DataFrame) -> DataFrame:
    """All directories that hold a file at any depth: ``repo_id, dir``."""
    parts = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    deep = index.where(F.contains("path", F.lit("/")))
    own = F.regexp_replace("path", r"/[^/]*\z", "")
    # Reduce to distinct directories first, then expand to their parents.
    distinct = deep.select("repo_id", F.concat(own, F.lit("/")).alias("path")).distinct()
    return distinct.select("repo_id", F.explode(parents).alias("dir")).distinct()


def paths_by_stem(index: DataFrame) -> DataFrame:
    """One file per base name without extension, by extension preference, then path."""
    path = F.col("path")
    usable = index.withColumn("_rank", rank_in(F.col("ext"), K.RESOLVE_EXTENSIONS)).where(
        (F.col("_rank") > 0) & ~has_dot_segment(path) & ~in_directory(path, K.LOOKUP_IGNORED_DIRS)
    )
    return usable.groupBy("repo_id", stem(path).alias("stem")).agg(
        F.min_by("path", F.struct("_rank", "path")).alias("file")
    )


def specifiers(edges: DataFrame) -> DataFrame:
    """Distinct import paths per repository and how often each occurs."""
    return edges.groupBy("repo_id", "import_path").agg(F.count("*").alias("n"))


def stem_of(import_path: Column) -> Column:
    """Last name of a namespaced or slashed import path."""
    return F.regexp_replace(
        last_part(last_part(last_part(import_path, "::"), "."), "/"), r"^\*+|\*+\z", ""
    )


def _direct_type(root: Column) -> Column:
    return F.when(F.contains(root, F.lit("/util")), "util").otherwise("service")


def _stem_type(file: Column) -> Column:
    return first_rule(F.lower(file), K.STEM_TYPE_RULES, "service")


def resolve_direct(specs: DataFrame, index: DataFrame) -> DataFrame:
    """Import path taken as a path from the root: ``repo_id, import_path, type, file``."""
    roots = paths_by_root(index, K.RESOLVE_EXTENSIONS).select("repo_id", "root", "file")
    probes = specs.withColumn("root", rooted(F.col("import_path")))
    return probes.join(roots, ["repo_id", "root"]).select(
        "repo_id", "import_path", _direct_type(F.col("root")).alias("type"), "file"
    )


def resolve_stem(specs: DataFrame, index: DataFrame) -> DataFrame:
    """Import path matched by its last name: ``repo_id, import_path, type, stem, file``."""
    probes = specs.withColumn("stem", stem_of(F.col("import_path"))).where("stem <> ''")
    found = probes.join(paths_by_stem(index), ["repo_id", "stem"])
    return found.select("repo_id", "import_path", _stem_type(F.col("file")).alias("type"), "stem", "file")


def resolve_specifiers(specs: DataFrame, index: DataFrame) -> DataFrame:
    """Every specifier with how it resolved; ``label`` is null when the imported names are the label.

    A specifier meets the roots, then the stems: one row of each at most, so nothing returns to the specifiers.
    """
    import_path = F.col("import_path")
    probes = specs.select("repo_id", "import_path", rooted(import_path).alias("root"), stem_of(import_path).alias("stem"))
    roots = paths_by_root(index, K.RESOLVE_EXTENSIONS).select("repo_id", "root", F.col("file").alias("by_root"))
    stems = paths_by_stem(index).where("stem <> ''").select("repo_id", "stem", F.col("file").alias("by_stem"))
    both = probes.join(roots, ["repo_id", "root"], "left").join(stems, ["repo_id", "stem"], "left")
    direct, named = F.col("by_root").isNotNull(), F.col("by_stem").isNotNull()
    return both.select(
        "repo_id",
        "import_path",
        F.when(direct, _direct_type(F.col("root"))).when(named, _stem_type(F.col("by_stem"))).otherwise("external_package").alias("type"),
        F.when(direct, F.lit(None)).when(named, F.col("stem")).otherwise(import_path).alias("label"),
        F.coalesce("by_root", "by_stem", F.lit("")).alias("file"),
    )


def dependencies(edges: DataFrame, index: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Each edge with its dependency type, name and file."""
    on = ["repo_id", "import_path"]
    specs = materialise(specifiers(edges))  # read for the heavy ones and to be resolved
    heavy = skew.heavy_keys(specs, on, hot_rows=hot_rows)
    resolved = resolve_specifiers(specs, index)
    spread_by = [c for c in edges.columns if c not in on]
    found = skew.lookup(edges, resolved, on, heavy, spread_by)
    names = F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise(F.col("import_path"))
    return found.withColumn("name", F.coalesce("label", names)).drop("label")


def alias_dependencies(
    edges: DataFrame, index: DataFrame, hot_rows: int = skew.HOT_ROWS, names_shown: int | None = None
) -> DataFrame:
    """Classification by path alias: ``@/``, ``./`` and ``../`` are internal, all else is external."""
    on = ["repo_id", "import_path"]
    internal = F.col("import_path").rlike(r"^(@/|\./|\.\./)")
    specs = materialise(specifiers(edges))
    heavy = skew.heavy_keys(specs, on, hot_rows=hot_rows)
    roots = paths_by_root(index, K.ALIAS_EXTENSIONS).select("repo_id", "root", "file")
    bare = F.regexp_replace(F.replace("import_path", F.lit("@/"), F.lit("src/")), r"^[./]+", "")
    probes = specs.where(internal).withColumn("root", bare)
    resolved = (
        probes.join(roots, ["repo_id", "root"], "left")
        .withColumn("file", F.coalesce("file", "root"))
        .select(*on, first_rule(F.col("file"), K.ALIAS_TYPE_RULES, "util").alias("type"), "file")
    )
    spread_by = [c for c in edges.columns if c not in on]
    found = skew.lookup(edges, resolved, on, heavy, spread_by)
    few = F.when(F.size("names") > 0, F.array_join("names" if names_shown is None else F.slice("names", 1, names_shown), ", ")).otherwise(
        F.col("import_path")
    )
    return (
        found.withColumn("name", F.when(internal, few).otherwise(F.col("import_path")))
        .withColumn("type", F.coalesce("type", F.lit("external_package")))
        .withColumn("file", F.coalesce("file", F.lit("")))
    )


def related_files(entry_edges: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Files one hop from the entry files through ``@/`` imports, distinct per key.

    ``entry_edges`` carries ``keys`` (with ``repo_id``) and ``import_path``.
    """
    aliased = entry_edges.where(F.startswith("import_path", F.lit("@/")))
    wanted = aliased.select(
        *keys, F.replace("import_path", F.lit("@/"), F.lit("src/")).alias("root")
    ).distinct()
    roots = paths_by_root(index, K.RELATED_EXTENSIONS).select("repo_id", "root", "file")
    return wanted.join(roots, ["repo_id", "root"]).select(*keys, F.col("file").alias("path")).distinct()
