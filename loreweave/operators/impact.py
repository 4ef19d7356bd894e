"""Change sets: normalisation, the large-commit guard, impacted specifications and new domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreweave.functions import constants as K
from loreweave.operators import skew
from loreweave.operators.domains import ENTRY, Domains
from loreweave.session import materialise


def changed_paths(changes: DataFrame) -> DataFrame:
    """Forward slashes only; paths that begin with a dot are dropped."""
    clean = changes.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    return clean.where(~F.startswith("path", F.lit(".")))


def over_limit(n_files: str, limit: int = K.MAX_COMMIT_FILES) -> Column:
    return F.col(n_files) > limit


def commit_guard(changes: DataFrame, limit: int = K.MAX_COMMIT_FILES) -> DataFrame:
    """Every commit with its number of files and whether that is over the limit."""
    sizes = changes.groupBy("commit_id").agg(F.count("*").alias("n_files"))
    return sizes.withColumn("over_limit", over_limit("n_files", limit))


def deferred_commits(changes: DataFrame, limit: int = K.MAX_COMMIT_FILES) -> DataFrame:
    """Commits that touch more than ``limit`` files: ``commit_id, n_files``."""
    return commit_guard(changes, limit).where("over_limit").drop("over_limit")


def accepted_changes(changes: DataFrame, limit: int = K.MAX_COMMIT_FILES) -> DataFrame:
    """Changes of all other commits.  Sizes are counted before the shuffle."""
    return changes.join(deferred_commits(changes, limit).select("commit_id"), "commit_id", "left_anti")


def tracked_files(meta: DataFrame) -> DataFrame:
    """Files each specification refers to: ``spec_id, path``."""
    deps = F.filter(F.col("dependencies.file"), lambda f: f != "")
    every = F.array_distinct(F.concat("entry_files", "related_files", deps))
    return meta.select("spec_id", F.explode(every).alias("path")).distinct()


def impacted_specs(changes: DataFrame, tracked: DataFrame, keys: list[str] = [], side: int = skew.PAIR_SIDE, once: bool = True) -> DataFrame:
    """Specifications whose files were changed, per ``keys`` (a commit) or overall.

    A path that most commits touch, or most specifications refer to, is spread over tasks.
    Without ``once``, a specification comes for each of its files that was changed by the same
    commit: for callers that fold the rows by their keys anyway.
    """
    paths = changes.select(*keys, "path").distinct()
    if not keys:
        return tracked.join(paths, "path", "left_semi").select("spec_id").distinct()
    # Both sides are read for their counts and for their rows.
    hit = skew.match(materialise(paths), materialise(tracked), ["path"], side).select(*keys, "spec_id")
    return hit.distinct() if once else hit


def new_domains(domains: Domains, catalog: DataFrame, changed: DataFrame) -> DataFrame:
    """Domains without a specification of which an entry file was changed."""
    unknown = domains.headers.join(catalog.select("spec_id"), "spec_id", "left_anti")
    touched = (
        domains.files.where(F.col("role") == ENTRY)
        .join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        .select("repo_id", "domain_no")
        .distinct()
    )
    return unknown.join(touched, ["repo_id", "domain_no"], "left_semi").select("repo_id", "domain_no", "spec_id", "display_name", "framework")


def regen_plan(impacted: DataFrame, domains: Domains) -> DataFrame:
    """Impacted specifications with the domain to regenerate; those without a domain are skipped."""
    first = domains.headers.groupBy("repo_id", "spec_id").agg(
        F.min_by(F.struct("domain_no", "display_name", "framework"), "domain_no").alias("d")
    )
    keys = [c for c in ("repo_id", "spec_id") if c in impacted.columns]
    return impacted.join(first, keys).select("repo_id", "spec_id", "d.*")
