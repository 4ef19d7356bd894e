"""From source files to specifications, for all repositories at once.

Files are written to the shared folder once.  Domains are found from paths and root
manifests; features are taken only from texts that may belong to a domain.  The narrow
tables in between are written too, because several later steps read each of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from loreweave.operators import domains as dom, resolve, specs
from loreweave.session import materialise


@dataclass(frozen=True)
class Survey:
    """Intermediate tables of an onboarding run."""

    files: DataFrame
    features: DataFrame
    index: DataFrame
    domains: dom.Domains


def _written(domains: dom.Domains) -> dom.Domains:
    return dom.Domains(materialise(domains.headers), materialise(domains.files))


def survey(files: DataFrame, candidates: Callable[[DataFrame], dom.Domains] | None = None) -> Survey:
    """Features, file index and domains with their related files.

    ``candidates`` builds suggested domains from the file index.
    """
    files = materialise(files)
    index = resolve.file_index(files)
    suggested = None if candidates is None else candidates(index)
    domains = _written(dom.discover(files, index, suggested))
    features = materialise(specs.file_features(_possible_members(files, domains)))
    return Survey(files, features, index, _written(specs.add_related(domains, features, index)))


def _possible_members(files: DataFrame, domains: dom.Domains) -> DataFrame:
    """Every file of a repository with route domains, whose imports may make any of them related; of others those that domains list."""
    routed = domains.headers.where("source = 'route'").select("repo_id").distinct()
    listed = domains.files.join(routed, "repo_id", "left_anti").select("repo_id", "path").distinct()
    return files.join(routed, "repo_id", "left_semi").unionByName(files.join(listed, ["repo_id", "path"], "left_semi"))


FEW_REPOS = 1_000  # named in the filter itself, which then reaches the scan


def in_touched_repos(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of the repositories that ``changed`` (``repo_id, path``) names."""
    repos = changed.select("repo_id").distinct()
    named = [r.repo_id for r in repos.limit(FEW_REPOS + 1).collect()]
    if len(named) <= FEW_REPOS:
        return files.where(F.col("repo_id").isin(named))
    return files.join(repos, "repo_id", "left_semi")


def domains_of(files: DataFrame) -> dom.Domains:
    """Domains with their entry files only: paths and root manifests are read, no other text."""
    return _written(dom.discover(files, materialise(resolve.file_index(files))))


def touched_domains(files: DataFrame, changed: DataFrame) -> tuple[dom.Domains, DataFrame]:
    """Domains of the touched repositories, and which of them hold or use a changed file: ``repo_id, domain_no``.

    Features are taken from entry and related files of those repositories alone.  Import paths
    are resolved once each, and only those that lead to a changed file go back to
    the files that have them.
    """
    own = materialise(in_touched_repos(files, changed))  # read for paths, manifests and twice for texts
    index = resolve.file_index(own)
    found = _written(dom.discover(own, index))
    members = own.join(found.files.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    features = materialise(specs.file_features(members))
    whole = _written(specs.add_related(found, features, index))
    more = whole.files.where(F.col("role") == dom.RELATED).select("repo_id", "path").distinct().join(features.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    features = features.unionByName(materialise(specs.file_features(own.join(more, ["repo_id", "path"], "left_semi"))))
    edges = features.select("repo_id", "path", F.explode(F.array_distinct("imports.from")).alias("import_path"))
    leads = resolve.resolve_specifiers(resolve.specifiers(edges), index).select("repo_id", "import_path", F.col("file").alias("path"))
    leads = leads.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").select("repo_id", "import_path").distinct()
    users = edges.join(leads, ["repo_id", "import_path"], "left_semi").select("repo_id", "path")
    hit = users.unionByName(changed.select("repo_id", "path")).distinct()
    return whole, whole.files.join(hit, ["repo_id", "path"], "left_semi").select("repo_id", "domain_no").distinct()


def dependencies(found: Survey) -> DataFrame:
    """Dependency rows of every domain."""
    return materialise(specs.spec_dependencies(found.domains, found.features, found.index))


def onboard(files: DataFrame, generate: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, metadata) of all domains; ``generate`` may write the overviews."""
    found = survey(files)
    deps = dependencies(found)
    narratives = None
    if generate is not None:
        # A prompt too long for one part is generated from its first; the reply is one per domain.
        prompts = specs.spec_prompts(found.domains, deps, found.files).where("part_no = 0")
        narratives = specs.apply_text_generator(prompts, specs.DOMAIN, "prompt", generate)
    docs = specs.spec_markdown(found.domains, deps, found.features, narratives)
    return docs, specs.spec_meta(found.domains, deps)
