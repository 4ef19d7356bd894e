"""Framework detection and feature-domain discovery for all repositories at once.

Domains are kept in two tables: headers (``repo_id, domain_no, spec_id,
display_name, framework, source``) and files (``repo_id, domain_no, role, rank, path``).
The file lists of a domain are unbounded, so they stay rows until a document is
written.  ``domain_no`` counts from 1.  Limits are arguments and off by default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import (
    basename,
    display_name,
    extension,
    has_dot_segment,
    in_directory,
    spec_id,
    stem,
    strip,
    title,
    unfence,
)
from loreweave.operators.ordered import numbered
from loreweave.operators.resolve import directories
from loreweave.session import materialise

FRAMEWORKS_PYTHON = ["fastapi", "flask", "python"]
ENTRY, RELATED = "entry", "related"


@dataclass(frozen=True)
class Domains:
    """Header rows and file rows of a set of domains."""

    headers: DataFrame
    files: DataFrame


def detect_framework(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One framework per repository from its root manifests: ``repo_id, framework``.

    ``repos`` lists the repositories once each, if a narrower table than ``files`` has them.
    """
    manifests = ["next.config.ts", "next.config.js", "next.config.mjs"]
    path, text = F.col("path"), F.col("content")
    deps = "map<string,string>"
    package = F.from_json(text, f"dependencies {deps}, devDependencies {deps}")
    has_next = F.coalesce(F.map_contains_key(package["dependencies"], "next"), F.lit(False)) | F.coalesce(
        F.map_contains_key(package["devDependencies"], "next"), F.lit(False)
    )

    def names(file: str, word: str):
        return F.max((path == file) & F.contains(F.lower(text), F.lit(word)))

    # The text is read for root manifests only; every repository is listed from its key alone.
    known = [*manifests, "package.json", "requirements.txt", "pyproject.toml"]
    repos = files.select("repo_id").distinct() if repos is None else repos
    rows = files.where(path.isin(known))
    flags = rows.groupBy("repo_id").agg(
        F.max(path.isin(manifests)).alias("next_config"),
        F.max(path == "package.json").alias("package"),
        F.max((path == "package.json") & has_next).alias("next_dep"),
        F.max(path == "requirements.txt").alias("req"),
        F.max(path == "pyproject.toml").alias("pyproject"),
        names("requirements.txt", "fastapi").alias("req_fastapi"),
        names("requirements.txt", "flask").alias("req_flask"),
        names("pyproject.toml", "fastapi").alias("py_fastapi"),
        names("pyproject.toml", "flask").alias("py_flask"),
    )
    c = F.col
    return repos.join(flags, "repo_id", "left").select(
        "repo_id",
        F.when(c("next_config") | c("next_dep"), "nextjs")
        .when(c("package"), "nodejs")
        .when(c("req_fastapi"), "fastapi")
        .when(c("req_flask"), "flask")
        .when(c("py_fastapi"), "fastapi")
        .when(c("py_flask"), "flask")
        .when(c("req") | c("pyproject"), "python")
        .otherwise("generic")
        .alias("framework"),
    )


def _numbered(rows: DataFrame, order: list, cap: int | None) -> DataFrame:
    """Rows of each repository numbered from 1; with a cap the first ones, pruned before the shuffle."""
    if cap is None:
        return numbered(rows, ["repo_id"], order, "domain_no")
    w = Window.partitionBy("repo_id").orderBy(*order)
    return rows.withColumn("domain_no", F.row_number().over(w)).where(F.col("domain_no") <= cap)


def domains_nextjs(index: DataFrame, cap: int | None = None, service_cap: int | None = None) -> Domains:
    """Route groups below the API folder, then the services layer and the configuration."""
    path = F.col("path")
    in_src = F.startswith(path, F.lit("src/app/api/"))
    below = F.when(in_src, F.substr(path, F.lit(len("src/app/api/") + 1))).when(
        F.startswith(path, F.lit("app/api/")), F.substr(path, F.lit(len("app/api/") + 1))
    )
    group = F.when(F.contains(below, F.lit("/")), F.nullif(F.substring_index(below, "/", 1), F.lit("")))
    inside = F.substr(below, F.length(group) + 2)
    # The folder without src/ counts only in repositories that lack the one with src/.
    with_src = index.where(in_src).select("repo_id", F.lit(True).alias("with_src")).distinct()
    routes = (
        index.where(basename(path).isin("route.ts", "route.tsx") & group.isNotNull() & ~has_dot_segment(inside))
        .join(with_src, "repo_id", "left")
        .where(in_src | F.col("with_src").isNull())
        .select("repo_id", group.alias("name"), F.endswith(path, F.lit(".tsx")).cast("long").alias("rank"), "path")
    )
    services_at, config_at = "src/app/services/", "src/app/config/"
    services = index.where(
        F.startswith(path, F.lit(services_at))
        & F.endswith(path, F.lit(".ts"))
        & ~has_dot_segment(F.substr(path, F.lit(len(services_at) + 1)))
    )
    if service_cap is not None:  # the first few files only: top-k per repository, pruned map-side
        first_few = Window.partitionBy("repo_id").orderBy("path")
        services = services.withColumn("_n", F.row_number().over(first_few)).where(F.col("_n") <= service_cap)
    services = services.select(
        "repo_id", F.lit("AI-SERVICES").alias("name"), F.lit(0).cast("long").alias("rank"), "path"
    )
    config = index.where(F.startswith(path, F.lit(config_at)) & path.rlike(r"^src/app/config/[^/.][^/]*\.ts$")).select(
        "repo_id", F.lit("APP-CONFIG").alias("name"), F.lit(0).cast("long").alias("rank"), "path"
    )
    members = (
        routes.withColumn("kind", F.lit(0))
        .unionByName(services.withColumn("kind", F.lit(1)))
        .unionByName(config.withColumn("kind", F.lit(2)))
    )
    names = members.select("repo_id", "kind", "name").distinct()
    chosen = _numbered(names, ["kind", "name"], cap)
    label = (
        F.when(F.col("kind") == 1, "AI Services Layer")
        .when(F.col("kind") == 2, "App Configuration")
        .otherwise(display_name(F.col("name")))
    )
    headers = chosen.select(
        "repo_id",
        "domain_no",
        F.when(F.col("kind") == 0, spec_id(F.col("name"))).otherwise(F.col("name")).alias("spec_id"),
        label.alias("display_name"),
        F.when(F.col("kind") == 0, "route").otherwise("layer").alias("source"),
    )
    files = members.join(chosen, ["repo_id", "kind", "name"]).select(
        "repo_id", "domain_no", F.lit(ENTRY).alias("role"), "rank", "path"
    )
    return Domains(headers, files)


def _single_file_domains(chosen: DataFrame, name, label) -> Domains:
    headers = chosen.select(
        "repo_id", "domain_no", spec_id(name).alias("spec_id"), label.alias("display_name"), F.lit("module").alias("source")
    )
    files = chosen.select(
        "repo_id", "domain_no", F.lit(ENTRY).alias("role"), F.lit(0).cast("long").alias("rank"), "path"
    )
    return Domains(headers, files)


def domains_python(index: DataFrame, cap: int | None = None) -> Domains:
    """Route modules by name, else by directory, else the root modules."""
    path = F.col("path")
    usable = index.where(
        F.endswith(path, F.lit(".py"))
        & ~has_dot_segment(path)
        & ~F.contains(path, F.lit(K.PYTHON_IGNORED_PARTS[0]))
        & ~F.contains(path, F.lit(K.PYTHON_IGNORED_PARTS[1]))
    )
    tier = (
        F.when(F.lower(stem(path)).isin(K.ROUTE_STEMS), 1)
        .when(in_directory(path, K.ROUTE_DIRS), 2)
        .when(~F.contains(path, F.lit("/")), 3)
    )
    tiered = usable.withColumn("tier", tier).where("tier is not null")
    best = tiered.groupBy("repo_id").agg(F.min("tier").alias("tier"))
    chosen = _numbered(tiered.join(best, ["repo_id", "tier"], "left_semi"), ["path"], cap)
    name = stem(path)
    return _single_file_domains(chosen, name, title(F.translate(name, "_", " ")))


def domains_generic(index: DataFrame, cap: int | None = None) -> Domains:
    """Top-level directories with source files, each with its first file."""
    path = F.col("path")
    top = F.substring_index(path, "/", 1)
    usable = index.where(
        F.contains(path, F.lit("/"))
        & ~has_dot_segment(path)
        & ~top.isin(K.GENERIC_IGNORED_DIRS)
        & extension(path).isin(K.GENERIC_SOURCE_EXTENSIONS)
    )
    tops = usable.groupBy("repo_id", top.alias("top")).agg(F.min("path").alias("path"))
    chosen = _numbered(tops, ["top"], cap)
    return _single_file_domains(chosen, F.col("top"), display_name(F.col("top")))


CANDIDATE = (
    "array<struct<spec_id:string,display_name:string,entry_files:array<string>,"
    "related_files:array<string>,framework:string,language:string>>"
)


def parse_candidates(replies: DataFrame) -> DataFrame:
    """Suggested domains from model replies: ``repo_id, candidate_no`` and the suggested fields.

    Replies that are no JSON array give nothing.
    """
    parsed = replies.select("repo_id", F.from_json(unfence(F.col("reply")), CANDIDATE).alias("items"))
    rows = parsed.select("repo_id", F.posexplode("items").alias("candidate_no", "item"))
    return rows.select("repo_id", "candidate_no", "item.*").where("spec_id is not null and entry_files is not null")


def suggestions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed candidates as path rows and header rows, numbered by identifier within a repository.

    Gives ``repo_id, candidate_no, role, pos, path`` and ``repo_id, candidate_no,
    spec_id, display_name, framework``.
    """
    order = ["spec_id", "candidate_no"]
    rows = numbered(parsed, ["repo_id"], order, "_no").withColumn("candidate_no", F.col("_no")).drop("_no")
    paths = None
    for role, column in ((ENTRY, "entry_files"), (RELATED, "related_files")):
        own = rows.select("repo_id", "candidate_no", F.lit(role).alias("role"), F.posexplode(column).alias("pos", "path")).withColumn("pos", F.col("pos") + 1)
        paths = own if paths is None else paths.unionByName(own)
    heads = rows.select("repo_id", "candidate_no", "spec_id", F.coalesce("display_name", "spec_id").alias("display_name"), "framework")
    return paths, heads


def repair_paths(suggested: DataFrame, index: DataFrame) -> DataFrame:
    """Keep a suggested path that exists, else take the first file of that name, else drop it.

    Adds ``repaired``; ``path`` is the suggestion.
    """
    index = materialise(index.select("repo_id", "path"))  # read three times
    usable = index.where(~in_directory(F.col("path"), K.REPAIR_IGNORED_DIRS) & ~has_dot_segment(F.col("path")))
    by_name = usable.groupBy("repo_id", basename(F.col("path")).alias("base")).agg(
        F.min("path").alias("by_name")
    )
    known = (
        index.union(directories(index).select("repo_id", "dir"))
        .select("repo_id", F.col("path").alias("clean"), F.lit(True).alias("exact"))
    )
    clean = F.replace(strip(F.col("path")), F.lit("\\"), F.lit("/"))
    probes = suggested.withColumn("clean", clean)
    # Suggestions repeat; each distinct path is looked up once.  One that exists does not travel a second time.
    distinct = probes.select("repo_id", "clean").distinct()
    found = (
        distinct.join(known, ["repo_id", "clean"], "left")
        .withColumn("base", basename(F.col("clean")))
        .join(by_name, ["repo_id", "base"], "left")
        .where("exact or by_name is not null")
        .select("repo_id", "clean", F.when(F.col("exact").isNull(), F.col("by_name")).alias("other"))
    )
    return probes.join(found, ["repo_id", "clean"]).withColumn("repaired", F.coalesce("other", "clean")).drop("clean", "other")


def candidate_domains(
    suggested: DataFrame, candidates: DataFrame, index: DataFrame, cap: int | None = None
) -> Domains:
    """Candidates with at least one usable entry file, the first ``cap`` per repository.

    ``suggested``: ``repo_id, candidate_no, role, pos, path``;
    ``candidates``: ``repo_id, candidate_no, spec_id, display_name, framework``.
    """
    # Read for the candidates that have any and for the files; the end of a long plan.
    usable = materialise(repair_paths(suggested, index).select("repo_id", "candidate_no", "role", "pos", "repaired"))
    valid = usable.where(F.col("role") == ENTRY).select("repo_id", "candidate_no").distinct()
    headers = _numbered(candidates.join(valid, ["repo_id", "candidate_no"], "left_semi"), ["candidate_no"], cap)
    files = usable.join(headers.select("repo_id", "candidate_no", "domain_no"), ["repo_id", "candidate_no"])
    return Domains(
        headers.drop("candidate_no").withColumn("source", F.lit("candidate")),
        files.select(
            "repo_id", "domain_no", "role", F.col("pos").cast("long").alias("rank"), F.col("repaired").alias("path")
        ),
    )


def discover(
    files: DataFrame, index: DataFrame, candidates: Domains | None = None, cap: int | None = None
) -> Domains:
    """Validated candidates where a repository has some, else the rules of its framework."""
    # One row per repository, asked for by the headers and the files of every rule.
    frameworks = materialise(detect_framework(files, index.select("repo_id").distinct()))
    headers, members = None, None
    for rule, kinds in ((domains_nextjs, ["nextjs"]), (domains_python, FRAMEWORKS_PYTHON), (domains_generic, ["nodejs", "generic"])):
        fitting = frameworks.where(F.col("framework").isin(kinds))
        # A rule looks at one repository at a time: it gets the files of its own ones only.
        found = rule(index.join(fitting.select("repo_id"), "repo_id", "left_semi"), cap)
        h = found.headers.join(fitting, "repo_id")
        headers = h if headers is None else headers.unionByName(h)
        members = found.files if members is None else members.unionByName(found.files)
    if candidates is not None:
        won = candidates.headers.select("repo_id").distinct()
        detected = frameworks.withColumnRenamed("framework", "detected")
        own = candidates.headers.join(detected, "repo_id", "left").withColumn(
            "framework", F.coalesce(F.nullif("framework", F.lit("")), "detected")
        ).drop("detected")
        headers = headers.join(won, "repo_id", "left_anti").unionByName(own)
        members = members.join(won, "repo_id", "left_anti").unionByName(candidates.files)
    return Domains(headers, members)
