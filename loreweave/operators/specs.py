"""Feature specifications: dependencies, tags, metadata and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import extension, strip
from loreweave.operators import resolve, skew
from loreweave.operators.domains import ENTRY, RELATED, Domains
from loreweave.operators.ordered import numbered
from loreweave.operators.imports import DIALECTS, imports_of, ts_imports, ts_requires
from loreweave.operators.tags import auth_label, generic_verbs
from loreweave.session import materialise

DOMAIN = ["repo_id", "domain_no"]


def file_features(files: DataFrame) -> DataFrame:
    """What specifications need from each text, taken in one pass:
    ``repo_id, path, imports, aliased, verbs, auth``.

    ``aliased`` holds the ``@/`` paths of import statements.
    """
    text, ext = F.col("content"), extension(F.col("path"))
    is_ts = F.lower(ext).isin(DIALECTS["ts"][0])
    # Statements feed two columns; as a column of their own they are matched once.
    staged = files.withColumn("_ts", F.when(is_ts, ts_imports(text, with_require=False)))
    imports = F.when(is_ts, F.concat("_ts", ts_requires(text))).otherwise(imports_of(text, ext))
    aliased = F.filter(F.col("_ts")["from"], lambda p: F.startswith(p, F.lit("@/")))
    return staged.select(
        "repo_id",
        "path",
        imports.alias("imports"),
        aliased.alias("aliased"),
        generic_verbs(text).alias("verbs"),
        auth_label(text).alias("auth"),
    )


def add_related(domains: Domains, features: DataFrame, index: DataFrame) -> Domains:
    """Add the files one hop from the route files of Next.js domains."""
    routed = domains.headers.where("source = 'route'").select(*DOMAIN)
    entries = domains.files.where(F.col("role") == ENTRY).join(routed, DOMAIN, "left_semi")
    aliased = features.where(F.size("aliased") > 0).select("repo_id", "path", "aliased")
    # Files meet their domains before their imports become rows; only repositories with such domains are looked up.
    near = index.join(routed.select("repo_id").distinct(), "repo_id", "left_semi")
    hops = resolve.related_files(
        entries.select(*DOMAIN, "path").join(aliased, ["repo_id", "path"]).select(*DOMAIN, F.explode("aliased").alias("import_path")),
        near,
        DOMAIN,
    ).select(*DOMAIN, F.lit(RELATED).alias("role"), F.lit(0).cast("long").alias("rank"), "path")
    return Domains(domains.headers, domains.files.unionByName(hops))


def spec_dependencies(
    domains: Domains, features: DataFrame, index: DataFrame, cap: int | None = None
) -> DataFrame:
    """The dependencies of each domain, numbered from 1; with a cap the first ones.

    Route entries come first, the last file's last verb leading; then each
    imported file or package at its first occurrence over entry files and
    related files.
    """
    telling = features.where((F.size("imports") > 0) | (F.size("verbs") > 0)).select("repo_id", "path", "imports", "verbs")
    # Read for the specifiers, for the look-up of each import and for the routes.
    members = materialise(domains.files.join(telling, ["repo_id", "path"]))
    imported = members.select(*DOMAIN, "role", "rank", "path", F.posexplode("imports").alias("pos", "imp")).select(
        *DOMAIN, "role", "rank", "path", "pos", F.col("imp.from").alias("import_path"), F.col("imp.names").alias("names")
    )
    classified = resolve.dependencies(imported, index).withColumn(
        "key", F.when(F.col("file") != "", F.col("file")).otherwise(F.col("name"))
    )
    # First occurrence per key as an aggregate, so that it is reduced before the shuffle.
    at = F.struct("role", "rank", "path", "pos")
    first = classified.groupBy(*DOMAIN, "key").agg(F.min(F.struct(at.alias("at"), F.struct("type", "name", "file").alias("dep"))).alias("first"))
    imports = first.select(*DOMAIN, F.lit(1).alias("band"), "first.at", "first.dep")
    entry = members.where(F.col("role") == ENTRY)
    verbs = entry.select(*DOMAIN, "role", "rank", "path", F.posexplode("verbs").alias("pos", "verb"))
    routes = (
        verbs.groupBy(*DOMAIN, "path", "verb")
        .agg(F.min(at).alias("at"))
        .select(
            *DOMAIN,
            F.lit(0).alias("band"),
            "at",
            F.struct(
                F.lit("api_route").alias("type"),
                F.concat("verb", F.lit(" /"), "path").alias("name"),
                F.col("path").alias("file"),
            ).alias("dep"),
        )
    )
    route_at = F.when(F.col("band") == 0, F.col("at"))
    import_at = F.when(F.col("band") == 1, F.col("at"))
    order = ["band", route_at.desc(), import_at.asc()]
    rows = routes.unionByName(imports)
    if cap is None:
        rows = numbered(rows, DOMAIN, order, "dep_no")
    else:
        rows = rows.withColumn("dep_no", F.row_number().over(Window.partitionBy(*DOMAIN).orderBy(*order))).where(F.col("dep_no") <= cap)
    return rows.select(*DOMAIN, "dep_no", "dep.type", "dep.name", "dep.file")


def spec_tags(domains: Domains, deps: DataFrame) -> DataFrame:
    """Framework, dependency types in order of first occurrence, and the kebab-case display name."""
    # One row per type: the list of a domain is as long as there are types.
    firsts = deps.groupBy(*DOMAIN, "type").agg(F.min("dep_no").alias("at"))
    listed = firsts.groupBy(*DOMAIN).agg(F.array_sort(F.collect_list(F.struct("at", "type")))["type"].alias("types"))
    joined = domains.headers.join(listed, DOMAIN, "left")
    slug = F.replace(F.lower("display_name"), F.lit(" "), F.lit("-"))
    tags = F.concat(F.array("framework"), F.coalesce("types", F.array().cast("array<string>")), F.array(slug))
    return joined.select(*DOMAIN, "spec_id", "display_name", "framework", tags.alias("tags"))


def spec_files(domains: Domains) -> DataFrame:
    """Every entry and related file of each domain, by rank and path."""
    return domains.files.select(*DOMAIN, "role", "rank", "path")


def spec_meta(domains: Domains, deps: DataFrame) -> DataFrame:
    """Metadata of each domain; its lists are the rows of :func:`spec_files` and of the dependencies."""
    counts = domains.files.groupBy(*DOMAIN).agg(
        *[F.count(F.when(F.col("role") == r, 1)).alias(f"n_{r}") for r in (ENTRY, RELATED)]
    )
    internal = deps.where(F.col("type") != "external_package").groupBy(*DOMAIN).agg(F.count("*").alias("n_dependencies"))
    return (
        spec_tags(domains, deps)
        .join(counts, DOMAIN)
        .join(internal, DOMAIN, "left")
        .select(
            *DOMAIN,
            "spec_id",
            F.col("display_name").alias("feature_name"),
            F.concat(
                F.lit("Auto-generated spec for "), "display_name", F.lit(" ("), "framework", F.lit(" framework).")
            ).alias("description"),
            *[f"n_{r}" for r in (ENTRY, RELATED)],
            F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"),
            "framework",
            "tags",
            F.lit(True).alias("auto_generated"),
        )
    )


def domain_auth(domains: Domains, features: DataFrame) -> DataFrame:
    """Auth label of the first entry file that has one."""
    entry = domains.files.where(F.col("role") == ENTRY)
    labelled = entry.join(features.where("auth is not null").select("repo_id", "path", "auth"), ["repo_id", "path"])
    return labelled.groupBy(*DOMAIN).agg(F.min_by("auth", F.struct("rank", "path")).alias("auth"))


def _line(rows: DataFrame, section: int, rank, key, text) -> DataFrame:
    """Lines of one section of a document; ``rank`` and ``key`` order them within it."""
    return rows.select(
        *DOMAIN,
        F.lit(section).alias("section"),
        F.lit(rank).cast("long").alias("rank") if isinstance(rank, int) else rank.cast("long").alias("rank"),
        (F.lit(key) if isinstance(key, str) else key).alias("key"),
        text.alias("line"),
    )


def _first_files(domains: Domains, role: str, n: int | None) -> DataFrame:
    """The files of a role per domain, the first ``n`` if asked for."""
    rows = domains.files.where(F.col("role") == role)
    if n is None:
        return rows
    w = Window.partitionBy(*DOMAIN).orderBy("rank", "path")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)


def spec_markdown(
    domains: Domains,
    deps: DataFrame,
    features: DataFrame,
    narratives: DataFrame | None = None,
    related_listed: int | None = None,
    dependencies_listed: int | None = None,
    part_lines: int = skew.PART_LINES,
) -> DataFrame:
    """The specification document of each domain, built from its lines, in parts.

    ``narratives`` (``repo_id, domain_no, reply``) replaces the generated
    overview where a reply is given.
    """
    heads = domains.headers
    plain = F.concat(
        F.lit("Auto-generated spec for the **"), "display_name", F.lit("** feature domain.\nFramework: `"),
        "framework", F.lit("`"),
    )
    if narratives is None:
        overview = plain
    else:
        heads = heads.join(narratives.select(*DOMAIN, "reply"), DOMAIN, "left")
        overview = F.coalesce(strip(F.col("reply")), plain)
    opening = F.concat(
        F.lit("# Feature Spec: "), "spec_id", F.lit("\n## Feature ID: "), "spec_id",
        F.lit("\n## Feature Name: "), "display_name",
        F.lit("\n\n---\n\n## Overview\n"), overview,
        F.lit("\n\n---\n\n## Entry Points\n\n| File | Description |\n|---|---|"),
    )
    entry = domains.files.where(F.col("role") == ENTRY)
    related = _first_files(domains, RELATED, related_listed)
    without = heads.join(related.select(*DOMAIN), DOMAIN, "left_anti")
    internal = deps.where(F.col("type") != "external_package")
    table = internal
    if dependencies_listed is not None:
        w = Window.partitionBy(*DOMAIN).orderBy("dep_no")
        table = internal.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= dependencies_listed)
    guard = domain_auth(domains, features)
    lines = [
        _line(heads, 0, 0, "", opening),
        _line(entry, 1, F.col("rank"), F.col("path"), F.concat(F.lit("| `"), "path", F.lit("` | Entry point |"))),
        _line(heads, 2, 0, "", F.lit("\n---\n\n## Related Files\n")),
        _line(related, 3, F.col("rank"), F.col("path"), F.concat(F.lit("- `"), "path", F.lit("`"))),
        _line(without, 3, 0, "", F.lit("_No related files detected._")),
        _line(heads, 4, 0, "", F.lit("\n---\n\n## Key Dependencies\n\n| Type | Name | File |\n|---|---|---|")),
        _line(table, 5, F.col("dep_no"), "",
              F.concat(F.lit("| "), "type", F.lit(" | "), "name", F.lit(" | `"), "file", F.lit("` |"))),
        _line(guard, 6, 0, "", F.concat(F.lit("\n---\n\n## Auth Pattern\n\nDetected: `"), "auth", F.lit("`"))),
        _line(heads, 7, 0, "", F.lit("")),
    ]
    return _documents(domains, lines, "markdown", part_lines)


def _documents(domains: Domains, sections: list[DataFrame], out: str, part_lines: int) -> DataFrame:
    lines = sections[0]
    for more in sections[1:]:
        lines = lines.unionByName(more)
    docs = skew.assemble(lines, DOMAIN, ["section", "rank", "key"], "line", out, part_lines)
    return docs.join(domains.headers.select(*DOMAIN, "spec_id"), DOMAIN).select(*DOMAIN, "spec_id", "part_no", out)


def spec_prompts(
    domains: Domains,
    deps: DataFrame,
    files: DataFrame,
    dependencies_shown: int | None = None,
    code_lines: int | None = None,
    part_lines: int = skew.PART_LINES,
) -> DataFrame:
    """Input for a text-generation function, in parts: entry files, dependencies and the first entry file's code.

    ``code_lines`` cuts the code to its first lines, ``dependencies_shown`` the list.
    """
    at = F.struct("rank", "path")
    first = domains.files.where(F.col("role") == ENTRY).groupBy(*DOMAIN).agg(F.min_by("path", at).alias("path"))
    if code_lines is None:
        whole_lines, title = F.col("content"), "\n--- Code Snippet ---\n"
    else:
        head = F.substring_index("content", "\n", code_lines)
        whole_lines = F.when(F.length(head) < F.length("content"), F.concat(head, F.lit("\n"))).otherwise(head)
        title = f"\n--- Code Snippet (First {code_lines} lines) ---\n"
    code = first.join(files, ["repo_id", "path"]).select(*DOMAIN, whole_lines.alias("code"))
    entry = domains.files.where(F.col("role") == ENTRY)
    shown = deps.where(F.col("type") != "external_package")
    if dependencies_shown is not None:
        shown = shown.where(F.col("dep_no") <= dependencies_shown)
    opening = F.concat(
        F.lit("Repository framework: "), "framework", F.lit("\nFeature domain: "), "display_name",
        F.lit("\n\nEntry files:"),
    )
    lines = [
        _line(domains.headers, 0, 0, "", opening),
        _line(entry, 1, F.col("rank"), F.col("path"), F.concat(F.lit("  - "), "path")),
        _line(domains.headers, 2, 0, "", F.lit("\nKey dependencies:")),
        _line(shown, 3, F.col("dep_no"), "",
              F.concat(F.lit("  - ["), "type", F.lit("] "), "name", F.lit(" → "), "file")),
        _line(code, 4, 0, "", F.concat(F.lit(title), "code")),
    ]
    return _documents(domains, lines, "prompt", part_lines)


def apply_text_generator(rows: DataFrame, keys: list[str], prompt: str, generate) -> DataFrame:
    """Reply of a user function to each prompt: ``keys..., reply, error``; the reply is null where it fails.

    ``generate(text) -> text`` runs inside the tasks.  Without a reply callers keep
    their deterministic text; ``error`` says what went wrong.
    """
    none = F.lit(None).cast("string")
    schema = rows.select(*keys, none.alias("reply"), none.alias("error")).schema

    def attempt(text):
        try:
            return generate(text), None
        except Exception as e:  # one failing call must not fail the others
            return None, f"{type(e).__name__}: {e}"

    def answer(batches):
        for batch in batches:
            found = [attempt(p) for p in batch.pop(prompt)]
            yield batch.assign(reply=[r for r, _ in found], error=[e for _, e in found])

    return rows.select(*keys, prompt).mapInPandas(answer, schema)
