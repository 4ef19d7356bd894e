"""Registered queries: every operator applied to views over the given tables."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave import fixtures
from loreweave.functions import constants as K
from loreweave.operators import (
    commits, domains as dom, history, impact, imports, jobs, renames, resolve, retrieval, routing, specs, tags, throttle, treemap,
)
from loreweave.plans import ask, onboard, post_commit
from loreweave.session import materialise, shared_dir
from loreweave.sources import catalog, sink, tree
from loreweave.sources.merge import BucketTable
from loreweave.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
VERSION = ["path"]
THREAD = ["thread_id", "turn"]


class Inputs:
    """Views of one data folder, and what several queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    @property
    def files(self) -> DataFrame:
        return self.view("v_source_files")

    @property
    def index(self) -> DataFrame:
        return resolve.file_index(self.files)

    @property
    def meta(self) -> DataFrame:
        return catalog.parse_meta(self.view("v_spec_meta"))

    @property
    def pairs(self) -> DataFrame:
        return renames.pair_versions(renames.parse_versions(self.view("v_file_versions")), VERSION)

    @property
    def routes(self) -> DataFrame:
        return routing.route_intents(self.view("v_intents"), THREAD, self.view("v_rules"), self.view("v_spec_docs"))

    @property
    def constitution(self) -> DataFrame:
        regions = self.spark.read.parquet(f"{self.sf_dir}/region.parquet")  # one document, five lines
        lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), "r_name")))
        return regions.agg(F.array_join(lines, "\n").alias("body"))

    @property
    def documents(self) -> DataFrame:
        return self.view("v_spec_docs").select("spec_id", "markdown")

    def survey(self) -> tuple[onboard.Survey, DataFrame]:
        found = onboard.survey(self.files)
        return found, onboard.dependencies(found)

    def changed_r0(self) -> DataFrame:
        path = F.col("path")
        order = F.regexp_extract(path, "o([0-9]+)/route", 1).cast("long")
        return self.files.where((F.col("repo_id") == "r0") & path.like("%/route.ts") & (order % 1000 == 0)).select("repo_id", "path")


def _joined(names: str = "names"):
    return F.array_join(names, ", ").alias("names")


def _edges(df: DataFrame) -> DataFrame:
    return df.select("repo_id", "path", "pos", "import_path", _joined())


def _domain_rows(found: dom.Domains, *more: str) -> DataFrame:
    entry = found.files.where(F.col("role") == dom.ENTRY)
    return entry.join(found.headers, ["repo_id", "domain_no"]).select("repo_id", "domain_no", "spec_id", "display_name", "rank", "path", *more)


def source_scan(i: Inputs) -> DataFrame:
    return tree.source_scan(i.files).select("repo_id", "path", F.length("content").alias("n_chars"))


def spec_catalog(i: Inputs) -> DataFrame:
    return catalog.spec_catalog(i.documents.select(F.concat("spec_id", F.lit(".md")).alias("key")))


def meta_scan(i: Inputs) -> DataFrame:
    lists = [("n_entry", "entry_files"), ("n_related", "related_files"), ("n_dependencies", "dependencies"), ("n_tags", "tags")]
    return i.meta.select("spec_id", *[F.size(c).cast("long").alias(n) for n, c in lists])


def seed_load_summary(i: Inputs) -> DataFrame:
    entries = (
        i.documents.select(F.concat("spec_id", F.lit(".md")).alias("key"), F.col("markdown").alias("body"))
        .unionAll(i.view("v_spec_meta").select(F.concat("spec_id", F.lit(".meta.json")), "meta_json"))
        .unionAll(i.constitution.select(F.lit("hot_memory.md"), "body"))
    )
    return catalog.seed_load_summary(entries)


def version_pairs(i: Inputs) -> DataFrame:
    pairs = renames.version_pairs(i.view("v_file_versions"), VERSION)
    return pairs.select("path", "commit_seq", F.md5("old_content").alias("old_md5"), F.md5("content").alias("new_md5"))


def spec_upsert(i: Inputs) -> DataFrame:
    """Generated documents merged into a bucketed table of the stored ones."""
    found, deps = i.survey()
    text = specs.spec_markdown(found.domains, deps, found.features)
    old = i.documents.select(F.lit("r0").alias("repo_id"), "spec_id", F.lit(0).alias("domain_no"), F.lit(0).alias("part_no"), "markdown")
    placeholder = i.spark.sql("select 'r0' as repo_id, 'G0' as spec_id, 0 as domain_no, 0 as part_no, 'old' as markdown")
    new = text.select("repo_id", "spec_id", "domain_no", "part_no", "markdown")
    key = ["repo_id", "spec_id"]
    store = BucketTable(i.spark, f"{shared_dir(i.spark)}/loreweave-{uuid.uuid4().hex}", tuple(key), buckets=16)
    fold = sink.winning_parts(key, ["domain_no"])
    store.merge(old.unionByName(placeholder), 0, fold)
    store.merge(new, 1, fold)
    return store.read().select("repo_id", "spec_id", "part_no", F.md5("markdown").alias("markdown_md5"))


def ignored_paths(i: Inputs) -> DataFrame:
    profiles = ["tree", "lookup", "repair", "python", "generic"]
    return i.files.select("repo_id", "path", *[treemap.ignored_by(p, F.col("path")).cast("int").alias(p) for p in profiles])


def candidate_domains(i: Inputs) -> DataFrame:
    """Suggestions as a model replies them: parsed, checked against the files and numbered."""
    rows = i.view("v_candidates")
    item = F.struct("spec_id", F.col("spec_id").alias("display_name"), F.array_sort(F.collect_list(F.struct("pos", "path")))["path"].alias("entry_files"))
    replies = rows.groupBy("repo_id", "spec_id").agg(F.to_json(F.array(item)).alias("reply")).select("repo_id", "reply")
    suggested, candidates = dom.suggestions(dom.parse_candidates(replies))
    found = dom.candidate_domains(suggested, candidates, i.index)
    return found.files.join(found.headers, ["repo_id", "domain_no"]).select("repo_id", "domain_no", "spec_id", "rank", "path")


def ts_exports(i: Inputs) -> DataFrame:
    return imports.ts_exports(i.files)


def fn_names_regex(i: Inputs) -> DataFrame:
    parsed = renames.parse_versions(i.view("v_file_versions"))
    return parsed.where("not ok").select("path", "commit_seq", F.explode("names").alias("name"))


def reply_parse(i: Inputs) -> DataFrame:
    parsed = routing.parse_replies(i.view("v_llm_replies"), ["intent_id"])
    return parsed.select("intent_id", "ok", F.array_join("spec_ids", ",").alias("spec_ids"), "needed", "message")


def _resolved(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Distinct specifiers and the index, from one pass over the texts."""
    features = materialise(specs.file_features(i.files))
    edges = features.select("repo_id", "path", F.posexplode("imports").alias("pos", "imp")).select(
        "repo_id", "path", "pos", F.col("imp.from").alias("import_path"), F.col("imp.names").alias("names")
    )
    return edges, resolve.file_index(features)


def resolve_direct(i: Inputs) -> DataFrame:
    edges, index = _resolved(i)
    return resolve.resolve_direct(resolve.specifiers(edges), index).select("repo_id", "import_path", "type", "file")


def resolve_stem(i: Inputs) -> DataFrame:
    edges, index = _resolved(i)
    return resolve.resolve_stem(resolve.specifiers(edges), index).select("repo_id", "import_path", "type", "stem", "file")


def dependencies(i: Inputs) -> DataFrame:
    edges, index = _resolved(i)
    return resolve.dependencies(edges, index).select("repo_id", "path", "pos", "type", "name", "file")


def alias_dependencies(i: Inputs) -> DataFrame:
    edges = materialise(imports.ts_import_edges(i.files))
    return resolve.alias_dependencies(edges, i.index).select("repo_id", "path", "pos", "type", "name", "file")


def related_files(i: Inputs) -> DataFrame:
    found = onboard.survey(i.files)
    rows = found.domains.files.where(F.col("role") == dom.RELATED)
    return rows.join(found.domains.headers, ["repo_id", "domain_no"]).select("repo_id", "spec_id", "path")


def impacted_specs(i: Inputs) -> DataFrame:
    return impact.impacted_specs(i.view("v_changes"), impact.tracked_files(i.meta), ["commit_id"])


def new_domains(i: Inputs) -> DataFrame:
    changed = materialise(i.changed_r0())
    known = i.documents.select("spec_id").unionAll(i.spark.sql("select * from values ('G0'), ('G10') as t(spec_id)"))
    return impact.new_domains(onboard.domains_of(onboard.in_touched_repos(i.files, changed)), known, changed)


def path_repair(i: Inputs) -> DataFrame:
    return dom.repair_paths(i.view("v_candidates"), i.index).select("repo_id", "spec_id", "pos", "path", "repaired")


def route_replies(i: Inputs) -> DataFrame:
    parsed = routing.route_replies(routing.parse_replies(i.view("v_llm_replies"), ["intent_id"]), ["intent_id"])
    return parsed.select("intent_id", "ok", F.array_join("spec_ids", ",").alias("spec_ids"), "clarification")


def retrieve_meta(i: Inputs) -> DataFrame:
    rows = retrieval.retrieve_meta(i.routes, i.meta)
    return rows.select("thread_id", "turn", "pos", "spec_id", F.array_join("entry_files", ",").alias("entry_files"), F.size("dependencies").cast("long").alias("n_dependencies"))


def retrieve_docs(i: Inputs) -> DataFrame:
    rows = retrieval.retrieve_docs(i.routes, i.documents.withColumn("markdown", F.md5("markdown")))
    return rows.select("thread_id", "turn", "pos", "spec_id", F.col("markdown").alias("markdown_md5"), retrieval.global_text(i.constitution).alias("constitution"))


def _renames(kind: str):
    return lambda i: renames.renames(i.pairs, ["path", "commit_seq"], (kind,))


def heal_dependencies(i: Inputs) -> DataFrame:
    mapping = renames.rename_map(renames.renames(i.pairs, ["path", "commit_seq"]), ["commit_seq"])
    healed = renames.heal_dependencies(materialise(i.meta), mapping)
    return healed.select("spec_id", F.posexplode("dependencies").alias("dep_pos", "d")).select("spec_id", "dep_pos", "d.type", "d.name", "d.file")


def regen_plan(i: Inputs) -> DataFrame:
    found, touched = onboard.touched_domains(i.files, materialise(i.changed_r0()))
    heads = found.headers.where("spec_id <> 'G14'")
    hit = heads.join(touched, ["repo_id", "domain_no"], "left_semi").select("repo_id", "spec_id")
    return impact.regen_plan(hit, found).select("repo_id", "spec_id", "domain_no", "display_name", "framework")


def spec_tags(i: Inputs) -> DataFrame:
    found, deps = i.survey()
    return specs.spec_tags(found.domains, deps).select("repo_id", "domain_no", "spec_id", F.array_join("tags", ",").alias("tags"))


def spec_meta(i: Inputs) -> DataFrame:
    found, deps = i.survey()
    return specs.spec_meta(found.domains, deps).withColumn("tags", F.array_join("tags", ","))


def spec_markdown(i: Inputs) -> DataFrame:
    found, deps = i.survey()
    return specs.spec_markdown(found.domains, deps, found.features)


def spec_splice(i: Inputs) -> DataFrame:
    """Documents with the replies of a text function in place of the overview, where it gave one."""
    found, deps = i.survey()
    prompts = found.domains.headers.select(*specs.DOMAIN, F.when(F.col("domain_no") % 2 == 0, F.col("spec_id")).alias("prompt"))
    replies = specs.apply_text_generator(prompts, specs.DOMAIN, "prompt", lambda text: "Narrative of " + text)
    return specs.spec_markdown(found.domains, deps, found.features, replies)


def spec_prompts(i: Inputs) -> DataFrame:
    found, deps = i.survey()
    return specs.spec_prompts(found.domains, deps, found.files)


def rename_map(i: Inputs) -> DataFrame:
    found = renames.renames(i.pairs, ["path", "commit_seq"]).withColumn("commit_no", F.floor(F.col("commit_seq") / 20))
    return renames.rename_map(found, ["commit_seq"], ["commit_no"])


def heal_over_commits(i: Inputs) -> DataFrame:
    """Metadata healed by all commits in their order."""
    healed = renames.heal_dependencies(materialise(i.meta), renames.first_renames(renames.rename_closure(rename_map(i))))
    return healed.select("spec_id", F.posexplode("dependencies").alias("dep_pos", "d")).select("spec_id", "dep_pos", "d.type", "d.name", "d.file")


def post_commit_stream(i: Inputs) -> DataFrame:
    """Changed paths and file versions as they arrive, in one stream."""
    changes = i.view("v_changes").select(F.col("pos").alias("seq"), "commit_id", "path", F.lit(None).cast("string").alias("content"))
    versions = i.view("v_file_versions").select(F.col("commit_seq").alias("seq"), F.concat(F.lit("V"), F.floor(F.col("commit_seq") / 20)).alias("commit_id"), "path", "content")
    meta = materialise(i.meta)
    return streams.replayed(changes.unionByName(versions), "seq", lambda source, out, state: post_commit.stream(source, meta, out, state, buckets=8), parts=2, result=post_commit.results)


def _answers(i: Inputs) -> DataFrame:
    return ask.answer(i.view("v_intents"), THREAD, i.view("v_rules"), i.documents, i.meta, i.constitution)


def intent_history(i: Inputs) -> DataFrame:
    return history.intent_history(i.view("v_intents")).withColumn("recent", F.array_join("recent", "\x1f"))


def history_pages(i: Inputs) -> DataFrame:
    return history.history_pages(history.intent_history(i.view("v_threads"))).withColumn("intents", F.array_join("intents", "\x1f"))


_BY_INPUTS: dict[str, Callable[[Inputs], DataFrame]] = {
    "source_scan": source_scan,
    "spec_catalog": spec_catalog,
    "meta_scan": meta_scan,
    "seed_load_summary": seed_load_summary,
    "version_pairs": version_pairs,
    "commit_window": lambda i: commits.commit_window(i.view("v_commits")),
    "config_samples": lambda i: treemap.config_samples(i.files),
    "spec_upsert": spec_upsert,
    "ignored_paths": ignored_paths,
    "changed_paths": lambda i: impact.changed_paths(i.view("v_changes")),
    "commit_guard": lambda i: impact.commit_guard(i.view("v_changes")),
    "payload_limits": lambda i: retrieval.payload_limits(_answers(i)),
    "candidate_domains": candidate_domains,
    "import_edges": lambda i: _edges(imports.import_edges(i.files)),
    **{f"imports_{d}": (lambda i, d=d: _edges(imports.dialect_edges(i.files, d))) for d in imports.DIALECTS},
    "ts_import_edges": lambda i: _edges(imports.ts_import_edges(i.files)),
    "ts_exports": ts_exports,
    "fn_fingerprints": lambda i: renames.fn_fingerprints(i.pairs, VERSION),
    "fn_names_regex": fn_names_regex,
    "auth_tags": lambda i: tags.auth_tags(i.files),
    "auth_tags_ts": lambda i: tags.auth_tags(i.files, K.AUTH_RULES_TS, "ts"),
    "auth_tags_py": lambda i: tags.auth_tags(i.files, K.AUTH_RULES_PY, "py"),
    "http_verbs": lambda i: tags.http_verbs(i.files),
    "http_verbs_ts": lambda i: tags.http_verbs(i.files, tags.ts_verbs, "ts"),
    "reply_parse": reply_parse,
    "resolve_direct": resolve_direct,
    "resolve_stem": resolve_stem,
    "dependencies": dependencies,
    "alias_dependencies": alias_dependencies,
    "related_files": related_files,
    "impacted_specs": impacted_specs,
    "new_domains": new_domains,
    "path_repair": path_repair,
    "route_intents": lambda i: i.routes,
    "route_replies": route_replies,
    "retrieve_meta": retrieve_meta,
    "retrieve_docs": retrieve_docs,
    "rename_exact": _renames("exact"),
    "rename_singleton": _renames("singleton"),
    "rename_regex": _renames("regex"),
    "heal_dependencies": heal_dependencies,
    "regen_plan": regen_plan,
    "framework": lambda i: dom.detect_framework(i.files),
    "domains_nextjs": lambda i: _domain_rows(dom.domains_nextjs(i.index)),
    "domains_python": lambda i: _domain_rows(dom.domains_python(i.index)),
    "domains_generic": lambda i: _domain_rows(dom.domains_generic(i.index)),
    "domains": lambda i: _domain_rows(dom.discover(i.files, materialise(i.index)), "framework"),
    "spec_dependencies": lambda i: i.survey()[1],
    "spec_tags": spec_tags,
    "spec_files": lambda i: specs.spec_files(onboard.survey(i.files).domains),
    "spec_meta": spec_meta,
    "spec_markdown": spec_markdown,
    "spec_splice": spec_splice,
    "spec_prompts": spec_prompts,
    "commit_batches": lambda i: commits.commit_batches(commits.commit_window(i.view("v_commits"))),
    "digest_rollup": lambda i: commits.digest_rollup(commits.commit_batches(commits.commit_window(i.view("v_commits"))).select("repo_id", "batch_id")),
    "rename_map": rename_map,
    "rename_closure": lambda i: renames.rename_closure(rename_map(i)),
    "heal_over_commits": heal_over_commits,
    "tree_map": lambda i: treemap.tree_map(i.index, i.files),
    "payload": _answers,
    "job_current": lambda i: jobs.job_current(i.view("v_job_events")),
    "intent_history": intent_history,
    "history_pages": history_pages,
    "progress_monotone": lambda i: jobs.progress_monotone(i.view("v_scan_progress")),
    "progress_domains": lambda i: jobs.progress_domains(i.view("v_domain_results")),
    "tracked_files": lambda i: impact.tracked_files(i.meta),
    "post_commit": lambda i: post_commit.run(i.view("v_changes"), i.view("v_file_versions"), materialise(i.meta), F.concat(F.lit("V"), F.floor(F.col("commit_seq") / 20))),
    "throttle": lambda i: throttle.throttle(i.view("v_throttle_in")),
    "post_commit_stream": post_commit_stream,
    "throttle_stream": lambda i: streams.throttled(i.view("v_throttle_in"), "event_id"),
    "job_stream": lambda i: streams.replayed(i.view("v_job_events"), "seq", streams.job_current, result=streams.jobs_now),
    "history_stream": lambda i: streams.replayed(i.view("v_threads"), "turn", streams.thread_turns).withColumn("recent", F.array_join("recent", "\x1f")),
}


def queries() -> dict[str, Query]:
    return {key: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for key, f in _BY_INPUTS.items()}
