"""Final selection of every query (DuckDB).  Column names match the Spark results."""

from oracle.parts import ALIAS_RULES, DIALECTS, TS, _pos, rules

_EDGES = "select repo_id, path, pos, import_path, array_to_string(names, ', ') as names from "
_DOMAIN_COLS = "repo_id, domain_no, spec_id, display_name, rank, path"

_auth_ts = r"""case when contains(content, 'requireAuth') and contains(content, 'verifyUserIdMatch') then 'requireAuth + verifyUserIdMatch'
 when contains(content, 'requireAuth') then 'requireAuth' when contains(content, 'getServerSession') then 'getServerSession'
 when regexp_matches(content, '\bauth\(\)') then 'auth()' when contains(content, 'verifyToken') then 'verifyToken' end"""
_auth_py = """case when contains(content, 'get_current_user') and contains(content, 'Depends') then 'Depends(get_current_user)'
 when contains(content, 'login_required') then 'login_required' when contains(content, 'jwt_required') then 'jwt_required'
 when contains(content, 'verify_token') then 'verify_token' when contains(content, 'requireAuth') then 'requireAuth' end"""
_ts_verbs = ", ".join(
    rf"case when regexp_matches(content, 'export\s+async\s+function\s+{v}\b') then '{v}' end"
    for v in ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD"]
)
_history = """select thread_id, turn, intent, n_prior, n_prior // 64 as page_no,
 coalesce(string_agg(intent, chr(31)) over (partition by thread_id, n_prior // 64 order by turn rows between unbounded preceding and 1 preceding), '') as recent
 from (select *, row_number() over (partition by thread_id order by turn) - 1 as n_prior from v_intents)"""
_pages = """select thread_id, n // 64 as page_no, string_agg(intent, chr(31) order by turn) as intents
 from (select *, row_number() over (partition by thread_id order by turn) - 1 as n from v_threads) group by all having count(*) = 64"""


def _parts(documents: str, out: str) -> str:
    """Documents cut into parts of 1,000 lines."""
    return f"""select * exclude (l, n), array_to_string(l[n * 1000 + 1 : (n + 1) * 1000], chr(10)) as {out}, n as part_no from (
 select * exclude ({out}), string_split({out}, chr(10)) as l, unnest(range((len(string_split({out}, chr(10))) + 999) // 1000)) as n from ({documents}))"""


_current = """select job_id, arg_max(status, seq) as status, arg_max(progress, seq) as progress, arg_max(message, seq) as message
 from v_job_events group by job_id"""
_throttled = "select spec_id, event_id, sec as at from c_rec_accepted"
_impacted = "select distinct c.commit_id, t.spec_id from v_changes c join c_tracked t on t.path = c.path"

_post_commit = """select 'oversized' as kind, commit_id, '' as item from c_sizes where n_files > 50
 union all select 'impacted', commit_id, spec_id from (select distinct c.commit_id, t.spec_id from v_changes c join c_tracked t on t.path = c.path)
 union all select 'renamed', commit_id, old_name || '>' || new_name from (select 'V' || (commit_seq // 20) as commit_id, old_name, arg_max(new_name, commit_seq) as new_name from c_renames group by all)
 union all select distinct 'healed', '', d.spec_id from (select distinct old_name from c_renames) r join c_dep_rows d on d.name = r.old_name"""
_commit_map = "select commit_seq // 20 as commit_no, old_name, arg_max(new_name, commit_seq) as new_name from c_renames group by all"
_closure = f"""select * from (with recursive e as ({_commit_map}),
 nxt as (select a.commit_no, a.old_name, a.new_name, (select min(b.commit_no) from e b where b.old_name = a.new_name and b.commit_no > a.commit_no) as n from e a),
 step as (select commit_no, old_name, new_name, n, 1 as hops from nxt
  union all select s.commit_no, s.old_name, t.new_name, t.n, s.hops + 1 from step s join nxt t on t.commit_no = s.n and t.old_name = s.new_name)
 select commit_no, old_name, new_name, hops from step where n is null)"""

QUERIES = {
    # sources and sinks
    "source_scan": "select repo_id, path, length(content) as n_chars from c_walk",
    "spec_catalog": "select distinct spec_id from v_spec_docs",
    "meta_scan": """select spec_id, json_array_length(j, '$.entry_files') as n_entry, json_array_length(j, '$.related_files') as n_related,
 json_array_length(j, '$.dependencies') as n_dependencies, json_array_length(j, '$.tags') as n_tags from c_meta""",
    "seed_load_summary": """select kind, status, count(*) as n from (select 'document' as kind, 'valid' as status from v_spec_docs
 union all select 'metadata', case when json_valid(meta_json) then 'valid' else 'invalid' end from v_spec_meta
 union all select 'constitution', 'valid' from c_constitution) group by all""",
    "version_pairs": "select path, commit_seq, md5(old_content) as old_md5, md5(content) as new_md5 from c_pairs",
    "commit_window": "select repo_id, seq, rn, hexsha, author, message, diff from c_window",
    "config_samples": """select repo_id, path, content as sample from v_source_files
 where path in ('package.json','Cargo.toml','Gemfile','go.mod','pom.xml','build.gradle','requirements.txt')""",
    "spec_upsert": """select repo_id, spec_id, part_no, md5(markdown) as markdown_md5 from (""" + _parts("""
 select repo_id, spec_id, markdown, fresh from (select *, row_number() over (partition by repo_id, spec_id order by fresh desc, domain_no desc) as rn from (
  select 'r0' as repo_id, 0 as domain_no, spec_id, markdown, 0 as fresh from v_spec_docs
  union all select 'r0', 0, 'G0', 'old', 0
  union all select repo_id, domain_no, spec_id, markdown, 1 from c_markdown)) where rn = 1 and fresh = 1""", "markdown") + """) union all
 select 'r0', d.spec_id, 0, md5(markdown) from v_spec_docs d where d.spec_id not in (select spec_id from c_heads where repo_id = 'r0')
 union all select 'r0', 'G0', 0, md5('old') where 'G0' not in (select spec_id from c_heads where repo_id = 'r0')""",
    # predicates
    "ignored_paths": r"""select repo_id, path, case when t.path2 is null then 1 else 0 end as tree,
 cast(list_has_any(dirs, ['node_modules','.venv','target','bin','obj','dist','build','__pycache__']) as int) as lookup,
 cast(list_has_any(dirs, ['node_modules','.venv','target','bin','obj','dist','build','__pycache__','.git']) as int) as repair,
 cast(contains(path, '.venv') or contains(path, '__pycache__') as int) as python,
 cast(path[1] = '.' or coalesce(dirs[1], '') in ('node_modules','__pycache__','.venv','dist','build') as int) as generic
 from c_files f left join (select repo_id as repo2, path as path2 from c_tree where base[1] <> '.'
  and not regexp_matches(base, '(\.pyc|\.png|\.jpg|\.jpeg|\.ico|\.svg|\.zip|\.tar\.gz|\.lock)$')) t on t.repo2 = f.repo_id and t.path2 = f.path""",
    "changed_paths": "select commit_id, pos, replace(path, '\\', '/') as path from v_changes where path[1] <> '.'",
    "commit_guard": "select commit_id, n_files, n_files > 50 as over_limit from c_sizes",
    "payload_limits": "select thread_id, turn, payload, length(payload) as n_chars, length(payload) > 50000 as over_limit from c_payload",
    "candidate_domains": """select repo_id, domain_no, spec_id, pos as rank, repaired as path from c_repaired join (
 select repo_id, spec_id, row_number() over (partition by repo_id order by spec_id) as domain_no from (select distinct repo_id, spec_id from c_repaired))
 using (repo_id, spec_id)""",
    # extraction
    "import_edges": _EDGES + "c_edges",
    **{f"imports_{d}": _EDGES + "(" + _pos(b) + ")" for d, b in DIALECTS.items()},
    "ts_import_edges": _EDGES + "c_ts_edges",
    "ts_exports": rf"""select repo_id, path, unnest(range(len(l))) as pos, unnest(l) as name from (select repo_id, path,
 regexp_extract_all(content, 'export\s+(?:async\s+)?function\s+(\w+)', 1) || regexp_extract_all(content, 'export\s+const\s+(\w+)\s*[=:]', 1)
 || regexp_extract_all(content, 'export\s+class\s+(\w+)', 1) as l from c_files where lower(ext) in {TS})""",
    "fn_fingerprints": """select path, commit_seq, name, coalesce(old_bodies[list_position(old_names, name)] = body, false) as same_as_prev from c_new_fns""",
    "fn_names_regex": "select path, commit_seq, unnest(list_distinct(names)) as name from c_versions where not ok",
    "auth_tags": "select repo_id, path, auth from c_auth where auth is not null",
    "auth_tags_ts": f"select repo_id, path, auth from (select repo_id, path, {_auth_ts} as auth from c_files where lower(ext) in {TS}) where auth is not null",
    "auth_tags_py": f"select repo_id, path, auth from (select repo_id, path, {_auth_py} as auth from c_files where lower(ext) = '.py') where auth is not null",
    "http_verbs": "select repo_id, path, pos, verb from c_verbs",
    "http_verbs_ts": f"""select repo_id, path, unnest(range(len(l))) as pos, unnest(l) as verb from (select repo_id, path,
 list_filter([{_ts_verbs}], lambda x: x is not null) as l from c_files where lower(ext) in {TS})""",
    "reply_parse": "select intent_id, ok, array_to_string(ids, ',') as spec_ids, needed, message from c_parsed",
    # joins
    "resolve_direct": "select repo_id, import_path, type, file from c_direct",
    "resolve_stem": "select repo_id, import_path, type, stem, file from c_named",
    "dependencies": "select repo_id, path, pos, type, name, file from c_deps",
    "alias_dependencies": f"""select repo_id, path, pos, case when internal then {rules('file', ALIAS_RULES, 'util')} else 'external_package' end as type,
 case when internal and len(names) > 0 then array_to_string(names, ', ') else import_path end as name, file from (
 select e.*, regexp_matches(import_path, '^(@/|\\./|\\.\\./)') as internal,
  case when regexp_matches(import_path, '^(@/|\\./|\\.\\./)') then coalesce(i.path, regexp_replace(replace(import_path, '@/', 'src/'), '^[./]+', '')) else '' end as file
 from c_ts_edges e left join (select repo_id, root, arg_min(path, list_position(['.ts','.tsx','.js','.jsx','.py'], ext)) as path from c_index
  where ext in ('.ts','.tsx','.js','.jsx','.py') group by all) i
 on i.repo_id = e.repo_id and i.root = regexp_replace(replace(import_path, '@/', 'src/'), '^[./]+', ''))""",
    "related_files": "select repo_id, spec_id, path from c_related",
    "impacted_specs": _impacted,
    "new_domains": """select distinct repo_id, domain_no, spec_id, display_name, framework from c_entry e where repo_id = 'r0'
 and spec_id not in (select spec_id from v_spec_docs) and spec_id not in ('G0','G10')
 and exists (select 1 from c_entry x join c_r0_changed c using (repo_id, path) where x.repo_id = e.repo_id and x.domain_no = e.domain_no)""",
    "path_repair": "select repo_id, spec_id, pos, path, repaired from c_repaired",
    "route_intents": "select thread_id, turn, pos, spec_id from c_routes",
    "route_replies": """select intent_id, ok, case when needed then '' else array_to_string(ids, ',') end as spec_ids,
 case when needed then coalesce(nullif(message, ''), 'Your query is too broad. Please specify a narrower set of features (up to 3 specs).') end as clarification
 from c_parsed""",
    "retrieve_meta": """select thread_id, turn, pos, spec_id, array_to_string((j->'entry_files')::varchar[], ',') as entry_files,
 json_array_length(j, '$.dependencies') as n_dependencies from c_routes join c_meta using (spec_id)""",
    "retrieve_docs": """select thread_id, turn, pos, spec_id, md5(markdown) as markdown_md5, (select body from c_constitution) as constitution
 from c_routes join v_spec_docs using (spec_id)""",
    "rename_exact": "select path, commit_seq, old_name, new_name from c_exact",
    "rename_singleton": "select path, commit_seq, old_name, new_name from c_singleton",
    "rename_regex": "select path, commit_seq, old_name, new_name from c_regex",
    "heal_dependencies": """select d.spec_id, d.i as dep_pos, d.type, coalesce(m.new_name, d.name) as name, d.file from c_dep_rows d
 left join (select old_name, arg_max(new_name, commit_seq) as new_name from c_renames group by old_name) m on m.old_name = d.name
 where d.spec_id in (select d2.spec_id from c_dep_rows d2 join c_renames r on r.old_name = d2.name)""",
    "regen_plan": """select distinct e.repo_id, e.spec_id, e.domain_no, e.display_name, e.framework from c_entry e where repo_id = 'r0' and spec_id <> 'G14'
 and e.domain_no in (select m.domain_no from c_members m join c_r0_changed c using (repo_id, path)
  union select s.domain_no from c_spec_deps s join c_r0_changed c on c.repo_id = s.repo_id and c.path = s.file where s.type <> 'external_package')""",
    # aggregations
    "framework": "select repo_id, framework from c_framework",
    "domains_nextjs": f"select {_DOMAIN_COLS} from c_next",
    "domains_python": f"select {_DOMAIN_COLS} from c_py",
    "domains_generic": f"select {_DOMAIN_COLS} from c_gen",
    "domains": f"select {_DOMAIN_COLS}, framework from c_entry",
    "spec_dependencies": "select repo_id, domain_no, dep_no, type, name, file from c_spec_deps",
    "spec_tags": "select repo_id, domain_no, spec_id, tags from c_tags",
    "spec_files": "select repo_id, domain_no, role, rank, path from c_members",
    "spec_meta": """select t.repo_id, t.domain_no, t.spec_id, t.display_name as feature_name,
 'Auto-generated spec for ' || display_name || ' (' || framework || ' framework).' as description, m.n_entry, m.n_related,
 coalesce(d.n, 0) as n_dependencies, framework, tags, true as auto_generated from c_tags t
 join (select repo_id, domain_no, count(*) filter (role = 'entry') as n_entry, count(*) filter (role = 'related') as n_related from c_members group by all) m using (repo_id, domain_no)
 left join (select repo_id, domain_no, count(*) as n from c_spec_deps where type <> 'external_package' group by all) d using (repo_id, domain_no)""",
    "spec_markdown": _parts("select repo_id, domain_no, spec_id, markdown from c_markdown", "markdown"),
    "spec_splice": _parts("""select repo_id, domain_no, spec_id, opening || case when domain_no % 2 = 0 then 'Narrative of ' || spec_id else overview end || rest as markdown from c_lines""", "markdown"),
    "spec_prompts": _parts("""select h.repo_id, h.domain_no, h.spec_id, 'Repository framework: ' || framework || chr(10) || 'Feature domain: ' || display_name || chr(10) || chr(10)
 || 'Entry files:' || chr(10) || e.lines || chr(10) || chr(10) || 'Key dependencies:' || coalesce(chr(10) || d.lines, '') || chr(10) || chr(10)
 || '--- Code Snippet ---' || chr(10) || c.content as prompt
 from c_heads h
 join (select repo_id, domain_no, string_agg('  - ' || path, chr(10) order by rank, path) as lines, first(path order by rank, path) as head from c_entry group by all) e using (repo_id, domain_no)
 join v_source_files c on c.repo_id = h.repo_id and c.path = e.head
 left join (select repo_id, domain_no, string_agg('  - [' || type || '] ' || name || ' → ' || file, chr(10) order by dep_no) as lines from c_spec_deps
   where type <> 'external_package' group by all) d on d.repo_id = h.repo_id and d.domain_no = h.domain_no""", "prompt"),
    "commit_batches": "select repo_id, batch_id, digest from c_batches",
    "digest_rollup": _parts("""select repo_id, string_agg('Batch ' || (batch_id + 1) || ' Summary:' || chr(10) || 'Ollama is offline. Skipped batch summary.', chr(10) || chr(10) order by batch_id) as rollup
 from c_batches group by repo_id""", "rollup"),
    "rename_map": _commit_map,
    "rename_closure": _closure,
    "heal_over_commits": f"""select * from (with c as ({_closure}), m as (select old_name, arg_min(new_name, commit_no) as new_name from c group by old_name)
 select d.spec_id, d.i as dep_pos, d.type, coalesce(m.new_name, d.name) as name, d.file from c_dep_rows d left join m on m.old_name = d.name
 where d.spec_id in (select d2.spec_id from c_dep_rows d2 join m on m.old_name = d2.name))""",
    "tree_map": _parts("""select repo_id, string_agg(line, chr(10) order by section, dirs, name) as tree from (
 select repo_id, 0 as section, dirs, '' as name, repeat('  ', len(dirs)) || '[Dir] ' || dirs[-1] || '/' as line from (
  select distinct repo_id, list_slice(dirs, 1, n) as dirs from (select repo_id, dirs, unnest(range(1, len(dirs) + 1)) as n from c_tree))
 union all select repo_id, 0, dirs, base, repeat('  ', len(dirs)) || '  - ' || base from c_walk
 union all select repo_id, 2, [], lpad(cast(list_position(['package.json','Cargo.toml','Gemfile','go.mod','pom.xml','build.gradle','requirements.txt'], path) as varchar), 2, '0'),
  chr(10) || '--- Root Configuration File: ' || path || ' ---' || chr(10) || content
  from v_source_files where path in ('package.json','Cargo.toml','Gemfile','go.mod','pom.xml','build.gradle','requirements.txt')
 union all select distinct repo_id, 1, []::varchar[], '', '' from v_source_files where repo_id not in (select repo_id from v_source_files
  where path in ('package.json','Cargo.toml','Gemfile','go.mod','pom.xml','build.gradle','requirements.txt'))) group by repo_id""", "tree"),
    "payload": "select thread_id, turn, payload from c_payload",
    "job_current": _current,
    # windows and sets
    "intent_history": _history,
    "history_pages": _pages,
    "progress_monotone": """select job_id, seq, greatest(30, max(least(50, case when p >= 10 then 30 + trunc((p - 10) / 35 * 20)::int else 30 end))
 over (partition by job_id order by seq rows unbounded preceding)) as progress from v_scan_progress where p > 0""",
    "progress_domains": """select job_id, pos, least(95, 50 + trunc(45 / count(*) over (partition by job_id))::int
 * sum(success::int) over (partition by job_id order by pos rows unbounded preceding))::int as progress from v_domain_results""",
    "tracked_files": "select spec_id, path from c_tracked",
    # streams
    "post_commit": _post_commit,
    "post_commit_stream": _post_commit,
    "throttle": _throttled,
    "throttle_stream": _throttled,
    "job_stream": _current,
    "history_stream": _history.replace("v_intents", "v_threads"),
}
