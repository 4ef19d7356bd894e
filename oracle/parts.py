"""Named sub-queries shared by the expected results (DuckDB)."""

P_TS = r"""import\s+(?:(?:\{([^}]+)\}|(\w+))\s+from\s+)?["'']([^"'']+)["'']"""
P_REQ = r"""require\s*\(\s*["'']([^"'']+)["'']\s*\)"""
P_FROM = r"(?m)^\s*from\s+([\w\.]+)\s+import\s+(.+)$"
P_IMP = r"(?m)^\s*import\s+([\w\.]+)"
P_JAVA = r"(?m)^\s*import\s+([\w\.]+);"
P_USE = r"(?m)^\s*use\s+([\w:\*\{\},\s]+);"
P_MOD = r"(?m)^\s*mod\s+(\w+);"
P_RUBY = r"""(?:require|require_relative)\s+["'']([^"'']+)["'']"""
P_GO = r'import\s+"([^"]+)"'
P_GOB = r"import\s+\(\s*([\s\S]*?)\s*\)"
P_CS = r"(?m)^\s*using\s+([\w\.]+);"
P_C = r"""(?m)^\s*#include\s+["<]([^">]+)[">]"""

RES = "['.ts','.tsx','.js','.jsx','.py','.java','.rs','.rb','.go','.cs','.cpp','.h']"
TS = "('.ts','.tsx','.js','.jsx')"


def _matches(band: int, exts: str, pattern: str, path: str, names: str, src: str = "") -> str:
    """Rows (repo_id, path, band, k, import_path, names) of one pattern; m is the match."""
    return f"""select repo_id, path, {band} as band, k, {path} as import_path, {names} as names
from (select repo_id, path, unnest(l) as m, unnest(range(len(l))) as k
      from (select repo_id, path, regexp_extract_all(content, '{pattern}') as l from c_files where lower(ext) in {exts}))"""


def _g(pattern: str, n: int) -> str:
    return f"coalesce(regexp_extract(m, '{pattern}', {n}), '')"


def _items(x: str) -> str:
    return f"list_transform(string_split({x}, ','), lambda x: trim(x))"


def _pos(branches: list[str]) -> str:
    return (
        "select repo_id, path, row_number() over (partition by repo_id, path order by band, k) - 1 as pos, "
        "import_path, names from (" + "\nunion all\n".join(branches) + ")"
    )


def _last(x: str, sep: str) -> str:
    return f"string_split({x}, '{sep}')[-1]"


NONE = "[]::varchar[]"
B_TS = _matches(
    0, TS, P_TS, _g(P_TS, 3),
    f"case when {_g(P_TS, 1)} <> '' then list_transform(list_filter({_items(_g(P_TS, 1))}, lambda x: x <> ''), "
    f"lambda x: split_part(x, ' as ', 1)) when {_g(P_TS, 2)} <> '' then [{_g(P_TS, 2)}] else {NONE} end",
)
B_REQ = _matches(1, TS, P_REQ, _g(P_REQ, 1), NONE)
B_FROM = _matches(0, "('.py')", P_FROM, _g(P_FROM, 1), _items(_g(P_FROM, 2)))
B_IMP = _matches(1, "('.py')", P_IMP, _g(P_IMP, 1), f"[{_g(P_IMP, 1)}]")
B_JAVA = _matches(0, "('.java','.kt')", P_JAVA, _g(P_JAVA, 1), f"[{_last(_g(P_JAVA, 1), '.')}]")
_use = f"replace(trim({_g(P_USE, 1)}), ' ', '')"
B_USE = _matches(0, "('.rs')", P_USE, _use, f"[{_last(_use, '::')}]")
B_MOD = _matches(1, "('.rs')", P_MOD, f"'./' || {_g(P_MOD, 1)}", f"[{_g(P_MOD, 1)}]")
B_RUBY = _matches(0, "('.rb')", P_RUBY, _g(P_RUBY, 1), f"[{_last(_g(P_RUBY, 1), '/')}]")
B_GO = _matches(0, "('.go')", P_GO, _g(P_GO, 1), f"[{_last(_g(P_GO, 1), '/')}]")
B_GOB = f"""select repo_id, path, 1 as band, k, line as import_path, [{_last('line', '/')}] as names
from (select repo_id, path, unnest(l) as line, unnest(range(len(l))) as k
      from (select repo_id, path, list_filter(list_transform(
              flatten(list_transform(regexp_extract_all(content, '{P_GOB}', 1), lambda b: string_split(b, chr(10)))),
              lambda x: trim(trim(x), '"')), lambda x: x <> '') as l
            from c_files where lower(ext) = '.go'))"""
B_CS = _matches(0, "('.cs')", P_CS, _g(P_CS, 1), f"[{_last(_g(P_CS, 1), '.')}]")
B_C = _matches(0, "('.c','.cpp','.h','.hpp')", P_C, _g(P_C, 1), f"[{_last(_g(P_C, 1), '/')}]")

DIALECTS = {
    "ts": [B_TS, B_REQ], "py": [B_FROM, B_IMP], "java": [B_JAVA], "rust": [B_USE, B_MOD],
    "ruby": [B_RUBY], "go": [B_GO, B_GOB], "cs": [B_CS], "c": [B_C],
}


def title(x: str) -> str:
    return (
        f"list_aggregate(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), "
        "lambda t: upper(t[1]) || t[2:]), 'string_agg', '')"
    )


def spec_id(x: str) -> str:
    return (
        rf"upper(regexp_replace(trim(regexp_replace({x}, '[^a-zA-Z0-9\s\-_]', '', 'g')), '[\s_]+', '-', 'g'))"
    )


def rules(x: str, table: list[tuple[str, list[str]]], default: str) -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains({x}, '{w}')" for w in words) + f" then '{label}'" for label, words in table
    )
    return f"case {cases} else '{default}' end"


STEM_RULES = [
    ("util", ["util", "helper"]), ("api_route", ["controller", "route", "handler", "api"]),
    ("database", ["model", "schema", "db", "entity"]), ("config", ["config"]),
]
ALIAS_RULES = [
    ("api_route", ["/api/"]), ("service", ["/service", "/provider"]), ("config", ["/config"]),
    ("database", ["/lib/", "/supabase"]), ("prompt", ["/prompt"]), ("type", ["/type"]),
    ("hook", ["/hook"]), ("component", ["/component"]),
]
_dirs = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
_tree_dirs = (
    "['.git','node_modules','.venv','venv','target','bin','obj','out','dist','build','gradle','.idea','.vscode','__pycache__']"
)

PARTS = {
    # ---- source files -------------------------------------------------------------------
    "c_files": rf"""select repo_id, path, content, coalesce(regexp_extract(path, '(?:^|/)\.*[^./][^/]*?(\.[^./]*)$', 1), '') as ext,
 string_split(path, '/')[-1] as base, {_dirs} as dirs from v_source_files""",
    "c_index": """select repo_id, path, ext, base, base[:len(base) - len(ext)] as stem, path[:len(path) - len(ext)] as root, dirs,
 regexp_matches(path, '(^|/)\\.') as hidden from c_files""",
    "c_tree": f"""select * from c_files where len(list_filter(dirs, lambda d: d[1] = '.' or list_contains({_tree_dirs}, d))) = 0""",
    "c_walk": """select * from c_tree where base[1] <> '.'
 and not regexp_matches(base, '(\\.pyc|\\.png|\\.jpg|\\.jpeg|\\.ico|\\.svg|\\.zip|\\.tar\\.gz|\\.lock)$')""",
    "c_edges": _pos([b for d in DIALECTS.values() for b in d]),
    "c_ts_edges": _pos([B_TS]),
    # ---- resolution ---------------------------------------------------------------------
    "c_specifiers": "select distinct repo_id, import_path from c_edges",
    "c_roots": f"""select repo_id, root, arg_min(path, list_position({RES}, ext)) as file from c_index
 where list_contains({RES}, ext) group by all""",
    "c_direct": r"""select s.repo_id, s.import_path, case when contains(clean, '/util') then 'util' else 'service' end as type, r.file
 from (select *, regexp_replace(replace(import_path, '@/', 'src/'), '^[./]+', '') as clean from c_specifiers) s
 join c_roots r on r.repo_id = s.repo_id and r.root = s.clean""",
    "c_stems": f"""select repo_id, stem, first(path order by list_position({RES}, ext), path) as file from c_index
 where list_contains({RES}, ext) and not hidden
 and not list_has_any(dirs, ['node_modules','.venv','target','bin','obj','dist','build','__pycache__']) group by all""",
    "c_named": f"""select s.repo_id, s.import_path, {rules('lower(t.file)', STEM_RULES, 'service')} as type, s.stem, t.file
 from (select *, trim({_last(_last(_last('import_path', '::'), '.'), '/')}, '*') as stem from c_specifiers) s
 join c_stems t on t.repo_id = s.repo_id and t.stem = s.stem where s.stem <> ''""",
    "c_deps": """select e.repo_id, e.path, e.pos, coalesce(d.type, n.type, 'external_package') as type,
 case when d.file is not null then case when len(e.names) > 0 then array_to_string(e.names, ', ') else e.import_path end
      when n.file is not null then n.stem else e.import_path end as name,
 coalesce(d.file, n.file, '') as file
 from c_edges e left join c_direct d on d.repo_id = e.repo_id and d.import_path = e.import_path
 left join c_named n on n.repo_id = e.repo_id and n.import_path = e.import_path""",
    # ---- domains ------------------------------------------------------------------------
    "c_framework": """select repo_id, case
  when bool_or(path in ('next.config.ts','next.config.js','next.config.mjs')) then 'nextjs'
  when bool_or(path = 'package.json') then case when bool_or(path = 'package.json' and contains(content, '"next"')) then 'nextjs' else 'nodejs' end
  when bool_or(path = 'requirements.txt' and contains(lower(content), 'fastapi')) then 'fastapi'
  when bool_or(path = 'requirements.txt' and contains(lower(content), 'flask')) then 'flask'
  when bool_or(path in ('requirements.txt','pyproject.toml')) then 'python' else 'generic' end as framework
 from c_files group by repo_id""",
    "c_next_members": r"""select repo_id, 0 as kind, regexp_extract(path, '^src/app/api/([^/]+)/', 1) as name,
  case when base = 'route.tsx' then 1 else 0 end as rank, path from c_index
  where base in ('route.ts','route.tsx') and regexp_matches(path, '^src/app/api/[^/]+/')
 union all select repo_id, 1, 'AI-SERVICES', 0, path from c_index where path like 'src/app/services/%.ts'
 union all select repo_id, 2, 'APP-CONFIG', 0, path from c_index where regexp_matches(path, '^src/app/config/[^/.][^/]*\.ts$')""",
    "c_next_names": """select *, row_number() over (partition by repo_id order by kind, name) as domain_no
 from (select distinct repo_id, kind, name from c_next_members)""",
    "c_next": f"""select n.repo_id, n.domain_no, case when n.kind = 0 then {spec_id('n.name')} else n.name end as spec_id,
 case n.kind when 1 then 'AI Services Layer' when 2 then 'App Configuration' else {title("translate(n.name, '-_', '  ')")} end as display_name,
 m.rank, m.path from c_next_names n join c_next_members m on m.repo_id = n.repo_id and m.kind = n.kind and m.name = n.name""",
    "c_py_tiers": """select repo_id, path, stem, case when lower(stem) in ('routes','router','views','api','handlers','endpoints') then 1
  when list_has_any(dirs, ['routes','api','views','handlers']) then 2 when len(dirs) = 0 then 3 end as tier
 from c_index where path like '%.py' and not hidden and not contains(path, '.venv') and not contains(path, '__pycache__')""",
    "c_py": f"""select repo_id, domain_no, {spec_id('stem')} as spec_id, {title("replace(stem, '_', ' ')")} as display_name, 0 as rank, path
 from (select *, row_number() over (partition by repo_id order by path) as domain_no
  from (select *, min(tier) over (partition by repo_id) as best from c_py_tiers where tier is not null) where tier = best)""",
    "c_gen": f"""select repo_id, domain_no, {spec_id('top')} as spec_id, {title("translate(top, '-_', '  ')")} as display_name, 0 as rank, path
 from (select *, row_number() over (partition by repo_id order by top) as domain_no
  from (select repo_id, dirs[1] as top, min(path) as path from c_index where len(dirs) > 0 and not hidden
    and dirs[1] not in ('node_modules','__pycache__','.venv','dist','build') and ext in ('.ts','.tsx','.js','.py') group by all))""",
    "c_entry": """select d.*, f.framework from c_next d join c_framework f using (repo_id) where f.framework = 'nextjs'
 union all select d.*, f.framework from c_py d join c_framework f using (repo_id) where f.framework in ('fastapi','flask','python')
 union all select d.*, f.framework from c_gen d join c_framework f using (repo_id) where f.framework in ('nodejs','generic')""",
    "c_heads": "select distinct repo_id, domain_no, spec_id, display_name, framework from c_entry",
    "c_related": """select distinct e.repo_id, e.domain_no, e.spec_id, i.path
 from c_entry e join c_ts_edges t on t.repo_id = e.repo_id and t.path = e.path
 join (select repo_id, root, arg_min(path, list_position(['.ts','.tsx','.js','.jsx'], ext)) as path from c_index
       where ext in ('.ts','.tsx','.js','.jsx') group by all) i on i.repo_id = t.repo_id and i.root = replace(t.import_path, '@/', 'src/')
 where e.framework = 'nextjs' and e.spec_id not in ('AI-SERVICES','APP-CONFIG') and t.import_path like '@/%'""",
    "c_members": """select repo_id, domain_no, 'entry' as role, rank, path from c_entry
 union all select repo_id, domain_no, 'related', 0, path from c_related""",
    # ---- specifications -----------------------------------------------------------------
    "c_verbs": r"""select repo_id, path, pos, verb from (select repo_id, path, unnest(l) as verb, unnest(range(len(l))) as pos
  from (select repo_id, path, list_filter([
    case when regexp_matches(content, '\bGET\b|(?i:@GETMapping)|#\[get\(') then 'GET' end,
    case when regexp_matches(content, '\bPOST\b|(?i:@POSTMapping)|#\[post\(') then 'POST' end,
    case when regexp_matches(content, '\bPUT\b|(?i:@PUTMapping)|#\[put\(') then 'PUT' end,
    case when regexp_matches(content, '\bDELETE\b|(?i:@DELETEMapping)|#\[delete\(') then 'DELETE' end,
    case when regexp_matches(content, '\bPATCH\b|(?i:@PATCHMapping)|#\[patch\(') then 'PATCH' end], lambda x: x is not null) as l from c_files))""",
    "c_auth": r"""select repo_id, path, case
  when contains(content, 'get_current_user') and contains(content, 'Depends') then 'Depends(get_current_user)'
  when contains(content, 'requireAuth') and contains(content, 'verifyUserIdMatch') then 'requireAuth + verifyUserIdMatch'
  when contains(content, 'requireAuth') then 'requireAuth'
  when contains(content, 'getServerSession') then 'getServerSession'
  when regexp_matches(content, '\bauth\(\)') then 'auth()'
  when contains(content, 'login_required') then 'login_required'
  when contains(content, 'jwt_required') then 'jwt_required'
  when contains(content, 'verifyToken') then 'verifyToken'
  when contains(content, 'authorize') then 'authorize'
  when contains(content, 'authenticate') then 'authenticate' end as auth from c_files""",
    "c_first_deps": """select repo_id, domain_no, type, name, file, role, rank, path, pos from (
  select m.repo_id, m.domain_no, d.type, d.name, d.file, m.role, m.rank, m.path, d.pos,
   row_number() over (partition by m.repo_id, m.domain_no, case when d.file <> '' then d.file else d.name end order by m.role, m.rank, m.path, d.pos) as rn
  from c_members m join c_deps d on d.repo_id = m.repo_id and d.path = m.path) where rn = 1""",
    "c_spec_deps": """select repo_id, domain_no, dep_no, type, name, file from (
  select *, row_number() over (partition by repo_id, domain_no order by band, n) as dep_no from (
   select repo_id, domain_no, 0 as band, row_number() over (partition by repo_id, domain_no order by rank desc, path desc, pos desc) as n,
     'api_route' as type, verb || ' /' || path as name, path as file
   from (select m.*, v.pos, v.verb from c_members m join c_verbs v on v.repo_id = m.repo_id and v.path = m.path where m.role = 'entry')
   union all
   select repo_id, domain_no, 1, row_number() over (partition by repo_id, domain_no order by role, rank, path, pos), type, name, file from c_first_deps))""",
    "c_types": """select repo_id, domain_no, string_agg(type, ',' order by first_no) as types from (
  select repo_id, domain_no, type, min(dep_no) as first_no from c_spec_deps group by all) group by repo_id, domain_no""",
    "c_tags": """select h.*, h.framework || coalesce(',' || t.types, '') || ',' || replace(lower(h.display_name), ' ', '-') as tags
 from c_heads h left join c_types t using (repo_id, domain_no)""",
    "c_guard": """select repo_id, domain_no, first(auth order by rank, path) as auth from c_entry join c_auth using (repo_id, path)
 where auth is not null group by all""",
    "c_lines": """select h.repo_id, h.domain_no, 'Auto-generated spec for the **' || display_name || '** feature domain.' || chr(10) || 'Framework: `' || framework || '`' as overview,
 '# Feature Spec: ' || spec_id || chr(10) || '## Feature ID: ' || spec_id || chr(10) || '## Feature Name: ' || display_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Overview' || chr(10) as opening,
 chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Entry Points' || chr(10) || chr(10) || '| File | Description |' || chr(10) || '|---|---|' || chr(10)
 || e.lines || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Related Files' || chr(10) || chr(10)
 || coalesce(r.lines, '_No related files detected._') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Key Dependencies' || chr(10) || chr(10) || '| Type | Name | File |' || chr(10) || '|---|---|---|'
 || coalesce(chr(10) || d.lines, '')
 || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Auth Pattern' || chr(10) || chr(10) || 'Detected: `' || g.auth || '`', '') || chr(10) as rest,
 h.spec_id
 from c_heads h
 join (select repo_id, domain_no, string_agg('| `' || path || '` | Entry point |', chr(10) order by rank, path) as lines from c_entry group by all) e using (repo_id, domain_no)
 left join (select repo_id, domain_no, string_agg('- `' || path || '`', chr(10) order by path) as lines from c_related group by all) r using (repo_id, domain_no)
 left join (select repo_id, domain_no, string_agg('| ' || type || ' | ' || name || ' | `' || file || '` |', chr(10) order by dep_no) as lines from c_spec_deps where type <> 'external_package' group by all) d using (repo_id, domain_no)
 left join c_guard g using (repo_id, domain_no)""",
    "c_markdown": "select repo_id, domain_no, spec_id, opening || overview || rest as markdown from c_lines",
    # ---- changes ------------------------------------------------------------------------
    "c_meta": """select spec_id, meta_json::json as j from v_spec_meta where json_valid(meta_json)""",
    "c_meta_deps": """select spec_id, unnest(range(json_array_length(j, '$.dependencies')::bigint)) as i, j from c_meta""",
    "c_dep_rows": """select spec_id, i, j->'dependencies'->i->>'type' as type, j->'dependencies'->i->>'name' as name, j->'dependencies'->i->>'file' as file
 from c_meta_deps""",
    "c_tracked": """select distinct spec_id, path from (select spec_id, unnest((j->'entry_files')::varchar[]) as path from c_meta
 union all select spec_id, unnest((j->'related_files')::varchar[]) from c_meta union all select spec_id, file from c_dep_rows where file <> '')""",
    "c_sizes": "select commit_id, count(*) as n_files from v_changes group by commit_id",
    "c_r0_changed": r"""select 'r0' as repo_id, path from v_source_files where repo_id = 'r0' and path like '%/route.ts'
 and cast(regexp_extract(path, 'o([0-9]+)/route', 1) as bigint) % 1000 = 0""",
    # ---- versions -----------------------------------------------------------------------
    "c_versions": r"""select path, commit_seq, content, not contains(content, 'x = = 1') as ok,
 regexp_extract_all(content, 'def\s+(\w+)\s*\(', 1) as names,
 regexp_extract_all(content, 'def\s+\w+(\s*\([^\n]*\n[^\n]*)', 1) as bodies from v_file_versions""",
    "c_pairs": """select * from (select path, commit_seq, content, ok, names, bodies, lag(content) over w as old_content, lag(ok) over w as old_ok,
 lag(names) over w as old_names, lag(bodies) over w as old_bodies from c_versions window w as (partition by path order by commit_seq))
 where old_content is not null""",
    "c_new_fns": "select path, commit_seq, unnest(names) as name, unnest(bodies) as body, unnest(range(len(names))) as pos, old_names, old_bodies, names from c_pairs where ok and old_ok",
    "c_old_fns": "select path, commit_seq, unnest(old_names) as name, unnest(old_bodies) as body, unnest(range(len(old_names))) as pos, names from c_pairs where ok and old_ok",
    "c_removed": "select *, row_number() over (partition by path, commit_seq, body order by pos) as rn from c_old_fns where not list_contains(names, name)",
    "c_added": "select *, row_number() over (partition by path, commit_seq, body order by pos) as rn from c_new_fns where not list_contains(old_names, name)",
    "c_exact": """select r.path, r.commit_seq, r.name as old_name, a.name as new_name from c_removed r
 join c_added a on a.path = r.path and a.commit_seq = r.commit_seq and a.body = r.body and a.rn = r.rn""",
    "c_left_old": "select r.path, r.commit_seq, r.name from c_removed r anti join c_exact x on x.path = r.path and x.commit_seq = r.commit_seq and x.old_name = r.name",
    "c_left_new": "select r.path, r.commit_seq, r.name from c_added r anti join c_exact x on x.path = r.path and x.commit_seq = r.commit_seq and x.new_name = r.name",
    "c_singleton": """select path, commit_seq, o.name as old_name, n.name as new_name
 from (select path, commit_seq, min(name) as name from c_left_old group by all having count(*) = 1) o
 join (select path, commit_seq, min(name) as name from c_left_new group by all having count(*) = 1) n using (path, commit_seq)""",
    "c_regex": """select path, commit_seq, gone[1] as old_name, come[1] as new_name from (
 select path, commit_seq, list_distinct(list_filter(old_names, lambda x: not list_contains(names, x))) as gone,
  list_distinct(list_filter(names, lambda x: not list_contains(old_names, x))) as come from c_pairs where not (ok and old_ok))
 where len(gone) = 1 and len(come) = 1""",
    "c_renames": """select * from c_exact union all select * from c_singleton union all select * from c_regex""",
    # ---- asking -------------------------------------------------------------------------
    "c_constitution": "select string_agg('- ' || r_name, chr(10) order by r_name) as body from region",
    "c_named_specs": "select thread_id, turn, 0 as rank, spec_id from v_intents, (select distinct spec_id from v_spec_docs) c where contains(lower(intent), lower(spec_id))",
    "c_ruled_specs": """select i.thread_id, i.turn, min(r.rank) as rank, r.spec_id from v_intents i join v_rules r on contains(lower(i.intent), lower(r.keyword))
 where r.spec_id in (select spec_id from v_spec_docs) and not exists (select 1 from c_named_specs n where n.thread_id = i.thread_id and n.turn = i.turn) group by all""",
    "c_routes": """select thread_id, turn, pos, spec_id from (select *, row_number() over (partition by thread_id, turn order by rank, spec_id) as pos
 from (select * from c_named_specs union all select * from c_ruled_specs))""",
    "c_sections": """select m.spec_id, '## Feature ID: ' || m.spec_id || chr(10) || chr(10) || 'Dependencies:' || chr(10) || chr(10)
 || coalesce(d.lines, '- None') as section from c_meta m left join (select spec_id, string_agg('- Type: ' || type || ', Name: ' || name || ', File: ' || file, chr(10) || chr(10) order by i) as lines
 from c_dep_rows group by spec_id) d using (spec_id)""",
    "c_payload": """select i.thread_id, i.turn, '# Global Constitution' || chr(10) || (select body from c_constitution)
 || coalesce(chr(10) || chr(10) || '# Feature Documentation' || chr(10) || chr(10) || d.docs, '')
 || coalesce(chr(10) || chr(10) || '# Codebase Mappings' || chr(10) || chr(10) || m.maps, '') as payload
 from v_intents i
 left join (select thread_id, turn, string_agg(markdown, chr(10) || chr(10) order by pos) as docs from c_routes join v_spec_docs using (spec_id) group by all) d using (thread_id, turn)
 left join (select thread_id, turn, string_agg(section, chr(10) || chr(10) order by pos) as maps from c_routes join c_sections using (spec_id) group by all) m using (thread_id, turn)""",
    "c_replies": r"""select intent_id, body, json_valid(body) and trim(body)[1] = '{' as ok from (select intent_id, trim(case
   when contains(reply, '```json') then split_part(split_part(reply, '```json', 2), '```', 1)
   when contains(reply, '```') then split_part(reply, '```', 2) else reply end, chr(10) || ' ') as body from v_llm_replies)""",
    "c_parsed": """select intent_id, ok, case when ok then coalesce((body::json->'implicated_features')::varchar[], []) else [] end as ids,
 case when ok then coalesce((body::json->>'clarification_needed')::boolean, false) else false end as needed,
 case when ok then body::json->>'clarification_message' end as message from (select intent_id, ok, case when ok then body else '{}' end as body from c_replies)""",
    # ---- commits ------------------------------------------------------------------------
    "c_window": """select repo_id, seq, rn, coalesce(hexsha, '') as hexsha, coalesce(author, 'Unknown') as author, coalesce(trim(message), '') as message, coalesce(diff, '') as diff
 from (select *, row_number() over (partition by repo_id order by seq desc) as rn from v_commits)""",
    "c_batches": """select repo_id, (rn - 1) // 5 as batch_id, string_agg('Commit: ' || hexsha || chr(10) || 'Author: ' || author || chr(10) || 'Message: ' || message
 || chr(10) || 'Diff:' || chr(10) || diff || chr(10) || chr(10), '' order by rn) as digest from c_window group by all""",
    # ---- candidates ---------------------------------------------------------------------
    "c_repaired": """select s.repo_id, s.spec_id, s.pos, s.path, coalesce(e.path, b.path) as repaired from v_candidates s
 left join c_index e on e.repo_id = s.repo_id and e.path = s.path
 left join (select repo_id, base, min(path) as path from c_index where not hidden
  and not list_has_any(dirs, ['node_modules','.venv','target','bin','obj','dist','build','__pycache__','.git']) group by all) b
  on b.repo_id = s.repo_id and b.base = string_split(s.path, '/')[-1]
 where coalesce(e.path, b.path) is not null""",
    # ---- throttle -----------------------------------------------------------------------
    "c_actions": """select spec_id, epoch_us(ts) as sec, min(event_id) as event_id from v_throttle_in where success group by all""",
    "c_jumps": """select a.spec_id, a.sec, a.event_id, b.sec as next_sec from (select *, sec + 300000000 as due from c_actions) a
 asof left join c_actions b on a.spec_id = b.spec_id and a.due <= b.sec""",
    "c_rec_accepted": """select spec_id, sec, event_id, next_sec from c_jumps where (spec_id, sec) in (select spec_id, min(sec) from c_actions group by spec_id)
 union all select j.spec_id, j.sec, j.event_id, j.next_sec from c_rec_accepted r join c_jumps j on j.spec_id = r.spec_id and j.sec = r.next_sec""",
}
