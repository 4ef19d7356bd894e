"""What an onboarding run reads, and import statements against the pattern that defines them."""

from pyspark.sql import functions as F

from loreweave.operators import imports, resolve
from loreweave.operators.domains import RELATED
from loreweave.plans import onboard

ROUTE = "import { a, b as c } from \"@/lib/x\";\nexport async function GET() {}"
FILES = [
    ("n", "next.config.ts", "x"), ("n", "src/app/api/g/route.ts", ROUTE), ("n", "src/lib/x.ts", "import y from 'z'"), ("n", "src/lib/other.ts", ""),
    ("p", "requirements.txt", "flask"), ("p", "routes.py", "import os\n@x GET"), ("p", "deep/helper.py", "import re"), ("g", "top/a.py", "import a"), ("g", "top/b.py", "import b"),
]


def test_features_of_possible_members_only(spark):
    files = spark.createDataFrame(FILES, "repo_id string, path string, content string")
    found = onboard.survey(files)
    assert {(r.repo_id, r.path) for r in found.features.collect()} == {(r, p) for r, p, _ in FILES if r == "n"} | {("p", "routes.py"), ("g", "top/a.py")}
    assert found.index.count() == len(FILES)
    assert [r.path for r in found.domains.files.where(F.col("role") == RELATED).collect()] == ["src/lib/x.ts"]
    deps = {(r.repo_id, r.dep_no, r.type, r.name, r.file) for r in onboard.dependencies(found).collect()}
    assert deps == {
        ("n", 1, "api_route", "GET /src/app/api/g/route.ts", "src/app/api/g/route.ts"), ("n", 2, "service", "a, b", "src/lib/x.ts"), ("n", 3, "external_package", "z", ""),
        ("p", 1, "api_route", "GET /routes.py", "routes.py"), ("p", 2, "external_package", "os", ""), ("g", 1, "service", "a", "top/a.py"),
    }


def test_specifiers_are_resolved_without_returning_to_them(spark):
    index = spark.createDataFrame([("r", p, e) for p, e in (("src/util/a.ts", ".ts"), ("src/b.js", ".js"), ("c.py", ".py"))], "repo_id string, path string, ext string")
    specs = spark.createDataFrame([("r", s, 1) for s in ("@/util/a", "x/b", "c", "*", "none", "./c")] + [("q", "c", 1)], "repo_id string, import_path string, n long")
    found = resolve.resolve_specifiers(specs, index)
    assert {tuple(r) for r in found.collect()} == {
        ("r", "@/util/a", "util", None, "src/util/a.ts"), ("r", "x/b", "service", "b", "src/b.js"), ("r", "c", "service", None, "c.py"), ("r", "./c", "service", None, "c.py"),
        ("r", "*", "external_package", "*", ""), ("r", "none", "external_package", "none", ""), ("q", "c", "external_package", "c", ""),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_statements_against_their_pattern(spark):
    spaces = [" ", "\n", "\u2003 \t", "\x85"]
    heads = ["", "{a}", "{ a , b as c,,d }", "{\n a\u2003,\tb as  c\n}", "{}", "{'x'}", "name", "é_1", "* as x", "a, {b}", "{a} {b}"]
    ends = ["'p'", '"p/q"', "'{x}'", "\"a'", "'a\nb'", "''", "' as '", '"@/from"']
    texts = ["import" + s + h + (s + "from" + s if h else "") + e + ";" for s in spaces for h in heads for e in ends]
    texts += ["".join(texts[:40]), "import'x'", "import {a} from'b'", "importx 'y'", "require('a') require ( \"b\" )", "xrequire('a')", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plainly(text):
        def build(g):
            inner = F.transform(F.filter(imports._trimmed_items(g(1)), lambda n: n != ""), lambda n: F.substring_index(n, " as ", 1))
            return imports._import(g(3), F.when(g(1) != "", inner).when(g(2) != "", F.array(g(2))).otherwise(imports._no_names()))

        return F.concat(imports._each(text, imports.TS_IMPORT, build), imports._each(text, imports.TS_REQUIRE, lambda g: imports._import(g(1), imports._no_names())))

    got = imports.ts_imports(F.col("t"))
    assert df.where(~got.eqNullSafe(plainly(F.col("t")))).collect() == []
    assert df.where(F.size(got) > 0).count() > 100
    plan = df.select(got)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan


def test_route_groups_without_patterns(spark):
    from loreweave.operators import domains as dom

    heads = ["src/app/api/", "app/api/", "x/app/api/", "src/app/", "/src/app/api/"]
    tails = ["route.ts", "g/route.ts", "g/h/route.tsx", "/route.ts", "g/.h/route.ts", "g\nh/route.ts", ".g/route.ts", "g//route.ts", "route.ts/route.ts"]
    path = F.col("path")
    for own in (heads, heads[1:]):  # with and without the folder under src/
        index = spark.createDataFrame([("r", h + t, ".ts") for h in own for t in tails], "repo_id string, path string, ext string")
        found = dom.domains_nextjs(index)
        got = {(r.spec_id, r.path) for r in found.files.join(found.headers, ["repo_id", "domain_no"]).collect()}
        group = F.coalesce(F.nullif(F.regexp_extract(path, r"^src/app/api/([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"^app/api/([^/]+)/", 1), F.lit("")))
        inside = F.regexp_replace(path, r"^(src/)?app/api/[^/]+/", "")
        kept = index.where(path.rlike(r"(^|/)route\.tsx?\z") & group.isNotNull() & ~inside.rlike(r"(^|/)\."))
        kept = kept if own is not heads else kept.where(F.startswith(path, F.lit("src/app/api/")))
        assert got == {(r.s, r.path) for r in kept.select(dom.spec_id(group).alias("s"), "path").collect()}
