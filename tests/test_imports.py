"""Import, export and tag extraction on literal snippets."""

import pytest

from loreweave.operators import imports, tags

CASES = [
    ("a.ts", 'import { A, B as C } from "./x";\nimport D from \'y\';\nimport "z";\nconst q = require("w");', [("./x", ["A", "B"]), ("y", ["D"]), ("z", []), ("w", [])]),
    ("a.py", "from a.b import c, d\n  import os\nimport x.y\n", [("a.b", ["c", "d"]), ("os", ["os"]), ("x.y", ["x.y"])]),
    ("A.java", "import java.util.List;\n  import a.B;\n", [("java.util.List", ["List"]), ("a.B", ["B"])]),
    ("a.kt", "import a.B;\n", [("a.B", ["B"])]),
    ("a.rs", "use crate::db::Pool;\nmod routes;\n", [("crate::db::Pool", ["Pool"]), ("./routes", ["routes"])]),
    ("a.rb", "require 'sinatra'\nrequire_relative 'lib/x'\n", [("sinatra", ["sinatra"]), ("lib/x", ["x"])]),
    ("a.go", 'import "fmt"\nimport (\n  "net/http"\n  "x/y"\n)\n', [("fmt", ["fmt"]), ("net/http", ["http"]), ("x/y", ["y"])]),
    ("a.cs", "using System.Text;\n", [("System.Text", ["Text"])]),
    ("a.hpp", '#include <stdio.h>\n  #include "a/b.h"\n', [("stdio.h", ["stdio.h"]), ("a/b.h", ["b.h"])]),
    ("a.md", "import x\n", []),
]


@pytest.mark.parametrize("path, content, want", CASES)
def test_dialects(spark, path, content, want):
    files = spark.createDataFrame([("r", path, content)], "repo_id string, path string, content string")
    rows = imports.import_edges(files).orderBy("pos").collect()
    assert [(r.import_path, r.names) for r in rows] == want


def test_exports_and_tags(spark):
    text = "export async function GET(req) {}\nexport const limit: number = 1;\nexport class Svc {}\nexport function f() {}\nrequireAuth(x); verifyUserIdMatch(y)"
    files = spark.createDataFrame([("r", "a.ts", text), ("r", "b.py", "authorize()"), ("r", "c.py", "x")], "repo_id string, path string, content string")
    assert [r.name for r in imports.ts_exports(files).orderBy("pos").collect()] == ["GET", "f", "limit", "Svc"]
    assert {(r.path, r.auth) for r in tags.auth_tags(files).collect()} == {("a.ts", "requireAuth + verifyUserIdMatch"), ("b.py", "authorize")}
    assert [r.verb for r in tags.http_verbs(files, tags.ts_verbs, "ts").collect()] == ["GET"]
