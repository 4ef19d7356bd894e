"""Suggested paths are looked up once, and rows are numbered where their range was written."""

from loreweave.operators import domains as dom, ordered, resolve


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_numbered_rows_are_not_dealt_again(spark, capsys):
    rows = [("ab"[i % 2], i * 7 % 101, "x" * (i % 5)) for i in range(400)] + [("c", 1, "only"), (None, 1, "no key")]
    frame = spark.createDataFrame(rows, "key string, at int, value string")
    placed = ordered.numbered(frame, ["key"], ["at", "value"], "n")
    assert placed.columns == ["key", "at", "value", "n"] and dict(placed.dtypes)["n"] == "int"
    assert "hashpartitioning" not in plan_of(placed, capsys)
    got = sorted(tuple(r) for r in placed.collect())
    want = [(k, a, v, n) for key in "abc" for n, (k, a, v) in enumerate(sorted(r for r in rows if r[0] == key), 1)]
    assert got == sorted(want)


def test_candidates_look_each_path_up_once(spark, capsys):
    files = ["src/app/one.ts", "src/app/two.ts", "lib/deep/two.ts", "node_modules/three.ts", "src/.hid/four.ts"]
    index = resolve.file_index(spark.createDataFrame([("r", p, "") for p in files], "repo_id string, path string, content string"))
    asked = [(1, 1, "src/app/one.ts"), (1, 2, " src\\app "), (2, 1, "gone/two.ts"), (3, 1, "gone/three.ts"), (4, 1, "x/four.ts"), (4, 2, None), (5, 1, "src/app/one.ts"), (5, 2, "node_modules/three.ts")]
    suggested = spark.createDataFrame([("r", c, dom.ENTRY, pos, p) for c, pos, p in asked], "repo_id string, candidate_no int, role string, pos int, path string")
    candidates = spark.createDataFrame([("r", c, f"S{c}", f"S{c}", None) for c in range(1, 6)], "repo_id string, candidate_no int, spec_id string, display_name string, framework string")
    found = dom.candidate_domains(suggested, candidates, index)
    assert "by_name" not in plan_of(found.files, capsys)
    heads = {r.domain_no: r.spec_id for r in found.headers.collect()}
    got = sorted((heads[r.domain_no], r["rank"], r.path) for r in found.files.collect())
    assert heads == {1: "S1", 2: "S2", 3: "S5"}
    assert got == [("S1", 1, "src/app/one.ts"), ("S1", 2, "src/app"), ("S2", 1, "lib/deep/two.ts"), ("S5", 1, "src/app/one.ts"), ("S5", 2, "node_modules/three.ts")]
    repaired = dom.repair_paths(suggested, index)
    assert sorted(repaired.columns) == ["candidate_no", "path", "pos", "repaired", "repo_id", "role"]
