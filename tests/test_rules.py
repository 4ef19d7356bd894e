"""Rules with an edge: times, ties, nulls, limits as arguments, heavy keys and paths."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from loreweave.operators import commits, domains, history, impact, ordered, renames, retrieval, routing, skew, specs, throttle, treemap
from loreweave.plans import ask
from loreweave.sources import sink, tree
from loreweave.streaming import streams


def actions(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, i, start + dt.timedelta(seconds=s), ok) for k, i, s, ok in rows], "spec_id string, event_id long, ts timestamp, success boolean")


def test_throttle_counts_parts_of_a_second(spark):
    got = throttle.throttle(actions(spark, [("a", 1, 0.9, True), ("a", 2, 300.1, True), ("a", 3, 300.9, True), ("b", 4, 5, False)])).collect()
    assert [r.event_id for r in sorted(got, key=lambda r: r["at"])] == [1, 3]


def test_throttle_against_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.random() * 20_000, rng.random() < 0.8) for i in range(400)]
    gate, want = {}, set()
    for k, i, s, ok in sorted(rows, key=lambda r: r[2]):
        if ok and s >= gate.get(k, -1e9):
            gate[k] = round(s, 6) + 300
            want.add(i)
    events = actions(spark, rows)
    assert {r.event_id for r in throttle.throttle(events).collect()} == want
    assert {r.event_id for r in streams.throttled(events.withColumn("_at", F.unix_micros("ts")), "_at").collect()} == want


def test_commit_without_a_difference_stays(spark):
    rows = spark.createDataFrame([("r", 1, None, None, " m ", None), ("r", 2, "abcdefghij", "dev", "n", "x" * 5)], "repo_id string, seq int, hexsha string, author string, message string, diff string")
    digest = commits.commit_batches(commits.commit_window(rows)).first().digest
    assert digest.count("Commit: ") == 2 and "Author: Unknown" in digest
    cut = commits.commit_window(rows, n=1, sha_chars=8, diff_chars=2).collect()
    assert [(r.seq, r.hexsha, r.diff) for r in cut] == [(2, "abcdefgh", "xx")]


def test_windows_of_a_heavy_key_with_sparse_orders(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.randrange(10**12), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, value long")
    w = Window.partitionBy("key").orderBy("at", "value")
    want = {(r.key, r["at"], r.value): (r.before, r.total, r.n) for r in df.select("*", F.lag("value").over(w).alias("before"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(w).alias("n")).collect()}
    before = ordered.with_previous(df, ["key"], "at", {"before": "value"}, ties=["value"]).collect()
    assert {(r.key, r["at"], r.value): r.before for r in before} == {k: v[0] for k, v in want.items() if v[0] is not None}
    running = ordered.with_running(df, ["key"], "at", {"total": (F.col("value"), "sum")}, ties=["value"]).collect()
    assert {(r.key, r["at"], r.value): r.total for r in running} == {k: v[1] for k, v in want.items()}
    placed = ordered.numbered(df, ["key"], ["at", "value"], "n").collect()
    assert {(r.key, r["at"], r.value): r.n for r in placed} == {k: v[2] for k, v in want.items()}


def test_documents_of_several_parts(spark):
    lines = spark.createDataFrame([("d", i, f"l{i}\nm{i}") for i in range(25)] + [("e", 0, "x")], "key string, at int, line string")
    got = skew.assemble(lines, ["key"], ["at"], "line", "text", part_lines=7).orderBy("part_no").collect()
    assert "\n".join(r.text for r in got if r.key == "d") == "\n".join(f"l{i}\nm{i}" for i in range(25))
    assert [r.part_no for r in got if r.key == "d"] == list(range(8)) and all(len(r.text.split("\n")) <= 7 for r in got)


def test_heavy_keys_are_salted_without_loss(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1)], "key string, n int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c")], "key string, value string")
    heavy = skew.heavy_keys(left.groupBy("key").agg(F.count("*").alias("n")), ["key"], hot_rows=100)
    got = skew.lookup(left, right, ["key"], heavy, ["n"], salts=4).groupBy("key", "value").count().collect()
    assert {(r.key, r.value): r["count"] for r in got} == {("hot", "h"): 500, ("cold", "c"): 1}


def test_long_thread(spark):
    turns = spark.createDataFrame([("t", i, f"q{i}") for i in range(200)], "thread_id string, turn int, intent string")
    rows = {r.turn: r for r in history.intent_history(turns).collect()}
    pages = sorted(history.history_pages(history.intent_history(turns)).collect(), key=lambda p: p.page_no)
    for turn, r in rows.items():
        whole = [q for p in pages if p.page_no < r.page_no for q in p.intents] + r.recent
        assert whole == [f"q{i}" for i in range(turn)] and r.n_prior == turn
    stream = streams.replayed(turns, "turn", streams.thread_turns).collect()
    assert {r.turn: r.n_prior for r in stream} == {i: i for i in range(200)}


def test_limits_are_arguments(spark):
    changes = spark.createDataFrame([("big", i, f"p{i}") for i in range(51)] + [("ok", i, f"p{i}") for i in range(50)], "commit_id string, pos int, path string")
    assert {(r.commit_id, r.over_limit) for r in impact.commit_guard(changes).collect()} == {("big", True), ("ok", False)}
    assert {r.commit_id for r in impact.accepted_changes(changes).select("commit_id").distinct().collect()} == {"ok"}
    replies = spark.createDataFrame([(n, '{"implicated_features":[' + ",".join(f'"S{i}"' for i in range(n)) + "]}") for n in (3, 4)], "intent_id int, reply string")
    parsed = routing.parse_replies(replies, ["intent_id"])
    assert {r.intent_id: len(r.spec_ids) for r in routing.route_replies(parsed, ["intent_id"]).collect()} == {3: 3, 4: 4}
    assert {r.intent_id: len(r.spec_ids) for r in routing.route_replies(parsed, ["intent_id"], top=3).collect()} == {3: 3, 4: 0}
    long = spark.createDataFrame([("x" * 11,), ("y" * 10,)], "payload string")
    assert [r.over_limit for r in retrieval.payload_limits(long, 10).orderBy("payload").collect()] == [True, False]
    index = spark.createDataFrame([("r", f"d{i}/f.ts", ".ts") for i in range(12)], "repo_id string, path string, ext string")
    assert domains.domains_generic(index).headers.count() == 12 and domains.domains_generic(index, cap=10).headers.count() == 10
    files = spark.createDataFrame([("r", "a/b/c/d/e.py", "1"), ("r", "f.py", "2")], "repo_id string, path string, content string")
    assert treemap.walkable(files).count() == 2 and treemap.walkable(files, max_depth=3).count() == 1
    assert "e.py" in treemap.tree_map(files, files).first().tree


def test_related_files_for_route_groups_only(spark):
    heads = spark.createDataFrame([("r", 1, "AI-SERVICES", "x", "nextjs", "route"), ("r", 2, "OTHER", "y", "nextjs", "candidate")], "repo_id string, domain_no int, spec_id string, display_name string, framework string, source string")
    files = spark.createDataFrame([("r", 1, "entry", 0, "a.ts"), ("r", 2, "entry", 0, "a.ts")], "repo_id string, domain_no int, role string, rank long, path string")
    texts = spark.createDataFrame([("r", "a.ts", 'import x from "@/b";'), ("r", "src/b.ts", "")], "repo_id string, path string, content string")
    features = specs.file_features(texts)
    got = specs.add_related(domains.Domains(heads, files), features, texts.selectExpr("repo_id", "path", "'.ts' as ext")).files.where("role = 'related'").collect()
    assert [(r.domain_no, r.path) for r in got] == [(1, "src/b.ts")]


def test_failed_replies_say_why(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, None)], "id int, prompt string")
    got = {r.id: (r.reply, r.error) for r in specs.apply_text_generator(rows, ["id"], "prompt", lambda t: t.upper()).collect()}
    assert got[1] == ("OK", None) and got[2][0] is None and got[2][1].startswith("AttributeError")


def test_source_tree(spark, tmp_path):
    root = tmp_path / "a.b+(c)"
    for name, data in {"r1/src/x.py": b"import os\n", "r1/node_modules/y.js": b"no", "r1/bad.py": b"\xff\xfeok", "r1/big.py": b"z" * 200}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {(r.repo_id, r.path): r.content for r in tree.read_source_tree(spark, str(root), max_bytes=100).collect()}
    assert set(got) == {("r1", "src/x.py"), ("r1", "bad.py")} and got["r1", "bad.py"].endswith("ok")
    listed = {r.path: r.oversized for r in tree.list_source_tree(spark, str(root), max_bytes=100).collect()}
    assert listed == {"src/x.py": False, "bad.py": False, "big.py": True}


def test_sink(spark):
    old = spark.createDataFrame([("a", 0, "old"), ("b", 0, "kept")], "id string, n int, body string")
    new = spark.createDataFrame([("a", 1, "x"), ("a", 2, "new")], "id string, n int, body string")
    assert {(r.id, r.body) for r in sink.upsert(old, new, ["id"], ["n"]).collect()} == {("a", "new"), ("b", "kept")}


def test_renames_of_one_pair(spark):
    versions = spark.createDataFrame([("m.py", 1, "def a(x):\n    return x\n\ndef b():\n    return 1\n"), ("m.py", 2, "def c(x):\n    return x\n\ndef b():\n    return 1\n")], "path string, commit_seq int, content string")
    pairs = renames.pair_versions(renames.parse_versions(versions), ["path"])
    assert [(r.old_name, r.new_name) for r in renames.renames(pairs, ["path"]).collect()] == [("a", "c")]


def test_answers_with_replies(spark):
    intents = spark.createDataFrame([(1, "about s1"), (2, "about s2"), (3, "nothing")], "id int, intent string")
    replies = spark.createDataFrame([(1, '```json\n{"implicated_features": ["S2"]}\n```'), (3, '{"clarification_needed": true, "clarification_message": "which?"}')], "id int, reply string")
    docs = spark.createDataFrame([("S1", "one"), ("S2", "two")], "spec_id string, markdown string")
    meta = spark.createDataFrame([], "spec_id string, dependencies array<struct<type:string,name:string,file:string>>")
    rules = spark.createDataFrame([], "rank int, spec_id string, keyword string")
    body = spark.createDataFrame([("all",)], "body string")
    got = {r.id: r.payload for r in ask.answer(intents, ["id"], rules, docs, meta, body, replies).collect()}
    assert "two" in got[1] and "two" in got[2] and got[3] == "Clarification Needed:\nwhich?"
    with pytest.raises(ValueError):
        throttle.throttle(actions(spark, []), gap=10, chunk=5)


def test_routing_by_ids_with_one_prefix(spark):
    """Ten thousand identifiers that begin alike: texts meet only those they name, in any number of automata."""
    catalog = spark.range(10_000).select(F.concat(F.lit("SPEC-"), "id").alias("spec_id"))
    intents = spark.createDataFrame([(i, f"what about spec-{i * 7} and Spec-{i}?" if i % 2 else "no spec- here" if i % 4 else None) for i in range(400)], "id int, intent string")
    want = {(i, f"SPEC-{n[:k]}") for i in range(1, 400, 2) for n in (str(i * 7), str(i)) for k in range(1, len(n) + 1) if n[:k] == "0" or n[0] != "0"}
    for chars in (routing.BLOCK_CHARS, 30_000):
        found = routing.containing(intents, ["id"], "intent", catalog, "spec_id", chars)
        assert {(r.id, r.spec_id) for r in found.collect()} == want
        nodes = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in nodes and "NestedLoop" not in nodes


def test_a_path_in_every_commit(spark):
    """One path that all commits touch and all specifications refer to: no task gets much more than others."""
    hot = [(c, "hot.ts") for c in range(2000)] + [(c, f"p{c % 700}.ts") for c in range(2000)]
    refs = [(f"S{i}", "hot.ts") for i in range(300)] + [(f"S{i}", f"p{i}.ts") for i in range(300)] + [("N", None)]
    changes, tracked = spark.createDataFrame(hot, "commit_id int, path string"), spark.createDataFrame(refs, "spec_id string, path string")
    want = {(c, s) for c, p in hot for s, q in refs if p == q}
    assert {tuple(r) for r in impact.impacted_specs(changes, tracked, ["commit_id"], side=50).collect()} == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "16")):
            spark.conf.set(k, v)
        sizes = [r.n for r in skew.match(changes, tracked, ["path"], 50).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == sum(p == q for _, p in hot for _, q in refs) and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
