"""Merged tables and streams: what is rewritten, restarts, late arrivals, state that goes."""

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loreweave.operators import history, renames, throttle
from loreweave.plans import post_commit
from loreweave.sources import tree
from loreweave.sources.merge import BucketTable, latest, once, total
from loreweave.streaming import streams


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ("id",), 16)
    assert table.read() is None
    frame = lambda rows: spark.createDataFrame(rows, "id string, n int, body string")
    fold = latest(["id"], ["n"])
    assert len(table.merge(frame([(f"k{i}", 0, "old") for i in range(200)]), 0, fold)) == 16
    seen = table.read()  # of a reader that began before the next merge
    assert len(table.merge(frame([("k7", 1, "new"), ("k7", 2, "newest")]), 1, fold)) == 1
    assert len(list(Path(tmp_path, "data/at=1").glob("bucket=*"))) == 1
    assert rows_of(seen) == sorted((f"k{i}", 0, "old") for i in range(200))
    want = {f"k{i}": "old" for i in range(200)} | {"k7": "newest"}
    assert {r.id: r.body for r in table.read().collect()} == want
    # A version that was written in part, or again, is the same; one without a manifest is not seen.
    table.merge(frame([("k7", 1, "new"), ("k7", 2, "newest")]), 1, fold)
    assert {r.id: r.body for r in table.read().collect()} == want
    frame([("k7", 9, "torn")]).write.parquet(f"{tmp_path}/data/at=2/bucket=0")
    assert {r.id: r.body for r in table.read().collect()} == want
    assert table.merge(frame([]), 3, fold) == set()


def test_merge_folds(spark, tmp_path):
    sums, sets = BucketTable(spark, f"{tmp_path}/a", ("k",), 4), BucketTable(spark, f"{tmp_path}/b", ("k", "v"), 4)
    for version in (0, 1, 1, 2):
        sums.merge(spark.createDataFrame([("x", 2), ("y", version)], "k string, n long"), version, total(["k"], "n"))
        sets.merge(spark.createDataFrame([("x", 1), ("x", version)], "k string, v int"), version, once(["k", "v"]))
    assert rows_of(sums.read()) == [("x", 6), ("y", 3)]
    assert rows_of(sets.read()) == [("x", 0), ("x", 1), ("x", 2)]


META = "spec_id string, entry_files array<string>, related_files array<string>, dependencies array<struct<type:string,name:string,file:string>>, tags array<string>"


def records(n=240):
    """Commits that go on over batches, renames of one name again and again, texts that don't parse."""
    r = random.Random(9)
    rows = []
    for seq in range(n):
        rows.append((seq, f"c{seq // 70}", f"src/f{r.randrange(9)}.ts", None))
        name = r.choice("abcd")
        rows.append((seq, f"v{seq // 15}", f"m{r.randrange(3)}.py", f"def {name}(x):\n    return {r.randrange(2)}\n" + ("= =" if r.random() < 0.1 else "")))
    return rows


def test_post_commit_as_a_stream_that_is_killed(spark, tmp_path, monkeypatch):
    meta = spark.createDataFrame([(f"S{i}", [f"src/f{i}.ts"], [], [("util", "abcd"[i % 4], ""), ("util", "zz", "")], []) for i in range(12)], META)
    schema = "seq long, commit_id string, path string, content string"
    everything = spark.createDataFrame(records(), schema)
    changes, versions = everything.where("content is null"), everything.where("content is not null").withColumnRenamed("seq", "commit_seq").select("path", "commit_seq", "commit_id", "content")
    versions = versions.dropDuplicates(["path", "commit_seq"])
    want = rows_of(post_commit.run(changes, versions, meta, F.concat(F.lit("v"), F.floor(F.col("commit_seq") / 15))))
    assert {"oversized", "impacted", "renamed", "healed"} == {w[0] for w in want}

    folder, arriving = f"{tmp_path}/out", f"{tmp_path}/in"
    real, calls = BucketTable.merge, []

    def dying(self, rows, version, fold):
        """The second batch dies after some of its tables were written."""
        if version == 1 and self.folder.endswith("healed") and not calls:
            calls.append(1)
            raise RuntimeError("killed")
        return real(self, rows, version, fold)

    monkeypatch.setattr(BucketTable, "merge", dying)
    for i in range(3):
        everything.where(f"seq % 3 = {i} and seq < 0 or floor(seq / 80) = {i}").write.mode("append").parquet(arriving)
        run = lambda: post_commit.stream(spark.readStream.schema(schema).parquet(arriving), meta, folder, f"{tmp_path}/state", buckets=4).awaitTermination()
        if i == 1:
            with pytest.raises(Exception, match="killed"):
                run()
        run()
    assert calls and rows_of(post_commit.results(spark, folder)) == want


def closed(edges):
    """Each rename followed by the first one of its new name in a later commit."""
    out = []
    for at, old, new in edges:
        now, name, hops = at, new, 1
        while True:
            later = [(a, n) for a, o, n in edges if o == name and a > now]
            if not later:
                break
            now, name = min(later)
            hops += 1
        out.append((at, old, name, hops))
    return sorted(out)


def test_rename_closure(spark):
    chain = [(i, f"n{i}", f"n{i + 1}") for i in range(20)]
    cycle = [(100 + i, "ab"[i % 2], "ba"[i % 2]) for i in range(7)]
    same_commit = [(200, "p", "q"), (200, "q", "r"), (201, "r", "s")]
    reused = [(300, "x", "y"), (301, "y", "z"), (302, "new", "y"), (303, "y", "w"), (299, "z", "early")]
    rng = random.Random(1)
    drawn = {(rng.randrange(400, 440), rng.choice("ABCDEF")): rng.choice("ABCDEF") for _ in range(80)}
    edges = chain + cycle + same_commit + reused + [(a, o, n) for (a, o), n in drawn.items()]
    frame = spark.createDataFrame(edges, "commit_no long, old_name string, new_name string")
    got = {(r.commit_no, r.old_name): (r.new_name, r.hops) for r in renames.rename_closure(frame).collect()}
    assert sorted((a, o, n, h) for (a, o), (n, h) in got.items()) == closed(edges)
    assert got[0, "n0"] == ("n20", 20) and got[100, "a"][0] == "b" and got[200, "p"] == ("q", 1) and got[300, "x"] == ("z", 2)
    first = {r.old_name: r.new_name for r in renames.first_renames(renames.rename_closure(frame)).collect()}
    assert first["n3"] == "n20" and first["y"] == "z"
    assert renames.rename_closure(frame.limit(0)).count() == 0


def test_throttle_with_late_rows_and_state_that_goes(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), i, start + dt.timedelta(seconds=i * 20 + rng.randrange(-400, 400)), rng.random() < 0.9, i) for i in range(600)]
    rows.append(("once", 1000, start + dt.timedelta(seconds=50), True, 0))
    events = spark.createDataFrame(rows, "spec_id string, event_id long, ts timestamp, success boolean, arrival long")
    want = rows_of(throttle.throttle(events).select("spec_id", "event_id"))
    states = []
    original = streams.throttle

    def watched(*a):
        query = original(*a)
        query.awaitTermination()
        states.append([p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators])
        return query

    with pytest.MonkeyPatch.context() as m:
        m.setattr(streams, "throttle", watched)
        assert rows_of(streams.throttled(events, "arrival", late="15 minutes").select("spec_id", "event_id")) == want
    assert max(max(s) for s in states if s) > states[-1][-1]


def test_a_batch_of_one_job_writes_one_bucket(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "job_id long, seq long, status string, progress int, message string")
    schema = frame([]).schema
    for i, rows in enumerate([[(j, 0, "queued", 0, "m") for j in range(300)], [(5, 2, "done", 100, "m"), (5, 1, "processing", 10, "m")]]):
        frame(rows).write.mode("append").parquet(f"{tmp_path}/in")
        streams.job_current(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert len(list(Path(tmp_path, "out/data/at=1").glob("bucket=*"))) == 1
    got = {r.job_id: r.status for r in streams.jobs_now(spark, f"{tmp_path}/out").collect()}
    assert got == {j: "queued" for j in range(300)} | {5: "done"}


def test_history_of_a_thread_longer_than_a_page(spark):
    rows = [("t", i, f"i{i}") for i in range(150)] + [("u", i, f"j{i}") for i in range(5)]
    intents = spark.createDataFrame(rows, "thread_id string, turn long, intent string")
    want = rows_of(history.intent_history(intents))
    got = streams.replayed(intents, "turn", streams.thread_turns, parts=3)
    assert rows_of(got.select("thread_id", "turn", "intent", "n_prior", "page_no", "recent")) == want
    assert Counter(r.thread_id for r in history.history_pages(history.intent_history(intents)).collect()) == {"t": 2}


def test_large_files_in_parts(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 40) for i in range(60_000)]
    texts = {"r1/big file.py": "\n".join(lines), "r1/src/small.py": "a\r\nb\n", "r2/crlf.ts": "\r\n".join(lines[:30_000]), "r2/node_modules/big.js": "\n".join(lines)}
    for name, text in texts.items():
        Path(tmp_path, name).parent.mkdir(parents=True, exist_ok=True)
        Path(tmp_path, name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        parts = tree.read_source_parts(spark, str(tmp_path), max_bytes=100_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in sorted(parts, key=lambda r: r.start):
        got.setdefault(f"{r.repo_id}/{r.path}", []).append(r.content)
    assert {k: "\n".join(v) for k, v in got.items()} == {k: v for k, v in texts.items() if "node_modules" not in k}
    assert len(got["r1/big file.py"]) > 3 and len(got["r1/src/small.py"]) == 1
    assert {r.path: r.content for r in tree.read_source_tree(spark, str(tmp_path)).collect()}["big file.py"] == texts["r1/big file.py"]


def test_changes_go_on_after_a_stop(spark, tmp_path):
    meta = spark.createDataFrame([("S", ["a.ts"], [], [], [])], META)
    for i in range(3):
        spark.createDataFrame([(i, f"c{i}", "a.ts", None)], tree.RECORDS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = post_commit.stream(tree.stream_changes(spark, f"{tmp_path}/in", 1), meta, f"{tmp_path}/out", f"{tmp_path}/state", buckets=2)
        stream.awaitTermination()
        assert sum(p.numInputRows for p in stream.recentProgress) == 1
    assert rows_of(post_commit.results(spark, f"{tmp_path}/out")) == [("impacted", f"c{i}", "S") for i in range(3)]
