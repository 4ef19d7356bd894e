"""Merges deal their rows once and hold none in memory; rows are not shuffled to be marked as heavy."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators import impact, skew
from loreweave.sources import merge
from loreweave.sources.merge import BucketTable, once, total


def test_a_merge_caches_nothing_and_deals_rows_once(spark, tmp_path, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long")
    first, second = frame([("a", 1), ("a", 2), ("b", 3), (None, 4)]), frame([("a", 5), ("c", 6), (None, 7)])
    wrong = lambda self, *a: 1 / 0
    monkeypatch.setattr(type(first), "persist", wrong)
    monkeypatch.setattr(type(first), "hint", wrong)
    sums, sets = BucketTable(spark, f"{tmp_path}/a", ("k",), 4), BucketTable(spark, f"{tmp_path}/b", ("k", "n"), 4)
    for version, rows in enumerate((first, second, second)):
        sums.merge(rows, version, total(["k"], "n"))
        sets.merge(rows, version, once(["k", "n"]))
    assert {r.k: r.n for r in sums.read().collect()} == {"a": 13, "b": 3, "c": 12, None: 18}
    assert sorted(((r.k, r.n) for r in sets.read().collect()), key=str) == sorted([("a", 1), ("a", 2), ("a", 5), ("b", 3), ("c", 6), (None, 4), (None, 7)], key=str)


def test_match_shuffles_each_side_once(spark, capsys):
    left = spark.range(2_000_000).select((F.col("id") % 1000).alias("path"), F.col("id").alias("a"))
    right = spark.range(2_000_000).select((F.col("id") % 1000).alias("path"), F.col("id").alias("b"))
    joined = skew.match(left, right, ["path"])
    capsys.readouterr()
    joined.explain()
    assert capsys.readouterr().out.count("hashpartitioning") == 2


def test_impacted_pairs_for_a_merge(spark):
    changes = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "a"), ("c2", "b")], "commit_id string, path string")
    tracked = spark.createDataFrame([("S", "a"), ("S", "b"), ("T", "b")], "spec_id string, path string")
    rows = sorted(tuple(r) for r in impact.impacted_specs(changes, tracked, ["commit_id"], once=False).collect())
    assert rows == [("c1", "S"), ("c1", "S"), ("c1", "T"), ("c2", "S"), ("c2", "T")]
    assert sorted(tuple(r) for r in impact.impacted_specs(changes, tracked, ["commit_id"]).collect()) == sorted(set(rows))


@pytest.mark.parametrize("few", [0, merge.FEW_VALUES])
def test_old_rows_of_other_commits_are_not_folded(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(merge, "FEW_VALUES", few)
    frame = lambda rows: spark.createDataFrame(rows, "commit_id string, spec_id string")
    store, seen = BucketTable(spark, str(tmp_path), ("commit_id", "spec_id"), 2, "commit_id"), []

    def fold(rows):
        seen.append({tuple(r) for r in rows.where("_new = 0").select("commit_id", "spec_id").collect()})
        return once(["commit_id", "spec_id"])(rows)

    old = [("c1", "S"), ("c1", "T"), ("c2", "S"), (None, "S"), (None, "T"), ("c3", None)]
    new = [("c2", "S"), ("c2", "T"), ("c4", "S"), (None, "S"), ("c2", "T")] + [(f"d{i}", "S") for i in range(20)]
    store.merge(frame(old), 0, fold)
    store.merge(frame(new), 1, fold)
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted({*old, *new}, key=str)
    assert seen[1] == ({r for r in old if r[0] in ("c2", None)} if few else set(old))
