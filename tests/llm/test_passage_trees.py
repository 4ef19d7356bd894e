"""Removal of repeated passages against plain versions, at several group sizes."""

import hashlib
import random

import numpy as np
import pytest

from loreweave.llm import passage_trees as T
from tests.llm.cases import frame


def plain(rows, window):
    """rows: (key or None, text or None); by the definition."""
    words = [(text or "").encode().split() for _, text in rows]
    least, first = {}, {}
    for i, w in enumerate(words):
        key = T.NO_KEY if rows[i][0] is None else rows[i][0]
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            least[g] = min(least.get(g, key), key)
            first.setdefault((g, i), s)
    out = []
    for i, w in enumerate(words):
        key = T.NO_KEY if rows[i][0] is None else rows[i][0]
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if key > least[g] or s > first[g, i]:
                gone.update(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(n_docs, n_passages, seed, vocabulary=300):
    """Passages of many lengths in surroundings of their own, copies, and texts that repeat themselves."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    shared = [some(r.randint(4, 70)) for _ in range(n_passages)]
    rows = []
    for i in range(n_docs):
        text = []
        for _ in range(r.randint(0, 4)):
            text += some(r.randint(0, 30)) + r.choice(shared)
        if r.random() < 0.1:
            text += text
        if r.random() < 0.1 and rows:
            text = rows[r.randrange(len(rows))][1].split()
        rows.append((i * 7 % n_docs, r.choice([" ", "\n", "\t "]).join(text)))
    return rows


def run(spark, rows, window, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in T.deduplicated(df, keep=["doc_id"], window=window, **more).collect()), key=str)


@pytest.mark.parametrize("window, group", [(20, 1 << 17), (20, 40), (20, 3), (5, 10), (2, 50)])
def test_against_plain(spark, monkeypatch, window, group):
    monkeypatch.setattr(T.B, "pieces", lambda batch, column, _pieces=T.B.pieces: _pieces(batch, column, limit=3000))
    rows = passages(400, 120, window)
    assert run(spark, rows, window, group=group) == plain(rows, window)


def test_frequent_prefixes(spark, monkeypatch):
    """One passage in most texts, with the same words before it or after it, in groups far too small for it."""
    monkeypatch.setattr(T.B, "pieces", lambda batch, column, _pieces=T.B.pieces: _pieces(batch, column, limit=500))
    r = random.Random(5)
    hot = [f"h{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{r.randrange(3)}"] * r.randrange(4) + hot[r.randrange(8) :] + [f"z{r.randrange(4)}" for _ in range(r.randrange(25))])) for i in range(600)]
    for group in (2, 8, 1 << 17):
        assert run(spark, rows, 20, group=group) == plain(rows, 20)


def test_edges(spark):
    long = " ".join(f"x{i % 5000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c " * 30), (None, "a b c " * 30), (4, long), (4, long), (5, "é " * 40), (6, "short text"), (6, "short text")]
    assert run(spark, rows, 20) == plain(rows, 20)
    assert run(spark, [], 20) == []


def test_columns(spark):
    docs = frame(spark, ["one two", "three"]).withColumnsRenamed({"lang": "n_words", "source": "owner", "n_chars": "first"})
    got = T.deduplicated(docs)
    assert sorted(got.columns) == ["doc_id", "first", "kept_sha256", "n_removed", "n_words", "owner", "text"]
    assert {r.n_words for r in got.collect()} == {1, 2}


def test_trimmed(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "a"), (2, "before  it " + text, "b"), (3, "left  as is", "c"), (4, None, "d")], "doc_id long, text string, n_words string")
    out = {r.doc_id: (r.text, r.n_words) for r in T.trimmed(df).collect()}
    assert out == {1: (text, "a"), 2: ("before it", "b"), 3: ("left  as is", "c"), 4: (None, "d")}


def test_tree():
    r = np.random.default_rng(1)
    for bits in (1, 8, 20):
        table = np.concatenate([r.integers(0, 1 << bits, (200, 9)), np.repeat(r.integers(0, 2, (20, 9)), 5, axis=0)]).astype(np.int32)
        order, common = T.suffix_tree(table)
        rows = [tuple(x) for x in table[order].tolist()]
        assert rows == sorted(rows)
        assert common[0] == 0
        for a, b, n in zip(rows, rows[1:], common[1:]):
            assert n == next((j for j in range(9) if a[j] != b[j]), 9)
