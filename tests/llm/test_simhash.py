import random

import numpy as np
import pytest
import xxhash

from loreweave.llm import _components, simhash
from tests.llm.cases import corpus, frame


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, edges):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_keys_meet_at_four_bits():
    rng = np.random.default_rng(3)
    tables = simhash.golay_tables()
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype=np.int64)
    for bits in range(5):
        other = base.copy()
        for i in range(len(base)):
            for place in rng.choice(64, bits, replace=False):
                other[i] ^= np.int64(np.uint64(1 << int(place)).astype(np.int64))
        for x, y in zip(base, other):
            kx, _ = simhash.keys_of(np.array([x]), tables)
            ky, _ = simhash.keys_of(np.array([y]), tables)
            assert set(kx.tolist()) & set(ky.tolist())


def test_components_of_a_path(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(500, 501), (7, 7), (None, 3), (500, 501)]
    got = _components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(n + 1), 0), 500: 500, 501: 500} and len(got) == n + 3
    assert _components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_texts():
    rng = random.Random(5)
    texts = corpus()
    base = texts[30] + " " + texts[31]
    for _ in range(60):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts


def test_against_brute_force(spark):
    texts = near_texts()
    fps = [plain_fingerprint(t) for t in texts]
    n = len(texts)
    expected = roots(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    rows = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == expected
    kept = simhash.keep_one(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in kept] == [(i, texts[i]) for i in sorted(set(expected))]


def test_forest_of_a_large_group():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, dtype=np.int64)
    fps = np.unique(base ^ (np.int64(1) << rng.integers(0, 62, 4000)) ^ (np.int64(1) << rng.integers(0, 62, 4000)))
    u, v = simhash.forest(np.zeros(len(fps), np.int64), fps, 4)
    assert len(u) == len(fps) - 1 and set(v.tolist()) == {int(fps.min())}


def test_odd_tables(spark):
    docs = frame(spark, ["a b", "a b", None], [None, 5, None])
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(None, 5), (5, 5), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs).count() == 2
    clash = docs.withColumnsRenamed({"lang": "fingerprint", "source": "_fp"})
    assert simhash.near_duplicates(clash).columns.count("fingerprint") == 1
    with pytest.raises(ValueError):
        simhash.links(docs.selectExpr("doc_id as _fp"), 5)
