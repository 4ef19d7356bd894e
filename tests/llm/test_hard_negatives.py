"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = []
    for i, v, l in rows:
        if l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(x))))) for x in v], l))
    last = lambda i: H.NO_ID if i is None else i
    out = []
    for i, v, l in good:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), last(j), m, j) for j, w, m in good if j != i)
        for s, _, _, p in [x for x in scored if x[2] == l][:positives]:
            fits = [x for x in scored if x[2] != l and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, k + 1, x[3], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


def run(spark, rows, every=100, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, **more).collect()), key=str)


def vectors(seed, n, width=16, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, width))
    return [(i, (centres[r.integers(8)] + spread * r.normal(size=width)).astype(np.float32).tolist(), int(r.integers(4))) for i in range(n)]


@pytest.mark.parametrize("spread, block", [(0.05, 1 << 14), (0.5, 7), (3.0, 7)])
def test_against_all_scores(spark, monkeypatch, spread, block):
    for name, value in (("CLUSTER", 4), ("STEP", 16), ("ITEMS", 100)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(1, 900, spread=spread)
    assert run(spark, rows, every=30, block=block) == plain(rows, every=30)


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = vectors(2, 600)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, 1 if i % 5 else l) for i, v, l in rows]
    assert run(spark, rows, every=50) == plain(rows, every=50)


def test_odd_rows(spark):
    rows = vectors(3, 120, width=4)
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 2), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("inf")], 1), (204, [1.0], None),
             (300, [], 1), (400, [0.0] * 4, 2), (500, [1e30, -1e30, 1.0, 1.0], 2), (501, [1e30, 1e30, 1.0], 3), (502, [2.0, 2.0, 2.0, 2.0, 2.0, 2.0], 2), (600, [2.0] * 6, 1)]
    rows += [(700, [1.0, 2.0, 3.0, 4.0], 1), (701, [1.0, 1.0, 1.0, 1.0], 2), (701, [1.0, 1.0, 1.0, 1.0], 2)]
    assert run(spark, rows, every=20) == plain(rows, every=20)
    assert run(spark, []) == []
    clash = spark.createDataFrame(vectors(4, 50), SCHEMA).withColumns({"rank": F.lit(1), "slot": F.lit("x"), "cluster": F.lit(2), "is_anchor": F.lit(0)})
    assert H.mine(clash, F.col("vec_id") == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_lists_end_early():
    """In tight clusters members leave their list long before its end."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    x = np.floor(256 * (centres[np.arange(8000) % 40] + 0.02 * r.normal(size=(8000, 16))))
    anchors = {"id": np.arange(0, 8000, 100), "label": np.zeros(80, np.int64), "vectors": x[::100].astype(np.int32), "cluster": (np.arange(0, 8000, 100) % 40).astype(np.int32)}
    best = H.Best(80, 5)
    done = sum(H.walk(anchors, g, x, np.arange(8000), np.zeros(8000, np.int64), best, None) for g in H.clusters(anchors))
    assert done < 0.3 * 80 * 8000 and len(best.slot) == 400
