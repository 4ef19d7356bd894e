import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import _bytes as B, quality
from tests.llm.cases import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_statistics(spark):
    texts = corpus() + ["a b c d e f g a b c d e", "x\ny\nx\n \nx", "#|<> **", "l1 a\nl1 a", "\n", "last\n"]
    rows = quality.score(frame(spark, texts), None).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected(t), t
        assert r.kept == (not r.base_failed)


def test_classifier(spark):
    clean = [f"the quiet river number {i} runs past old stone houses and green fields today" for i in range(60)]
    junk = [f"BUY!! NOW!! {i} CHEAP!! CLICK!! HERE!! FAST!! WIN!! BIG!! CASH!! PRIZE!!" for i in range(40)]
    docs = frame(spark, clean + junk + [None])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 2)] + [(None, 1), (4, None), (4, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).orderBy("doc_id").collect()
    assert [r.kept for r in rows if r.doc_id < 100] == [i < 60 for i in range(100)]
    assert quality.train(docs, labels.where("quality = 1")) is None


M64 = (1 << 64) - 1


def mixed(x):
    x &= M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def plain_probability(text, model):
    """Mean weight of each kind of n-gram, one n-gram at a time."""
    data, base = (text or "").encode(), int(B.BASE)
    hashes = [mixed(sum(int(B._BYTES[b]) * pow(base, i, 1 << 64) for i, b in enumerate(w.encode())) + len(w.encode())) for w in WORD.findall(text or "")]
    kinds = [[int.from_bytes(data[i : i + k], "big") * base % (1 << 64) >> 64 - quality.BITS for i in range(len(data) - k + 1)] for k in quality.CHAR_ORDERS]
    kinds.append([mixed(h) & (1 << quality.BITS) - 1 for h in hashes])
    kinds.append([mixed(a * base + b) & (1 << quality.BITS) - 1 for a, b in zip(hashes, hashes[1:])])
    raw = sum(sum(float(model.weights[kind][b]) for b in buckets) / len(buckets) for kind, buckets in enumerate(kinds) if buckets)
    return 1 / (1 + math.exp(-(model.a * raw + model.b)))


def test_probability_against_plain_model(spark):
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=(quality.KINDS, 1 << quality.BITS)).astype(np.float32) * 100, 0.05, -1.5)
    texts = corpus(n=25)
    for r, t in zip(quality.score(frame(spark, texts), model).orderBy("doc_id").collect(), texts):
        assert math.isclose(r.probability, plain_probability(t, model), rel_tol=1e-9), t
        assert r.kept == (not r.base_failed and r.probability >= quality.KEEP_FROM)


def test_score_does_not_hang_on_neighbours():
    rng = np.random.default_rng(6)
    weights = rng.normal(size=(quality.KINDS, 1 << quality.BITS)).astype(np.float32) + 10

    def last(texts):
        ((_, p),) = B.pieces(pa.record_batch({"t": texts}), "t", limit=1 << 30)
        quality.statistics(p)
        return quality._raw_scores(p, weights)[-1]

    text = "a short text of ten words that stands here alone"
    assert math.isclose(last([text]), last(["some words before it " * 40_000, text]), rel_tol=1e-9)


def test_calibration_finds_the_curve():
    rng = np.random.default_rng(7)
    x = rng.normal(size=40_000)
    y = (rng.random(40_000) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))).astype(int)
    a, b = quality._platt(x, y)
    assert abs(a - 1.7) < 0.06 and abs(b + 0.4) < 0.06


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.where("quality in (0, 1)").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows}
    text = {r.doc_id: r.text for r in docs.join(labels.select("doc_id"), "doc_id").collect()}
    seen = {text.get(r.doc_id) for r in rows if fold[r.doc_id]}
    train = spark.createDataFrame([r for r in rows if fold[r.doc_id]], labels.schema)
    held = {r.doc_id: r.quality for r in rows if not fold[r.doc_id] and text.get(r.doc_id) not in seen}
    got = [r for r in quality.score(docs, quality.train(docs, train), keep=["doc_id"]).collect() if r.doc_id in held and not r.base_failed]
    good, poor = ([r.kept for r in got if held[r.doc_id] == y] for y in (1, 0))
    assert len(good) >= 20 and sum(good) >= 0.95 * len(good) and sum(poor) <= 0.2 * len(poor)


@pytest.mark.parametrize("columns", [["doc_id", "text", "n_words", "KEPT", "_row"]])
def test_clashes_and_empty(spark, columns):
    docs = spark.createDataFrame([(1, "a b", 5, True, "x")], "doc_id long, text string, n_words int, KEPT boolean, _row string")
    got = quality.score(docs, None)
    assert got.first().n_words == 2 and "_row" in got.columns and got.columns.count("n_words") == 1
    assert quality.score(docs.limit(0), None).count() == 0
