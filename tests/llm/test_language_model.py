import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loreweave.llm import language_model as lm
from tests.llm.cases import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def test_counts_base_and_probabilities(spark):
    texts = corpus(n=60)
    seqs = [tokens(t) for t in texts]
    train = [s for i, s in enumerate(seqs) if fold(i) != 1]
    words = Counter(w for s in train for w in s)
    pairs = Counter(p for s in train for p in zip(["<s>", *s], s))
    starts = len(train)
    n, v = sum(words.values()), len(words)
    captured = {}
    learn = lm.learn
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "learn", lambda *a: captured.setdefault("w", learn(*a)))
        rows = lm.score(frame(spark, texts)).orderBy("doc_id").collect()
    w = captured["w"]
    assert (w.tokens, w.types) == (n, v) and 0 < w.word < 1 and (w.pair >= 0).all() and (w.pair < 1).all()
    for i, (r, s) in enumerate(zip(rows, seqs)):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(s), sum(words[t] > 0 for t in s), n)
        assert math.isclose(r.base_score, sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in s), rel_tol=1e-9)
        total = 0.0
        for before, t in zip(["<s>", *s], s):
            c = starts if before == "<s>" else words[before]
            share = w.pair[c.bit_length()]
            total += math.log10(share * (pairs[before, t] / c if c else 0) + (1 - share) * (w.word * words[t] / n + (1 - w.word) / (v + 1)))
        assert math.isclose(r.score, total, rel_tol=1e-9)


def test_weights_make_held_out_text_likelier(spark):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(40)}" for _ in range(3)] for i in range(40)}
    texts = []
    for _ in range(200):
        out = ["w0"]
        for _ in range(60):
            out.append(rng.choice(follow[out[-1]]))
        texts.append(" ".join(out))
    rows = [r for r in lm.score(frame(spark, texts)).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.5 * sum(r.base_score for r in rows)


def test_em_finds_the_weight():
    high, low = np.array([0.9, 0.1]), np.array([0.2, 0.8])
    got = lm.expectation_maximisation(high, low, np.array([0.3 * 0.9 + 0.7 * 0.2, 0.3 * 0.1 + 0.7 * 0.8]) * 1000, np.zeros(2, int), 1, 2000)
    assert abs(got[0] - 0.3) < 1e-3


def test_odd_tables(spark):
    docs = frame(spark, ["a b", None, "a"], [None, 2, 2])
    assert sorted(r.n_tokens for r in lm.score(docs).collect()) == [1, 2, 3]
    assert lm.score(docs.limit(0)).count() == 0
    assert lm.score(docs.withColumnsRenamed({"lang": "score", "source": "_fold"})).columns.count("score") == 1


def test_text_longer_than_a_chunk(spark):
    long = "one two three four " * 500_000
    assert len(long) > lm.CHUNK_BYTES
    rows = {r.doc_id: r for r in lm.score(frame(spark, [None, "one two", long, "", "three"]), keep=["doc_id"]).collect()}
    train = [i for i in range(5) if fold(i) != 1]
    n_tokens = {0: 1, 1: 3, 2: 2_000_001, 3: 1, 4: 2}
    assert {i: r.n_tokens for i, r in rows.items()} == n_tokens
    assert rows[2].train_tokens == sum(n_tokens[i] for i in train) and all(math.isfinite(r.score) and r.score <= 0 for r in rows.values())
