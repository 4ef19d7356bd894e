import math
import random
import re
import zlib

import numpy as np
import pytest

from loreweave.llm import toxicity
from tests.llm.cases import ODD, frame, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(6)
    for _ in range(40):
        stems = sorted({"".join(rng.choice("abç") for _ in range(rng.randrange(2, 6))) for _ in range(4)})
        fuzzy = {s for s in stems if rng.random() < 0.7}
        words = ["".join(rng.choice("abçx") for _ in range(rng.randrange(8))) for _ in range(200)]
        weights = {s: i + 1.5 for i, s in enumerate(stems)}
        exact, near = toxicity.run_words(toxicity.automaton(weights, fuzzy), words)
        for w, e, n in zip(words, exact, near):
            starts = [w[:k] for k in range(1, len(w) + 1)]
            want = max([weights[s] for s in stems if w.startswith(s)], default=0)
            near_want = 0 if want else max([weights[s] for s in fuzzy if any(distance(p, s) <= 1 for p in starts)], default=0)
            assert (e, n) == (want, near_want), (w, stems, fuzzy)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    bad = ["blorgface", "snidgewit", "grumpkin"]
    texts, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            w = bad[i // 4 % 3]
            if zlib.crc32(str(i).encode()) % 5 == 0 and i % 8 == 0:
                w = w[:3] + "z" + w[3:]  # misspelled where nothing was learned
            words.insert(rng.randrange(60), w.upper() if i % 3 else w + "s")
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None)]
    docs = frame(spark, texts + ODD)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, table)).collect()
    assert len(rows) == 400 + len(ODD)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.doc_id % 4 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in held)
    assert all(r.predicted == 0 for r in rows if r.doc_id >= 400)
    assert toxicity.train(docs, table.where("toxic = 0")) is None


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_score(text, weights, fuzzy, fitted):
    """Every word against every stem, every hit against every other."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    hits = []
    for at, m in enumerate(WORD.finditer(text)):
        exact = max([v for s, v in weights.items() if m[0].startswith(s)], default=0)
        near = 0 if exact else max([weights[s] for s in fuzzy if any(distance(m[0][:k], s) <= 1 for k in range(1, len(m[0]) + 1))], default=0)
        if exact or near:
            hits.append((at, exact, near, sum(c in map(chr, toxicity.QUOTES) for c in text[: m.start()]) % 2 == 1))
    x = [0.0] * toxicity.N_FEATURES
    if hits:
        x = [math.log1p(sum(h[kind] for h in hits if h[3] == quoted)) for kind in (1, 2) for quoted in (False, True)]
        x += [math.log1p(max(sum(e + n for at, e, n, _ in hits if abs(at - mid) <= toxicity.WINDOW) for mid, *_ in hits)), 1.0]
    return 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(x, fitted)) + fitted[-1]))))


def test_score_against_plain_version(spark):
    rng = random.Random(9)
    weights, fuzzy = {"blorg": 3.0, "snidge": 4.5, "grum": 2.6}, {"blorg", "snidge"}
    fitted = np.array([1.1, -0.7, 0.6, -0.4, 0.8, 0.3, -3.0])
    model = toxicity.Model(toxicity.automaton(weights, fuzzy), weights, fitted)
    words = ["blorgs", "BLORG", "blrg", "bloorg", "snidge", "snidgy", "grump", "grm", "xgrum", "\"", "“", "”", "«", "fine", "day", "é"]
    texts = ODD + [rng.choice([" ", "-", " , "]).join(rng.choice([rng.choice(words), "plain", "talk", "of"]) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    rows = toxicity.score(frame(spark, texts), model).orderBy("doc_id").collect()
    want = [plain_score(t, weights, fuzzy, fitted) for t in texts]
    assert all(math.isclose(r.score, w, rel_tol=1e-9) for r, w in zip(rows, want)) and len(set(want)) > 50


def test_quotation_weighs_less(spark):
    rng = random.Random(3)
    texts = [prose(rng, 40).replace("\n", " ") + (f' he said "you {"blorgface"} there" ' if i % 3 == 1 else " you blorgface there " if i % 3 == 2 else "") for i in range(300)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 2)) for i in range(300)], "doc_id long, toxic int")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "MIN_LOG_ODDS", 0.3)
        patch.setattr(toxicity, "choose", lambda covers, costs, least: ["blorgface"])
        rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 2) for r in rows)


def test_odd_tables(spark):
    docs = frame(spark, ["a", None], [None, 1])
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), None).count() == 0
    assert toxicity.score(docs.withColumnsRenamed({"lang": "score", "source": "_row"}), None).columns.count("score") == 1
