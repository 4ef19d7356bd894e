import random
import re

from loreweave.llm import licenses
from tests.llm.cases import corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for t, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(t.split())] == t.split()]
    near, _ = licenses.prepare(licenses.TEMPLATES, {}, {w: 0 for t, _ in licenses.TEMPLATES for w in t.split()}, licenses.CONTAINMENT)
    met, score = set(), 0.0
    for t in near:
        most = max([len(set(words[i : i + t.width]) & set(t.words)) for i in range(len(words))], default=0)
        if most >= t.need:
            met.add(t.label)
            score = max(score, most / len(t.words))
    score = 1.0 if hits else score
    base = {label for _, label in hits}
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), score


def test_against_every_block(spark):
    rng = random.Random(8)
    lines = [t for t, _ in licenses.TEMPLATES] + list(licenses.PHRASES) + ["Licensed under CC BY-NC 4.0.", "Licensed under the Apache License,\nVersion 2.0", "UNDER the MIT-License under the mit license"]
    texts = corpus(n=15) + lines
    for _ in range(150):
        words = rng.choice(lines).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["the"], ["mit", "mit"], ["K"], ["ſ"]])
            words = words or ["under"]
        texts.append(" ".join([rng.choice(["", "the mit", "w " * 30])] + words + [rng.choice(["", "license", "under the"])]))
    rows = licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows] == [expected(t) for t in texts]


def test_odd_tables(spark):
    docs = frame(spark, ["cc by nc", "cc by nc", None], [None, 1, 1])
    assert sorted(r.n_base for r in licenses.scan(docs).collect()) == [0, 1, 1]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs.withColumnsRenamed({"lang": "labels", "source": "_hits"})).columns.count("labels") == 1


def test_very_long_text(spark):
    n = 400_000
    texts = ["word " * n + "Under the MIT License. " + "word " * n + "cc by nc", "word " * n]
    first, second = licenses.scan(frame(spark, texts), keep=["doc_id"]).orderBy("doc_id").collect()
    assert (first.n_words, first.n_base, first.first_word, first.last_word, first.base_labels) == (2 * n + 7, 2, n, 2 * n + 4, "cc-by-nc,mit")
    assert (second.n_words, second.n_base, second.first_word, second.labels, second.score) == (n, 0, None, "", 0.0)
