import hashlib
import random
import re

from loreweave.llm import decontaminate
from tests.llm.cases import corpus, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items):
    doc, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        if item is None or not w:
            continue
        n = min(13, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for p in range(len(doc) - n + 1):
            if tuple(doc[p : p + n]) in wins:
                hit.update(range(p, p + n))
                ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(doc), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(doc)


def inputs():
    rng = random.Random(11)
    texts = corpus()
    items = [(i, prose(rng, n, 30)) for i, n in enumerate([0, 1, 2, 4, 5, 6, 12, 13, 14, 30, 80])]
    items += [(20, None), (None, "w1 w2"), (9, items[9][1]), (21, "É"), (22, texts[20]), (10, "other words w3"), (23, "A b\x00C")]
    texts += [texts[14] + " " + items[9][1].upper() + "; " + items[8][1], items[10][1], items[10][1][:60], "w1"]
    return texts, items


def test_against_brute_force(spark):
    texts, items = inputs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 400):
        rows = decontaminate.scan(frame(spark, texts), bench, block_bytes=block_bytes).orderBy("doc_id").collect()
        got = [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]
        assert got == [expected(t, items) for t in texts]
    clean = decontaminate.clean(frame(spark, texts), bench).orderBy("doc_id").collect()
    assert [r.text for r in clean] == [t for t in texts if not expected(t, items)[4]]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    docs = frame(spark, ["w1 w2", None])
    assert [r.n_hit for r in decontaminate.scan(docs, bench.limit(0)).collect()] == [0, 0]
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    clash = docs.withColumnRenamed("lang", "contaminated").withColumnRenamed("source", "_items")
    assert decontaminate.scan(clash, bench).columns == ["doc_id", "text", "_items", "n_chars", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
