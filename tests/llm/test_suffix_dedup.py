import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import _bytes, suffix_array, suffix_dedup
from tests.llm.cases import corpus, frame, prose


def expected(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


@pytest.mark.parametrize("in_memory, block", [(1 << 26, 1 << 18), (0, 7)])
def test_suffix_array_against_sorting(monkeypatch, in_memory, block):
    monkeypatch.setattr(suffix_array, "IN_MEMORY", in_memory)
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    rng = np.random.default_rng(0)
    for trial in range(60):
        text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 80)).astype(np.uint8)
        with suffix_array.Spool() as spool:
            order = suffix_array.suffix_array(text, spool, 400).tolist()
        whole = text.tobytes()
        assert order == sorted(range(len(whole)), key=lambda i: whole[i:])
        length = 8
        valid = np.zeros(len(text), bool)
        valid[: max(0, len(text) - length + 1)] = True
        with suffix_array.Spool() as spool:
            at, kind = suffix_array.classes(text, valid, length, spool)
        strings = {}
        for i, k in zip(at.tolist(), kind.tolist()):
            strings.setdefault(whole[i : i + length], set()).add(k)
        assert all(len(k) == 1 for k in strings.values()) and len(strings) == len(set(kind.tolist()))


def inputs():
    rng = random.Random(2)
    texts = corpus()
    passage, other = prose(rng, 120), prose(rng, 90)
    texts += [prose(rng, 30) + passage + prose(rng, 20), passage[:-3] + other, "é" + other + passage, "ab" * 700, "ab" * 300 + "c", other[:399], other[:400]]
    return texts + [prose(rng, rng.randrange(40)) + passage[rng.randrange(60) :] + f" end {i}" for i in range(30)]


def test_against_brute_force(spark):
    texts = inputs()
    for length, shard_bytes in ((400, suffix_dedup.SHARD_BYTES), (400, 3000), (48, 20_000)):
        rows = suffix_dedup.deduplicated(frame(spark, texts), length=length, shard_bytes=shard_bytes).orderBy("doc_id").collect()
        want = list(expected(texts, length))
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [w[:4] for w in want]
    kept = suffix_dedup.trimmed(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in kept] == [None if t is None else w[4].decode("utf-8", "ignore") for t, w in zip(texts, expected(texts, 400))]


@pytest.mark.parametrize("shard_bytes", [8000, 1 << 20])
def test_passages_over_many_shards(spark, shard_bytes):
    """Thousands of passages, many of them hardly as long as a string, each time in other surroundings."""
    rng = random.Random(11)
    passages = [prose(rng, rng.randrange(14, 40), 5000) for _ in range(1200)]
    texts = ["".join(prose(rng, rng.randrange(25), 5000) + rng.choice(passages) for _ in range(rng.randrange(1, 5))) + prose(rng, rng.randrange(25), 5000) for _ in range(1500)]
    rows = suffix_dedup.deduplicated(frame(spark, texts), length=64, shard_bytes=shard_bytes).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [w[:4] for w in expected(texts, 64)]


def test_odd_tables(spark):
    docs = frame(spark, [None, "x" * 500, "y"], [None, 4, 4])
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(docs).collect()} == {(None, 0, 0), (4, 500, 500), (4, 1, 0)}
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "n_bytes", "source": "owner"})
    assert suffix_dedup.deduplicated(clash).columns.count("n_bytes") == 1


def test_anchors_need_little_memory(monkeypatch):
    """By blocks, the anchors of the whole piece; the memory follows the block, not the piece."""
    rng = random.Random(5)
    texts = ["", *[prose(rng, rng.randrange(90)) for _ in range(150)], "", "ab" * 300, prose(rng, 4000, 5000), ""]
    piece = _bytes.Piece(pa.array(texts), False)
    for length in (16, 48, 400):
        gram = suffix_dedup.gram_of(length)
        piece.prefix()
        at = np.arange(len(piece.data) - gram + 1)
        values = piece.span(at, at + gram) | np.uint64(1)
        want = set()
        for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist()):
            for i in range(a, b - length + 1):
                window = values[i : i + length - gram + 1]
                want.update((i + np.flatnonzero(window == window.min())).tolist())
        for block in (1 << 17, 1000, 7):
            monkeypatch.setattr(suffix_dedup, "BLOCK", block, raising=False)
            places, keys = suffix_dedup.anchors(piece, length)
            assert places.tolist() == sorted(want) and (keys == values[places]).all()
    monkeypatch.undo()
    large = _bytes.Piece(pa.array(["".join(rng.choices("abcdefgh ", k=3 << 20))]), False)
    tracemalloc.start()
    suffix_dedup.anchors(large, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(large.data)


def test_trimmed_texts_travel_once(spark, monkeypatch):
    tables = {}

    def kept(df, name, write=suffix_dedup.written):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "written", kept)
    texts = inputs()
    rows = suffix_dedup.trimmed(frame(spark, texts)).collect()
    assert "text" not in tables["chunks"].schema["rows"].dataType.simpleString()
    assert {r.doc_id: r.text for r in rows} == {i: None if t is None else w[4].decode("utf-8", "ignore") for i, (t, w) in enumerate(zip(texts, expected(texts, 400)))}
    broken = spark.sql("select 1L doc_id, cast(unhex('61FF62') as string) text, 7 n_chars union all select null, null, null union all select 2L, repeat('y', 500), 500")
    got = suffix_dedup.trimmed(broken)
    assert got.columns == broken.columns
    assert {(r.doc_id, r.h, r.n_chars) for r in got.selectExpr("doc_id", "hex(text) h", "n_chars").collect()} == {(1, "61FF62", 7), (None, None, None), (2, "", 0)}
    assert [r.text for r in suffix_dedup.trimmed(broken.select("text").where("doc_id = 2")).collect()] == [""]
