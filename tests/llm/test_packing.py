import random
from collections import Counter, defaultdict

from loreweave.llm import packing
from tests.llm.cases import corpus, frame, prose


def plain(sizes, sources, clusters, capacity, per_source):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [
            (capacity - sum(sizes[j] for j in b), n) for n, b in enumerate(bins)
            if sum(sizes[j] for j in b) + sizes[i] <= capacity and clusters[i] not in {clusters[j] for j in b} and sum(sources[j] == sources[i] for j in b) < per_source
        ]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[n].append(i)
        out[i] = n
    return out


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(80)
        args = [rng.randrange(1, 20) for _ in range(n)], [rng.randrange(3) for _ in range(n)], [rng.randrange(1 + n // 2) for _ in range(n)]
        assert packing.best_fit(*args, 20, 2) == plain(*args, 20, 2)


def test_pieces(spark):
    rng = random.Random(9)
    texts = corpus() + [prose(rng, 130), prose(rng, 50), "a b " * 25]
    rows = packing.pack(frame(spark, texts), keep=["doc_id", "source"], capacity=50, per_source=2, shard_words=900, with_text=True).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [w for r in own for w in r.piece_text.encode().split()] == words
        assert [r.first_word for r in own] == list(range(0, max(1, len(words)), 50)) and sum(r.n_words for r in own) == len(words)
        assert all((r.bin_id is None) == (r.n_words == 0) for r in own)
    for pieces in by_bin.values():
        assert sum(r.n_words for r in pieces) <= 50 and max(Counter(r.source for r in pieces).values()) <= 2
        assert len({(tuple(texts[r.doc_id].lower().split()), r.piece) for r in pieces}) == len(pieces)


def test_odd_tables(spark):
    docs = frame(spark, ["a b", "a b", None], [None, 1, 1])
    assert sorted(r.n_words for r in packing.pack(docs).collect()) == [0, 2, 2]
    assert packing.pack(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"lang": "bin_id", "n_chars": "Piece"})
    assert packing.pack(clash).columns == ["doc_id", "source", "piece", "first_word", "n_words", "bin_id"]
