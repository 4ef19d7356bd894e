import random

import pytest
from tokenizers import Tokenizer, models

from loreweave.llm import token_counts as tc
from tests.llm.cases import corpus, frame


def by_library(vocabulary, texts):
    """The library's own Unigram model over the same pieces."""
    pieces = [("<unk>", 0.0)] + ([(f"<0x{b:02X}>", min(vocabulary.pieces.values(), default=0)) for b in range(256)] if vocabulary.byte_fallback else []) + list(vocabulary.pieces.items())
    t = Tokenizer(models.Unigram(pieces, 0, vocabulary.byte_fallback))
    return [len(t.encode(tc.SPACE + x.replace(" ", tc.SPACE)).ids) if x else 0 for x in ((x or "") for x in texts)]


@pytest.fixture(scope="module")
def public():
    pytest.importorskip("public_tokenizers")
    return tc.read_vocabulary()


def test_public_vocabulary(spark, public):
    texts = corpus() + ["The quick  brown fox\tjumps; über «naïve» 東京 🎈é.", "aaaa" * 300, "  lead", "trail  ", "a\n\n b"]
    rows = tc.count(frame(spark, texts), public).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == by_library(public, texts)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_ties_and_unknown_characters(fallback, whole):
    rng = random.Random(5)
    for _ in range(150):
        letters = "abc" + tc.SPACE
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): float(-rng.randrange(4)) if whole else -rng.randrange(4) / 4 for _ in range(rng.randrange(1, 14))}
        v = tc.Vocabulary(pieces, fallback)
        texts = ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(25))) for _ in range(12)]
        counter = tc.Counter(v)
        assert [counter.of(t)[0] for t in texts] == by_library(v, texts), pieces


def test_odd_tables(spark, public):
    docs = frame(spark, [None, "", "a"], [None, 1, 1])
    assert sorted(r.n_tokens for r in tc.count(docs, public).collect()) == [0, 0, 1]
    assert tc.count(docs.limit(0), public).count() == 0
    assert tc.count(docs.withColumnsRenamed({"lang": "n_tokens", "source": "_row"}), public).columns.count("n_tokens") == 1


def test_very_long_text(spark, public):
    once = tc.count(frame(spark, ["the quick brown fox\n"]), public).first().n_tokens
    row = tc.count(frame(spark, ["the quick brown fox\n" * 300_000]), public, keep=["doc_id"]).first()
    own = tc.count(frame(spark, ["the quick brown fox\n" * 2]), public).first().n_tokens - once
    assert row.n_tokens == once + 299_999 * own
