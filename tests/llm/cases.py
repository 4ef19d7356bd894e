"""Texts that every operator must bear, and small tables of them."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
ODD = [None, "", " ", "\n\n\t", "a", "A\x00B", "é", "ÀÉ ß x y", "\x1c\x1d word", "x" * 3000, "🎈 🎈 🎈", "one\r\ntwo\rthree\n\nfour", "İK ſ K"]


def prose(rng: random.Random, n: int, size: int = 60) -> str:
    return "".join(f"w{rng.randrange(size)}" + rng.choice([" ", " ", " ", "\n", ", ", " é "]) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in zip(ids, texts)], DOCS)


def corpus(seed: int = 7, n: int = 40) -> list:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(n)]
    return [*ODD, *texts, texts[3], texts[3], texts[5] + " tail"]
