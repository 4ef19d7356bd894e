"""Quality rules: text statistics and a calibrated n-gram classifier.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and
carriage return.  A null or empty text has no words and fails the base rules.

The classifier is a logistic regression on hashed word and character n-grams
(mean weight per n-gram kind), trained on a sample of labelled rows whose size is
bounded by ``SAMPLE_ROWS`` and ``SAMPLE_CHARS``; a third of the sample is kept
from training and fits the calibration.  Without labels of both classes nothing
is rejected beyond the base rules.  Repeated label rows count once per row;
contradicting ones are both used.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm._shared import packed, sent, table, unpacked

BITS = 16
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000   # longer labelled texts are not used for training
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_FROM = 0.1         # probability of label 1, calibrated on as many rows of either class
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CHAR_ORDERS = (2, 4)
WORD_ORDERS = (1, 2)
KINDS = len(CHAR_ORDERS) + len(WORD_ORDERS)

RESULTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Model:
    """Weights by kind and bucket, and the calibration p = sigmoid(a * x + b)."""

    weights: np.ndarray
    a: float
    b: float


def _repeats(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keyed places in order: has the text the key elsewhere; has it the key before."""
    own = B.mix(keys + B.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice, before = np.zeros(len(own), bool), np.zeros(len(own), bool)
    before[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, before


def statistics(p: B.Piece) -> dict[str, np.ndarray]:
    """The counts behind the rules, one value per text of the piece."""
    p.words(B.NOT_SPACE)
    p.prefix()
    hashes = p.span(p.start, p.end)
    p.hashes = hashes
    n_words = np.diff(p.first)
    leading = (p.data & 0xC0) != 0x80
    runs, at = p.runs(hashes, WINDOW)
    twice, _ = _repeats(p.doc[at], runs)
    in_repeat = B.covered(len(hashes), at[twice], at[twice] + WINDOW)

    breaks = np.flatnonzero(p.data == 0x0A)
    starts = np.concatenate([p.bounds[:-1], breaks + 1])
    owner = np.concatenate([np.arange(p.n), np.searchsorted(p.bounds, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = p.bounds[owner + 1]
    ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:] - 1, ends[:-1])
    filled = np.concatenate([[0], np.cumsum(p.inside)])
    with_word = filled[ends] > filled[starts]
    starts, ends, owner = starts[with_word], ends[with_word], owner[with_word]
    _, before = _repeats(owner, p.span(starts, ends))
    return {
        "n_words": n_words,
        "word_chars": p.sums(p.inside & leading, p.bounds),
        "n_symbols": p.sums(SYMBOLS[p.data], p.bounds),
        "n_dup_lines": np.bincount(owner[before], minlength=p.n),
        "n_repeat_words": p.sums(in_repeat, p.first),
    }


def _grams(p: B.Piece):
    """(bucket of each n-gram, first n-gram of each text and the end) by kind."""
    mask = np.uint64((1 << BITS) - 1)
    data = p.data.astype(np.uint64)
    doc = np.repeat(np.arange(p.n), np.diff(p.bounds))
    for k in CHAR_ORDERS:
        n = max(0, len(data) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = (out << np.uint64(8)) | data[j : j + n]
        at = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
        yield ((out[at] * B.BASE) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(at, p.bounds)
    for k in WORD_ORDERS:
        runs, at = p.runs(p.hashes, k)
        yield (runs & mask).astype(np.int64), np.searchsorted(at, p.first)


def _raw_scores(p: B.Piece, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(p.n)
    for kind, (buckets, first) in enumerate(_grams(p)):
        # In double precision, or a text's score would hang on the texts before it.
        total += p.sums(weights[kind][buckets].astype(np.float64), first) / np.maximum(1, np.diff(first))
    return total


def _features(iterator):
    """Labelled texts as (row, column, value) lists of mean n-gram counts."""
    for batch in iterator:
        for rows, p in B.pieces(batch, "_text", limit=B.SMALL):
            p.words(B.NOT_SPACE)
            p.prefix()
            p.hashes = p.span(p.start, p.end)
            cols, vals = [[] for _ in range(p.n)], [[] for _ in range(p.n)]
            for kind, (buckets, first) in enumerate(_grams(p)):
                for i in range(p.n):
                    if first[i + 1] > first[i]:
                        c, n = np.unique(buckets[first[i] : first[i + 1]], return_counts=True)
                        cols[i].append((c + (kind << BITS)).astype(np.int32))
                        vals[i].append((n / (first[i + 1] - first[i])).astype(np.float32))
            blob = lambda parts, t: np.concatenate([np.zeros(0, t), *parts]).astype(t).tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column("y"), pa.array([blob(c, np.int32) for c in cols], pa.binary()), pa.array([blob(v, np.float32) for v in vals], pa.binary())],
                ["y", "cols", "vals"],
            )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(indptr, cols, vals, y, width: int, rounds: int = 80) -> np.ndarray:
    """L2-regularised logistic regression by accelerated gradient steps, classes weighted alike."""
    own = np.repeat(np.arange(len(y)), np.diff(indptr))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    scale = np.sqrt(np.bincount(cols, weights=vals.astype(float) ** 2 * weight[own], minlength=width)) + 1e-3
    x = vals / scale[cols]
    dot = lambda w: np.bincount(own, weights=x * w[cols], minlength=len(y))
    step = 4 / max(1e-9, (np.bincount(own, weights=x * x, minlength=len(y)) * weight).sum())
    w, ahead = np.zeros(width), np.zeros(width)
    for k in range(rounds):
        slope = np.bincount(cols, weights=x * (weight * (_sigmoid(dot(ahead)) - y))[own], minlength=width) + 1e-5 * ahead
        new = ahead - step * slope
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w / scale


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for p = sigmoid(a x + b)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return max(float(a), 1e-6), float(b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model | None:
    """The model, or None if the labels don't have both classes."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y"))
    half = SAMPLE_ROWS // 2
    # A random but repeatable choice: the rows with the smallest hashes, as many of either class.
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("_k"), "_k").limit(half)
    chosen = F.broadcast(pick(0).unionAll(pick(1)))  # at most SAMPLE_ROWS rows
    sample = (
        docs.where(F.length(text) <= SAMPLE_CHARS)
        .select(F.col(key).alias("_k"), F.col(text).alias("_text"))
        .join(chosen, "_k")
        .select("_text", "y")
        .mapInArrow(_features, "y int, cols binary, vals binary")
    )
    rows = sample.collect()
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    cols = [np.frombuffer(r.cols, np.int32) for r in rows]
    vals = [np.frombuffer(r.vals, np.float32) for r in rows]
    # Texts alike are in one fold: weights never see what the calibration is fitted on.
    alike = {}
    text_no = np.array([alike.setdefault(c.tobytes() + v.tobytes(), len(alike)) for c, v in zip(cols, vals)])
    crc = np.array([zlib.crc32(t) for t in alike])
    fold = np.zeros(len(y), int)
    for cls in (0, 1):
        own = np.unique(text_no[y == cls])
        dealt = np.zeros(len(alike), int)
        dealt[own[np.argsort(crc[own], kind="stable")]] = np.arange(len(own)) % 3
        fold[y == cls] = dealt[text_no[y == cls]]
    both = np.intersect1d(text_no[y == 0], text_no[y == 1])
    fold[np.isin(text_no, both)] = 0  # with contradicting labels: for the weights only

    def part(which):
        ids = np.flatnonzero(which)
        return np.concatenate([[0], np.cumsum([len(cols[i]) for i in ids])]), np.concatenate([cols[i] for i in ids]), np.concatenate([vals[i] for i in ids]), y[ids]

    held = fold == 2
    if len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    w = _fit(*part(~held), KINDS << BITS)
    x = np.array([(w[c] * v).sum() for c, v in zip(cols, vals)])
    use = held if held.any() else np.ones(len(y), bool)
    a, b = _platt(x[use], y[use])
    return Model(w.reshape(KINDS, -1).astype(np.float32), a, b)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Carried columns (all by default), the statistics, ``base_failed``, ``probability`` and ``kept``."""
    keep = docs.columns if keep is None else keep
    shared = sent(docs.sparkSession, model)

    def run(iterator):
        fitted = shared()
        for batch in iterator:
            for rows, p in B.pieces(batch, "_text", limit=B.SMALL):
                found = statistics(p)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
                prob = np.ones(p.n) if fitted is None else _sigmoid(fitted.a * _raw_scores(p, fitted.weights) + fitted.b)
                out = [rows.column("_row"), *[pa.array(v.astype(np.int64)) for v in found.values()], pa.array(failed), pa.array(prob), pa.array(~failed & (prob >= KEEP_FROM))]
                yield pa.RecordBatch.from_arrays(out, ["_row", *found, "base_failed", "probability", "kept"])

    source = packed(docs, text, keep)
    kind = source.schema["_row"].dataType.simpleString()
    scored = source.mapInArrow(run, f"_row {kind}, {RESULTS}, probability double, kept boolean")
    return unpacked(scored, keep, [c for c in scored.columns if c != "_row"])


def kept(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents that rules and model keep, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col(f"`{text}`").alias("_t"))
    return score(whole, model, "_t", keep=["_whole"]).where("kept").select("_whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
