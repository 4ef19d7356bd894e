"""Toxicity: a lexicon trie met by a Levenshtein automaton, scored in context.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; a null
text has none.

Lexicon: stems (beginnings of words, 4 to 10 characters) that toxic training texts
have significantly more often than clean ones, by a binomial test corrected for the
number of stems tried.  They are chosen greedily by how many toxic texts they
explain, a text being explained after ``EXPLAINED`` stems, so that the chance words
of copies add nothing.  A stem weighs by its log odds.

Matching: the trie of all stems and the automaton of one edit are joined by subset
construction into one deterministic automaton over characters; all distinct words
of a slice run through it together.  Stems of under five characters, and those
whose misspellings clean training texts have, match exactly only.

Context: a hit is quoted if an odd number of quotation marks precede it in the text,
and it is dense by how many hits lie within ``WINDOW`` words.  A logistic regression
weighs unquoted and quoted, exact and misspelled hits and the heaviest window.

Learning uses a sample of labelled rows bounded by ``SAMPLE_ROWS`` and
``SAMPLE_CHARS``, from documents whose crc32(id) modulo 5 is not ``HELD_OUT``; it
picks rows by hash, as many of either class as there are up to half.  Null ids and
labels other than 0 and 1 are passed over.  Without toxic rows every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm._shared import crc_fold, packed, sent, table, unpacked, written

HELD_OUT = 0
SAMPLE_ROWS = 8000
SAMPLE_CHARS = 30_000
STEM_SIZES = range(4, 11)
MIN_LOG_ODDS = 2.5
SIGNIFICANCE = 0.05
EXPLAINED = 3
MIN_GAIN = 3             # toxic texts that a stem must help to explain, and
MIN_GAIN_SHARE = 0.015   # the share of them
MAX_CLEAN_SHARE = 0.002  # of clean texts that may have a stem misspelled
FUZZY_FROM = 5           # characters
WINDOW = 10
PREDICTED_FROM = 0.5
QUOTES = [ord(c) for c in "\"“”„«»"]
N_FEATURES = 6


@dataclass(frozen=True)
class Automaton:
    """Deterministic: next state by (state, character class), and what a state has matched."""

    classes: dict[int, int]
    table: np.ndarray
    exact: np.ndarray   # weight of a stem that is complete without edits
    fuzzy: np.ndarray   # with one edit
    depth: int          # characters after which nothing new can match


def automaton(stems: dict[str, float], fuzzy: set[str]) -> Automaton:
    """Subset construction over (trie node, edits)."""
    nodes: list[dict[str, int]] = [{}]
    complete: list[float] = [0.0]
    edits_for: list[bool] = [False]  # some stem below may be misspelled
    for stem in stems:
        at = 0
        edits_for[0] |= stem in fuzzy
        for c in stem:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                complete.append(0.0)
                edits_for.append(False)
            at = nodes[at][c]
            edits_for[at] |= stem in fuzzy
        complete[at] = stems[stem]
    alphabet = sorted({c for n in nodes for c in n})
    ends_fuzzy = {}
    for stem in stems:
        at = 0
        for c in stem:
            at = nodes[at][c]
        ends_fuzzy[at] = stem in fuzzy

    def closed(states) -> frozenset:
        """Adds skipped stem characters (one edit)."""
        out = set(states)
        for node, edits in states:
            if edits == 0:
                out.update((child, 1) for child in nodes[node].values() if edits_for[child])
        return frozenset(s for s in out if not (s[1] == 1 and (s[0], 0) in out))

    def moved(states, c) -> frozenset:
        out = set()
        for node, edits in states:
            if c in nodes[node]:
                out.add((nodes[node][c], edits))
            if edits == 0 and edits_for[node]:
                out.add((node, 1))  # an extra character
                out.update((child, 1) for k, child in nodes[node].items() if k != c and edits_for[child])
        return closed(out)

    start = closed({(0, 0)})
    number, queue, table = {frozenset(): 0, start: 1}, [start], [[0] * (len(alphabet) + 1)]
    for states in queue:
        row = []
        for c in [None, *alphabet]:  # None: any other character
            to = moved(states, c)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        table.append(row)
    exact, near = np.zeros(len(number)), np.zeros(len(number))
    for states, k in number.items():
        exact[k] = max((complete[n] for n, e in states if e == 0), default=0)
        near[k] = max((complete[n] for n, e in states if e == 1 and ends_fuzzy.get(n)), default=0)
    return Automaton({ord(c): i + 1 for i, c in enumerate(alphabet)}, np.array(table, np.int32), exact, near, max(map(len, stems), default=0) + 1)


def run_words(a: Automaton, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the heaviest stem and the heaviest misspelled stem of each word, 0 for none."""
    exact, fuzzy = np.zeros(len(words)), np.zeros(len(words))
    if not words or a.depth <= 1:
        return exact, fuzzy
    codes = np.array([w[: a.depth] for w in words], f"U{a.depth}").view(np.uint32).reshape(len(words), a.depth)
    known, place = np.unique(codes, return_inverse=True)
    classes = np.array([a.classes.get(int(c), 0) for c in known])[place].reshape(codes.shape)
    live, state = np.arange(len(words)), np.ones(len(words), np.int32)
    for at in range(a.depth):
        going = codes[live, at] > 0
        live, state = live[going], state[going]
        state = a.table[state, classes[live, at]]
        exact[live] = np.maximum(exact[live], a.exact[state])
        fuzzy[live] = np.maximum(fuzzy[live], a.fuzzy[state])
        alive = state > 0
        live, state = live[alive], state[alive]
    return exact, np.where(exact > 0, 0, fuzzy)


def distinct_words(p: B.Piece) -> tuple[list[str], np.ndarray]:
    """Distinct words of the piece, and which one each word is."""
    p.words(B.ALNUM)
    p.prefix()
    _, first, own = np.unique(p.span(p.start, p.end), return_index=True, return_inverse=True)
    data = p.data.tobytes()
    return [data[s:e].decode("utf-8", "replace") for s, e in zip(p.start[first].tolist(), p.end[first].tolist())], own


def features(p: B.Piece, a: Automaton) -> np.ndarray:
    """Weights of exact, quoted exact, misspelled, quoted misspelled hits (log), of the heaviest window, and any hit."""
    out = np.zeros((p.n, N_FEATURES))
    words, own = distinct_words(p)
    if not words:
        return out
    exact, fuzzy = (w[own] for w in run_words(a, words))
    hits = np.flatnonzero(exact + fuzzy)
    if not len(hits):
        return out
    data, doc = p.data.tobytes(), p.doc[hits]
    for k in np.unique(doc).tolist():
        at = hits[doc == k]
        text = data[p.bounds[k] : p.bounds[k + 1]]
        marks = np.array(sorted(i for q in QUOTES for i in _all(text, chr(q).encode())))
        quoted = np.searchsorted(marks, p.start[at] - p.bounds[k]) % 2 == 1
        weight = np.concatenate([[0], np.cumsum(exact[at] + fuzzy[at])])
        heavy = weight[np.searchsorted(at, at + WINDOW, "right")] - weight[np.searchsorted(at, at - WINDOW, "left")]
        out[k, :4] = np.log1p([w[at][which].sum() for w in (exact, fuzzy) for which in (~quoted, quoted)])
        out[k, 4] = np.log1p(heavy.max())
        out[k, 5] = 1
    return out


def _all(text: bytes, mark: bytes):
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


def _stems(iterator):
    """Distinct stems of each sampled text."""
    for batch in iterator:
        for rows, p in B.pieces(batch, "_text", lower=True):
            p.words(B.ALNUM)
            data = p.data.tobytes()
            out = []
            for i in range(p.n):
                words = {data[s:e].decode("utf-8", "replace") for s, e in zip(p.start[p.first[i] : p.first[i + 1]].tolist(), p.end[p.first[i] : p.first[i + 1]].tolist())}
                out.append(sorted({w[:k] for w in words for k in STEM_SIZES if len(w) >= k}))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), pa.array(out, pa.list_(pa.string()))], ["id", "y", "stems"])


def significant(toxic: int, clean: int, n_toxic: int, n_clean: int, tried: int) -> bool:
    """Would so many toxic texts have it by chance, at the rate of clean ones, in one of all trials?"""
    rate = min(0.5, (clean + 1) / (n_clean + 1))
    tail = sum(exp(lgamma(n_toxic + 1) - lgamma(k + 1) - lgamma(n_toxic - k + 1) + k * log(rate) + (n_toxic - k) * log1p(-rate)) for k in range(toxic, min(n_toxic, toxic + 60) + 1))
    return toxic > rate * n_toxic and tail * tried < SIGNIFICANCE


def choose(covers: dict[str, set], costs: dict[str, float], least: float) -> list[str]:
    """Greedy choice by texts a stem helps to explain less its cost (of several the longest, then the first)."""
    chosen, left = [], dict.fromkeys((d for c in covers.values() for d in c), EXPLAINED)
    open_ = {s: set(d) for s, d in covers.items()}
    while open_:
        best = max(open_, key=lambda s: (len(open_[s]) - costs[s], len(s), s))
        mine = open_.pop(best)
        if len(mine) - costs[best] < least:
            break
        chosen.append(best)
        done = set()
        for d in mine:
            left[d] -= 1
            if not left[d]:
                done.add(d)
        open_ = {s: d - done for s, d in open_.items() if not (s.startswith(best) or best.startswith(s))}
    return chosen


@dataclass(frozen=True)
class Model:
    automaton: Automaton
    stems: dict[str, float]
    weights: np.ndarray  # by feature, then the constant


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (crc_fold(F.col(key)) != HELD_OUT)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y"))
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE_ROWS // 2)
    chosen = F.broadcast(pick(0).unionAll(pick(1)))  # at most SAMPLE_ROWS rows
    sample = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(chosen, "_k")
    sample = written(sample.groupBy("_text", "y").agg(F.min("_k").alias("id")), "sample")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(1):
        return None
    with_stems = written(sample.select("id", "y", "_text").mapInArrow(_stems, "id long, y int, stems array<string>"), "stems")
    rows = with_stems.select("id", "y", F.explode("stems").alias("stem"))
    n_toxic, n_clean = sizes[1], sizes.get(0, 0)
    counted = rows.groupBy("stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    tried = counted.count()
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    likely = counted.where((F.col("toxic") >= MIN_GAIN) & (odds >= MIN_LOG_ODDS)).withColumn("weight", odds)
    covers, costs, weights = {}, {}, {}
    for r in rows.where("y = 1").join(likely, "stem").groupBy("stem", "toxic", "clean", "weight").agg(F.collect_set("id").alias("ids")).collect():  # of the bounded sample
        if significant(r.toxic, r.clean, n_toxic, n_clean, tried):
            covers[r.stem], weights[r.stem] = set(r.ids), r.weight
            costs[r.stem] = 10 * r.clean * n_toxic / max(1, n_clean)
    stems = {s: weights[s] for s in choose(covers, costs, max(MIN_GAIN, MIN_GAIN_SHARE * n_toxic))}
    fuzzy = {s for s in stems if len(s) >= FUZZY_FROM}
    clean_hits = _fuzzy_in_clean(sample.where("y = 0"), stems, fuzzy)
    fuzzy = {s for s in fuzzy if clean_hits.get(s, 0) <= MAX_CLEAN_SHARE * n_clean}
    built = automaton(stems, fuzzy)
    shared = sent(spark, built)

    def run(iterator):
        own = shared()
        for batch in iterator:
            for rows, p in B.pieces(batch, "_text", lower=True):
                yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array(features(p, own).tolist(), pa.list_(pa.float64()))], ["y", "x"])

    got = sample.select("y", "_text").mapInArrow(run, "y int, x array<double>").collect()
    return Model(built, stems, _fit(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.y for r in got], float)))


def _fuzzy_in_clean(clean: DataFrame, stems: dict[str, float], fuzzy: set[str]) -> dict[str, int]:
    """Clean texts with a misspelling of each stem."""
    singles = sent(clean.sparkSession, {s: automaton({s: stems[s]}, {s}) for s in sorted(fuzzy)})

    def run(iterator):
        automata = singles()
        total = dict.fromkeys(automata, 0)
        for batch in iterator:
            for _, p in B.pieces(batch, "_text", lower=True):
                words, own = distinct_words(p)
                for stem, a in automata.items():
                    total[stem] += len(np.unique(p.doc[run_words(a, words)[1][own] > 0]))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["stem", "n"])

    return {r.stem: r.n for r in clean.select("_text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()}


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Carried columns (all by default), ``held_out, score, predicted``."""
    keep = docs.columns if keep is None else keep
    shared = sent(docs.sparkSession, model)

    def run(iterator):
        m = shared()
        for batch in iterator:
            for rows, p in B.pieces(batch, "_text", lower=True):
                value = np.zeros(p.n) if m is None else 1 / (1 + np.exp(-np.clip(features(p, m.automaton) @ m.weights[:-1] + m.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([rows.column("_row"), pa.array(value)], ["_row", "score"])

    source = packed(docs.withColumn("_held_out_", crc_fold(F.col(f"`{key}`")) == HELD_OUT), text, [*keep, "_held_out_"])
    scored = source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, score double")
    scored = scored.withColumns({"held_out": F.col("_row._held_out_"), "predicted": F.when(F.col("score") >= PREDICTED_FROM, 1).otherwise(0)})
    return unpacked(scored, keep, ["held_out", "score", "predicted"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
