"""Language-model scores by deleted interpolation.

Tokens are runs of anything but white space (space and \\x09-\\x0D) after
lower-casing A-Z, then one end per text; a null is empty.  The documents whose
crc32(id) modulo 5 is ``HELD_OUT`` are scored but never counted.

    p(w | v) = l(b) c(v w)/c(v) + (1 - l(b)) p(w),   b: the octave of c(v)
    p(w)     = m c(w)/N + (1 - m)/(V + 1)

The weights m and l(b) are learned by expectation-maximisation: one fold of the
training documents is deleted from the counts, and its tokens are predicted from
the rest.  For that, tokens are tallied by octave of the context and by quarter
octaves of c(v w)/c(v) and c(w), so that what reaches the driver has a fixed bound.
The final estimates use the counts of all training documents.

The corpus is read once, into chunks of token numbers in the shared folder; a chunk
asks for each of its distinct n-grams once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm._meet import joined_totals, pack, pack_sorted, rows_of, totals, unpack, unpack_sorted
from loreweave.llm._shared import crc_fold, packed, release, sent, table, unpacked, written

HELD_OUT = 1            # fold that is scored only
DELETED = 0             # training fold that the weights are learned on
CHUNK_BYTES = 6 << 20
PAIR_BITS = 56          # of the key of a pair; words have 64
START, END = np.uint64(1), np.uint64(2)  # keys of the text's ends
STEPS = 4               # tally steps per octave
OCTAVES = 48
RESULTS = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
FIELDS = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Weights:
    tokens: int        # N
    types: int         # V
    word: float        # m
    pair: np.ndarray   # l by octave of the context's count; index 0: unseen


def _chunks(iterator):
    from pyspark import TaskContext

    owner = (TaskContext.get().partitionId() << 32) - 1
    for batch in iterator:
        for rows, p in B.pieces(batch, "_text", lower=True, limit=CHUNK_BYTES):
            owner += 1
            p.words(B.NOT_SPACE)
            p.prefix()
            docs, words = np.arange(p.n), len(p.start)
            keys = np.empty(words + 2 * p.n, np.uint64)
            keys[np.arange(words) + 2 * p.doc + 1] = p.span(p.start, p.end)
            keys[p.first[:-1] + 2 * docs] = START
            keys[p.first[1:] + 2 * docs + 1] = END
            distinct, ids = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([owner], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, p.n], pa.int32()), rows.column("_row")),
                    pa.array([pack((np.diff(p.first) + 2).astype(np.uint64))], pa.binary()),
                    pa.array([np.asarray(rows.column("_fold")).astype(np.int8).tobytes()], pa.binary()),
                    pa.array([pack_sorted(distinct)], pa.binary()),
                    pa.array([pack(ids.astype(np.uint64))], pa.binary()),
                    pa.array([words + p.n], pa.int64()),
                ],
                ["owner", "rows", "lengths", "folds", "words", "ids", "n"],
            )


class Chunk:
    """Tokens of a chunk: their words, contexts and pairs, by place in the chunk's sorted keys."""

    def __init__(self, row: dict):
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.folds = np.frombuffer(row["folds"], np.int8)
        self.words = unpack_sorted(row["words"])
        ids = unpack(row["ids"]).astype(np.int32)
        ends = np.cumsum(self.lengths)
        token = np.ones(len(ids), bool)  # all but starts
        token[ends - self.lengths] = False
        at = np.flatnonzero(token)
        self.starts, self.start_id = self.folds, int(np.searchsorted(self.words, START))
        self.word, self.context = ids[at], ids[at - 1]
        self.fold = np.repeat(self.folds, self.lengths - 1)
        self.first = ends - self.lengths - np.arange(len(ends))
        keys = B.mix(self.words[self.context] * B.BASE + self.words[self.word]) >> np.uint64(64 - PAIR_BITS)
        self.pairs, self.pair = np.unique(keys, return_inverse=True)

    def word_counts(self, folds) -> np.ndarray:
        out = np.bincount(self.word[np.isin(self.fold, folds)], minlength=len(self.words))
        if len(out):
            out[self.start_id] += np.isin(self.starts, folds).sum()
        return out

    def pair_counts(self, folds) -> np.ndarray:
        return np.bincount(self.pair[np.isin(self.fold, folds)], minlength=len(self.pairs))


def _training(deleted: bool) -> list[int]:
    return [f for f in range(5) if f != HELD_OUT and not (deleted and f == DELETED)]


def _asks(pairs: bool):
    def run(iterator):
        for batch in iterator:
            for row in rows_of(batch):
                c = Chunk(row)
                keys, counts = (c.pairs, c.pair_counts) if pairs else (c.words, c.word_counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["owner"]], pa.int64()), *[pa.array([x], pa.binary()) for x in (pack_sorted(keys), pack(counts(_training(True))), pack(counts([DELETED])))]],
                    ["owner", "keys", "rest", "deleted"],
                )

    return run


def _counts(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Totals by word and by pair."""
    return tuple(joined_totals(row[which], name).astype(np.int64) for which in ("of_words", "of_pairs"))


def octave(counts: np.ndarray) -> np.ndarray:
    """0 for none, else one more than the whole part of the binary logarithm."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _step(x: np.ndarray) -> np.ndarray:
    """Quarter octaves of positive values, from 1; 0 for none."""
    return np.where(x > 0, np.clip(np.round(np.log2(np.where(x > 0, x, 1)) * STEPS).astype(np.int64) + OCTAVES * STEPS, 0, 2 * OCTAVES * STEPS) + 1, 0)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 1 - OCTAVES * STEPS) / STEPS), 0.0)


def _tally(iterator):
    """Tokens of the deleted fold by (octave of context, step of ratio, step of word); types under -1."""
    wide = 2 * OCTAVES * STEPS + 2
    total: dict[int, int] = {}
    types = rest_types = 0
    for batch in iterator:
        for row in rows_of(batch):
            c = Chunk(row)
            rest, rest_pairs = _counts(row, "rest")
            deleted, new = (joined_totals(row["of_words"], x).astype(np.int64) for x in ("deleted", "new"))
            counted = (new > 0) & (c.words != START)
            types += int((counted & (rest + deleted > 0)).sum())
            rest_types += int((counted & (rest > 0)).sum())
            at = np.flatnonzero(c.fold == DELETED)
            context = rest[c.context[at]]
            ratio = rest_pairs[c.pair[at]] / np.maximum(1, context)
            cells, n = np.unique((octave(context) * wide + _step(ratio)) * wide + _step(rest[c.word[at]].astype(float)), return_counts=True)
            for cell, k in zip(cells.tolist(), n.tolist()):
                total[cell] = total.get(cell, 0) + k
    rows = [*total.items(), (-1, types), (-2, rest_types)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["cell", "n"])


def expectation_maximisation(high: np.ndarray, low: np.ndarray, n: np.ndarray, group: np.ndarray, groups: int, rounds: int = 60) -> np.ndarray:
    """Weights of ``high`` against ``low`` by group that make the tallied tokens likeliest; 0 where there are none."""
    weight = np.full(groups, 0.5)
    size = np.bincount(group, weights=n, minlength=groups)
    for _ in range(rounds):
        w = weight[group]
        mine = w * high / np.maximum(w * high + (1 - w) * low, 1e-300)
        weight = np.where(size > 0, np.bincount(group, weights=n * mine, minlength=groups) / np.maximum(size, 1), 0)
    return np.clip(weight, 0, 1 - 1e-6)


def learn(cells: dict[int, int], tokens: int, rest_tokens: int) -> Weights:
    wide = 2 * OCTAVES * STEPS + 2
    types, rest_types = cells.pop(-1, 0), cells.pop(-2, 0)
    at, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    context, ratio, word = at // wide // wide, _value(at // wide % wide), _value(at % wide)
    ml, flat = word / max(1, rest_tokens), np.full(len(at), 1 / (rest_types + 1))
    m = float(expectation_maximisation(ml, flat, n, np.zeros(len(at), np.int64), 1)[0]) if len(at) else 0.5
    m = min(max(m, 1e-6), 1 - 1e-6)
    pair = expectation_maximisation(ratio, m * ml + (1 - m) * flat, n, context, OCTAVES + 2)
    pair[0] = 0
    for b in range(2, len(pair)):  # octaves that the deleted fold lacks take the next lower one's weight
        if not (context == b).any():
            pair[b] = pair[b - 1]
    return Weights(tokens, types, m, pair)


def _scores(shared):
    def run(iterator):
        w: Weights = shared()
        for batch in iterator:
            for i, row in enumerate(rows_of(batch.drop_columns("rows"))):
                c = Chunk(row)
                words, pairs = (r + d for r, d in zip(_counts(row, "rest"), _counts(row, "deleted")))
                of_word, of_context = words[c.word], words[c.context]
                low = w.word * of_word / max(1, w.tokens) + (1 - w.word) / (w.types + 1)
                share = w.pair[octave(of_context)]
                p = share * pairs[c.pair] / np.maximum(1, of_context) + (1 - share) * low
                add = lambda v, first=c.first: np.add.reduceat(v, first) if len(v) else np.zeros(0)
                base = np.log10((of_word + 0.5) / (w.tokens + 0.5 * (w.types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rows")[i].values,
                        pa.array(c.folds == HELD_OUT),
                        pa.array(c.lengths - 1),
                        pa.array(add((of_word > 0).astype(np.int64)).astype(np.int64)),
                        pa.array(np.full(len(c.lengths), w.tokens)),
                        pa.array(add(base)),
                        pa.array(add(np.log10(p))),
                    ],
                    ["_row", *RESULTS],
                )

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Carried columns (all by default), ``held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    keep = docs.columns if keep is None else keep
    source = packed(docs.withColumn("_fold_", crc_fold(F.col(f"`{key}`"))), text, [*keep, "_fold_"])
    source = source.select("_row", "_text", F.col("_row._fold_").alias("_fold")).withColumn("_row", F.col("_row").dropFields("_fold_") if keep else F.col("_row"))
    kind = source.schema["_row"].dataType.simpleString()
    chunks = written(source.mapInArrow(_chunks, f"owner long, rows array<{kind}>, lengths binary, folds binary, words binary, ids binary, n long"), "chunks")
    plain = chunks.select("owner", "lengths", "folds", "words", "ids")
    n_tokens = chunks.agg(F.sum("n")).first()[0] or 0
    fields = "owner long, keys binary, rest binary, deleted binary"
    answers = []
    for name, pairs, bits in (("of_words", False, 64), ("of_pairs", True, PAIR_BITS)):
        asked = totals(plain.mapInArrow(_asks(pairs), fields), ["rest", "deleted"], n_tokens, bits, mark_new=not pairs)
        answers.append(written(asked.withColumnRenamed("totals", name), name))
        del asked
        release(docs.sparkSession)

    def counted(part: DataFrame) -> DataFrame:
        return part.join(answers[0], "owner").join(answers[1], "owner")

    tallied = counted(plain).mapInArrow(_tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    weights = learn({r.cell: r.n for r in tallied.collect()}, *_token_totals(chunks))
    del tallied
    release(docs.sparkSession)
    shared = sent(docs.sparkSession, weights)
    scored = counted(chunks.drop("n")).mapInArrow(_scores(shared), f"_row {kind}, {FIELDS}")
    return unpacked(scored, keep, RESULTS)


def _token_totals(chunks: DataFrame) -> tuple[int, int]:
    """Tokens of all training documents, and of those but the deleted fold."""

    def run(iterator):
        for batch in iterator:
            n = np.zeros(5, np.int64)
            for lengths, folds in zip(batch.column("lengths").to_pylist(), batch.column("folds").to_pylist()):
                n += np.bincount(np.frombuffer(folds, np.int8), weights=unpack(lengths).astype(float) - 1, minlength=5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array(n)], ["fold", "n"])

    found = {r.fold: r.n for r in chunks.select("lengths", "folds").mapInArrow(run, "fold int, n long").groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    return tuple(sum(found.get(f, 0) for f in _training(deleted)) for deleted in (False, True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), keep=["doc_id"])
