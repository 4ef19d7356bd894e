"""Token counts of a unigram vocabulary, without the tokens.

The text gets a leading space, and spaces become U+2581.  Of all ways to write it as
vocabulary pieces the one with the largest sum of scores counts; a character that no
single-character piece covers may also stand alone, at the least score less
``PENALTY``, and then counts as its bytes if the vocabulary has all byte pieces, else
runs of such characters count one.  Ties go to the earlier start, that is to the
longer last piece, as in the usual implementation.  A null text has no pieces, an
empty one neither.

An Aho-Corasick automaton lists the pieces that end at each character; dynamic
programming carries score and count.  If no piece has U+2581 or a line feed after
another character, a text falls into independent parts there (the scores must add up
exactly, as whole numbers do); each distinct part is counted once while it is held.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm._shared import packed, sent, table, unpacked

SPACE = "▁"
PENALTY = 10.0
HELD_PARTS = 400_000  # distinct parts a task holds at a time


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, float]
    byte_fallback: bool


def read_vocabulary(path: str | None = None) -> Vocabulary:
    """Pieces and scores of a SentencePiece file; by default the public one with 32,000 pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))}
    return Vocabulary(pieces, sum(map(model.is_byte, ids)) == 256)


class Counter(dict):
    """(count, score) of a part, computed when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.find.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.find.make_automaton()
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - PENALTY
        self.bytes = vocabulary.byte_fallback
        whole = all(s == float(int(s)) for s in vocabulary.pieces.values())
        self.parts = whole and self.bytes and not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in vocabulary.pieces)

    def __missing__(self, part: str) -> tuple[int, float]:
        n = len(part)
        score, count, alone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ending: list[list] = [[] for _ in range(n + 1)]
        if len(self.find):
            for at, found in self.find.iter(part):
                ending[at + 1].append(found)
        for end in range(1, n + 1):
            best = None
            for size, value in sorted(ending[end], reverse=True):
                total = score[end - size] + value
                if best is None or total > best:
                    best, score[end], count[end] = total, total, count[end - size] + 1
            c = part[end - 1]
            if c not in self.singles:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not alone[end - 1])
                    score[end], count[end], alone[end] = total, count[end - 1] + more, True
        if len(self) >= HELD_PARTS:
            self.clear()
        self[part] = out = (count[n], score[n])
        return out

    def of(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        parts = _PARTS.findall(text) if self.parts else [text]
        found = [self[p] for p in parts]
        return sum(f[0] for f in found), sum(f[1] for f in found)


_PARTS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def count(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Carried columns (all by default), ``n_tokens`` and ``token_score``.  The vocabulary is broadcast: its size is fixed."""
    keep = docs.columns if keep is None else keep
    shared = sent(docs.sparkSession, vocabulary)

    def run(iterator):
        counter = Counter(shared())
        for batch in iterator:
            found = [counter.of(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["_row", "n_tokens", "token_score"])

    source = packed(docs, text, keep)
    counted = source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, n_tokens long, token_score double")
    return unpacked(counted, keep, ["n_tokens", "token_score"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), read_vocabulary(), keep=["doc_id"])
