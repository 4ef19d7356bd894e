"""Best-fit packing of documents into training sequences, under conflicts.

A document of more than ``capacity`` words is cut; each full cut is a sequence of
its own.  The remaining pieces of up to ``SHARD_WORDS`` words that follow each other
in a partition are packed together, largest first, into the compatible bin with the
least room that suffices: the search goes on from the tightest bin to its successors
until one has no conflict.  A bin conflicts with a piece if it holds one of the same
duplicate cluster (texts with the same words up to case of A-Z), or ``per_source`` of
the same source already.

Nothing is shuffled and no group is collected by source or cluster, so none is hot;
a bin never spans shards.  Texts without words and nulls get one row without a bin;
a null source is a source of its own; repeated rows are separate documents of one
cluster.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm import _bytes as B
from loreweave.llm._shared import packed, table, unpacked

CAPACITY = 2048
PER_SOURCE = 4
SHARD_WORDS = 4_000_000
RESULTS = ["piece", "first_word", "n_words", "bin_id"]


class Bins:
    """Open bins by residual room, with one bitmap of clusters and a unary stack of source bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.rooms: list[int] = []            # residuals that some bin has, ascending
        self.by_room: dict[int, list[int]] = {}
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def compatible(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b][-1] & source)

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes the piece; ``source`` and ``cluster`` are single bits (0: never in conflict)."""
        for i in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[i]
            b = next((b for b in self.by_room[room] if self.compatible(b, source, cluster)), None)
            if b is not None:
                self.by_room[room].remove(b)
                if not self.by_room[room]:
                    del self.by_room[room], self.rooms[i]
                break
        else:
            b, room = len(self.clusters), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[b] |= cluster
        for level in range(self.per_source):
            if not self.sources[b][level] & source:
                self.sources[b][level] |= source
                break
        if room > size:
            if room - size not in self.by_room:
                insort(self.rooms, room - size)
                self.by_room[room - size] = []
            insort(self.by_room[room - size], b)
        return b


def best_fit(sizes, sources, clusters, capacity: int, per_source: int) -> list[int]:
    """Bin numbers of pieces, given in any order and placed largest first (ties: as given)."""
    often = {}
    for c in clusters:
        often[c] = often.get(c, 0) + 1
    bit_of = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    bins, out = Bins(capacity, per_source), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.put(sizes[i], source_bit[sources[i]], bit_of.get(clusters[i], 0))
    return out


def pack(
    docs: DataFrame, text: str = "text", source: str = "source", keep: list[str] | None = None, capacity: int = CAPACITY,
    per_source: int = PER_SOURCE, shard_words: int = SHARD_WORDS, with_text: bool = False,
) -> DataFrame:
    """One row per piece: carried columns (all but the text by default), ``piece, first_word, n_words, bin_id``.

    ``with_text`` adds ``piece_text``.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    carried = list(dict.fromkeys([*keep, source]))

    def run(iterator):
        from pyspark import TaskContext

        bins_before = TaskContext.get().partitionId() << 40
        held, words = [], 0

        def flush():
            nonlocal held, words, bins_before
            if not held:
                return None
            rest = [i for i, h in enumerate(held) if 0 < h[3] < capacity]
            number: list = [None] * len(held)
            got = best_fit([held[i][3] for i in rest], [held[i][4] for i in rest], [held[i][5] for i in rest], capacity, per_source)
            n = max(got, default=-1) + 1
            for i, b in zip(rest, got):
                number[i] = bins_before + b
            for i, h in enumerate(held):
                if h[3] == capacity:
                    number[i] = bins_before + n
                    n += 1
            bins_before += n
            names = ["_row", *RESULTS]
            arrays = [pa.array([h[0] for h in held], row_type), *[pa.array([h[j] for h in held], pa.int64()) for j in (1, 2, 3)], pa.array(number, pa.int64())]
            if with_text:
                names.append("piece_text")
                arrays.append(pa.array([h[6] for h in held], pa.string()))
            held, words = [], 0
            return pa.RecordBatch.from_arrays(arrays, names)

        row_type = None
        for batch in iterator:
            row_type = batch.column("_row").type
            for rows, p in B.pieces(batch, "_text", lower=True):
                p.words(B.NOT_SPACE)
                p.prefix()
                hashes = p.span(p.start, p.end)
                own = rows.column("_row").to_pylist()
                raw = p.raw.tobytes()
                for i in range(p.n):
                    a, z = int(p.first[i]), int(p.first[i + 1])
                    cluster = hashes[a:z].tobytes() if z - a < 4 else hashlib.md5(hashes[a:z].tobytes()).digest()
                    for k, at in enumerate(range(a, max(z, a + 1), capacity)):
                        size = min(capacity, z - at)
                        piece = raw[p.start[at] : p.end[at + size - 1]].decode() if with_text and size else ""
                        held.append((own[i], k, at - a, size, own[i][source], (cluster, k), piece))
                    words += z - a + 1
                    if words >= shard_words:
                        yield flush()
        if held:
            yield flush()

    frame = packed(docs, text, carried)
    results = "piece long, first_word long, n_words long, bin_id long" + (", piece_text string" if with_text else "")
    out = frame.mapInArrow(run, f"_row {frame.schema['_row'].dataType.simpleString()}, {results}")
    return unpacked(out, keep, RESULTS + ["piece_text"] * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
