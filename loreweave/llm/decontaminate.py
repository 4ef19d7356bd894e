"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  A
window is ``WINDOW`` consecutive words of an item; a shorter item is one window.
A window's elements are its shingles of ``SHINGLE`` words (all its words, if it has
fewer).  To contain the whole window a document needs each of them, so the
necessary prefix is one: the shingle that is rarest in the documents.  Where a
document has that shingle, the window's place follows from the shingle's offset;
it must lie within the text (position and length bounds), and then its words are
compared byte for byte.

The documents are read twice, once for shingle counts and once for the join, and
never shuffled.  The items are broadcast in blocks of ``BLOCK_BYTES`` of text; each
further block is one more pass.  Items with a null id or text have no windows, null
documents no words; rows alike are treated alike, each on its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm._shared import packed, sent, table, unpacked, written

WINDOW = 13
SHINGLE = 5
BLOCK_BYTES = 4 << 20
CONTAMINATED_FROM = 20  # parts of 1/20 of the words
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def windows_of(text: bytes, window: int = WINDOW) -> set[bytes]:
    words = WORD.findall(text.lower())
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the shingles of a window, as a Piece has them."""
    p = B.Piece(pa.array([b" ".join(words)]).cast(pa.binary()).view(pa.string()), lower=False)
    p.words(B.ALNUM)
    p.prefix()
    return p.runs(p.span(p.start, p.end), k)[0]


class Members:
    """Sorted 64-bit values with a quick test that turns most others away."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(16, int(np.log2(len(self.values) + 1)) + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.values >> np.uint64(64 - self.bits)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, places in values) of the members."""
        at = np.flatnonzero(self.table[x >> np.uint64(64 - self.bits)])
        if not len(self.values):
            return at[:0], at[:0]
        to = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        hit = self.values[to] == x[at]
        return at[hit], to[hit]


@dataclass
class Block:
    """The windows of some items, and their shingle hashes by shingle size."""

    windows: list[bytes]
    items: list[list[str]]
    shingles: list[tuple[int, np.ndarray]]  # of each window: size, hashes in order
    members: dict[int, Members]
    places: dict[int, list[list[tuple[int, int]]]] | None = None  # by size and member: (window, offset)


def block_of(rows: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE) -> Block:
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in rows:
        for w in windows_of(text.encode(), window):
            owners[w].add(item)
    windows = sorted(owners)
    shingles, by_size = [], defaultdict(list)
    for w in windows:
        words = w.split(b" ")
        k = min(shingle, len(words))
        shingles.append((k, _hashes(words, k)))
        by_size[k].append(shingles[-1][1])
    return Block(windows, [sorted(owners[w]) for w in windows], shingles, {k: Members(np.concatenate(v)) for k, v in by_size.items()})


def with_prefixes(block: Block, counts: dict[int, np.ndarray]) -> Block:
    """Windows listed under their rarest shingle."""
    places = {k: [[] for _ in m.values] for k, m in block.members.items()}
    for at, (k, hashes) in enumerate(block.shingles):
        to = np.searchsorted(block.members[k].values, hashes)
        best = int(np.lexsort((hashes, counts[k][to]))[0])
        places[k][to[best]].append((at, best))
    used = {k: np.array([bool(x) for x in v], bool) for k, v in places.items()}
    return Block(
        block.windows, block.items, [],
        {k: Members(m.values[used[k]]) for k, m in block.members.items()},
        {k: [x for x in v if x] for k, v in places.items()},
    )


def _shingled(batch, sizes):
    for rows, p in B.pieces(batch, "_text", lower=True, limit=B.SMALL):
        p.words(B.ALNUM)
        p.prefix()
        words = p.span(p.start, p.end)
        yield rows, p, {k: p.runs(words, k) for k in sizes}


def count_shingles(texts: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often the documents have each shingle of the block."""
    shared = sent(texts.sparkSession, block.members)

    def run(iterator):
        members = shared()
        totals = {k: np.zeros(len(m.values), np.int64) for k, m in members.items()}
        for batch in iterator:
            for _, _, found in _shingled(batch, members):
                for k, (runs, _) in found.items():
                    totals[k] += np.bincount(members[k].find(runs)[1], minlength=len(totals[k]))
        for k, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "at", "n"])

    counts = {k: np.zeros(len(m.values), np.int64) for k, m in block.members.items()}
    for r in texts.select("_text").mapInArrow(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
        counts[r.k][r["at"]] = r.n
    return counts


def _occurrences(p: B.Piece, found, block: Block):
    """(text, first word, number of words, window) of every occurrence in the piece."""
    lowered = p.data.tobytes()
    starts, ends, first = p.start, p.end, p.first
    same: dict[tuple[int, bytes], bool] = {}
    for k, (runs, at) in found.items():
        where, member = block.members[k].find(runs)
        for place, m in zip(at[where].tolist(), member.tolist()):
            doc = int(p.doc[place])
            for window, offset in block.places[k][m]:
                text = block.windows[window]
                n = text.count(b" ") + 1
                begin = place - offset
                if begin < first[doc] or begin + n > first[doc + 1]:
                    continue
                span = lowered[starts[begin] : ends[begin + n - 1]]
                known = same.get((window, span))
                if known is None:
                    known = same[window, span] = b" ".join(lowered[a:b] for a, b in zip(starts[begin : begin + n], ends[begin : begin + n])) == text
                if known:
                    yield doc, begin, n, window


def _pass(source: DataFrame, block: Block, last: bool) -> DataFrame:
    """Adds what the block's windows hit to ``_spans`` (pairs of word numbers) and ``_items``."""
    shared = sent(source.sparkSession, block)
    again = "_spans" in source.columns

    def run(iterator):
        block = shared()
        for batch in iterator:
            for rows, p, found in _shingled(batch, block.members):
                spans: dict[int, set] = defaultdict(set)
                items: dict[int, set] = defaultdict(set)
                if again:
                    for i, (s, own) in enumerate(zip(rows.column("_spans").to_pylist(), rows.column("_items").to_pylist())):
                        if s:
                            spans[i].update(map(tuple, np.frombuffer(s, np.int64).reshape(-1, 2).tolist()))
                            items[i].update(own)
                for doc, begin, n, window in _occurrences(p, found, block):
                    spans[doc].add((begin - int(p.first[doc]), begin - int(p.first[doc]) + n))
                    items[doc].update(block.items[window])
                n_words = np.diff(p.first)
                n_hit = np.zeros(p.n, np.int64)
                for i, s in spans.items():
                    pairs = np.array(sorted(s), np.int64)
                    n_hit[i] = B.covered(int(n_words[i]), pairs[:, 0], pairs[:, 1]).sum()
                arrays = [rows.column("_row"), pa.array(n_words), pa.array(n_hit), pa.array([sorted(items[i]) if i in items else [] for i in range(p.n)], pa.list_(pa.string()))]
                names = ["_row", "n_words", "n_hit", "_items"]
                if not last:
                    arrays += [rows.column("_text"), pa.array([np.array(sorted(spans[i]), np.int64).tobytes() if i in spans else b"" for i in range(p.n)], pa.binary())]
                    names += ["_text", "_spans"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = source.schema["_row"].dataType.simpleString()
    return source.mapInArrow(run, f"_row {kind}, n_words long, n_hit long, _items array<string>" + ("" if last else ", _text string, _spans binary"))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Carried columns (all by default), ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    keep = docs.columns if keep is None else keep
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    own = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    source = packed(docs, text, keep)
    for b in range(blocks):
        block = block_of([(r.i, r.t) for r in items.where(own == b).distinct().collect()])
        block = with_prefixes(block, count_shingles(source, block))
        last = b == blocks - 1
        source = _pass(source, block, last)
        if not last:
            source = written(source, "spans")
    ids = F.array_sort(F.array_distinct("_items"))
    found = source.withColumns(
        {
            "n_items": F.size(ids).cast("long"),
            "items_sha256": F.sha2(F.array_join(ids, ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (CONTAMINATED_FROM * F.col("n_hit") >= F.col("n_words")),
        }
    )
    return unpacked(found, keep, RESULTS)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col(f"`{text}`").alias("_t"))
    return scan(whole, benchmark, "_t", keep=["_whole"]).where("not contaminated").select("_whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
iw as (select distinct item, least(len(w), 13) as n, array_to_string(w[s : s + 12], ' ') as win
 from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from i where len(w) > 0)),
dw as (select r, p, n, array_to_string(w[p : p + n - 1], ' ') as win from (
 select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from iw) where len(w) >= n)),
hit as (select r, p, n, item from dw join iw using (n, win)),
words as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from hit)) group by r),
found as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hit group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (r) left join found using (r)"""
