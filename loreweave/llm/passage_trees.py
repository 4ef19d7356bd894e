"""Removal of repeated passages, by prefix-partitioned suffix trees over words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``window`` consecutive words of
one document.  A word goes if a window that covers it also starts earlier: in a
document with a smaller key, or at an earlier place of the same one.  Windows are
judged on the input.  A null text has no words; a null key counts as the largest;
rows with the same key (or none) do not make each other's windows go, so repeated
rows fare alike.  Words are told apart by 64-bit hashes.

1. Every window has one anchor: the ``gram`` words in it with the least hash (of ties
   the leftmost).  Windows in a row that share an anchor travel together, as the
   suffix from the anchor on and the words left of it; a window whose anchor's words
   occur once in the corpus is unique and stays at home.  Documents come in chunks of
   whole rows, and a chunk sends each distinct run of windows once, with the least key.
2. Suffixes are split by prefixes of variable length: by the hash of the first word
   while such a group fits in memory, else of the first two, and so on up to the whole
   anchor.  Only prefixes that are too frequent are known to all tasks.
3. A task builds the tree of its suffixes: their order and common-prefix lengths, a few
   words at a time, where only suffixes that still agree are read on.  Nodes that are
   ``window - o`` words deep, with ``o`` equal words left of the anchor, are the windows
   that occur more than once.
4. Anchors too frequent for one task at full length send each window by itself: these
   meet by the hash of all their words, as one minimum per hash.
5. Classes return to the chunks, which give one row per document.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm._meet import joined_totals, pack, pack_sorted, rows_of, totals, unpack, unpack_sorted
from loreweave.llm._shared import packed, release, table, unpacked, written

WINDOW = 20
GROUP = 1 << 17  # suffixes in one tree: some 100 bytes each while it is built
SLICE = 4 << 20  # bytes of text that are hashed at once
RESULTS = ["n_words", "n_removed", "kept_sha256"]
NO_KEY = (1 << 63) - 1

SQL = r"""
with d as (select row_number() over () rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
pos as (select rn, doc_id, w, unnest(range(1, len(w) - 18)) s from d where len(w) >= 20),
win as (select rn, doc_id, s, array_to_string(w[s:s + 19], ' ') g from pos),
old as (select rn, s from win qualify doc_id > min(doc_id) over (partition by g) or s > min(s) over (partition by g, rn)),
gone as (select distinct rn, unnest(range(s, s + 20)) i from old),
each as (select rn, doc_id, w, unnest(range(1, len(w) + 1)) i from d),
kept as (select e.rn, string_agg(e.w[e.i], ' ' order by e.i) filter (g.i is null) k, count(g.i) n from each e left join gone g using (rn, i) group by e.rn)
select d.doc_id, len(d.w)::bigint n_words, coalesce(k.n, 0)::bigint n_removed, sha256(coalesce(k.k, '')) kept_sha256
from d left join kept k using (rn)
"""


def gram_of(window: int) -> int:
    return max(1, window * 3 // 5)


def levels(window: int) -> list[int]:
    """Prefix lengths in words."""
    gram = gram_of(window)
    return sorted({min(n, gram) for n in (1, 2, 4, gram)})


class Hashes:
    """Hashes of the words of a piece, and of any run of them."""

    def __init__(self, p: B.Piece):
        words = np.empty(len(p.start), np.uint64)
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(p.end, p.start[at] + SLICE, "right")))
            some = B.Piece.__new__(B.Piece)
            some.data = p.data[p.start[at] : p.end[to - 1]]
            some.prefix()
            words[at:to] = some.span(p.start[at:to] - p.start[at], p.end[at:to] - p.start[at])
            at = to
        self.words = words
        terms = B.powers(B.BASE, len(words))
        terms *= words
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self._inv = B.powers(B.INVERSE, len(words) + 1)

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return B.mix((self._sum[end] - self._sum[start]) * self._inv[start] + (end - start).astype(np.uint64))


def runs(p: B.Piece, h: Hashes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row with one anchor: the first one's start, words up to the anchor, number of windows, the anchor's hash."""
    gram = gram_of(window)
    n = len(h.words) - window + 1
    if n <= 0:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    at = np.arange(len(h.words) - gram + 1)
    values = h.run(at, at + gram)
    least, lead = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - gram + 1):
        other = values[j : j + n]
        lead[other < least] = j
        np.minimum(least, other, out=least)
    start = np.flatnonzero(p.doc[:n] == p.doc[window - 1 :])
    place = start + lead[start]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(place)]]))
    return start[first], lead[start[first]], count, values[place[first]]


def _words(text: bytes, bounds: np.ndarray | None = None) -> B.Piece:
    p = B.Piece.__new__(B.Piece)
    bounds = np.array([0, len(text)]) if bounds is None else bounds
    p.raw = p.data = np.frombuffer(text, np.uint8)
    p.bounds, p.n = bounds, len(bounds) - 1
    p.words(B.NOT_SPACE)
    return p


def _chunks(window: int):
    def run(iterator):
        from pyspark import TaskContext

        owner = (TaskContext.get().partitionId() << 32) - 1
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in iterator:
            for rows, p in B.pieces(batch, "_text"):
                owner += 1
                p.words(B.NOT_SPACE)
                keys, times = np.unique(runs(p, Hashes(p), window)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([owner], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, p.n], pa.int32()), rows.column("_row")),
                        pa.array([np.asarray(rows.column("_key")).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([squeeze.compress(p.raw.tobytes())], pa.binary()),
                        pa.array([pack_sorted(p.bounds.astype(np.uint64))], pa.binary()),
                        pa.array([pack_sorted(keys)], pa.binary()),
                        pa.array([pack(times)], pa.binary()),
                        pa.array([len(keys)], pa.int64()),
                    ],
                    ["owner", "rows", "ids", "blob", "bounds", "keys", "times", "n"],
                )

    return run


def _gather(base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of consecutive ranges, end to end."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(base - (upto - sizes), sizes)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges of ``data``, a space after each."""
    sizes = end - start + 1
    out = data[np.minimum(_gather(start, sizes), len(data) - 1)]
    out[np.cumsum(sizes) - 1] = 0x20
    return out.tobytes()


CANDIDATES = "owner long, first binary, count binary, member binary, least binary, d_lead binary, d_count binary, d_text binary, d_prefix binary, n long"


def _candidates(window: int):
    """Of a chunk: its runs whose anchors occur again, and each distinct one with its words."""

    def run(iterator):
        squeeze, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in iterator:
            for row in rows_of(batch):
                again = joined_totals(row["totals"], "times") > 1
                if not again.any():
                    continue
                p = _words(squeeze.decompress(row["blob"]), unpack_sorted(row["bounds"]).astype(np.int64))
                h = Hashes(p)
                first, lead, count, anchor = runs(p, h, window)
                some = again[np.searchsorted(np.unique(anchor), anchor)]
                first, lead, count = first[some], lead[some], count[some]
                key = np.frombuffer(row["ids"], np.int64)[p.doc[first]]
                kind = B.mix(h.run(first, first + count + window - 1) + (lead * 4096 + count).astype(np.uint64))
                _, at, member = np.unique(kind, return_index=True, return_inverse=True)
                least = np.full(len(at), NO_KEY, np.int64)
                np.minimum.at(least, member, key)
                d_first, d_lead, d_count = first[at], lead[at], count[at]
                text = _slices(p.data, p.start[d_first], p.end[d_first + d_count + window - 2])
                place = d_first + d_lead
                prefix = np.stack([(h.run(place, place + n) >> np.uint64(32)).astype(np.uint32) for n in levels(window)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["owner"]], pa.int64()), *[pa.array([x], pa.binary()) for x in (pack_sorted(first.astype(np.uint64)), pack(count), pack(member), pack(least.view(np.uint64)), pack(d_lead), pack(d_count), press.compress(text), prefix.tobytes())], pa.array([len(at)], pa.int64())],
                    [f.split()[0] for f in CANDIDATES.split(", ")],
                )

    return run


def _sizes(window: int, buckets: int):
    """Suffixes of a chunk by prefix length and bucket."""

    def run(iterator):
        for batch in iterator:
            for prefix in batch.column("d_prefix").to_pylist():
                for level, hashes in enumerate(np.frombuffer(prefix, np.uint32).reshape(len(levels(window)), -1)):
                    used, n = np.unique(hashes % np.uint32(buckets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), level, np.int32)), pa.array(used.astype(np.int64)), pa.array(n.astype(np.int64))], ["level", "bucket", "n"])

    return run


def _parts(prefix: bytes, window: int, buckets: int, heavy: list[np.ndarray]) -> np.ndarray:
    """The group of each suffix: the shortest prefix that isn't too frequent; -1 if all are."""
    hashes = np.frombuffer(prefix, np.uint32).reshape(len(levels(window)), -1) % np.uint32(buckets)
    part = np.full(hashes.shape[1], -1, np.int64)
    for level, own in enumerate(hashes.astype(np.int64)):
        fits = (part < 0) & ~np.isin(own, heavy[level])
        part[fits] = level * buckets + own[fits]
    return part


def _deal(window: int, buckets: int, heavy: list[np.ndarray]):
    """A chunk's distinct suffixes by group."""

    def run(iterator):
        squeeze, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in iterator:
            for row in rows_of(batch):
                part = _parts(row["d_prefix"], window, buckets, heavy)
                lead, count, least = unpack(row["d_lead"]).astype(np.int64), unpack(row["d_count"]).astype(np.int64), unpack(row["least"]).view(np.int64)
                p = _words(squeeze.decompress(row["d_text"]))
                to_word = np.cumsum(count + window - 1)
                start, end, windows = p.start[to_word - (count + window - 1)], p.end[to_word - 1], np.cumsum(count) - count
                order = np.argsort(part, kind="stable")
                used, cut = np.unique(part[order], return_index=True)
                for to, some in zip(used.tolist(), np.split(order, cut[1:]) if len(order) else []):
                    if to < 0:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([to], pa.int64()), pa.array([row["owner"]], pa.int64()), *[pa.array([x], pa.binary()) for x in (pack_sorted(windows[some].astype(np.uint64)), pack(lead[some]), pack(count[some]), pack(least[some].view(np.uint64)), press.compress(_slices(p.data, start[some], end[some])))]],
                        ["part", "owner", "at", "lead", "count", "least", "text"],
                    )

    return run


def suffix_tree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, words each has in common with the one before it) of a table of word numbers.

    A step reads as many words as fit into a key, and only for rows that agree so far.
    """
    n, depth = suffixes.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    if n == 0:
        return order, common
    common[1:] = depth
    bits = max(1, int(suffixes.max()).bit_length())
    step = max(1, 62 // bits)
    at = 0
    while at < depth:
        node = np.cumsum(common < at) if at else np.zeros(n, np.int64)
        live = np.flatnonzero(np.bincount(node, minlength=1)[node] > 1)
        if not len(live):
            break
        width = min(step, depth - at)
        keys = np.zeros(len(live), np.int64)
        for j in range(at, at + width):
            keys = keys << bits | suffixes[order[live], j]
        by = np.lexsort((keys, node[live]))
        order[live] = order[live[by]]
        keys, node = keys[by], node[live]
        within = np.flatnonzero((node[1:] == node[:-1]) & (keys[1:] != keys[:-1]))
        x, y = suffixes[order[live[within]]], suffixes[order[live[within + 1]]]
        common[live[within + 1]] = at + np.cumprod(x[:, at : at + width] == y[:, at : at + width], axis=1).sum(axis=1)
        at += width
    return order, common


def _classes(window: int):
    """Builds the tree of a group; for each window that occurs again its class, twice, and 1 if a smaller key has it."""

    def run(group: pa.Table) -> pa.Table:
        gram = gram_of(window)
        rows = [unpack(x).astype(np.int64) for x in group.column("lead").to_pylist()]
        lead = np.concatenate(rows)
        count = np.concatenate([unpack(x) for x in group.column("count").to_pylist()]).astype(np.int64)
        least = np.concatenate([unpack(x) for x in group.column("least").to_pylist()]).view(np.int64)
        squeeze = zstandard.ZstdDecompressor()
        known, codes = np.unique(np.concatenate([Hashes(_words(squeeze.decompress(x))).words for x in group.column("text").to_pylist()]), return_inverse=True)
        codes = (codes + 1).astype(np.int32)
        sizes = count + window - 1
        base, windows = np.cumsum(sizes) - sizes, np.cumsum(count) - count

        def words(offset: int, inside: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lead), np.int32)
            out[inside] = codes[(base + lead + offset)[inside]]
            return out

        right = np.stack([words(j, lead + j < sizes) for j in range(window)], axis=1)
        order, common = suffix_tree(right)
        answers = np.zeros(int(count.sum()), np.uint64)
        # Leaves below nodes as deep as the anchor; all other windows are unique.
        node = np.cumsum(common < gram)
        leaves = order[np.bincount(node, minlength=1)[node] > 1]
        rank = np.empty(len(order), np.int64)
        left, n_left = np.zeros(len(lead), np.int64), 1
        n_classes = 0
        for o in range(window - gram + 1):
            if o:
                _, left[leaves] = np.unique(left[leaves] * (len(known) + 1) + words(-o, lead >= o)[leaves], return_inverse=True)
                n_left = len(leaves) + 1
            have = leaves[(lead[leaves] >= o) & (lead[leaves] - count[leaves] < o)]
            if not len(have):
                continue
            rank[order] = np.cumsum(common < window - o)
            _, kind, times = np.unique(rank[have] * n_left + left[have], return_inverse=True, return_counts=True)
            low = np.full(len(times), NO_KEY, np.int64)
            np.minimum.at(low, kind, least[have])
            many = times[kind] > 1
            value = (n_classes + kind + 1) * 2 + (low[kind] < least[have])
            answers[(windows + lead - o)[have[many]]] = value[many]
            n_classes += len(times)
        out, to = [], np.cumsum([len(r) for r in rows])
        for at, a, z in zip(group.column("at").to_pylist(), to - [len(r) for r in rows], to):
            flat = _gather(unpack_sorted(at).astype(np.int64), count[a:z])
            value = answers[_gather(windows[a:z], count[a:z])]
            out.append((pack_sorted(flat[value > 0].astype(np.uint64)), pack(value[value > 0])))
        return pa.table({"owner": group.column("owner"), "part": group.column("part"), "windows": pa.array([a for a, _ in out], pa.binary()), "answers": pa.array([z for _, z in out], pa.binary())})

    return run


def _single(window: int, buckets: int, heavy: list[np.ndarray]):
    """The windows under anchors that are too frequent for one tree: a row for each, by the hash of its words."""

    def run(iterator):
        squeeze = zstandard.ZstdDecompressor()
        for batch in iterator:
            for row in rows_of(batch):
                some = np.flatnonzero(_parts(row["d_prefix"], window, buckets, heavy) < 0)
                count, least = unpack(row["d_count"]).astype(np.int64), unpack(row["least"]).view(np.int64)
                words = Hashes(_words(squeeze.decompress(row["d_text"]))).words
                sizes = count + window - 1
                start = _gather((np.cumsum(sizes) - sizes)[some], count[some])
                hashes = np.zeros(len(start), np.uint64)
                for j in range(window):
                    hashes = hashes * B.BASE + words[start + j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), row["owner"], np.int64)), pa.array(_gather((np.cumsum(count) - count)[some], count[some])), pa.array((B.mix(hashes) >> np.uint64(2)).astype(np.int64)), pa.array(np.repeat(least[some], count[some]))],
                    ["owner", "window", "kind", "least"],
                )

    return run


def _packed_single(group: pa.Table) -> pa.Table:
    at = np.asarray(group.column("window")).astype(np.uint64)
    order = np.argsort(at)
    value = (np.asarray(group.column("kind")) * 2 + np.asarray(group.column("lower")).astype(np.int64)).astype(np.uint64)
    return pa.table({"owner": group.column("owner")[:1], "part": pa.array([-1], pa.int64()), "windows": pa.array([pack_sorted(at[order])], pa.binary()), "answers": pa.array([pack(value[order])], pa.binary())})


def removed_words(row: dict, p: B.Piece, window: int) -> np.ndarray:
    """Which words of a chunk go."""
    if row["member"] is None:
        return np.zeros(len(p.start), bool)
    first, count, member = unpack_sorted(row["first"]).astype(np.int64), unpack(row["count"]).astype(np.int64), unpack(row["member"]).astype(np.int64)
    least, d_count = unpack(row["least"]).view(np.int64), unpack(row["d_count"]).astype(np.int64)
    base = np.cumsum(d_count) - d_count
    total = int(d_count.sum())
    kind, space, lower = np.arange(total), np.full(total, -2, np.int64), np.zeros(total, bool)
    for x in row["found"] or []:
        at, value = unpack_sorted(x["windows"]).astype(np.int64), unpack(x["answers"])
        kind[at], space[at], lower[at] = (value >> np.uint64(1)).astype(np.int64), x["part"], (value & np.uint64(1)).astype(bool)
    which, start = _gather(base[member], count), _gather(first, count)
    doc = p.doc[start]
    key = np.frombuffer(row["ids"], np.int64)[doc]
    gone = lower[which] | (key > np.repeat(least[member], count))
    order = np.lexsort((kind[which], space[which], doc))  # places stay in order
    k, s, d = kind[which][order], space[which][order], doc[order]
    gone[order[1:]] |= (k[1:] == k[:-1]) & (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    return B.covered(len(p.start), start[gone], start[gone] + window)


def _cut(window: int, with_text: bool):
    """One row per document of a chunk."""

    def run(iterator):
        squeeze = zstandard.ZstdDecompressor()
        for batch in iterator:
            for i in range(batch.num_rows):
                row = batch.drop_columns(["rows"]).slice(i, 1).to_pylist()[0]
                text = squeeze.decompress(row["blob"])
                p = _words(text, unpack_sorted(row["bounds"]).astype(np.int64))
                gone = removed_words(row, p, window)
                n_removed, kept = p.sums(gone, p.first), []
                for j, (a, z) in enumerate(zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist())):
                    words = text[a:z].split()
                    kept.append(b" ".join(words if not n_removed[j] else compress(words, (~gone[p.first[j] : p.first[j + 1]]).tolist())))
                arrays = [batch.column("rows")[i].values, pa.array(np.diff(p.first)), pa.array(n_removed.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    arrays.append(pa.array([k.decode() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["_row", *RESULTS, "_kept"][: len(arrays)])

    return run


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, window: int = WINDOW, with_text: bool = False, group: int = GROUP) -> DataFrame:
    """Carried columns (all by default), ``n_words, n_removed, kept_sha256``; ``with_text`` adds ``_kept``, the words left, joined by a space.

    ``key`` is an integer column.  ``group`` is the number of suffixes that a tree holds
    at most; the prefixes known to all tasks are as many as such groups at most.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    source = packed(docs, text, list(dict.fromkeys([*keep, key])))
    source = source.withColumn("_key", F.coalesce(F.col(f"_row.`{key}`").cast("long"), F.lit(NO_KEY)))
    kind = source.schema["_row"].dataType.simpleString()
    chunks = written(
        source.mapInArrow(_chunks(window), f"owner long, rows array<{kind}>, ids binary, blob binary, bounds binary, keys binary, times binary, n long"), "chunks"
    )
    n_anchors = chunks.agg(F.sum("n")).first()[0] or 0
    repeated = chunks.select("owner", "ids", "blob", "bounds").join(totals(chunks.select("owner", "keys", "times"), ["times"], n_anchors), "owner")
    candidates = written(repeated.mapInArrow(_candidates(window), CANDIDATES), "candidates")
    release(spark)

    total = candidates.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, 2 * total // group + 1)
    limit = min(group, max(64, 2 * total // buckets))
    sizes = candidates.select("d_prefix").mapInArrow(_sizes(window, buckets), "level int, bucket long, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n"))
    heavy: list = [[] for _ in levels(window)]
    for level, bucket in sizes.where(F.col("n") > F.when(F.col("level") < len(heavy) - 1, limit).otherwise(group)).select("level", "bucket").collect():  # total / limit of a level at most
        heavy[level].append(bucket)
    heavy = [np.array(sorted(x), np.int64) for x in heavy]

    dealt = candidates.select("owner", "least", "d_lead", "d_count", "d_text", "d_prefix").mapInArrow(
        _deal(window, buckets, heavy), "part long, owner long, at binary, lead binary, count binary, least binary, text binary"
    )
    fields = "owner long, part long, windows binary, answers binary"
    found = dealt.repartition(max(partitions, total // group + 1), "part").groupBy("part").applyInArrow(_classes(window), fields)
    if len(heavy[-1]):
        single = written(candidates.select("owner", "least", "d_count", "d_text", "d_prefix").mapInArrow(_single(window, buckets, heavy), "owner long, window long, kind long, least long"), "single")
        low = single.groupBy("kind").agg(F.min("least").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
        answered = single.join(low, "kind").select("owner", "window", "kind", (F.col("low") < F.col("least")).alias("lower"))
        found = found.unionAll(answered.groupBy("owner").applyInArrow(_packed_single, fields))
    found = written(found, "found")
    release(spark)
    gathered = found.groupBy("owner").agg(F.collect_list(F.struct("part", "windows", "answers")).alias("found"))  # of one chunk: bounded by its words
    results = f"_row {kind}, n_words long, n_removed long, kept_sha256 string" + (", _kept string" if with_text else "")
    cut = (
        chunks.select("owner", "rows", "ids", "blob", "bounds")
        .join(candidates.select("owner", "first", "count", "member", "least", "d_count"), "owner", "left")
        .join(gathered, "owner", "left")
        .mapInArrow(_cut(window, with_text), results)
    )
    return cut if with_text else unpacked(cut, keep, RESULTS)


def trimmed(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The documents with the words that are left, all columns kept; a text that loses none stays as it is."""
    found = deduplicated(docs, text, key, docs.columns, window, with_text=True)
    left = F.when(F.col("n_removed") == 0, F.col(f"_row.`{text}`")).otherwise(F.col("_kept"))
    return found.select(*[(left if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"])
