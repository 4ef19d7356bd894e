"""Removal of long repeated byte strings, by suffix arrays over shards.

Every byte that lies in a ``length``-byte string which also starts elsewhere (in
any document, the same one included) is removed; all strings are judged on the
input.  Texts are UTF-8 bytes, a null is empty, matches stay within a document, and
repeated rows are documents of their own.

1. Chunks of documents are written once, compressed, with their anchors: bytes at
   which the hash of ``GRAM`` bytes is least among the windows of ``length`` bytes
   around it.  Alike windows have alike anchors, so a window without an anchor that
   occurs elsewhere is unique.
2. The regions around such anchors go to shards by their least anchor; what would
   exceed a shard under one anchor is salted over several.
3. A shard sorts the suffixes of its regions by external induction and gives
   every ``length``-byte string a class.  Strings whose own anchor occurs in several
   shards also meet over shards, once for each class and shard.
4. Repeated starts return to their chunks, which give one row per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm import suffix_array as S
from loreweave.llm._meet import joined_totals, pack, pack_sorted, rows_of, totals, unpack, unpack_sorted
from loreweave.llm._shared import packed, release, table, unpacked, written

LENGTH = 400
SHARD_BYTES = 3 << 20
BLOCK = 1 << 17
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of every ``width`` consecutive values."""
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(p: B.Piece, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) such that every window of ``length`` bytes of a text has one wholly inside."""
    gram = gram_of(length)
    width = length - gram + 1
    n = len(p.data) - gram + 1
    places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, n if len(p.data) >= length else 0, BLOCK):
        # The windows around a block's bytes need the hashes of width - 1 bytes on either side.
        b = min(a + BLOCK, n)
        lo, hi = max(0, a - width + 1), min(n, b + width - 1)
        values = _hashes(p.data[lo : hi + gram - 1], gram) | np.uint64(1)
        least = _slide(values, width, np.minimum)
        cut = p.bounds[np.searchsorted(p.bounds, lo, "right") : np.searchsorted(p.bounds, hi + gram - 1)]
        least[B.covered(len(least), np.maximum(cut - lo - length + 1, 0), np.minimum(cut - lo, len(least)))] = 0
        pad = np.zeros(width - 1, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
        found = np.flatnonzero(most[a - lo : b - lo] == values[a - lo : b - lo]) + (a - lo)
        places.append(found + lo)
        keys.append(values[found])
    return np.concatenate(places), np.concatenate(keys)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive bytes."""
    p = B.Piece.__new__(B.Piece)
    p.data = data
    p.prefix()
    at = np.arange(len(data) - width + 1)
    return p.span(at, at + width)


def _digests(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes at each of the starts."""
    by = np.argsort(starts)
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK), sorter=by)
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            out[by[a:b]] = _hashes(data[k * BLOCK : (k + 1) * BLOCK + length - 1], length)[starts[by[a:b]] - k * BLOCK]
    return out


def gram_of(length: int) -> int:
    return max(1, length * 16 // 25)


def _chunks(length: int):
    def run(iterator):
        from pyspark import TaskContext

        owner = (TaskContext.get().partitionId() << 32) - 1
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in iterator:
            for rows, p in B.pieces(batch, "_text"):
                owner += 1
                places, keys = anchors(p, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([owner], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, p.n], pa.int32()), rows.column("_row")),
                        pa.array([squeeze.compress(p.raw.tobytes())], pa.binary()),
                        pa.array([pack_sorted(p.bounds.astype(np.uint64))], pa.binary()),
                        pa.array([pack_sorted(places.astype(np.uint64))], pa.binary()),
                        pa.array([keys.tobytes()], pa.binary()),
                        pa.array([len(keys)], pa.int64()),
                    ],
                    ["owner", "rows", "blob", "bounds", "places", "anchors", "n"],
                )

    return run


def _asks(iterator):
    for batch in iterator:
        for owner, keys in zip(batch.column("owner").to_pylist(), batch.column("anchors").to_pylist()):
            keys, n = np.unique(np.frombuffer(keys, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([pack(n)], pa.binary())], ["owner", "keys", "n"])


def _regions(length: int):
    """Ranges around repeated anchors: their bytes, and the repeated anchors inside."""

    def run(iterator):
        gram, squeeze = gram_of(length), zstandard.ZstdDecompressor()
        for batch in iterator:
            for row in rows_of(batch):
                keys = np.frombuffer(row["anchors"], np.uint64)
                distinct = np.unique(keys)
                repeated = joined_totals(row["totals"], "n")[np.searchsorted(distinct, keys)] > 1
                if not repeated.any():
                    continue
                places, keys = unpack_sorted(row["places"]).astype(np.int64)[repeated], keys[repeated]
                bounds = unpack_sorted(row["bounds"]).astype(np.int64)
                doc = np.searchsorted(bounds, places, "right") - 1
                begins = np.maximum(places - (length - gram), bounds[doc])
                ends = np.minimum(places + length, bounds[doc + 1])
                fresh = np.ones(len(places), bool)
                fresh[1:] = (begins[1:] > ends[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(fresh)
                last = np.concatenate([first[1:], [len(places)]])
                text = squeeze.decompress(row["blob"])
                texts = [text[a:b] for a, b in zip(begins[first].tolist(), ends[last - 1].tolist())]
                inner = [(places[a:b] - begins[a]).astype(np.int32).tobytes() for a, b in zip(first, last)]
                own = [keys[a:b].tobytes() for a, b in zip(first, last)]
                hint = np.minimum.reduceat(keys, first).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), row["owner"])), pa.array(begins[first]), pa.array(texts, pa.binary()), pa.array(inner, pa.binary()), pa.array(own, pa.binary()), pa.array(hint), pa.array([len(t) for t in texts], pa.int64())],
                    ["owner", "start", "bytes", "places", "keys", "hint", "size"],
                )

    return run


def _shard_asks(group: pa.Table) -> pa.Table:
    keys = np.unique(np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64))
    return pa.table({"owner": group.column("shard")[:1], "keys": pa.array([pack_sorted(keys)], pa.binary()), "n": pa.array([pack(np.ones(len(keys), np.uint64))], pa.binary())})


def _classed(length: int):
    """Of a shard: repeated starts by chunk, and the strings that other shards may have too."""

    def run(regions: pa.Table, answer: pa.Table) -> pa.Table:
        gram = gram_of(length)
        shard = regions.column("shard")[0].as_py()
        keys = np.frombuffer(b"".join(regions.column("keys").to_pylist()), np.uint64)
        distinct = np.unique(keys)
        wide = joined_totals(answer.column("totals")[0].as_py(), "n") > 1
        texts, owners, starts = regions.column("bytes").to_pylist(), np.asarray(regions.column("owner")), np.asarray(regions.column("start"))
        places, own_keys = regions.column("places").to_pylist(), regions.column("keys").to_pylist()

        # Regions alike to the last byte are sorted once.
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        times = np.bincount(group)
        sizes = np.array([len(t) for t in number], np.int64)
        base = np.cumsum(sizes) - sizes
        whole = np.frombuffer(b"".join(number), np.uint8)
        n = len(whole)
        valid = np.zeros(n, bool)
        least = np.full(n, np.iinfo(np.uint64).max)
        multiple = np.zeros(n, bool)
        done = set()
        for i, g in enumerate(group.tolist()):
            if g in done:
                continue
            done.add(g)
            valid[base[g] : base[g] + sizes[g] - length + 1] = True
            multiple[base[g] : base[g] + sizes[g]] = times[g] > 1
            least[base[g] + np.frombuffer(places[i], np.int32)] = np.frombuffer(own_keys[i], np.uint64)
        with S.Spool() as spool:
            at, kind = S.classes(whole, valid, length, spool)
        many = np.bincount(kind, minlength=1) > 1 if len(kind) else np.zeros(0, bool)
        repeated = np.zeros(n, bool)
        repeated[at[many[kind]]] = True
        repeated |= multiple & valid

        # One string of each class asks the other shards, if they have the anchor chosen for the string itself: its
        # least.  Others inside it may have been chosen for neighbours, and its copies need not have them.
        for a in range(0, n - length + gram if len(at) else 0, BLOCK):  # a block needs nothing to its left
            some = _slide(least[a : a + BLOCK + length - gram], length - gram + 1, np.minimum)
            least[a : a + len(some)] = some
        least = least[at]
        known = np.minimum(np.searchsorted(distinct, least), len(distinct) - 1)
        ask = (distinct[known] == least) & wide[known]
        del least
        at, kind = at[ask], kind[ask]
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
        digest = _digests(whole, at[first], length)
        order = np.argsort(digest)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        member = np.repeat(rank, np.diff(np.concatenate([first, [len(kind)]])))
        kept = ~repeated[at]  # those that are repeated here need no answer
        return pa.table(
            {
                "owner": pa.array([shard], pa.int64()),
                "keys": pa.array([pack_sorted(digest[order])], pa.binary()),
                "n": pa.array([pack(np.ones(len(order), np.uint64))], pa.binary()),
                "n_keys": pa.array([len(order)], pa.int64()),
                "asked": pa.array([pack(at[kept].astype(np.uint64))], pa.binary()),
                "member": pa.array([pack(member[kept].astype(np.uint64))], pa.binary()),
                "repeated": pa.array([np.packbits(repeated).tobytes()], pa.binary()),
                "base": pa.array([pack(base[group].astype(np.uint64))], pa.binary()),
                "sizes": pa.array([pack(sizes[group].astype(np.uint64))], pa.binary()),
                "chunks": pa.array([owners.astype(np.int64).tobytes()], pa.binary()),
                "starts": pa.array([pack(starts.astype(np.uint64))], pa.binary()),
            }
        )

    return run


def _spans(length: int):
    """Removed ranges of each chunk."""

    def run(iterator):
        for batch in iterator:
            for row in rows_of(batch):
                base, sizes, starts = (unpack(row[c]).astype(np.int64) for c in ("base", "sizes", "starts"))
                chunks = np.frombuffer(row["chunks"], np.int64)
                repeated = np.unpackbits(np.frombuffer(row["repeated"], np.uint8)).astype(bool)
                if row["totals"]:
                    elsewhere = joined_totals(row["totals"], "n") > 1
                    repeated[unpack(row["asked"]).astype(np.int64)[elsewhere[unpack(row["member"]).astype(np.int64)]]] = True
                out: dict[int, list] = {}
                for b, size, chunk, start in zip(base.tolist(), sizes.tolist(), chunks.tolist(), starts.tolist()):
                    hit = np.flatnonzero(repeated[b : b + size])
                    if len(hit):
                        cut = np.flatnonzero(np.diff(hit) > length)
                        a, z = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])] + length
                        out.setdefault(chunk, []).append(np.stack([a, z], axis=1) + start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out), pa.int64()), pa.array([np.concatenate(v).astype(np.int64).tobytes() for v in out.values()], pa.binary())], ["owner", "spans"]
                )

    return run


def _cut(with_text: bool):
    """One row per document of a chunk: counts and, if asked for, the text that is left."""

    def run(iterator):
        squeeze = zstandard.ZstdDecompressor()
        for batch in iterator:
            for i in range(batch.num_rows):
                text = squeeze.decompress(batch.column("blob")[i].as_py())
                bounds = unpack_sorted(batch.column("bounds")[i].as_py()).astype(np.int64)
                found = batch.column("spans")[i].as_py() or []
                removed = np.zeros(len(text), bool)
                if found:
                    pairs = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                    removed = B.covered(len(text), pairs[:, 0], pairs[:, 1])
                edge = np.zeros(len(text) + 1, bool)
                edge[bounds] = True
                begins = removed & edge[:-1]
                begins[1:] |= removed[1:] & ~removed[:-1]
                data, kept, gone, runs = np.frombuffer(text, np.uint8), [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    gone.append(np.count_nonzero(removed[a:b]))
                    runs.append(np.count_nonzero(begins[a:b]))
                    kept.append(data[a:b][~removed[a:b]].tobytes() if gone[-1] else text[a:b])
                arrays = [batch.column("rows")[i].values, pa.array(np.diff(bounds)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    left = [k.decode("utf-8", "ignore").encode() if n else k for k, n in zip(kept, gone)]
                    arrays.append(pa.array(left, pa.binary()).view(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["_row", *RESULTS, "_kept"][: len(arrays)])

    return run


def deduplicated(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, with_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Carried columns (all by default), ``n_bytes, n_removed, n_spans, kept_sha256``.

    ``with_text`` gives the remaining text as ``_kept`` (null if it was) and the carried
    columns as ``_row``; bytes that no longer form a character are left out of it.
    A text travels in its chunk: it need not be carried as well.
    """
    if length < 16:
        raise ValueError("strings of fewer than 16 bytes are not supported")
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    source = packed(docs, text, keep)
    if with_text:
        source = source.select(F.struct("_row", F.col("_text").isNull().alias("_null")).alias("_row"), "_text")
    kind = source.schema["_row"].dataType.simpleString()
    chunks = written(source.mapInArrow(_chunks(length), f"owner long, rows array<{kind}>, blob binary, bounds binary, places binary, anchors binary, n long"), "chunks")
    n_anchors = chunks.agg(F.sum("n")).first()[0] or 0

    asks = chunks.select("owner", "anchors").mapInArrow(_asks, "owner long, keys binary, n binary")
    regions = written(
        chunks.select("owner", "blob", "bounds", "places", "anchors").join(totals(asks, ["n"], n_anchors), "owner")
        .mapInArrow(_regions(length), "owner long, start long, bytes binary, places binary, keys binary, hint long, size long"), "regions",
    )
    release(spark)
    sizes = regions.groupBy("hint").agg(F.sum("size").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # At most total / shard_bytes anchors are that heavy: Spark chooses the join by their number.
    heavy = sizes.where(F.col("size") > shard_bytes).select("hint", F.ceil(F.col("size") / shard_bytes).alias("salts"))
    n_shards = int(total // shard_bytes) + 1
    salt = F.pmod(F.xxhash64("owner", "start"), F.coalesce("salts", F.lit(1)))
    sharded = regions.join(heavy, "hint", "left").withColumn("shard", F.pmod(F.xxhash64("hint", salt), F.lit(n_shards))).drop("hint", "salts", "size")

    shard_asks = sharded.select("shard", "keys").groupBy("shard").applyInArrow(_shard_asks, "owner long, keys binary, n binary")
    answers = totals(shard_asks, ["n"], n_anchors).withColumnRenamed("owner", "shard")
    fields = "owner long, keys binary, n binary, n_keys long, asked binary, member binary, repeated binary, base binary, sizes binary, chunks binary, starts binary"
    classed = written(sharded.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards // 4), "shard").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_classed(length), fields), "classed")
    release(spark)
    n_keys = classed.agg(F.sum("n_keys")).first()[0] or 0
    across = totals(classed.select("owner", "keys", "n"), ["n"], n_keys)
    spans = classed.drop("keys", "n", "n_keys").join(across, "owner", "left").mapInArrow(_spans(length), "owner long, spans binary")
    gathered = spans.groupBy("owner").agg(F.collect_list("spans").alias("spans"))  # of one chunk: bounded by its bytes
    results = f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", _kept string" if with_text else "")
    cut = chunks.select("owner", "rows", "blob", "bounds").join(gathered, "owner", "left").mapInArrow(_cut(with_text), results)
    if with_text:
        return cut.select("_row._row", *RESULTS, F.when(~F.col("_row._null"), F.col("_kept")).alias("_kept"))
    return unpacked(cut, keep, RESULTS)


def trimmed(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with what is left of their texts, all columns kept; null texts stay null.

    A column ``n_chars`` is counted anew where bytes were removed.
    """
    found = deduplicated(docs, text, [c for c in docs.columns if c != text], length, with_text=True)
    counted = F.when(F.col("n_removed") == 0, F.col("_row.n_chars")).otherwise(F.length("_kept")) if "n_chars" in docs.columns else None
    kind = dict(docs.dtypes)
    new = lambda c: F.col("_kept") if c == text else counted.cast(kind[c]) if c == "n_chars" else F.col(f"_row.`{c}`")
    return found.select(*[new(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"])
