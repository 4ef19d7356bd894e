"""SimHash near-duplicates, found through Golay-code keys.

Fingerprint: words are runs of non-space bytes after lower-casing A-Z; shingles
are four words joined by one space, repeats included (a shorter text is one
shingle; a text without words, or null, has fingerprint zero).  A bit is set if it
is set in over half of the shingles' XXH64 values (seed 42).

Keys: the 64 bits are cut into segments a, b (23 bits) and c (18 bits, padded).
Every 23-bit word has one Golay codeword within 3 bits; a word at 3 bits has five
more at 4 bits.  ``near(x)`` are these 1 or 6 codewords, and any two words that
differ in 2 bits at most share one.  Four errors over three segments leave
  * no segment above 2: a common pair of near(a) and near(b), or
  * one segment with 3 or 4, so of the others one is free of errors and the other
    has one at most: a, b or c itself with near() of c, a or b.
All fingerprints that share a key are compared and those within ``MAX_BITS`` are
joined; of a group only a spanning forest leaves the task.  Fingerprints meet
once however many texts have them, and keys are dealt to tasks as packed blocks.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loreweave.llm import _bytes as B
from loreweave.llm._components import components
from loreweave.llm._shared import packed, release, table, unpacked, written
from loreweave.operators import skew

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCK_BYTES = 48 << 20  # of packed keys in a task
KEYS = 60               # at most so many keys for a fingerprint on average
HOT_ROWS = 2048         # of a fingerprint or component, which are then dealt over tasks
GOLAY = 0xAE3           # generator x^11+x^9+x^7+x^6+x^5+x+1


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(SHINGLE, len(words))
    joined = b" ".join(words)
    shingles = [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[at : at + (1 << 16)], repeat(SEED)))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _fingerprints(iterator):
    for batch in iterator:
        for rows, p in B.pieces(batch, "_text"):
            values = np.array([fingerprint(t) for t in B.texts_of(p)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("_row"), pa.array(values)], ["_row", "_fp"])


def fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``_row`` (carried columns) and ``_fp``."""
    source = packed(docs, text, keep)
    return source.mapInArrow(_fingerprints, f"_row {source.schema['_row'].dataType.simpleString()}, _fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of bytes by position, and up to six error patterns by syndrome (the first repeated)."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    bits = [syndrome(1 << i) for i in range(23)]
    parts = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and byte * 8 + i < 23:
                    parts[byte, v] ^= bits[byte * 8 + i]
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= bits[i]
            if weight < 4 or len(found[s]) and bin(found[s][0]).count("1") == 3:
                found.setdefault(s, []).append(sum(1 << i for i in places))
    errors = np.array([(found[s] * 6)[:6] if len(found[s]) == 1 else found[s] for s in range(2048)], np.int64)
    return parts, errors


def near(x: np.ndarray, tables) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word: six columns, repeats where there is one only."""
    parts, errors = tables
    s = parts[0, x & 255] ^ parts[1, (x >> 8) & 255] ^ parts[2, x >> 16]
    return (x[:, None] ^ errors[s]) >> 11


def keys_of(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, fingerprint) pairs."""
    u = fps.view(np.uint64)
    a, b, c = (u >> np.uint64(41)).astype(np.int64), ((u >> np.uint64(18)) & np.uint64(0x7FFFFF)).astype(np.int64), (u & np.uint64(0x3FFFF)).astype(np.int64)
    na, nb, nc = near(a, tables), near(b, tables), near(c, tables)
    columns = [(na[:, :, None] << 12 | nb[:, None, :]).reshape(len(u), -1)]
    columns += [exact[:, None] << 12 | fuzzy for exact, fuzzy in ((a, nc), (b, nc), (c, na), (c, nb))]
    keys = np.concatenate([(np.int64(tag) << 40) | k for tag, k in enumerate(columns)], axis=1)
    order = np.sort(keys, axis=1)
    fresh = np.ones(order.shape, bool)
    fresh[:, 1:] = order[:, 1:] != order[:, :-1]
    return order[fresh], np.repeat(fps, fresh.sum(axis=1))


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest of its group) that join all within ``max_bits`` sharing a key."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps = keys[fresh], fps[fresh]
    nodes, node = np.unique(fps, return_inverse=True)
    label = np.arange(len(nodes))
    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        x, y = node[at], node[at + step]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        close = np.bitwise_count((nodes[x] ^ nodes[y]).view(np.uint64)) <= max_bits
        x, y = x[close], y[close]
        while len(x):
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while (label != label[label]).any():
                label = label[label]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
        if step & (step - 1) == 0 and len(at):  # groups that hang together need no more comparisons
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            own = label[node]
            whole = np.minimum.reduceat(own, begins) == np.maximum.reduceat(own, begins)
            whole = np.repeat(whole, np.diff(np.concatenate([begins, [len(keys)]])))
            at = at[~whole[at]]
        step += 1
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``u, v`` that join the distinct values of ``_fp`` within ``max_bits``."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys hold for 0 to {MAX_BITS} bits")
    spark = found.sparkSession
    distinct = found.where("_fp is not null").select("_fp").distinct()
    n = distinct.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * KEYS * 16 // BLOCK_BYTES + 1)

    def deal(iterator):
        tables = golay_tables()
        for batch in iterator:
            keys, fps = keys_of(np.asarray(batch.column(0)).astype(np.int64), tables)
            to = (B.mix(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            used, first = np.unique(to[order], return_index=True)
            split = lambda v: [x.tobytes() for x in np.split(v[order], first[1:])] if len(v) else []
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(split(keys), pa.binary()), pa.array(split(fps), pa.binary())], ["part", "keys", "fps"])

    def join(group: pa.Table) -> pa.Table:
        read = lambda c: np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64)
        u, v = forest(read("keys"), read("fps"), max_bits)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    dealt = distinct.mapInArrow(deal, "part int, keys binary, fps binary")
    return dealt.groupBy("part").applyInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """Carried columns (all by default), ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest ``key`` among the documents reachable through
    links, repeated rows included; rows with a null key are linked like any other
    and take the smallest key that is not null, if there is one.
    """
    keep = docs.columns if keep is None else keep
    carried = list(dict.fromkeys([*keep, key]))
    found = written(fingerprints(docs, text, carried), "fingerprints")
    return unpacked(grouped(found, key, max_bits).withColumnRenamed("_component", "component_id").withColumn("fingerprint", F.lpad(F.lower(F.hex("_fp")), 16, "0")), keep, ["fingerprint", "component_id"])


def grouped(found: DataFrame, key: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds ``_component`` to a written table of ``_row`` and ``_fp``."""
    counted = found.groupBy("_fp").agg(F.min(F.col(f"_row.`{key}`")).alias("_least"), F.count("*").alias("_n"))
    least = _of_roots(counted, components(links(found, max_bits)), F.min("_least").alias("_component"))
    return _spread(found, least, counted, "_fp", ["_row"], found.count())


def _of_roots(counted: DataFrame, roots: DataFrame, value: Column) -> DataFrame:
    """``_fp`` with an aggregate over the distinct fingerprints of its component."""
    rooted = written(counted.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp")).drop("root", "_n"), "rooted")
    sizes = rooted.groupBy("_root").agg(value, F.count("*").alias("_n"))
    return _spread(rooted.select("_fp", "_root"), sizes.drop("_n"), sizes, "_root", ["_fp"], counted.count()).drop("_root")


def _spread(rows: DataFrame, values: DataFrame, counted: DataFrame, on: str, by: list[str], n: int) -> DataFrame:
    """``rows`` with the ``values`` of their key; keys with many of the ``n`` rows are dealt over tasks."""
    heavy = skew.heavy_keys(counted, [on], "_n", max(HOT_ROWS, n >> 20))  # 2^20 keys at most
    return skew.lookup(rows, values, [on], heavy, by)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One document of every component: the one with the smallest key (nulls last; of rows alike, any one)."""
    numbered = written(fingerprints(docs, text, docs.columns).withColumn("_no", F.monotonically_increasing_id()), "numbered")
    release(docs.sparkSession)
    order = F.struct(F.col(f"_row.`{key}`").isNull().alias("no_key"), F.col(f"_row.`{key}`").alias("key"), F.col("_no").alias("no"))
    firsts = numbered.groupBy("_fp").agg(F.min(order).alias("_first"))  # of texts alike, then of their component
    roots = components(links(numbered.select("_fp"), max_bits))
    rooted = firsts.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp"))
    chosen = rooted.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first.no").alias("_no"))
    return numbered.join(chosen, "_no", "left_semi").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
