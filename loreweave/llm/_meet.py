"""Totals of 64-bit keys over many owners, exchanged as packed blocks.

An owner (a chunk of the corpus, a shard) asks once for each of its distinct keys
and gets one total per key back.  What is shuffled is the sorted keys, cut by
ranges into parts, and the totals; a key costs an owner one entry however often
it has it, so no key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

PART_BYTES = 48 << 20


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers at the least width that holds them: the width, then their bytes by significance, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and differences."""
    return np.uint64(keys[0]).tobytes() + pack(np.diff(keys)) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), unpack(data[8:])]), dtype=np.uint64)


def totals(asks: DataFrame, counts: list[str], n_keys: int, bits: int = 64, mark_new: bool = False) -> DataFrame:
    """``owner, totals``: for each of ``counts`` (packed, by key), the packed sums over all owners by key.

    ``bits`` is the width of the keys, which are evenly spread.  ``mark_new`` adds
    ``_new``: for each key, a mark at one owner that has it.

    ``asks`` has ``owner`` (unique, long), ``keys`` (``pack_sorted``, distinct) and
    the ``counts`` columns.  ``n_keys`` is the number of entries, or more.
    """
    parts = max(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_keys * 8 * (2 + len(counts)) // PART_BYTES + 1)
    width = (1 << bits) // parts + 1
    ends = np.array([min((i + 1) * width, (1 << bits) - 1) for i in range(parts)], np.uint64)

    def deal(iterator):
        for batch in iterator:
            for row in rows_of(batch):
                owner, keys, own = row["owner"], unpack_sorted(row["keys"]), [row[c] for c in counts]
                cut = np.searchsorted(keys, ends, "left")
                cut[-1] = len(keys)
                own = [unpack(x) for x in own]
                before = np.concatenate([[0], cut[:-1]])
                rows = [(i, a, b) for i, (a, b) in enumerate(zip(before.tolist(), cut.tolist())) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in rows], pa.int32()), pa.array([owner] * len(rows), pa.int64()), pa.array([pack_sorted(keys[a:b]) for _, a, b in rows], pa.binary()),
                     *[pa.array([pack(x[a:b]) for _, a, b in rows], pa.binary()) for x in own]],
                    ["part", "owner", "keys", *counts],
                )

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k) for k in group.column("keys").to_pylist()]
        whole, seen, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        new = np.zeros(len(place), np.uint64)
        new[seen] = 1
        sums = [np.bincount(place, weights=np.concatenate([unpack(x) for x in group.column(c).to_pylist()]).astype(float), minlength=len(whole)).astype(np.uint64) for c in counts]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = [[pack(s[at]) for at in np.split(place, cuts)] for s in sums] + [[pack(x) for x in np.split(new, cuts)]] * mark_new
        return pa.table([group.column("owner"), group.column("part"), *[pa.array(a, pa.binary()) for a in answers]], names=["owner", "part", *out])

    out = [f"_{c}" for c in [*counts, *["new"] * mark_new]]
    fields = ", ".join(f"{c} binary" for c in counts)
    dealt = asks.select("owner", "keys", *counts).mapInArrow(deal, f"part int, owner long, keys binary, {fields}")
    answered = dealt.groupBy("part").applyInArrow(add, "owner long, part int, " + ", ".join(f"{c} binary" for c in out))
    return answered.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("part", *out))).alias("totals"))


def rows_of(batch: pa.RecordBatch):
    """Rows as dictionaries, one at a time: packed blocks are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def joined_totals(parts: list[dict], count: str) -> np.ndarray:
    """The totals of one owner in the order of its keys."""
    return np.concatenate([np.zeros(0, np.uint64), *[unpack(p[f"_{count}"]) for p in parts]])
