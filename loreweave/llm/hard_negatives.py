"""Hard negatives by anchor clusters with shared candidate lists.

Vectors are taken as ``floor(scale * x)``, x as double; a score is the integer inner
product with an anchor, and higher scores come first, of ties smaller ids.  An
anchor's positives are the best rows of its label with another id; for each, the best
rows of other labels are taken whose scores lie within ``low`` and ``high`` hundredths
of the positive's.  Rows without a label or vector, or with a component that is null
or not finite, take no part; missing components at a vector's end count as zero; scaled
components beyond 2^24 count as that.  A row without an id is nobody's anchor and comes
last in ties.  Every anchor row gives its own results, rows alike all count.

Anchors are clustered by direction (centroids from a bounded sample) and written in
blocks of ``BLOCK`` anchors of the same or neighbouring clusters; a block is what tasks
are sent at once.  Each pass over all rows, in parts of ``ITEMS``, gives every
cluster one list: the rows by descending bound ``|x| cos(max(0, angle(x, centroid) -
radius))``, which no member's score exceeds, taken with the member's norm.  Members
walk the list together; one leaves it once the bound on the rest is below the last of
its best scores, or below its window, so what it has is exact.  A task keeps the best
of each member over its parts, and the best of all tasks are ranked.  The first pass finds
positives, the second negatives, since a positive's score sets the window.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loreweave.llm._shared import shared_dir, table, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
BLOCK = 1 << 14        # anchors sent to tasks at once: 64 numbers of 4 bytes each make 4 MB
ITEMS = 1 << 15        # rows in one list
STEP = 512             # rows that members score at once
SAMPLE = 4096          # anchors from which the centroids are learned
CLUSTER = 32           # anchors in a cluster, about
CLUSTERS = 64          # centroids at most
CLIP = 1 << 24
NO_ID = (1 << 63) - 1

SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id aid, n.vec_id nid, a.l = n.l alike, list_dot_product(a.v, n.v)::bigint score
  from r a join r n on a.vec_id % 100 = 0 and n.vec_id <> a.vec_id),
p as (select aid, nid, score from s where alike qualify row_number() over (partition by aid order by score desc, nid) <= 5)
select p.aid anchor_id, p.nid positive_id, row_number() over (partition by p.aid, p.nid order by s.score desc, s.nid)::int rank, s.nid negative_id,
  p.score positive_score, s.score negative_score
from p join s on s.aid = p.aid and not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify row_number() over (partition by p.aid, p.nid order by s.score desc, s.nid) <= 10
"""


def matrix(column: pa.ListArray, scale: float, width: int | None = None) -> np.ndarray:
    """Scaled integer components, as doubles; padded or cut to ``width`` (the longest, if none is given)."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    own = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), own))
    out[np.arange(own) < sizes[:, None]] = np.clip(np.floor(flat * scale), -CLIP, CLIP)
    if width is None:
        return out
    return out[:, :width] if own >= width else np.pad(out, ((0, 0), (0, width - own)))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms; a zero vector's direction is zero."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(norm, 1e-300)[:, None], norm


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Directions of k clusters, by k-means over directions from seeds far apart."""
    x, _ = unit(sample)
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    rng, chosen = np.random.default_rng(0), [0]
    far = 1 - x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        weight = np.maximum(far, 0) ** 2
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())) if weight.sum() > 0 else 0)
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    at = x[sorted(set(chosen))]
    for _ in range(12):
        own = np.argmax(x @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        new, norm = unit(sums)
        at = np.where(norm[:, None] > 0, new, at)
    return at


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The ``k`` best (score, id) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = np.zeros(0, np.int64)
        self.score, self.id = self.slot, self.slot
        self.last_score = np.full(slots, -(1 << 62), np.int64)  # of a full slot, its last
        self.last_id = np.full(slots, NO_ID, np.int64)

    def better(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (a row for each slot, a column for each id) would enter."""
        last = self.last_score[slots][:, None]
        return (score > last) | (score == last) & (ids < self.last_id[slots][:, None])

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.zeros(len(self.last_score), bool)
        touched[slot] = True
        old = touched[self.slot]
        slot, score, ids = (np.concatenate([a[old], b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate([first, [len(slot)]])))
        full = place == self.k - 1
        self.last_score[slot[full]], self.last_id[slot[full]] = score[full], ids[full]
        top = place < self.k
        self.slot, self.score, self.id = (np.concatenate([a[~old], b[top]]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))


def clusters(anchors: dict) -> list[dict]:
    """Members, direction and radius of each cluster in a block."""
    out = []
    direction, norm = unit(anchors["vectors"].astype(np.float64))
    for c in np.unique(anchors["cluster"]).tolist():
        members = np.flatnonzero(anchors["cluster"] == c)
        centre, size = unit(direction[members].sum(axis=0, keepdims=True))
        centre = centre[0] if size[0] > 0 else direction[members[0]]
        away = angle(direction[members] @ centre)
        radius = np.pi if (norm[members] == 0).all() else away[norm[members] > 0].max()
        out.append({"members": members, "centre": centre, "radius": float(radius), "norm": norm[members]})
    return out


def walk(anchors: dict, group: dict, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, best: Best, window: dict | None) -> int:
    """Members of a cluster go down its list of these rows; returns the number of scores computed.

    Without ``window``, slots are anchors and rows of their label enter; with it (``positive``
    scores by anchor, one slot for each), rows of other labels within the limits.
    """
    direction, norm = unit(x)
    bound = norm * np.cos(np.maximum(0, angle(direction @ group["centre"]) - group["radius"]))
    bound = np.where(norm > 0, bound, 0) + 1e-9 * norm + 1e-9
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    live, done = np.arange(len(group["members"])), 0
    for at in range(0, len(order), STEP):
        members = group["members"][live]
        reach = (group["norm"][live] * (1 + 1e-9) + 1e-9) * np.maximum(bound[at], 0) if bound[at] >= 0 else np.zeros(len(live))
        if window is None:
            stay = reach >= best.last_score[members]
        else:
            positive = window["positive"][members]
            n = positive.shape[1]
            slots = members[:, None] * n + np.arange(n)
            stay = (window["known"][members] & (reach[:, None] >= best.last_score[slots]) & (100 * reach[:, None] >= window["low"] * positive)).any(axis=1)
        live, members = live[stay], members[stay]
        if not len(live):
            break
        some = order[at : at + STEP]
        score = scores(anchors["vectors"][members].astype(np.float64), x[some])
        done += score.size
        same = labels[some][None, :] == anchors["label"][members][:, None]
        if window is None:
            i, j = np.nonzero(same & (ids[some][None, :] != anchors["id"][members][:, None]) & best.better(members, score, ids[some]))
            best.add(members[i], score[i, j], ids[some][j])
            continue
        positive = window["positive"][members]
        found = []
        for p in range(positive.shape[1]):
            slots, limit = members * positive.shape[1] + p, positive[:, p][:, None]
            fits = window["known"][members][:, p][:, None] & ~same & (window["low"] * limit <= 100 * score) & (100 * score <= window["high"] * limit)
            i, j = np.nonzero(fits & best.better(slots, score, ids[some]))
            found.append((slots[i], score[i, j], ids[some][j]))
        best.add(*(np.concatenate(v) for v in zip(*found)))
    return done


def _passed(block, k: int, window, scale: float):
    """The best of each slot over the rows of a task."""

    def run(iterator):
        anchors = block.value
        limits = window.value if window else None
        groups = clusters(anchors)
        best = Best(limits["positive"].size if limits else len(anchors["id"]), k)

        def part(batches):
            rows = pa.Table.from_batches(batches).combine_chunks()
            x = matrix(rows.column("vector").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64())), scale, anchors["vectors"].shape[1])
            ids, labels = np.asarray(rows.column("id")).astype(np.int64), np.asarray(rows.column("label")).astype(np.int64)
            for group in groups:
                walk(anchors, group, x, ids, labels, best, limits)

        held, n = [], 0
        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ITEMS:
                part(held)
                held, n = [], 0
        if held:
            part(held)
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], ["slot", "score", "id"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks: ``slot, score, id, rank``."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(size: int, scale: float):
    """Anchors of a partition sorted by cluster, in packed blocks."""

    def run(iterator):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def out(tables):
            nonlocal number
            rows = pa.Table.from_batches(tables).combine_chunks()
            for a in range(0, rows.num_rows, size):
                some = rows.slice(a, size)
                vectors = matrix(some.column("vector").combine_chunks(), scale).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([some.num_rows], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in (np.asarray(some.column("id")).astype(np.int64), np.asarray(some.column("label")).astype(np.int64), np.asarray(some.column("cluster")).astype(np.int32), vectors)]],
                    ["block", "n", "id", "label", "cluster", "vectors"],
                )
                number += 1

        for batch in iterator:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return run


def _assigned(at: np.ndarray, scale: float):
    def run(iterator):
        for batch in iterator:
            x, _ = unit(matrix(batch.column("vector"), scale, at.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.argmax(x @ at.T, axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32))], [*batch.schema.names, "cluster"])

    return run


def _together(blocks: list[tuple[int, int]], size: int) -> list[list[int]]:
    """Small blocks in a row that make up one of ``size`` anchors at most."""
    out, total = [], size
    for number, n in blocks:
        if total + n > size:
            out.append([])
            total = 0
        out[-1].append(number)
        total += n
    return out


def _read(rows: list) -> dict:
    """The anchors of packed blocks."""
    vectors = [np.frombuffer(r["vectors"], np.int32).reshape(r["n"], -1) for r in rows]
    width = max(v.shape[1] for v in vectors)
    kinds = {"id": np.int64, "label": np.int64, "cluster": np.int32}
    return {k: np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in kinds.items()} | {"vectors": np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])}


def mine(
    rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``rows``.  Pairs without any negative have no rows.
    """
    spark = rows.sparkSession
    finite = F.forall(F.col(f"`{vector}`"), lambda x: F.coalesce(x.isNotNull() & (F.abs(x) < float("inf")), F.lit(False)))  # NaN is the largest of all
    source = rows.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & finite)
    items = source.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(f"`{label}`").cast("string")).alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    own = items.where("is_anchor").drop("is_anchor").where(F.col("id") != NO_ID)
    # Small partitions are read together: each task gives its own best for every anchor.
    items = items.drop("is_anchor").coalesce(max(spark.sparkContext.defaultParallelism, source.count() // ITEMS + 1))

    sample = own.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).toArrow()
    vectors = matrix(sample.column("vector").combine_chunks(), scale) if sample.num_rows else np.zeros((0, 1))
    at = centroids(vectors, max(1, min(CLUSTERS, len(vectors) // CLUSTER)))
    assigned = own.mapInArrow(_assigned(at, scale), "id long, label long, vector array<double>, cluster int")
    packed = written(assigned.repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id").mapInArrow(_blocks(block, scale), "block long, n long, id binary, label binary, cluster binary, vectors binary"), "anchors")

    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = f"{shared_dir(spark)}/loreweave-{uuid.uuid4().hex}/hard-negatives"
    spark.createDataFrame([], result).write.parquet(path)
    for numbers in _together(packed.select("block", "n").orderBy("block").collect(), block):  # two numbers for each block
        a = _read(packed.where(F.col("block").isin(numbers)).orderBy("block").collect())
        sent = spark.sparkContext.broadcast(a)
        fields = "slot long, score long, id long"
        found = _ranked(items.mapInArrow(_passed(sent, positives, None, scale), fields), positives).toArrow()  # ``positives`` of each anchor that is sent
        slot, rank = np.asarray(found.column("slot")), np.asarray(found.column("rank")) - 1
        positive, ids, known = (np.zeros((len(a["id"]), positives), t) for t in (np.int64, np.int64, bool))
        positive[slot, rank], ids[slot, rank], known[slot, rank] = np.asarray(found.column("score")), np.asarray(found.column("id")), True
        limits = spark.sparkContext.broadcast({"positive": positive, "known": known, "low": low, "high": high})
        ranked = _ranked(items.mapInArrow(_passed(sent, negatives, limits, scale), fields), negatives)
        named = spark.createDataFrame(pa.table({"slot": np.arange(positive.size), "anchor_id": np.repeat(a["id"], positives), "positive_id": ids.ravel(), "positive_score": positive.ravel()}))
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        ranked.join(F.broadcast(named), "slot").select(  # ``positives`` rows for each anchor that is sent
            "anchor_id", real("positive_id").alias("positive_id"), "rank", real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
        sent.unpersist()
        limits.unpersist()
    return spark.read.schema(result).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)
