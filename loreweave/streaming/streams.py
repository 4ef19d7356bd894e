"""Streams over files of events: throttle, job status and thread turns.

``replayed`` lets a table arrive in parts, restarting the stream for each, as tests and
queries do.
"""

from __future__ import annotations

import sys
import uuid
from typing import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from loreweave.functions.constants import THROTTLE_SECONDS
from loreweave.operators.history import PAGE
from loreweave.session import materialise, shared_dir
from loreweave.sources.merge import BucketTable, latest

PARTS = 4  # in which a replayed table arrives
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Gate(StatefulProcessor):
    """Holds actions until the watermark has passed them, then lets them in by time.

    State of a key: the time from which actions are let in again, and the actions
    that wait.  Both go once the watermark is beyond them.
    """

    def __init__(self, gap: int, id_type, id_name: str = "event_id"):
        self.gap, self.id_type = gap * 1_000_000, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opens = handle.getValueState("opens", StructType([StructField("at", LongType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), StructField("event_id", self.id_type)]))

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([r[["at", "event_id"]] for r in rows], ignore_index=True)
        self.waiting.appendList(list(new.itertuples(index=False, name=None)))
        self._wake(int(new["at"].max()))
        return iter([])

    def _wake(self, at: int) -> None:
        """Comes back when the watermark, in milliseconds, is past a time in microseconds."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready, rest = [r for r in rows if r[0] < upto], [r for r in rows if r[0] >= upto]
        gate = self.opens.get()[0] if self.opens.exists() else None
        picked = []
        for at, event_id in ready:
            if gate is None or at >= gate:
                picked.append((*key, event_id, at))
                gate = at + self.gap
        if rest:
            self.waiting.put(rest)
            self._wake(max(r[0] for r in rest))
        elif rows:
            self.waiting.clear()
        if gate is not None and gate <= upto and not rest:
            self.opens.clear()  # whatever comes now is let in anyway
        elif gate is not None:
            self.opens.update((gate,))
            self._wake(gate)
        if picked:
            yield pd.DataFrame(picked, columns=["spec_id", "event_id", "at"])

    def close(self) -> None:
        pass


def throttle(events: DataFrame, sink: str, checkpoint: str, gap: int = THROTTLE_SECONDS, late: str = "10 minutes"):
    """Appends accepted successful actions, in event time: ``spec_id, event_id, at``.

    Actions may arrive out of order by up to ``late``; later ones are left out.  An action
    is decided on once the watermark has passed it.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where("success").select("spec_id", "event_id", F.unix_micros("ts").alias("at"), "ts")
    kinds = {f.name: f.dataType for f in rows.schema}
    out = rows.groupBy("spec_id").transformWithStateInPandas(
        Gate(gap, kinds["event_id"]), f"spec_id {kinds['spec_id'].simpleString()}, event_id {kinds['event_id'].simpleString()}, at long", "Append", "EventTime"
    )
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)


def job_table(spark: SparkSession, folder: str) -> BucketTable:
    return BucketTable(spark, folder, ("job_id",))


def job_current(events: DataFrame, sink: str, checkpoint: str):
    """Merges the latest state of each job of a batch into a bucketed table."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "message"), "seq").alias("s"), F.max("seq").alias("seq"))
        job_table(batch.sparkSession, sink).merge(newest.select("job_id", "s.*", "seq"), number, latest(["job_id"], ["seq"]))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jobs_now(spark: SparkSession, sink: str) -> DataFrame:
    """What the job stream has written."""
    return job_table(spark, sink).read().drop("seq")


def thread_turns(intents: DataFrame, sink: str, checkpoint: str, page: int = PAGE):
    """Appends each turn with the number of turns before it, its page, and the earlier intents of that page.

    The state of a thread is its number of turns and the intents of the page at
    hand; pages before it stand in the sink, in the last turn of each.
    """
    kinds = dict(intents.dtypes)

    def step(key, frames, state: GroupState):
        n, recent = state.get if state.exists else (0, [])
        turns = pd.concat(list(frames)).sort_values("turn")
        recent, rows = list(recent), []
        for turn, intent in zip(turns["turn"].tolist(), turns["intent"].tolist()):
            rows.append((*key, turn, intent, n, n // page, list(recent)))
            n += 1
            recent = [] if n % page == 0 else [*recent, intent]
        state.update((n, recent))
        yield pd.DataFrame(rows, columns=["thread_id", "turn", "intent", "n_prior", "page_no", "recent"])

    out = intents.select("thread_id", "turn", "intent").groupBy("thread_id").applyInPandasWithState(
        step, f"thread_id {kinds['thread_id']}, turn {kinds['turn']}, intent string, n_prior long, page_no long, recent array<string>",
        "n long, recent array<string>", "append", GroupStateTimeout.NoTimeout,
    )
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)


def replayed(rows: DataFrame, order: str, stream: Callable, parts: int = PARTS, last: DataFrame | None = None, result: Callable | None = None) -> DataFrame:
    """What ``stream`` gives over ``rows`` that arrive by ``order`` in ``parts``; ``last`` arrives after them.

    The stream ends after every part and is started again from its checkpoint.  ``result``
    reads the sink (a Parquet folder by default).
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/loreweave-{uuid.uuid4().hex}"
    bounds = rows.approxQuantile(order, [(i + 1) / parts for i in range(parts - 1)], 0.001)
    cut = materialise(rows.withColumn("_part", sum(((F.col(order) > b).cast("int") for b in bounds), F.lit(0))))
    arriving = [cut.where(F.col("_part") == i).drop("_part") for i in range(parts)] + ([] if last is None else [last])
    for part in arriving:
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        stream(source, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out") if result is None else result(spark, f"{base}/out")


def throttled(events: DataFrame, order: str, gap: int = THROTTLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The throttle stream over a table that arrives by ``order``; a closing event without a key, which itself stays undecided, lets the last ones out."""
    end = events.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).where("ts is not null")
    names = {"ts": F.expr("ts + interval 10 years"), "success": F.lit(True)}
    closing = end.select(*[names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    return with_state_store(events.sparkSession, lambda: replayed(events, order, lambda s, o, c: throttle(s, o, c, gap, late), last=closing))


def with_state_store(spark: SparkSession, run: Callable):
    """Runs with the state store that timers need, and sets the session back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        return run()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
