"""Per-key throttle: act only if the last successful action is long enough ago.

The rule is a fold over time, which a plain implementation runs in one task per
key.  Here time is cut into chunks.  Within a chunk the outcome depends on the
past only through the second at which the gate opens, and a gate can reach into
a chunk by less than the gap.  So each chunk is summarised, in parallel, by the
last accepted time for every opening that makes a difference, that is for each
distinct first action in the gap; the summaries are chained per key (one short array
per chunk); then all chunks are replayed in parallel.

Times count in microseconds.  Attempts at one time collapse to the first; a chunk is
a day by default, so what a task holds is bounded by the actions of one key in a day.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from loreweave.functions.constants import THROTTLE_SECONDS

CHUNK = 86_400  # seconds

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def last_accepted(times: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For gates opening less than ``gap`` after ``start``: latest opening of each case, and its last accepted time.

    A gate lets in the first action at or after it, so openings up to the same
    action are one case.
    """
    n = len(times)
    nxt = np.searchsorted(times, times + gap)
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:  # follow the chain by doubling
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    cases = np.flatnonzero(times < start + gap)
    if len(cases) < n:  # openings after the last of these meet the next action
        cases = np.append(cases, len(cases))
    return times[cases], times[last[cases]]


def accepted(times: np.ndarray, opens: int, gap: int) -> np.ndarray:
    """Accepted times of a chunk whose gate opens at ``opens``."""
    nxt = np.searchsorted(times, times + gap)
    picked = []
    i = int(np.searchsorted(times, opens))
    while i < len(times):
        picked.append(i)
        i = int(nxt[i])
    return times[picked]


def chain(chunks: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Time at which the gate opens for each chunk of one key."""
    chunks = chunks.sort_values("chunk")
    opens, gate = [], None
    for start, upto, exits in zip(chunks["chunk"], chunks["upto"], chunks["exits"]):
        opens.append(start if gate is None else max(gate, start))
        case = int(np.searchsorted(upto, opens[-1]))
        if case < len(upto):
            gate = int(exits[case]) + gap
    return chunks[["spec_id", "chunk"]].assign(opens=opens)


def throttle(events: DataFrame, gap: int = THROTTLE_SECONDS, chunk: int = CHUNK) -> DataFrame:
    """Accepted successful actions: ``spec_id, event_id, at`` (microseconds).

    ``events``: ``spec_id, event_id, ts, success``; failures never close the gate.
    Ties go to the smallest ``event_id``.
    """
    if gap > chunk:
        raise ValueError("the gap must fit into one chunk")
    gap, chunk = gap * 1_000_000, chunk * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    actions = (
        events.where("success")
        .select("spec_id", "event_id", at.alias("at"))
        .groupBy("spec_id", "at")
        .agg(F.min("event_id").alias("event_id"))
        .withColumn("chunk", F.col("at") - F.pmod(F.col("at"), F.lit(chunk)))
    )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[:1][["spec_id", "chunk"]]
        upto, exits = last_accepted(np.sort(pdf["at"].to_numpy()), int(head["chunk"].iloc[0]), gap)
        return head.assign(upto=[upto], exits=[exits])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = accepted(np.sort(pdf["at"].to_numpy()), int(pdf["opens"].iloc[0]), gap)
        return pdf[pdf["at"].isin(kept)][["spec_id", "event_id", "at"]]

    spec_type = actions.schema["spec_id"].dataType.simpleString()
    id_type = actions.schema["event_id"].dataType.simpleString()
    summaries = actions.groupBy("spec_id", "chunk").applyInPandas(
        summarise, f"spec_id {spec_type}, chunk long, upto array<long>, exits array<long>"
    )
    gates = summaries.groupBy("spec_id").applyInPandas(
        lambda pdf: chain(pdf, gap), f"spec_id {spec_type}, chunk long, opens long"
    )
    return (
        actions.join(gates, ["spec_id", "chunk"])
        .groupBy("spec_id", "chunk")
        .applyInPandas(replay, f"spec_id {spec_type}, event_id {id_type}, at long")
    )
