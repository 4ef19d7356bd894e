"""Chat formatting: repair of role sequences at minimum cost.

Legal sequences are an optional system turn, then user and assistant turns in
alternation, from user to assistant.  A message keeps its role (free) or is
relabelled (2); it opens a turn, or joins the turn before it if that has its role
(1); empty turns may be put in (3 each).  Dynamic programming over the automaton's
states finds the cheapest repair; of several, the one whose last moves come first in
the order keep, relabel to system, user, assistant, each by state before.

Messages stand by turn (nulls first), then role and text; rows alike all count.  A
null or unknown role must be relabelled, a null text is empty, a null conversation is
one conversation.  A conversation may be of any length: rows are sorted by range over
all partitions and cut into segments of ``SEGMENT`` messages at most; a segment gives
the costs from each state to each, the segments of a conversation are combined from
these numbers only, and then every segment is repaired between its two states.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm._shared import table, written

ROLES = ["system", "user", "assistant"]
RELABEL, MERGE, INSERT = 2, 1, 3
SEGMENT = 4096
STATES = range(4)  # before the first turn, then in a turn of each role
#: Empty turns needed to get from a state to a new turn of a role; absent: impossible.
NEXT = {(0, 1): [], (0, 2): [], (0, 3): [2], (1, 2): [], (1, 3): [2], (2, 2): [3], (2, 3): [], (3, 2): [], (3, 3): [2]}
#: Empty turns that close a conversation in a state.
CLOSE = {1: [2, 3], 2: [3], 3: []}
INFINITE = 1 << 60

#: (state before, role, cost besides relabelling, empty turns, joins the turn before)
MOVES = [(q, t, INSERT * len(turns), turns, False) for (q, t), turns in NEXT.items()] + [(t, t, MERGE, [], True) for t in (1, 2, 3)]
MOVES.sort(key=lambda m: (m[1], m[2], m[0]))


def _number(role) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def _steps(own: int):
    """Moves for a message of a role, kept roles first."""
    return sorted(((q, t, c + (RELABEL if t != own else 0), turns, joins) for q, t, c, turns, joins in MOVES), key=lambda m: m[1] != own)


_BY_ROLE = [_steps(r) for r in range(4)]


def costs(roles: list[int], entry: int) -> list[int]:
    """Least costs from ``entry`` to every state over messages of these roles."""
    now = [INFINITE] * 4
    now[entry] = 0
    for role in roles:
        new = [INFINITE] * 4
        for q, t, c, _, _ in _BY_ROLE[role]:
            if now[q] + c < new[t]:
                new[t] = now[q] + c
        now = new
    return now


def repair(roles: list[int], entry: int, leave: int) -> list[tuple[int, list[int], bool]]:
    """For each message its role, the empty turns before it, and whether it joins the turn before."""
    now, back = [INFINITE] * 4, []
    now[entry] = 0
    for role in roles:
        new, via = [INFINITE] * 4, [None] * 4
        for move in _BY_ROLE[role]:
            q, t, c, _, _ = move
            if now[q] + c < new[t]:
                new[t], via[t] = now[q] + c, move
        now = new
        back.append(via)
    out, state = [], leave
    for via in reversed(back):
        q, t, _, turns, joins = via[state]
        out.append((t, turns, joins))
        state = q
    return out[::-1]


def fold(segments: list[list[list[int]]]) -> list[tuple[int, int]]:
    """States before and after each segment of a conversation on its cheapest repair."""
    now, back = [0, INFINITE, INFINITE, INFINITE], []
    for matrix in segments:
        via = [min(STATES, key=lambda q: (now[q] + matrix[q][t], q)) for t in STATES]
        now = [min(INFINITE, now[q] + matrix[q][t]) for t, q in zip(STATES, via)]
        back.append(via)
    state = min(CLOSE, key=lambda s: (now[s] + INSERT * len(CLOSE[s]), s))
    out = []
    for via in reversed(back):
        out.append((via[state], state))
        state = via[state]
    return out[::-1]


def _segments(size: int):
    """Rows of a sorted partition as segments with their cost tables."""

    def run(iterator):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def flush():
            nonlocal number, held
            roles = [_number(r["role"]) for r in held]
            table_ = [c for q in STATES for c in costs(roles, q)]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([held[0]["conv"]], types["conv"]), pa.array([[{k: r[k] for k in ("turn", "role", "text")} for r in held]], messages), pa.array([table_], pa.list_(pa.int64()))],
                ["segment", "conv", "messages", "costs"],
            )
            number, held = number + 1, []
            return batch

        for batch in iterator:
            types = {f.name: f.type for f in batch.schema}
            messages = pa.list_(pa.struct([("turn", types["turn"]), ("role", pa.string()), ("text", pa.string())]))
            for row in batch.to_pylist():
                if held and (held[0]["conv"] != row["conv"] or len(held) >= size):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


def _folded(iterator):
    for batch in iterator:
        for parts in batch.column("parts").to_pylist():
            states = fold([[p["costs"][4 * q : 4 * q + 4] for q in STATES] for p in parts])
            last = [False] * (len(parts) - 1) + [True]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p["segment"] for p in parts], pa.int64()), pa.array([a for a, _ in states], pa.int32()), pa.array([z for _, z in states], pa.int32()), pa.array(last)],
                ["segment", "entry", "leave", "last"],
            )


def header(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


END = "\n<|end|>\n"


def _rendered(iterator):
    """One row per message and per empty turn; the fragments in order are the rendered conversation."""
    for batch in iterator:
        turn_type = batch.schema.field("messages").type.value_type.field("turn").type
        for row in batch.to_pylist():
            out, at = [], 0
            open_ = row["entry"] > 0

            def add(turn, op, role, text, joins):
                nonlocal open_, at
                fragment = "\n" + text if joins else (END if open_ else "") + header(role) + text
                out.append((turn, at, op, ROLES[role - 1], fragment))
                open_, at = True, at + 1

            moves = repair([_number(m["role"]) for m in row["messages"]], row["entry"], row["leave"])
            for m, (role, turns, joins) in zip(row["messages"], moves):
                for empty in turns:
                    add(None, "insert", empty, "", False)
                kept = _number(m["role"]) == role
                add(m["turn"], ("merge" if joins else "keep") if kept else ("relabel+merge" if joins else "relabel"), role, m["text"] or "", joins)
            if row["last"]:
                for empty in CLOSE[row["leave"]]:
                    add(None, "insert", empty, "", False)
                turn, k, op, role, fragment = out[-1]
                out[-1] = (turn, k, op, role, fragment + END)
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["conv"]] * n, batch.schema.field("conv").type), pa.array([row["segment"]] * n, pa.int64()), pa.array([o[0] for o in out], turn_type), pa.array([o[1] for o in out], pa.int32()),
                 *[pa.array([o[j] for o in out], pa.string()) for j in (2, 3, 4)]],
                ["conv", "segment", "turn", "place", "op", "role", "fragment"],
            )


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``conv, segment, turn, place, op, role, fragment``, the first named as given.

    Per conversation, fragments by (segment, place) make up the rendered text.
    Other columns are not carried.
    """
    kinds = dict(messages.dtypes)
    rows = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    order = ["conv", "turn", "role", "text"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = f"array<struct<turn:{kinds[turn]},role:string,text:string>>"
    cut = written(spread.mapInArrow(_segments(segment), f"segment long, conv {kinds[conv]}, messages {kind}, costs array<bigint>"), "segments")
    parts = cut.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "costs"))).alias("parts"))  # 16 numbers per segment
    states = parts.mapInArrow(_folded, "segment long, entry int, leave int, last boolean")
    out = cut.drop("costs").join(states, "segment").mapInArrow(_rendered, f"conv {kinds[conv]}, segment long, turn {kinds[turn]}, place int, op string, role string, fragment string")
    return out.withColumnRenamed("conv", conv)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))
