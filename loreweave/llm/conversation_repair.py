"""Repair of conversations by dynamic programming over grammar-compressed symbol sequences.

Messages stand by turn (nulls first), then role and text.  Each has one symbol: its
role's initial, and whether it is sound, truncated (its last character that is not
white space is not one of ``.!?``) or to be deleted (blank, or the same role and text
stood earlier).  Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an
empty user or assistant message 2; a truncated message that stays adds 1.  The result's
initials are ``(s?(ua)+)?``; of the cheapest repairs the one whose edits' initials, in
order, come first in ASCII is taken.  Nulls in role or text count as one space, a null
conversation is one conversation, rows alike all count.  Other columns are not carried.

A symbol is a min-plus matrix over the automaton's states: for every state before and
after, the least cost and the first of its audits, as a rope.  Re-Pair replaces frequent
pairs of symbols over all distinct sequences of a batch by rules, a rule's matrix is the
product of its two, made once and shared by all conversations that a task sees.  Two
audits for the same messages from one state never have one as the beginning of the other
(each ends with a message's edit, and the state after follows from the audit), so ties
are settled by what comes first, and products are associative.

Rows are sorted by range over all partitions and cut into segments of ``SEGMENT``
messages.  A conversation inside one segment, of which nothing can lie in another
partition, is finished on the spot.  Of others, segments tell each other the hashes of their
messages (for duplicates), and then 16 costs and 16 ranks each, which are multiplied by
blocks and by conversation; the states come back, and a task reads the segments in
order, since the hash of the repaired text is sequential, without holding them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loreweave.llm._meet import rows_of
from loreweave.llm._shared import table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT = 4096
BLOCK_BITS = 10       # segments in a block, as a power of two
RULES = 1 << 15       # rules that a task keeps before it starts anew
SPACE = " \t\n\x0b\x0c\r"
INFINITE = 1 << 60
STATES = range(4)     # nothing yet, after system, after user, after assistant
CLOSE = ["", "II", "I", ""]
GONE = 8              # the symbol of a message that must be deleted
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def next_role(state: int) -> int:
    """The state after a user or assistant message put where a state allows it."""
    return 3 if state == 2 else 2


class Rope:
    """A string as a tree: equal parts are passed over by their hashes."""

    __slots__ = ("n", "hash", "power", "left", "right", "text")
    MOD, BASE, LEAF = (1 << 61) - 1, 911382323, 48

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.n, self.hash, self.power = len(text), 0, pow(self.BASE, len(text), self.MOD)
            for c in text:
                self.hash = (self.hash * self.BASE + ord(c)) % self.MOD
        else:
            self.n, self.power = left.n + right.n, left.power * right.power % self.MOD
            self.hash = (left.hash * right.power + right.hash) % self.MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.n or not other.n:
            return self if self.n else other
        if self.n + other.n <= self.LEAF:
            return Rope(str(self) + str(other))
        return Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.n == y.n and x.hash == y.hash:
                continue
            if x.left is not None and (x.n >= y.n or y.left is None):
                a += [x.right, x.left]
                b.append(y)
            elif y.left is not None:
                b += [y.right, y.left]
                a.append(x)
            else:
                k = min(x.n, y.n)
                if x.text[:k] != y.text[:k]:
                    return x.text < y.text
                a += [Rope(x.text[k:])] if x.n > k else []
                b += [Rope(y.text[k:])] if y.n > k else []
        return bool(b)


class Matrix:
    """Costs and audits by state before and after; ``order`` ranks the audits of each row."""

    __slots__ = ("cost", "audit", "order")

    def __init__(self, cost: list[list[int]], audit: list[list[Rope | None]]):
        self.cost, self.audit = cost, audit
        self.order = []
        for i in STATES:
            ranks = [0] * 4
            some = [j for j in STATES if audit[i][j] is not None]
            for a in some:
                ranks[a] = sum(audit[i][b] < audit[i][a] for b in some if b != a)
            self.order.append(ranks)

    def __mul__(self, other: Matrix) -> Matrix:
        cost, audit = [], []
        for i in STATES:
            c, a = [INFINITE] * 4, [None] * 4
            for j in STATES:
                best = min(((self.cost[i][k] + other.cost[k][j], self.order[i][k], k) for k in STATES), default=None)
                if best[0] < INFINITE:
                    k = best[2]
                    c[j], a[j] = best[0], self.audit[i][k] + other.audit[k][j]
            cost.append(c)
            audit.append(a)
        return Matrix(cost, audit)


UNIT = Matrix([[0 if i == j else INFINITE for j in STATES] for i in STATES], [[Rope() if i == j else None for j in STATES] for i in STATES])


def terminal(symbol: int) -> Matrix:
    """Inserts, then the edit of one message."""
    cost, audit = [[INFINITE] * 4 for _ in STATES], [[""] * 4 for _ in STATES]
    role, extra = symbol % 4, TRUNCATED if 4 <= symbol < GONE else 0
    for i in STATES:
        state = i
        for n in range(4):
            moves = [("D", state, DELETE)]
            if symbol != GONE:
                moves.append(("R", next_role(state), REROLE + extra))
                to = 1 if role == 0 and state == 0 else next_role(state) if role == next_role(state) - 1 else None
                if to is not None:
                    moves.append(("K", to, KEEP + extra))
            for letter, to, c in moves:
                new = (INSERT * n + c, "I" * n + letter)
                if new < (cost[i][to], audit[i][to]):
                    cost[i][to], audit[i][to] = new
            state = next_role(state)
    return Matrix(cost, [[Rope(a) if c < INFINITE else None for c, a in zip(*row)] for row in zip(cost, audit)])


class Grammar:
    """Rules over symbols, with a matrix each; pairs seen before keep their rule."""

    def __init__(self):
        self.matrices = [terminal(s) for s in range(GONE + 1)]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, left: int, right: int) -> int:
        if (left, right) not in self.rules:
            self.rules[left, right] = len(self.matrices)
            self.matrices.append(self.matrices[left] * self.matrices[right])
        return self.rules[left, right]

    def compressed(self, sequences: list[bytes]) -> list[list[int]]:
        """The sequences with all pairs replaced that occur twice or more, the most frequent first."""
        ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
        text = np.full(int(ends[-1]) + 1 if len(ends) else 0, -1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(sequences), np.uint8)
        while True:
            at = np.flatnonzero((text[:-1] >= 0) & (text[1:] >= 0))
            width = len(self.matrices)
            pairs, times = np.unique(text[at] * width + text[at + 1], return_counts=True)
            if not len(times) or times.max() < 2:
                break
            # Pairs without a common symbol can't overlap: they are replaced together.
            taken, new = set(), {}
            for i in np.argsort(-times, kind="stable")[:64].tolist():
                a, b = divmod(int(pairs[i]), width)
                if times[i] >= max(2, times.max() // 4) and a not in taken and b not in taken:
                    taken |= {a, b}
                    new[int(pairs[i])] = self.rule(a, b)
            known = np.array(sorted(new), np.int64)
            codes = text[at] * width + text[at + 1]
            place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = known[place] == codes
            at, to = at[hit], np.array([new[k] for k in known.tolist()], np.int64)[place[hit]]
            # A symbol's pair with itself: every other one of a run.
            fresh = np.concatenate([[True], np.diff(at) > 1])
            first = np.flatnonzero(fresh)
            odd = (np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))) % 2 == 1
            at, to = at[~odd], to[~odd]
            text[at] = to
            text = np.delete(text, at + 1)
        cuts = np.flatnonzero(text < 0)
        return [x[:-1].tolist() if k < len(cuts) else x.tolist() for k, x in enumerate(np.split(text, cuts + 1))][: len(sequences)]

    def products(self, sequences: list[bytes]) -> dict[bytes, Matrix]:
        """The matrix of every distinct sequence."""
        if len(self.rules) > RULES:
            self.__init__()
        known = sorted(set(sequences))
        out = {}
        for sequence, symbols in zip(known, self.compressed(known)):
            parts = [self.matrices[s] for s in symbols]
            while len(parts) > 1:
                parts = [a * b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
            out[sequence] = parts[0] if parts else UNIT
        return out


def forward(parts: list[tuple], entry: int):
    """From ``entry`` through (costs, ranks) matrices: costs and ranks by state, and each state's state before."""
    cost, rank, back = [INFINITE] * 4, [0] * 4, []
    cost[entry] = 0
    for costs, order in parts:
        via = [min(STATES, key=lambda k, j=j: (cost[k] + costs[4 * k + j], rank[k])) for j in STATES]
        keys = [(rank[k], order[4 * k + j]) for j, k in enumerate(via)]
        cost = [min(INFINITE, cost[k] + costs[4 * k + j]) for j, k in enumerate(via)]
        real = sorted({x for x, c in zip(keys, cost) if c < INFINITE})
        rank = [real.index(x) if c < INFINITE else 4 for x, c in zip(keys, cost)]
        back.append(via)
    return cost, rank, back


def states(parts: list[tuple], entry: int, leave: int) -> list[tuple[int, int]]:
    """States before and after each part on the way from ``entry`` to ``leave``."""
    out = []
    for via in reversed(forward(parts, entry)[2]):
        out.append((via[leave], leave))
        leave = via[leave]
    return out[::-1]


def closing(cost: list[int], rank: list[int]) -> int:
    """The state in which the cheapest repair ends."""
    return min(STATES, key=lambda j: (cost[j] + INSERT * len(CLOSE[j]), rank[j]))


def joined(parts: list[dict]) -> dict:
    """Numbers of consecutive parts of a conversation."""
    out = None
    for x in parts:
        if x["n"] == 0 and out is not None:
            continue
        if out is None or out["n"] == 0:
            out = dict(x)
            continue
        out["illegal"] += x["illegal"] + (out["last"] + x["head"] not in ("su", "ua", "au"))
        out["turns"] += x["turns"] - (x["low"] is not None and out["high"] == x["low"])
        out["low"] = x["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if x["high"] is None else x["high"]
        out["last"] = x["last"]
        for k in ("n", "blank", "duplicate", "truncated"):
            out[k] += x[k]
    return out


def gaps(x: dict) -> int:
    return 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]


def digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def measured(messages: list[dict], earlier: set[bytes] = frozenset()) -> tuple[bytes, dict]:
    """Symbols of consecutive messages, and their numbers; ``earlier`` are digests of messages before."""
    symbols, seen = bytearray(), set()
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for m in messages:
        role, text = m["role"], m["text"]
        bare = text.rstrip(SPACE)
        if not bare:
            fault = "blank"
        elif (role, text) in seen or earlier and digest(role, text) in earlier:
            fault = "duplicate"
        else:
            fault = "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        own = "sua".find(role[0]) if role else -1
        symbols.append(GONE if fault in ("blank", "duplicate") else (own if own >= 0 else 3) + (4 if fault else 0))
        if fault:
            faults[fault] += 1
    heads = [m["role"][:1] for m in messages]
    turns = [m["turn"] for m in messages if m["turn"] is not None]
    return bytes(symbols), {
        "n": len(messages), **faults, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])),
        "head": heads[0] if heads else "", "last": heads[-1] if heads else "", "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
    }


def edited(messages: list[dict], audit: str, state: int):
    """(edit, role, text, turn) of each edit in order; a deleted message has its own role and text."""
    rest = iter(messages)
    for edit in audit:
        m = {"role": "", "text": "", "turn": None} if edit == "I" else next(rest)
        if edit == "D":
            yield edit, m["role"], m["text"], m["turn"]
            continue
        if edit == "K":
            state = 1 if m["role"][0] == "s" else next_role(state)
            yield edit, m["role"], m["text"], m["turn"]
        else:
            state = next_role(state)
            yield edit, ("user", "assistant")[state - 2], m["text"], m["turn"]


class _Out:
    """Results of one conversation after the other: its summary, or its edits."""

    def __init__(self, conv_type: pa.DataType, rows: bool):
        self.conv_type, self.rows = conv_type, rows
        self.names = ["conv", "place", "edit", "role", "text", "turn"] if rows else ["conv", *SUMMARY]
        self.types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()] if rows else [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        self.data: list[list] = [[] for _ in self.names]
        self.begin()

    def begin(self):
        self.hash, self.audits, self.place, self.any = hashlib.sha256(), [], 0, False

    def add(self, conv, messages, audit: str, state: int):
        for edit, role, text, turn in edited(messages, audit, state):
            if self.rows:
                for column, v in zip(self.data, (conv, self.place, edit, role, text, turn)):
                    column.append(v)
                self.place += 1
            elif edit != "D":
                self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
                self.any = True
        if not self.rows:
            self.audits.append(audit)

    def end(self, conv, numbers: list[int]):
        if not self.rows:
            for column, v in zip(self.data, (conv, *numbers, "".join(self.audits), self.hash.hexdigest())):
                column.append(v)
        self.begin()

    def flush(self):
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.data, self.types)], self.names)
        self.data = [[] for _ in self.names]
        return batch


MESSAGES = "array<struct<turn:bigint,role:string,text:string>>"


def _segments(size: int):
    """Rows of a sorted partition as segments; ``open`` ones may belong to a conversation that goes on elsewhere."""

    def run(iterator):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
        waiting: list[tuple] = []  # full segments of the conversation at hand
        held, key, conv, first = [], None, None, True

        def out(rows: list[tuple], is_open: bool, types):
            nonlocal number
            ids = list(range(number, number + len(rows)))
            number += len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], types), pa.array([is_open] * len(rows)), pa.array([r[2] for r in rows], kind)],
                ["segment", "key", "conv", "open", "messages"],
            )

        for batch in iterator:
            types = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if row["key"] != key and key is not None:
                    yield out([(key, conv, held)], first or bool(waiting), types)
                    first, waiting, held = False, [], []
                elif len(held) >= size:
                    yield out([(key, conv, held)], True, types)
                    waiting, held = [True], []
                key, conv = row["key"], row["conv"]
                if not row["gone"]:
                    held.append({k: row[k] for k in ("turn", "role", "text")})
        if key is not None:
            yield out([(key, conv, held)], True, types)

    return run


def _whole(rows: bool):
    """Finishes conversations of one segment."""

    def run(iterator):
        grammar = Grammar()
        for batch in iterator:
            out = _Out(batch.schema.field("conv").type, rows)
            convs = batch.select(["conv", "messages"]).to_pylist()
            found = [measured(c["messages"]) for c in convs]
            matrices = grammar.products([s for s, _ in found])
            for c, (symbols, x) in zip(convs, found):
                m = matrices[symbols]
                leave = closing(m.cost[0], m.order[0]) if x["n"] else 0
                out.add(c["conv"], c["messages"], str(m.audit[0][leave]) + CLOSE[leave], 0)
                out.end(c["conv"], [gaps(x), x["blank"], x["duplicate"], x["truncated"], x["illegal"], m.cost[0][leave] + INSERT * len(CLOSE[leave])])
            yield out.flush()

    return run


def _digests(iterator):
    for batch in iterator:
        for row in rows_of(batch):
            own = list({digest(m["role"], m["text"]) for m in row["messages"]})
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(own), pa.string()), pa.array([row["segment"]] * len(own), pa.int64()), pa.array(own, pa.binary())], ["key", "segment", "digest"])


NUMBERS = "struct<n:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,head:string,last:string,low:bigint,high:bigint,turns:bigint>"
_NUMBERS = pa.struct([(f.split(":")[0], pa.string() if f.endswith("string") else pa.int64()) for f in NUMBERS[7:-1].split(",")])


def _measured(iterator):
    """Symbols, costs and ranks of segments of longer conversations."""
    grammar = Grammar()
    for batch in iterator:
        rows = batch.select(["segment", "key", "messages", "earlier"]).to_pylist()
        found = [measured(r["messages"], set(r["earlier"] or [])) for r in rows]
        matrices = [grammar.products([s])[s] for s, _ in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("segment"), batch.column("key"), pa.array([s for s, _ in found], pa.binary()), pa.array([sum(m.cost, []) for m in matrices], pa.list_(pa.int64())),
             pa.array([sum(m.order, []) for m in matrices], pa.list_(pa.int64())), pa.array([x for _, x in found], _NUMBERS)],
            ["segment", "key", "symbols", "costs", "ranks", "numbers"],
        )


def _composed(group: pa.Table) -> pa.Table:
    """The product of a block's segments."""
    rows = sorted(group.select(["segment", "costs", "ranks", "numbers"]).to_pylist(), key=lambda r: r["segment"])
    parts = [(r["costs"], r["ranks"]) for r in rows]
    ways = [forward(parts, i)[:2] for i in STATES]
    return pa.table({
        "key": group.column("key")[:1], "block": group.column("block")[:1], "costs": pa.array([sum((c for c, _ in ways), [])], pa.list_(pa.int64())),
        "ranks": pa.array([sum((r for _, r in ways), [])], pa.list_(pa.int64())), "numbers": pa.array([joined([r["numbers"] for r in rows])], _NUMBERS),
    })


def _ways(group: pa.Table) -> pa.Table:
    """States around the blocks of a conversation, and its totals."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    parts = [(r["costs"], r["ranks"]) for r in rows]
    x = joined([r["numbers"] for r in rows])
    cost, rank, _ = forward(parts, 0)
    leave = closing(cost, rank) if x["n"] else 0
    totals = [gaps(x), x["blank"], x["duplicate"], x["truncated"], x["illegal"], cost[leave] + INSERT * len(CLOSE[leave])]
    between = states(parts, 0, leave)
    return pa.table({
        "key": pa.array([r["key"] for r in rows], pa.string()), "block": pa.array([r["block"] for r in rows], pa.int64()), "entry": pa.array([a for a, _ in between], pa.int32()),
        "leave": pa.array([z for _, z in between], pa.int32()), "totals": pa.array([totals] * len(rows), pa.list_(pa.int64())),
    })


def _inner(segments: pa.Table, ways: pa.Table) -> pa.Table:
    """States around the segments of a block."""
    rows = sorted(segments.select(["segment", "costs", "ranks"]).to_pylist(), key=lambda r: r["segment"])
    way = ways.slice(0, 1).to_pylist()[0]
    between = states([(r["costs"], r["ranks"]) for r in rows], way["entry"], way["leave"])
    return pa.table({
        "segment": pa.array([r["segment"] for r in rows], pa.int64()), "entry": pa.array([a for a, _ in between], pa.int32()),
        "leave": pa.array([z for _, z in between], pa.int32()), "totals": pa.array([way["totals"]] * len(rows), pa.list_(pa.int64())),
    })


def _streamed(rows: bool):
    """Segments in order, one conversation after the other."""

    def run(iterator):
        grammar, last, out = Grammar(), None, None

        def end():
            out.add(last["conv"], [], CLOSE[last["leave"]], last["leave"])
            out.end(last["conv"], last["totals"])

        for batch in iterator:
            out = out or _Out(batch.schema.field("conv").type, rows)
            for row in rows_of(batch):
                if last and last["key"] != row["key"]:
                    end()
                out.add(row["conv"], row["messages"], str(grammar.products([row["symbols"]])[row["symbols"]].audit[row["entry"]][row["leave"]]), row["entry"])
                last = {k: row[k] for k in ("key", "conv", "leave", "totals")}
                if rows:
                    yield out.flush()
        if last:
            end()
            yield out.flush()

    return run


def repair(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, rows: bool = False, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: its id, ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gaps`` are missing turn numbers between the least and the largest, ``illegal``
    neighbours whose roles' initials are not su, ua or au.  ``rows`` gives, instead, each edit
    in order: ``place, edit, role, text, turn`` (deleted messages included).  Rows for which
    the boolean column ``gone`` holds only make their conversation appear.
    """
    kind = dict(messages.dtypes)[conv]
    is_gone = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    value = lambda c: F.when(~is_gone, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")))
    source = messages.select(
        F.concat(F.when(F.col(f"`{conv}`").isNull(), "null").otherwise("="), F.coalesce(F.col(f"`{conv}`").cast("string"), F.lit(""))).alias("key"), F.col(f"`{conv}`").alias("conv"),
        F.when(~is_gone, F.col(f"`{turn}`").cast("long")).alias("turn"), value(role).alias("role"), value(text).alias("text"), is_gone.alias("gone"),
    )
    order = ["key", "turn", "role", "text"]
    cut = written(source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(segment), f"segment long, key string, conv {kind}, open boolean, messages {MESSAGES}"), "segments")
    results = f"conv {kind}, place long, edit string, role string, text string, turn long" if rows else f"conv {kind}, {', '.join(f'{c} long' for c in SUMMARY[:6])}, audit string, repaired_sha256 string"
    whole = cut.where("not open").mapInArrow(_whole(rows), results)

    parted = cut.where("open")
    digests = written(parted.select("key", "segment", "messages").mapInArrow(_digests, "key string, segment long, digest binary"), "digests")
    first = digests.groupBy("key", "digest").agg(F.min("segment").alias("first"), F.count("*").alias("n")).where("n > 1")
    earlier = digests.join(first, ["key", "digest"]).where("segment > first").groupBy("segment").agg(F.collect_list("digest").alias("earlier"))  # of one segment
    parts = written(
        parted.join(earlier, "segment", "left").mapInArrow(_measured, f"segment long, key string, symbols binary, costs array<bigint>, ranks array<bigint>, numbers {NUMBERS}")
        .withColumn("block", F.shiftright("segment", BLOCK_BITS)), "parts",
    )
    blocks = parts.groupBy("key", "block").applyInArrow(_composed, f"key string, block long, costs array<bigint>, ranks array<bigint>, numbers {NUMBERS}")
    ways = blocks.groupBy("key").applyInArrow(_ways, "key string, block long, entry int, leave int, totals array<bigint>")
    inner = parts.groupBy("key", "block").cogroup(ways.groupBy("key", "block")).applyInArrow(_inner, "segment long, entry int, leave int, totals array<bigint>")
    joined_ = parted.select("segment", "key", "conv", "messages").join(parts.select("segment", "symbols").join(inner, "segment"), "segment")
    streamed = joined_.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_streamed(rows), results)
    return whole.unionAll(streamed).withColumnRenamed("conv", conv)


def damaged(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, _gone``, faults put in by crc32 of ``conv:turn`` modulo 20 (nulls: one space).

    0 drops the row (``_gone``), 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats it, 4 makes it a user's.
    """
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(value(conv), F.lit(":"), value(turn)).cast("binary")), F.lit(20))
    rows = messages.select(F.col(f"`{conv}`"), F.col(f"`{turn}`"), value(role).alias(role), value(text).alias(text), fault.alias("_fault"))
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new_text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(f"`{text}`"))
    new_role = F.when(F.col("_fault") == 4, "user").otherwise(F.col(f"`{role}`"))
    return rows.select(conv, turn, new_role.alias(role), new_text.alias(text), (F.col("_fault") == 0).alias("_gone"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), gone="_gone")
