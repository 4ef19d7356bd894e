"""Repairs of conversations against a search over all of them, and a plain program over strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loreweave.llm import conversation_repair as C
from loreweave.llm._shared import table

LEGAL = re.compile(r"(s?(ua)+)?")


def searched(symbols):
    """(cost, audit) by trying every edit with up to three inserts before each message and at the end."""
    best = None
    choices = []
    for s in symbols:
        one = ["D"] if s == C.GONE else ["D", "K", "Ru", "Ra"]
        choices.append([(list(ins), e) for n in range(3) for ins in itertools.product("ua", repeat=n) for e in one])
    tail = [list(ins) for n in range(3) for ins in itertools.product("ua", repeat=n)]
    for plan in itertools.product(*choices, tail):
        cost, audit, out = 0, "", ""
        for s, (ins, e) in zip(symbols, plan[:-1]):
            extra = 1 if 4 <= s < C.GONE else 0
            cost += 2 * len(ins) + {"D": 3, "K": extra}.get(e, 2 + extra)
            audit += "I" * len(ins) + e[0]
            out += "".join(ins) + {"D": "", "K": "suax"[s % 4] if s < C.GONE else ""}.get(e, e[1:])
        cost, audit, out = cost + 2 * len(plan[-1]), audit + "I" * len(plan[-1]), out + "".join(plan[-1])
        if LEGAL.fullmatch(out) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def dynamic(symbols):
    """The same by whole strings, state by state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    now = {"": (0, "")}

    def inserts(now):
        for _ in range(3):
            new = dict(now)
            for q, (c, a) in now.items():
                for r in "ua":
                    if r in step[q]:
                        new[step[q][r]] = min(new.get(step[q][r], (1 << 60, "")), (c + 2, a + "I"))
            now = new
        return now

    for s in symbols:
        extra, new = (1 if 4 <= s < C.GONE else 0), {}
        for q, (c, a) in inserts(now).items():
            options = [(q, 3, "D")]
            if s != C.GONE:
                options += [(step[q][r], 2 + extra, "R") for r in "ua" if r in step[q]]
                r = "suax"[s % 4]
                options += [(step[q][r], extra, "K")] if r in step[q] else []
            for to, k, e in options:
                new[to] = min(new.get(to, (1 << 60, "")), (c + k, a + e))
        now = new
    now = inserts(now)
    return min(v for q, v in now.items() if q in ("", "a"))


def answer(grammar, symbols):
    m = grammar.products([bytes(symbols)])[bytes(symbols)]
    leave = C.closing(m.cost[0], m.order[0]) if symbols else 0
    return m.cost[0][leave] + 2 * len(C.CLOSE[leave]), str(m.audit[0][leave]) + C.CLOSE[leave]


def test_against_all_repairs():
    grammar = C.Grammar()
    for n in range(3):
        for symbols in itertools.product(range(9), repeat=n):
            assert answer(grammar, symbols) == searched(symbols) == dynamic(symbols)
    r = random.Random(1)
    for _ in range(8):
        symbols = [r.randrange(9) for _ in range(3)]
        assert dynamic(symbols) == searched(symbols)


def test_grammar():
    r = random.Random(2)
    blocks = [b"\x00\x01\x02", b"\x01\x02", b"\x01\x02\x01\x02", b"\x08", b"\x05", b"\x02" * 3, bytes(range(9))]
    many = [b"".join(r.choice(blocks) for _ in range(r.randrange(20))) for _ in range(80)]
    many += [bytes(r.randrange(9) for _ in range(n)) for n in range(200)] + [b"\x01" * n for n in range(30)] + [b"\x01\x02" * 700]
    grammar = C.Grammar()
    found = grammar.products(many)
    assert len(grammar.rules) > 20
    spelled = {i: bytes([i]) for i in range(9)}
    for (a, b), rule in grammar.rules.items():
        spelled[rule] = spelled[a] + spelled[b]
    known = sorted(set(many))
    assert [b"".join(spelled[s] for s in x) for x in grammar.compressed(known)] == known
    for symbols in many:
        m = found[symbols]
        leave = C.closing(m.cost[0], m.order[0]) if symbols else 0
        assert (m.cost[0][leave] + 2 * len(C.CLOSE[leave]), str(m.audit[0][leave]) + C.CLOSE[leave]) == dynamic(symbols)


def test_ropes():
    r = random.Random(3)
    ropes = [C.Rope(c) for c in "DIKR"]
    for _ in range(300):
        ropes.append(r.choice(ropes) + r.choice(ropes[-12:]))
    ropes = [x for x in ropes if x.n < 20000]
    for _ in range(2000):
        a, b = r.choice(ropes), r.choice(ropes)
        assert (a < b) == (str(a) < str(b))
        assert (a + b).n == a.n + b.n


def plain(rows, damage=True):
    """rows: (conv, turn, role, text)."""
    out = []
    for conv in sorted({r[0] for r in rows}, key=str):
        kept = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        kept.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        symbols, seen, faults = [], set(), []
        for _, role, text in kept:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            symbols.append(C.GONE if fault in ("b", "d") else ("sua".find(role[0]) if role and role[0] in "sua" else 3) + 4 * (fault == "t"))
        cost, audit = dynamic(symbols)
        turns = [t for t, _, _ in kept if t is not None]
        heads = [role[:1] for _, role, _ in kept]
        repaired, rest, last = [], iter(kept), ""
        for e in audit:
            m = (0, "", "") if e == "I" else next(rest)
            if e != "D":
                role = m[1] if e == "K" else "assistant" if last == "u" else "user"
                repaired.append(f"{role}:{m[2]}")
                last = role[0]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


def conversations(seed, n=60, longest=14):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.choice([1, 3, longest])):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "User"])
            text = r.choice(["hello.", "yes!", "no", " \n\t", "", None, "é?", f"text {turn}.", f"text {turn} ", "a\x1c.", "\x85"])
            rows.append((conv, r.choice([turn, turn, turn + 3, None]), role, text))
    r.shuffle(rows)
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    return sorted((tuple(x) for x in C.repair(C.damaged(df), gone="_gone", **more).collect()), key=lambda x: str(x[0]))


@pytest.mark.parametrize("segment", [4096, 3])
def test_against_plain(spark, segment):
    rows = conversations(segment)
    assert got(spark, rows, segment=segment) == plain(rows)


def test_long_conversation(spark, monkeypatch):
    """One conversation with most rows, one message in much of it, over many segments and blocks."""
    monkeypatch.setattr(C, "BLOCK_BITS", 3)
    r = random.Random(4)
    rows = [(7, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["same.", f"own {t}.", f"own {t}", f"again {t % 50}!", ""])) for t in range(3000)]
    rows += [(8, None, "user", "q.")] * 3 + [(None, 1, "user", "q."), (None, 1, "assistant", None)]
    want = plain(rows)
    for segment in (16, 4096):
        assert got(spark, rows, segment=segment) == want


def test_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "q?"), (1, 2, "user", "again?"), (1, 3, "assistant", ""), (2, 1, "assistant", "a.")], "conv_id long, turn long, role string, text string")
    rows = sorted(tuple(x) for x in C.repair(df, rows=True, segment=1).fillna({"turn": -1}).collect())
    assert rows == [
        (1, 0, "K", "user", "q?", 1), (1, 1, "R", "assistant", "again?", 2), (1, 2, "D", "assistant", "", 3),
        (2, 0, "I", "user", "", -1), (2, 1, "K", "assistant", "a.", 1),
    ]


def test_odd_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None, None, None)]) == plain([(None, None, None, None)])
    clash = spark.createDataFrame([(1, 1, "user", "x" * 300_000 + ".", 5, "k")], "conv_id long, turn long, role string, text string, cost int, key string")
    assert C.repair(clash).columns == ["conv_id", *C.SUMMARY]
    assert C.repair(clash).first().audit == "KI"


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.query(spark, sf_dir).collect()), key=lambda x: str(x[0])) == plain(rows)
