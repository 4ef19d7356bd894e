import random
from collections import defaultdict
from itertools import product

from loreweave.llm import chat_format as cf


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) >= 2 and len(roles) % 2 == 0 and roles[::2] == ["user"] * (len(roles) // 2) and roles[1::2] == ["assistant"] * (len(roles) // 2)


def least_cost(roles):
    """Over all relabellings and joins, with empty turns put in wherever they help."""
    best = 1 << 60
    for new in product(cf.ROLES, repeat=len(roles)):
        relabelled = cf.RELABEL * sum(a != b for a, b in zip(roles, new))
        for joins in product([False, True], repeat=len(roles) - 1):
            if any(j and a != b for j, a, b in zip(joins, new, new[1:])):
                continue
            turns = [new[0]] + [b for j, b in zip(joins, new[1:]) if not j]
            cost = relabelled + cf.MERGE * sum(joins)
            if "system" in turns[1:] or cost >= best:
                continue
            out, added = [], 0
            for t in turns:
                want = "assistant" if out[-1:] == ["user"] else "user"
                if t != "system" and t != want:
                    out.append(want)
                    added += 1
                out.append(t)
            while not legal(out):
                out.append("assistant" if out[-1] == "user" else "user")
                added += 1
            best = min(best, cost + cf.INSERT * added)
    return best


def repaired(rows):
    out, cost = [], 0
    for r in rows:
        cost += {"keep": 0, "relabel": cf.RELABEL, "merge": cf.MERGE, "relabel+merge": cf.RELABEL + cf.MERGE, "insert": cf.INSERT}[r.op]
        if "merge" not in r.op:
            out.append(r.role)
    return out, cost


def test_against_all_repairs(spark):
    rng = random.Random(1)
    data, roles_of = [], {}
    for c in range(120):
        roles_of[c] = [rng.choice(["system", "user", "assistant", "assistant", "tool", None]) for _ in range(rng.randrange(1, 6))]
        data += [(c, i, r, rng.choice([None, "", f"m{i}"])) for i, r in enumerate(roles_of[c])]
    frame = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    for segment in (cf.SEGMENT, 2):
        by_conv = defaultdict(list)
        for r in cf.render(frame, segment=segment).collect():
            by_conv[r.conv_id].append(r)
        assert set(by_conv) == set(roles_of)
        for c, rows in by_conv.items():
            rows.sort(key=lambda r: (r.segment, r.place))
            roles, cost = repaired(rows)
            assert legal(roles) and cost == least_cost(roles_of[c])
            assert [r.turn for r in rows if r.turn is not None] == list(range(len(roles_of[c])))
            text = "".join(r.fragment for r in rows)
            turns = text.split(cf.END)
            assert turns[-1] == "" and [t.split("|>")[0][2:] for t in turns[:-1]] == roles
            mine = [t for k, _, _, t in data if k == c]
            assert [x for t in turns[:-1] for x in t.split("\n")[1:] if x] == [x for x in mine if x]


def test_long_and_odd_conversations(spark):
    rng = random.Random(2)
    data = [(None, i, rng.choice(["user", "assistant"]), "x") for i in range(9000)] + [(1, None, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b")]
    frame = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumnRenamed("text", "Segment")
    rows = cf.render(frame, text="Segment", segment=500).collect()
    long = sorted((r for r in rows if r.conv_id is None), key=lambda r: (r.segment, r.place))
    roles, cost = repaired(long)
    assert legal(roles) and cost == min(c + cf.INSERT * len(cf.CLOSE[s]) for s, c in enumerate(cf.costs([cf._number(r) for _, _, r, _ in data[:9000]], 0)) if s)
    assert len({r.segment for r in long}) >= 18 and len([r for r in rows if r.conv_id == 1]) == 3
    assert cf.render(frame.limit(0), text="Segment").count() == 0
