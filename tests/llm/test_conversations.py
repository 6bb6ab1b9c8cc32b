import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from findery.llm import conversations as C
from findery.llm import queries
from findery.session import table
from tests.oracle import compare, connect

SCHEMA = StructType([
    StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
    StructField("text", StringType()), StructField("kind", StringType()), StructField("part", StringType()),
    StructField("lead", StringType()), StructField("n", StringType()), StructField("symbols", StringType())])


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", "l", "n", "s") for r in rows], SCHEMA)


def faults_of(rows):
    """First fault of each ordered (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(rows, faults):
    """(cost, audit, lines) by trying every list of edits, with up to two inserts at each place."""
    best = None
    inserts = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    per_row = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    for edits in itertools.product(*per_row):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                for r in gaps[i]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append(({"u": "user", "a": "assistant"}[r], ""))
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and faults[i] == "truncated")
                    if e == "K":
                        lines.append((role, text))
                    elif e[0] == "R":
                        lines.append(({"u": "user", "a": "assistant"}[e[1]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def stepwise(rows, faults):
    """The same by whole strings, a row at a time."""
    def inserted(states):
        for _ in range(2):
            for (i, r), j in C.STEPS.items():
                if r != "s" and i in states:
                    c, a, t = states[i]
                    new = (c + 2, a + "I", t + [({"u": "user", "a": "assistant"}[r], "")])
                    states[j] = min(states.get(j, new), new, key=lambda x: x[:2])
        return states

    states = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        states, out = inserted(states), {}
        for i, (c, a, t) in states.items():
            new = [(i, (c + 3, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for (k, r), j in C.STEPS.items():
                    if k == i and role[:1] == r:
                        new.append((j, (c + extra, a + "K", t + [(role, text)])))
                    if k == i and r != "s":
                        new.append((j, (c + 2 + extra, a + "R", t + [({"u": "user", "a": "assistant"}[r], text)])))
            for j, x in new:
                out[j] = min(out.get(j, x), x, key=lambda y: y[:2])
        states = out
    states = inserted(states)
    return min((states[j] for j in (0, 3) if j in states), key=lambda x: x[:2])


def want(rows):
    """Report of one conversation from its unordered (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = faults_of(rows)
    cost, audit, lines = stepwise(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROLES = ["user", "assistant", "system", "tool", "", "assistant", "user"]
TEXTS = ["Yes.", "No!", "open end", "", " \n", "Why? \t", "a" * 70 + "1.", "a" * 70 + "2.", "More."]


def random_rows(draw, n, turns):
    return [(draw.choice([None, *range(turns)]) if draw.random() < 0.3 else i, draw.choice(ROLES), draw.choice(TEXTS) + draw.choice(["", " x", "."]))
            for i in range(n)]


def test_stepwise_equals_every_list_of_edits():
    draw = random.Random(3)
    for _ in range(25):
        rows = random_rows(draw, draw.randrange(4), 5)
        rows = [(i, r, t) for i, (_, r, t) in enumerate(rows)]
        faults = faults_of(rows)
        assert stepwise(rows, faults)[:2] == enumerated(rows, faults)[:2]


@pytest.mark.parametrize("rules", [0, 8])
def test_matrices_equal_stepwise(rules):
    """Products of matrices, with names of pairs or without, give the plain program's cost and edits."""
    draw, names = random.Random(rules), []
    for i in range(rules):
        known = "xsuaoSUAO" + "".join(n for _, n in names)
        names.append((draw.choice(known) + draw.choice(known), chr(C.FIRST_NAME + i)))
    grammar = C.Grammar(names)
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for n in list(range(12)) * 20 + [300]:
        symbols = "".join(draw.choice("xsuaauuoSUAO") for _ in range(n))
        rows = [(i, role[s.lower()], str(i)) for i, s in enumerate(symbols)]
        faults = ["blank" if s == "x" else "truncated" if s.isupper() else "" for s in symbols]
        assert grammar.end(grammar.onward(C.START, symbols)) == stepwise(rows, faults)[:2]
        cut = draw.randrange(n + 1)
        assert grammar.end(grammar.onward(grammar.onward(C.START, symbols[:cut]), symbols[cut:])) == stepwise(rows, faults)[:2]


def test_long_blocks_stay_near_linear():
    grammar = C.Grammar([])
    vector = C.START
    for _ in range(400):
        vector = grammar.onward(vector, "uSoaAxuuOa" * 25)
    assert len(grammar.end(vector)[1]) >= 100_000


def test_query_equals_sql(spark, sf01):
    plan, sql = queries.QUERIES["op11_conversation_repair"], queries.ORACLES["op11_conversation_repair"]
    assert compare(spark, connect(sf01), sf01, plan, sql) is None


def test_repair_equals_brute_force(spark, monkeypatch):
    draw, rows = random.Random(11), []
    for conv in range(120):
        rows += [(conv, *r) for r in random_rows(draw, draw.randrange(1, 12), 6)]
    rows += [(None, *r) for r in random_rows(draw, 9, 4)]
    rows += [(500, *r) for r in random_rows(draw, 700, 900)]  # more rows than a block
    rows += [(501, 3, "user", "Again and again.")] * 600
    rows += [(502, i, "user", "The same words.") for i in range(300)]
    by_conv = {}
    for c, *r in rows:
        by_conv.setdefault(c, []).append(tuple(r))
    for size in (C.BLOCK, 4):
        monkeypatch.setattr(C.cut_blocks, "__defaults__", (size,))
        got = C.repair(make(spark, rows)).collect()
        assert len(got) == len(by_conv)
        for r in got:
            assert tuple(r[n] for n in NAMES) == want(by_conv[r["conv_id"]]), r["conv_id"]


def test_damage_and_lost_conversations(spark, sf):
    whole = table(spark, sf, "conversations")
    damaged = [tuple(r) for r in C.damage(whole).collect()]
    got = {r["conv_id"]: r for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got.keys() == {r["conv_id"] for r in whole.select("conv_id").distinct().collect()}
    for conv, r in got.items():
        assert tuple(r[n] for n in NAMES) == want([d[1:] for d in damaged if d[0] == conv])
    lost = C.repair(make(spark, []), ids=spark.createDataFrame([(4,), (None,), (4,)], "conv_id long")).collect()
    assert {r["conv_id"] for r in lost} == {4, None} and len(lost) == 2
    assert all(tuple(r[n] for n in NAMES) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in lost)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 3, "tool", "Yes."), (1, 4, "user", "Bye")]
    turns = C.repaired_turns(make(spark, rows)).orderBy("position").collect()
    assert [(t["position"], t["edit"], t["role"], t["text"]) for t in turns][:3] == [
        (0, "K", "system", "Be kind."), (1, "K", "user", "Hello?"), (2, "R", "assistant", "Yes.")]
    lines = "\n".join(f"{t['role']}:{t['text']}" for t in turns)
    assert C.repair(make(spark, rows)).first()["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()


def test_odd_tables(spark):
    assert C.repair(make(spark, [])).count() == 0
    assert C.repaired_turns(make(spark, [])).count() == 0
    long = "lorem ipsum " * 50_000
    rows = [(1, None, None, None), (1, None, "user", long), (2, 1, None, " \v\f\r"), (3, 5, "user", long + "."), (3, 5, "assistant", long)]
    got = {r["conv_id"]: r for r in C.repair(make(spark, rows)).collect()}
    for conv in (1, 2, 3):
        assert tuple(got[conv][n] for n in NAMES) == want([r[1:] for r in rows if r[0] == conv])
    spaced = C.damage(make(spark, [(None, None, None, None)])).collect()
    assert len(spaced) <= 2


def test_pairs_are_named_by_frequency(spark):
    blocks = spark.createDataFrame([("ua" * n,) for n in range(1, 40)] + [("sua" + "x" * n,) for n in range(20)], "symbols string")
    grammar = C.name_pairs(blocks)
    assert grammar.rules[0][0] in ("ua", "au") and len(grammar.packed("ua" * 32)) <= 8
    assert C.name_pairs(blocks.where(F.lit(False))).rules == []
