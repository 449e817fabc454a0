"""Conversation repair against plain searches."""

import hashlib
import random
import re
from binascii import crc32
from itertools import product

from tickframe.llm import conversations as C
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    """Fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Least (cost, audit) and the repaired turns over all edits with up to two insertions at a place."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    acts = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults(rows)]
    for chosen in product(*acts):
        for put in product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                for x in put[i]:
                    cost, audit = cost + 5, audit + "I"
                    turns.append((C.ROLES[x], ""))
                if i < len(rows):
                    a = chosen[i]
                    audit += a[0]
                    cost += {"K": 0, "R": 1, "D": 2}[a[0]] + (5 if faults(rows)[i] == "truncated" and a != "D" else 0)
                    if a != "D":
                        turns.append((rows[i][0] if a == "K" else C.ROLES[a[1]], rows[i][1]))
            if (best is None or (cost, audit) < best[:2]) and LEGAL.fullmatch("".join((r or "?")[0] for r, _ in turns)):
                best = cost, audit, turns
    return best


def dynamic(rows):
    """The same by a table over (row, last role) that keeps whole audits."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    found = {"": (0, "", [])}

    def add(out, state, value):
        if state not in out or value[:2] < out[state][:2]:
            out[state] = value

    def insert(states):
        todo = list(states)
        while todo:
            s = todo.pop()
            cost, audit, turns = states[s]
            for x in after[s].replace("s", ""):
                new = cost + 5, audit + "I", turns + [(C.ROLES[x], "")]
                if x not in states or new[:2] < states[x][:2]:
                    states[x] = new
                    todo.append(x)
        return states

    for (role, text), fault in zip(rows, faults(rows)):
        out = {}
        for s, (cost, audit, turns) in insert(found).items():
            add(out, s, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            for x in after[s]:
                if x == role[:1]:
                    add(out, x, (cost + more, audit + "K", turns + [(role, text)]))
                elif x != "s":
                    add(out, x, (cost + 1 + more, audit + "R", turns + [(C.ROLES[x], text)]))
        found = out
    return min((insert(found)[s] for s in ("", "a") if s in found), key=lambda v: v[:2])


def parsed(rows):
    marked = [(None, role, text, f) for (role, text), f in zip(rows, faults(rows))]
    graph, total, back = C.PARSER.read([C.kind_of(role, f) for _, role, _, f in marked])
    cost, node, tail = C.PARSER.finish(graph)
    made = list(C.edited(marked, C.PARSER.edits(back, node), 0, tail))
    return total + cost, "".join(r[4] for r in made), [(r[5], r[2]) for r in made if r[5] is not None]


def made(r, n):
    roles = ["user", "assistant", "system", "tool", "", "User"]
    weights = [6, 6, 2, 1, 0.3, 0.3]
    return [(r.choices(roles, weights)[0], r.choices(["", " \t", "yes.", "no", f"t{r.random()}.", f"t{r.random()}"], [1, 0.5, 1, 1, 6, 1])[0]) for _ in range(n)]


def test_automaton():
    lr = C.Automaton(C.GRAMMAR)
    for n in range(7):
        for roles in map("".join, product("sua", repeat=n)):
            stack = (0,)
            for x in roles:
                stack = stack and lr.shift(stack, x)
            assert bool(stack and lr.accepts[stack[-1]]) == bool(LEGAL.fullmatch(roles)), roles


def test_against_all_edits():
    r = random.Random(1)
    for _ in range(60):
        rows = made(r, r.randint(0, 3))
        assert parsed(rows) == exhaustive(rows), rows


def test_against_plain_table():
    r = random.Random(2)
    for _ in range(1500):
        rows = made(r, r.randint(0, 14))
        assert parsed(rows) == dynamic(rows), rows
    rows = made(r, 3000)
    assert parsed(rows)[:2] == dynamic(rows)[:2]
    assert len({g for g, _ in C.PARSER.known}) < 300


def expected(conv, turns):
    """turns: (turn, role, text) of the undamaged conversation."""
    after = []
    for turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        d = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            after += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    after.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
    rows = [t[1:] for t in after]
    numbers = [t[0] for t in after if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    found = faults(rows)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    cost, audit, fixed = dynamic(rows)
    return (conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for conv, *turn in rows:
        out.setdefault(conv, []).append(tuple(turn))
    return sorted((expected(c, t) for c, t in out.items()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


SMALL = dict(long_rows=3, long_bytes=2000, chunk_rows=3)


def test_query_against_plain_version(spark):
    df = read(spark, SF, "conversations")
    want = by_conversation(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))
    assert got(C.conversation_digest(df)) == want
    assert got(C.conversation_digest(df, **SMALL)) == want


def test_edge_rows(spark):
    r = random.Random(4)
    given = [(c, t if r.random() < 0.9 else None, role if r.random() < 0.95 else None, text if r.random() < 0.95 else None)
             for c in [None, 1, 2, 3, 4, 5, -7, 2 ** 60] for t, (role, text) in enumerate(made(r, r.choice([1, 2, 9, 25])))]
    given += [(50, 3, "user", "same.")] * 40 + [(50, 4, "user", "same.")] * 30 + [(50, None, "assistant", "same.")] * 5
    given += [(51, -2 ** 63, "user", "a."), (51, 2 ** 63 - 1, "assistant", "x" * 100_000 + ".")]
    gone = next(c for c in range(100, 999) if crc32(f"{c}:0".encode()) % 20 == 0)
    given.append((gone, 0, "user", "dropped."))
    df = spark.createDataFrame([(*g, 1, "k") for g in given], "conv_id long, turn long, role string, text string, pos int, chunk string")
    want = [w if w[0] != 51 else (w[0], min(w[1], 2 ** 63 - 1), *w[2:]) for w in by_conversation(given)]
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in want
    assert got(C.conversation_digest(df)) == want
    assert got(C.conversation_digest(df, **SMALL)) == want
    empty = C.conversation_digest(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repaired_rows(spark):
    given = [("c", 0, "user", "hi."), ("c", 1, "tool", "out."), ("c", 2, "user", "more."), ("c", 3, "user", ""), ("c", 4, "assistant", "ok.")]
    df = spark.createDataFrame(given, "conv_id string, turn int, role string, text string")
    for sizes in ({}, dict(long_rows=2, chunk_rows=2)):
        rows = sorted(C.repair(df, **sizes).collect(), key=lambda x: (x.chunk, x.pos))
        assert [(x.edit, x.new_role, x.fault) for x in rows] == [("K", "user", None), ("R", "assistant", None), ("K", "user", None), ("D", None, "blank"), ("K", "assistant", None)]
