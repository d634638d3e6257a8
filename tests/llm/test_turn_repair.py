"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from ledgerlens.llm import queries, turn_repair

ODD = [
    (None, 0, "user", "Null id?", "x"), (None, 1, "assistant", "Yes.", "x"), (None, None, None, None, None),
    (1, 0, "user", "Hi.", "x"), (1, 1, "assistant", "Ho!", "x"), (1, 1, "assistant", "Ho!", "x"), (1, 4, "user", "cut", "x"),
    (2, None, "system", "Be nice.", "x"), (2, 0, "assistant", "first", "x"), (2, 1, "assistant", "second.", "x"), (2, 2, "", "no role.", "x"),
    (3, 7, "tool", " \t\n\x0b\x0c\r", "x"), (4, 0, "user", "", "x"), (5, 0, "system", "alone.", "x"),
    (6, 3, "user", "é \U0001f600.", "x"), (6, 3, "user", "tie.", "x"), (6, 3, "assistant", "tie.", "x"), (6, 4, "User", "big.", "x"),
    (7, 2**40, "user", "far " * 20000 + "end.", "x"), (7, -5, "assistant", " ", "x"),
]
SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def search(rows):
    """(cost, audit) by the best (cost, text) for each state, row by row."""
    # states: 0 nothing, 1 after s, 2 after u, 3 after a
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    due = {0: "u", 1: "u", 2: "a", 3: "u"}

    def inserts(best):
        for _ in range(4):
            for s, (cost, audit) in list(best.items()):
                to = step[s, due[s]]
                best[to] = min(best.get(to, (9**9, "")), (cost + 3, audit + "I"))
        return best

    best = inserts({0: (0, "")})
    for fault, role in rows:
        new = {}
        for s, (cost, audit) in best.items():
            options = [(s, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                options.append((step[s, due[s]], 3 + more, "R"))
                if (s, role) in step:
                    options.append((step[s, role], more, "K"))
            for to, price, x in options:
                new[to] = min(new.get(to, (9**9, "")), (cost + price, audit + x))
        best = inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def enumerated(rows, most):
    """The same by trying every text of edits up to a length."""
    best = None
    for n in range(most + 1):
        for audit in itertools.product("DIKR", repeat=n):
            cost, state, at = 0, 0, 0
            step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
            due = {0: "u", 1: "u", 2: "a", 3: "u"}
            for x in audit:
                if x == "I":
                    state, cost = step[state, due[state]], cost + 3
                    continue
                if at == len(rows):
                    break
                fault, role = rows[at]
                at += 1
                if x == "D":
                    cost += 4
                    continue
                key = (state, role if x == "K" else due[state])
                if fault in ("blank", "duplicate") or key not in step:
                    break
                state, cost = step[key], cost + (3 if x == "R" else 0) + (3 if fault == "truncated" else 0)
            else:
                if at == len(rows) and state in (0, 3):
                    best = min(best or (9**9, ""), (cost, "".join(audit)))
    return best


def codes(rows):
    kind = {"": "", "truncated": "truncated", "blank": "gone", "duplicate": "gone"}
    return bytes(turn_repair._CODES[kind[f], r] for f, r in rows)


def test_every_short_conversation():
    kinds = [("", "s"), ("", "u"), ("", "a"), ("", " "), ("truncated", "u"), ("truncated", "a"), ("blank", "u")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            assert turn_repair.cheapest(codes(rows)) == search(rows), rows


def test_search_equals_all_edits():
    rng = random.Random(3)
    for _ in range(12):
        rows = [(rng.choice(["", "", "truncated", "blank"]), rng.choice("suua ")) for _ in range(rng.randrange(4))]
        assert search(rows) == enumerated(rows, 6)


@pytest.mark.parametrize("seed", range(6))
def test_long_conversations(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(5, 120)
        rows = [(rng.choices(["", "truncated", "blank", "duplicate"], [12, 2, 1, 1])[0], "ua"[i % 2] if rng.random() < 0.8 else rng.choice("sua ")) for i in range(n)]
        assert turn_repair.cheapest(codes(rows)) == search(rows)


def expected(table):
    blank = lambda s: s is None
    fill = lambda v: " " if blank(v) else str(v)
    by = {}
    for c, t, role, text, *_ in table:
        by.setdefault(c, [])
        kind = zlib.crc32(f"{fill(c)}:{fill(t)}".encode()) % 20
        role, text = fill(role) or " ", fill(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        by[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, coded = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            coded.append((fault, role[0]))
        cost, audit = search([(f, r if r in "sua" else " ") for f, r in coded])
        turns = {t for t, _, _ in rows if t is not None}
        lines, left, before = [], iter(rows), None
        for x in audit:
            due = {None: "user", "s": "user", "u": "assistant", "a": "user"}[before]
            if x == "I":
                lines.append((due, ""))
            else:
                _, role, text = next(left)
                if x == "D":
                    continue
                lines.append((due if x == "R" else role, text))
            before = lines[-1][0][0]
        count = lambda k: sum(f == k for f, _ in coded)
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("given", ["odd", "sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, tmp_path, given):
    path = f"/root/testdata/{given}"
    if given == "odd":
        path = str(tmp_path)
        more = [(100 + i, j, "ua"[j % 2] == "u" and "user" or "assistant", f"t{j % 5}.", "x") for i in range(30) for j in range(i)]
        spark.createDataFrame(ODD + more, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    table = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op11_turn_repair(spark, path).collect()), key=str)
    assert got == expected(table)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi.", "x"), (1, 1, "user", "Hi.", "x"), (1, 2, "tool", "Ho.", "x"), (1, 3, "user", "Bye.", "x")]
    found, turns = turn_repair.repair(spark.createDataFrame(rows, SCHEMA))
    assert [(r["audit"], r["cost"]) for r in found.collect()] == [("KDRKI", 10)]
    assert [tuple(r) for r in turns.orderBy("position").collect()] == [
        (1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Ho."), (1, 2, "K", "user", "Bye."), (1, 3, "I", "assistant", ""),
    ]


def test_empty_table(spark):
    assert turn_repair.structure(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_ids(spark):
    rows = [(None, 0, "user", "Hi."), ("a", 0, "user", "Hi.")]
    found, _ = turn_repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert sorted((str(r["conv_id"]), r["audit"]) for r in found.collect()) == [("None", "KI"), ("a", "KI")]
