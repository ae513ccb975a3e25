"""Conversation repair against a plain reading of its contract and against all edit sequences of short conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from quern.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def marked(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """The least (cost, edits) by recursion over what is left, where a common beginning never changes the order."""

    @lru_cache(None)
    def rest(i, state, inserted):
        best = [(0, "")] if i == len(rows) and state in "ea" else []
        turn = "a" if state == "u" else "u"
        if inserted < 2:
            c, a = rest(i, turn, inserted + 1)
            best.append((c + 2, "I" + a))
        if i < len(rows):
            role, more = rows[i][1], fault[i] == "t"
            c, a = rest(i + 1, state, 0)
            best.append((c + 3, "D" + a))
            if fault[i] not in ("b", "d"):
                c, a = rest(i + 1, turn, 0)
                best.append((c + 2 + more, "R" + a))
                if role[:1] == turn or (role[:1] == "s" and state == "e"):
                    c, a = rest(i + 1, role[:1], 0)
                    best.append((c + more, "K" + a))
        return min(best, default=(10**9, ""))

    for i in range(len(rows), 0, -50):  # from the end on, so that no recursion is deep
        for state in "esua":
            rest(i, state, 0)
    return rest(0, "e", 0)


def applied(rows, audit):
    out, i = [], 0
    for edit in audit:
        turn = "assistant" if out and out[-1][0][0] == "u" else "user"
        if edit == "I":
            out.append((turn, ""))
            continue
        if edit != "D":
            out.append((rows[i][1] if edit == "K" else turn, rows[i][2]))
        i += 1
    assert GRAMMAR.fullmatch("".join(r[0][:1] for r in out)), audit
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain(rows):
    out = []
    for conv, own in damage(rows).items():
        fault = marked(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(tuple(own), tuple(fault))
        out.append((conv, gaps, *[fault.count(f) for f in "bdt"], illegal, cost, audit, applied(own, audit)))
    return out


def made(seed, conversations, length):
    rnd, rows = random.Random(seed), []
    for conv in range(conversations):
        turn = rnd.choice([0, -3])
        for _ in range(rnd.randint(0, length)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No?", "ok", "a\nb!", " \t", "", None, f"t{turn}. ", "x" * 50])
            rows.append((conv, turn if rnd.random() < 0.95 else None, role, text))
            turn += rnd.choice([1, 1, 1, 2, 0])
    return rows


def test_equals_plain(spark):
    rows = made(1, 300, 9) + [(None, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(30)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", fault string").repartition(5)
    found = [tuple(r) for r in turn_repair.report(df).collect()]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)


def test_long_conversation(spark):
    rnd = random.Random(5)
    rows = [(7, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", f"So {i}.", "cut"])) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in turn_repair.report(df).collect()] == plain(rows)


def test_all_dropped_and_empty(spark):
    gone = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(i, 0, "user", "Hello.") for i in gone], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, turn_repair.report(df).collect())) == [(i, 0, 0, 0, 0, 0, 0, "", nothing) for i in gone]
    assert turn_repair.report(df.limit(0)).count() == 0


def test_forward_pass_against_all_edits():
    """Every conversation of up to three rows over roles and faults, against all edit strings with two inserts a gap."""
    inserts = ["", "I", "II"]
    for n in range(4):
        kinds = list(itertools.product(["user", "assistant", "system", "x"], ["", "t", "d"]))
        for case in itertools.product(kinds, repeat=n):
            if n == 3 and hash(case) % 7:
                continue
            best = None
            for edits in itertools.product("DKR", repeat=n):
                for gaps in itertools.product(inserts, repeat=n + 1):
                    audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
                    cost, state, i, good = 0, "e", 0, True
                    for e in audit:
                        turn = "a" if state == "u" else "u"
                        if e == "I":
                            state, cost = turn, cost + 2
                            continue
                        (role, fault), i = case[i], i + 1
                        if e == "D":
                            cost += 3
                            continue
                        cost += (fault == "t") + 2 * (e == "R")
                        good &= fault != "d" and (e == "R" or role[0] == turn or (role[0] == "s" and state == "e"))
                        state = turn if e == "R" else role[0]
                    if good and state in "ea" and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            repair = turn_repair.Repair()
            for role, fault in case:
                repair.row(role, "", fault)
            assert repair.end()[:2] == best, case
