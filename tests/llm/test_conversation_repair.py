"""Repaired conversations against a search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from cloakwork.llm import conversation_repair


def hurt(rows):
    """Damaged turns by conversation, in order."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = role or " " if role is None else role, " " if text is None else text
        mine = by.setdefault(conv, [])
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(at, text)
        mine += [(turn, "user" if at == 4 else role, text)] * {0: 0, 3: 2}.get(at, 1)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, mine in by.items():
        of = digest("" if conv is None else f"={conv}")
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(of + digest(t[1]) + t[2])))
    return by


def repaired(turns):
    """Cheapest first, then by audit: every edit of every turn, with up to two insertions before each and at the end."""
    seen, faults = set(), []
    for _, role, text in turns:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    best = {("", 0): (0, "", ())}  # by the initials' state and the turn: cost, audit, result

    def state_after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    for i in range(len(turns) + 1):
        for _ in range(2):
            for (state, at), (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    if at == i and (to := state_after(state, role[0])):
                        new = (cost + 5, audit + "I", (*out, (role, "")))
                        best[to, i] = min(best.get((to, i), new), new)
        if i == len(turns):
            break
        _, role, text = turns[i]
        for (state, at), (cost, audit, out) in list(best.items()):
            if at != i:
                continue
            ways = [(state, (cost + 2, audit + "D", out))]
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                ways += [(state_after(state, role[:1]), (cost + extra, audit + "K", (*out, (role, text))))]
                ways += [(state_after(state, r[0]), (cost + extra + 1, audit + "R", (*out, (r, text)))) for r in ("user", "assistant")]
            for to, new in ways:
                if to is not None:
                    best[to, i + 1] = min(best.get((to, i + 1), new), new)
    cost, audit, out = min(best[s, len(turns)] for s in ("", "a") if (s, len(turns)) in best)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def report(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, key string, part int")
    found = conversation_repair.repair_report(conversation_repair.damaged(frame), **how)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in found.collect()}


@pytest.mark.parametrize(("chunk", "parts"), [(512, None), (2, 5), (1, 3)])
def test_every_edit(spark, chunk, parts):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "cut off", " ", "", "Why? \n", "More.", None, "é…", "long " * 5000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = [(rng.choice([*range(40), None]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += rows[:25] + [(100, t, ("assistant", "user")[t % 2], f"turn {t}.") for t in range(23)] + [(101, 3, "user", "Hm")] * 9 + [(102, 0, "user", "gone.")]
    rows += [(200 + c, t, "user", "all gone.") for c in range(60) for t in (0,)]
    want = {conv: repaired(turns) for conv, turns in hurt(rows).items()}
    got = report(spark, rows, chunk=chunk, parts=parts)
    assert got == want
    assert any(audit == "" for *_, audit, _ in want.values()) and {"K", "R", "D"} <= set("".join(w[-2] for w in want.values()))


def test_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b!", f"{t}.", f"{t}"])) for t in range(3000)]
    assert report(spark, rows, chunk=64, parts=9) == {1: repaired(hurt(rows)[1])}


def test_turns_and_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    found = conversation_repair.repair(spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "system", "S."), (1, 2, "user", "Q?"), (1, 2, "user", "Q?")], kind))
    assert [(r.conv_id, r.edit, r.role, r.text) for r in found.turns.orderBy("part", "chunk", "item").collect()] == [(1, "R", "user", "S."), (1, "R", "assistant", "Q?")]
    assert found.summary.first().audit == "DRRD"
    assert report(spark, []) == {}
    plan = conversation_repair.repair(spark.createDataFrame([], kind)).turns._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
