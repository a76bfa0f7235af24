"""Repair of conversations against a plain search over audits, in one block and in many."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """By conversation, the turns (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    mark = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    return {c: sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, mark(t[1], t[2]))) for c, ts in out.items()}


def plain_repair(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) by the least (cost, audit) of each state."""
    counts, seen, faults = [0, 0, 0], set(), []
    for _, role, text in turns:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault is not None:
            counts[fault] += 1
    step = {("b", "s"): "s", ("b", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"b": (0, "", ())}

    def offer(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def inserted(found):
        for _ in range(4):
            for state, (cost, audit, said) in list(found.items()):
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to:
                        offer(found, to, (cost + 5, audit + "I", (*said, (role, ""))))
        return found

    best = inserted(best)
    for (_, role, text), fault in zip(turns, faults, strict=True):
        found = {}
        for state, (cost, audit, said) in best.items():
            offer(found, state, (cost + 2, audit + "D", said))
            if fault in (0, 1):
                continue
            more = 5 if fault == 2 else 0
            for new, price, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                to = step.get((state, new[:1]))
                if to:
                    offer(found, to, (cost + price + more, audit + letter, (*said, (new, text))))
        best = inserted(found)
    cost, audit, said = min((best[s] for s in "ba" if s in best), key=lambda v: v[:2])
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest)


def _rows(found):
    return sorted(((r["conv_id"] is None, r["conv_id"] or 0, *list(r)[1:]) for r in found.collect()))


def _want(turns_by_conv, convs):
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return sorted((c is None, c or 0, *(plain_repair(turns_by_conv[c]) if turns_by_conv.get(c) else empty)) for c in convs)


def _odd(n, seed, convs=40):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "agent"]
    texts = ["Yes.", "No?", "Half a", "", " \t", "So!  \n", None, "One. Two", "é." * 30, "x.\x0b"]
    rows = []
    for _ in range(n):
        conv = None if rng.random() < 0.05 else int(rng.integers(-3, convs))
        rows.append((conv, None if rng.random() < 0.05 else int(rng.integers(0, 25)), roles[rng.integers(10)], texts[rng.integers(10)] if rng.random() < 0.5 else f"{rng.integers(99)}."))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [3, 256])
def test_odd_rows_equal_the_plain_search(spark, block):
    rows = _odd(600, block)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit(1)).repartition(5)
    assert _rows(repair.damage_and_repair(frame, block)) == _want(plain_damage(rows), {r[0] for r in rows})


def test_one_conversation_holds_most_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(7, k, ["user", "assistant"][(k + (rng.random() < 0.2)) % 2], f"{rng.integers(40)}" + ".?"[: rng.integers(0, 3)]) for k in range(900)]
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"{k} {t}.") for k in range(100, 150) for t in range(4)]
    got = _rows(repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA).repartition(6), 16))
    assert got == _want(plain_damage(rows), {r[0] for r in rows})


def test_all_lost_and_empty(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = repair.damage_and_repair(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)).collect()
    assert list(got[0]) == [lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_take_the_least_audit(spark):
    def one(*turns):
        return repair.repair(spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], SCHEMA)).collect()[0]

    # user, user, assistant: deleting either user turn costs 2; D comes before K
    assert (one(("user", "A."), ("user", "B."), ("assistant", "C."))["audit"], one(("user", "A."))["audit"]) == ("DKK", "D")
    # a system turn that can't stay first
    assert one(("user", "A."), ("assistant", "B."), ("system", "C."))["audit"] == "KKD"
    assert one(("assistant", "A."), ("user", "B."), ("assistant", "C."), ("user", "D."))["cost"] == 4


def test_ranks_are_those_of_the_audits():
    rng = np.random.default_rng(2)
    counts = np.array([5, 1, 12])
    graph = repair.Graph(counts, rng.integers(0, 4, 18), rng.random(18) < 0.2, rng.random(18) < 0.3, np.array([True, True, True]))
    letter, rank, pointers = graph.paths(graph.costs(np.tile(repair.ACCEPTED, (3, 1))))
    audits = []
    for node in range(len(letter)):
        text = ""
        while letter[node]:
            text += repair.LETTERS[letter[node] - 1]
            node = pointers[0][node]
        audits.append(text)
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == rank.tolist()
