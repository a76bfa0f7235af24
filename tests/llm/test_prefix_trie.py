"""Prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fathomline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn, role or "", text or ""))
    mark = lambda t: hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()
    said = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, mark(t)))] for c, ts in said.items()}
    made = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children[p])
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(made[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in (int(c) for c in rng.integers(-12, 60, n)):
        for turn in range(int(rng.integers(1, 14))):
            same = rng.random() < 0.7
            rows.append((conv, None if rng.random() < 0.05 else turn, [None, "user", ""][turn % 3], ["é", None, "", "same"][turn % 4] if same else f"t{rng.integers(4)}"))
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_prefixes(spark, block):
    rows = _rows(60, block) + [(None, 0, "user", "nobody's")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int").repartition(5)
    got = prefix_trie.conversation_trie(frame, block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_shared_first_turns_and_one_long_conversation(spark):
    rows = [(5 * k, t, "user", "hello" if t < 2 else f"{k % 7} {t}") for k in range(150) for t in range(4)]
    rows += [(7, t, "user", f"long {t % 50}") for t in range(1500)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
