from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import near_dup
from fathomline.llm.components import components
from fathomline.llm.shingles import shingle_sets

SCHEMA = "doc_id bigint, text string"


def brute_sets(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    """doc_id -> (set size, component), all pairs."""
    sets = {i: brute_sets(t, size) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, size=4, percent=80):
    out = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size, percent).collect()
    want = brute(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_groups_of_near_copies_match_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_one_large_group_around_the_threshold(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for n in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
        rows.append((n, " ".join(copy)))
    check(spark, rows)


def test_special_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "É a b c d"), (7, "é a b c d"), (8, "x " * 50_000), (9, "x " * 60_000)]
    check(spark, rows)


def test_empty_table_null_ids_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame(
        [(1, "a b c d e f", True, 7), (1, "a b c d e f", False, 7), (None, "a b c d e f", True, 8)],
        "doc_id bigint, text string, kept boolean, node int",
    )
    out = near_dup.near_duplicates(docs)
    assert out.columns == ["doc_id", "text", "node", "n_shingles", "component_id", "kept"]
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in out.collect()), key=str) == [(1, 1, True), (1, 1, True), (None, None, False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x1c\u00a0", max_size=40)), max_size=8), st.integers(1, 6))
def test_shingle_sets_have_the_size_of_word_sets(texts, size):
    got = [len(s) for s in shingle_sets(pa.array(texts, pa.string()), size)]
    assert got == [len(brute_sets(t, size)) for t in texts]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    bounds = near_dup.least_matches(80)
    a = rng.integers(0, 256, (4000, near_dup.SIZE), dtype=np.uint8)
    same = rng.random(a.shape) < 0.8
    b = np.where(same, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert near_dup.plausible(a, b, bounds).all()
    assert not near_dup.plausible(a, rng.integers(0, 256, a.shape, dtype=np.uint8), bounds).any()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}
