"""The lexical index: inexact terms against brute force, updates against rebuilds, pruned scans, stopped runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import lexical as L


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _edited(word: str, n: int, rnd: random.Random) -> str:
    for _ in range(n):
        k = rnd.randrange(len(word) + 1)
        word = rnd.choice([word[:k] + rnd.choice("abc1") + word[k:], word[: max(0, k - 1)] + word[k:], word[:k] + "z" + word[k + 1 :]])
    return word


def test_expansion_equals_all_pairs(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 9, 13, 14, 15, 16, 23, 24, 25, 26, 31, 40, 58, 70]))) for _ in range(150)]
    terms = sorted({w for w in words} | {_edited(w, rnd.randrange(0, 9), rnd) for w in words for _ in range(3)} | {w + "x" for w in words[:20]} - {""})
    terms = [t for t in terms if t]
    asked = sorted(set(words) | {_edited(w, 1, rnd) or "a" for w in words[:60]})
    got = {(r["asked"], r["term"]): r["weight"] for r in L.expanded(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {}
    for a in asked:
        most = min(int(len(a) * 0.1 + 0.5), 6)
        for t in terms:
            if t.startswith(a):
                want[a, t] = 1.0 if a == t else 0.375 * len(t) / (len(t) + 0.3 * (len(t) - len(a)))
            elif abs(len(a) - len(t)) <= most and most and (d := _distance(a, t)) <= most:
                want[a, t] = 0.45 * len(t) / (len(t) + d)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert sum(len(a) >= 25 and a != t and not t.startswith(a) for a, t in want) > 20  # long terms with three edits and more are among them




def fields():
    return {"name": (F.col("name"), 4.0), "content": (F.col("content"), 1.0)}


NOW = [(k, f"load item{k % 9}" if k % 3 else None, f"text {k} with words word{k % 7} and more") for k in range(60)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, name string, content string")


def _found(spark, index, inexact=True):
    questions = spark.createDataFrame([(1, "lod item3"), (2, "word5 mor"), (3, "outdated"), (4, ""), (5, None)], "question_id long, text string")
    return sorted(map(tuple, L.search(spark, index, questions, 8, inexact).collect()))


def test_update_equals_rebuild(spark, tmp_path):
    before = [(k, n, c + " outdated" * (k % 5 == 0)) for k, n, c in NOW if k % 4] + [(99, "gone", "outdated")]
    first = L.build(_frame(spark, before), f"file://{tmp_path}/a", "doc", fields())
    assert {q for q, *_ in _found(spark, first)} == {1, 2, 3}
    second = L.update(_frame(spark, NOW), first, "doc", fields())
    rebuilt = L.build(_frame(spark, NOW), f"file://{tmp_path}/b", "doc", fields())
    assert _found(spark, second) == _found(spark, rebuilt) and _found(spark, second, False) == _found(spark, rebuilt, False)
    assert L.latest(spark, f"file://{tmp_path}/a") == second
    # what didn't change stays in its segment
    kept = {r["doc"] for r in second.live(spark).filter("segment = 0").collect()}
    assert kept == {k for k, *_ in NOW if k % 4 and k % 5}


def test_a_stopped_update_changes_nothing(spark, tmp_path):
    first = L.build(_frame(spark, NOW), f"file://{tmp_path}/a", "doc", fields())
    want = _found(spark, first)
    L._write_segment(_frame(spark, [(1, "load", "word5 word5")]), L.Index(first.folder, 1, first.fields), "doc", {n: x for n, (x, _) in fields().items()})
    assert L.latest(spark, first.folder) == first and _found(spark, first) == want
    # and the run that follows starts its segment anew
    assert _found(spark, L.update(_frame(spark, NOW), first, "doc", fields())) == want


def test_search_reads_asked_buckets(spark, tmp_path):
    index = L.build(_frame(spark, NOW), f"file://{tmp_path}/a", "doc", fields())
    plan = index.postings(spark, spark.createDataFrame([("word5",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_index(spark, tmp_path):
    index = L.build(_frame(spark, []), f"file://{tmp_path}/a", "doc", fields())
    assert _found(spark, index) == []


@pytest.mark.parametrize(
    ("text", "path", "names", "terms", "points"),
    [
        ("the limit is set", "a.ts", [], ["limit"], 4),
        ("const x = 'limit'", "a.ts", [], ["limit"], 4 + 5),
        ("{ limit : 3 }", "a.ts", [], ["limit"], 4 + 4),
        ("limits", "a.ts", [], ["limit"], 1),
        ("my_limit", "a.ts", [], ["limit"], 1),  # an underscore belongs to the word
        ("other", "a.ts", ["Limit"], ["limit"], 5),
        ("min max limit", "a.ts", [], ["min", "max", "limit"], 3 * 4 + 2 * 12 + 20),
        ("min\nmax", "a.ts", [], ["min", "max"], 2 * 4),  # a phrase is told by one space
        ("of the limit", "a.ts", [], ["of", "the", "limit"], 3 * 4 + 12),  # terms of two characters make no phrases
        ("xmin maxy", "a.ts", [], ["min", "max"], 2 * 1 + 12),
        ("what limit means", "vocabulary://limit", ["limit"], ["limit", "means"], 5 + 4 + 12 + 25 + 5),
        ("", "a.ts", [], ["limit", ""], 0),
    ],
)
def test_exact_points_worked_out_by_hand(text, path, names, terms, points):
    from fathomline.operators.ranking import ExactText

    assert ExactText(text, path, names).score(terms) == points
