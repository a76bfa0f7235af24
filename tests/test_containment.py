"""Names in texts against brute force, both ways, in one piece and in many."""

from __future__ import annotations

import random

import pytest

from fathomline.operators import containment as C


@pytest.mark.parametrize("piece_bytes", [10, 8 << 20])
def test_contained_equals_all_pairs(spark, piece_bytes):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcAé") for _ in range(n))
    names = [word(rnd.randrange(0, 7)) for _ in range(60)] + ["abc", "bc", "ABC"]
    texts = [(k, word(rnd.randrange(0, 60))) for k in range(50)] + [(50, None), (51, ""), (3, "abcabc"), (None, "xabc")]
    frame = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc long, body string, name string").repartition(4)
    got = C.contained(frame, "doc", "body", spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), piece_bytes=piece_bytes).collect()
    low = {n.lower() for n in names if len(n) >= 3}
    want = [(k, n) for k, t in texts for n in low if n in (t or "").lower()]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_loose_matches_both_ways(spark):
    entries = spark.createDataFrame(
        [("Billing", ["invo", "re"], ["pay-core"]), ("Mail", None, ["mailer"]), ("XY", [], None)], "name string, aliases array<string>, repos array<string>"
    )
    questions = spark.createDataFrame([(1, "Where are INVOICES made?"), (2, " Mail "), (3, "y-co"), (4, "re"), (5, None), (6, "use pay-core and the mailer")], "question_id long, text string")
    assert {tuple(r) for r in C.loose_matches(questions, entries).collect()} == {(1, "Billing"), (2, "Mail"), (3, "Billing"), (6, "Billing"), (6, "Mail")}


def test_gaps(spark):
    names = spark.createDataFrame([("Alpha", 1), ("a", 2), ("beta", 3), ("", 4), ("Beta", 5)], "name string, n int")
    texts = spark.createDataFrame([(1, "an ALPHA text"), (2, None)], "id long, t string")
    assert {tuple(r) for r in C.not_contained(names, texts, "id", "t").collect()} == {("beta", 3), ("Beta", 5)}
    assert C.not_contained(names, texts.limit(0), "id", "t").count() == 4
    assert [tuple(r) for r in C.not_triggered(texts, ["id"], "t", names).collect()] == [(2,)]
