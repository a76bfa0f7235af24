"""Offsets of chat parts: windows of whole dialogues against sums by spans, crowded parts and many participants."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.llm import chat


def test_offsets_by_spans_equal_one_window(spark, monkeypatch):
    rows = [(1, t % 200 if t % 11 else None, f"s{t % 3}", f"text {t}") for t in range(900)] + [(1, 5, "s1", f"crowd {k}") for k in range(400)] + [(None, k, "a", "x") for k in range(50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    order = ["conv_id", "perspective", "part"]
    want = chat.rotate(turns, block=4).orderBy(*order).collect()
    split = chat._offsets
    monkeypatch.setattr(chat, "_offsets", lambda sized: split(sized, most=10, span=3))
    assert chat.rotate(turns, block=4).orderBy(*order).collect() == want
    for _, parts in spark.createDataFrame(want).groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("part", "start", "n_chars"))).alias("p")).select("conv_id", "p").collect():
        at = 0
        for k, part in enumerate(parts):
            assert (part["part"], part["start"]) == (k, at)
            at += part["n_chars"]


def test_a_dialogue_of_very_many_participants(spark):
    rows = [(1, k, f"speaker {k}", f"I am {k}") for k in range(300)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=64)
    assert got.groupBy("perspective").agg(F.sum("n_trained").alias("n")).filter("n = 1").count() == 300
    assert got.count() == 300 * 5
