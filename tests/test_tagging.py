"""Project tags worked out by hand: rules, paths, texts, thresholds, fallbacks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomline.operators import tagging


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("src/**", "src/a/b.ts", True), ("src/**", "srcx/a.ts", True), ("src/**", "lib/src/a.ts", False), ("src/*.ts", "src/a/b.ts", True), ("src/*.ts", "src/a.js", False),
        ("src/a", "src/a", True), ("src/a", "src/a/b", True), ("src/a", "src/ab", False), ("SRC\\A", "src/a/b.ts", True), ("*spec*", "x/y.spec.ts", True), ("a.c", "abc", False), ("x/*y/z", "x/q/y/z", True),
    ],
)
def test_rules(spark, pattern, path, fits):
    paths, rules = spark.createDataFrame([("Repo", path)], "repo string, path string"), spark.createDataFrame([("repo", pattern, "p"), ("other", pattern, "q")], "repo string, pattern string, project string")
    assert [r.project for r in tagging.rule_hits(paths, rules).collect()] == ["p"] * fits


def test_scores_and_fallbacks(spark):
    entries = spark.createDataFrame(
        [("Pay", "pay", ["Pay-Core", "invoice", "pay", "x"], ["shop"]), ("Mail", None, ["mailer", "mail"], ["shop", "post"])], "name string, project string, terms array<string>, repos array<string>"
    )
    rules = spark.createDataFrame([("shop", "legacy/**", "old")], "repo string, pattern string, project string")
    chunks = [
        (1, "shop", "src/pay_core/a.ts", "nothing", ["f"]),  # two terms in the path: 60
        (2, "Shop", "a.ts", "An invoice to pay", ["f"]),  # 8 + 4 = 12 in the text
        (3, "post", "a.ts", "invoice to pay by the mailer", ["f"]),  # the entry Pay isn't of this repository; mailer 8 and mail 4
        (4, "shop", "legacy/mail/x.ts", None, None),  # rule 100, path 30
        (5, "shop", "a.ts", "pay", ["f"]),  # 4 points are not enough
        (6, "shop", "a.ts", None, ["f", "g"]),
        (7, "shop", None, "mail", []),
        (8, None, "pay/a.ts", None, None),
    ]
    frame = spark.createDataFrame(chunks, "chunk_id long, repo string, path string, content string, fallback array<string>").withColumn("project", F.lit("x"))
    assert {r.chunk_id: (r.projects, r.how) for r in tagging.projects(frame, entries, rules).collect()} == {
        1: (["pay"], "scored"), 2: (["pay"], "scored"), 3: (["Mail"], "scored"), 4: (["old", "Mail"], "scored"), 5: (["f"], "repo"), 6: ([], "ambiguous"), 7: ([], "none"), 8: ([], "none"),
    }
