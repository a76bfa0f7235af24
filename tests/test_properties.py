"""Properties that hold for any input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import answers, chunking, documents, ranking


def _texts(seed, n=40):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("ab{}\n\n c;#") for _ in range(rng.randint(0, 120)))) for i in range(n)]


def test_chunks_cover_every_line_once(spark):
    docs = spark.createDataFrame(_texts(1), "id int, content string")
    for made in (chunking.blocks(docs, 3), chunking.sql_statements(chunking.lines(docs), ["id"]), chunking.at_boundaries(chunking.lines(docs), ["id"], F.col("text").startswith("#")), chunking.merge_tiny(chunking.blocks(docs, 3), ["id"])):
        rows = made.orderBy("id", "start_line").collect()
        for i, text in _texts(1):
            assert "\n".join(r.content for r in rows if r.id == i) == text


def test_packing_keeps_the_text(spark):
    docs = spark.createDataFrame(_texts(2), "id int, content string")
    rows = chunking.pack(docs, 20).orderBy("id", "piece").collect()
    for i, text in _texts(2):
        mine = [r.text for r in rows if r.id == i]
        assert "\n".join(mine) == text
        assert all(len(a) + 1 + len(b.split("\n")[0]) > 20 for a, b in zip(mine, mine[1:]))


def test_hashes_depend_on_every_part(spark):
    one = lambda *parts: spark.range(1).select(chunking.content_hash(*map(F.lit, parts))).first()[0]
    assert one("a", 1, 2, "x") == one("a", 1, 2, "x")
    assert len({one("a", 1, 2, "x"), one("b", 1, 2, "x"), one("a", 2, 2, "x"), one("a", 1, 2, "y")}) == 4


def test_top_k_is_a_prefix_of_a_larger_k(spark):
    docs = spark.createDataFrame([(i, t.replace("\n", " ")) for i, t in _texts(3)], "id int, content string")
    questions = spark.createDataFrame([(1, "a b c"), (2, "ab")], "question_id int, text string")
    top = lambda k: [tuple(r) for r in ranking.bm25(docs, questions, "id", {"content": (F.col("content"), 1.0)}, k).orderBy("question_id", "rank").select("question_id", "doc", "rank").collect()]
    assert top(3) == [r for r in top(10) if r[2] <= 3]


def test_dedup_twice_is_dedup_once(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in _texts(4)], "q int, rank int, content string").withColumn("id", F.col("rank"))
    once = ranking.drop_mirrors(rows, ["q"], F.col("content"), ["rank"])
    assert ranking.drop_mirrors(once, ["q"], F.col("content"), ["rank"]).count() == once.count()
    kept = ranking.compact(rows, ["q"], "id", F.col("content"), 100)
    again = ranking.compact(rows.join(kept, ["q", "id"]), ["q"], "id", F.col("content"), 100)
    assert kept.count() == again.count()


def test_object_blocks_balance(spark):
    text = "x\na {\n b {\n }\n}\ny\nc { }\nd {"
    rows = answers.object_blocks(chunking.lines(spark.createDataFrame([(1, text)], "id int, content string")), ["id"]).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.depth) for r in rows] == [(2, 5, 2), (7, 7, 0), (8, 8, 1)]


def test_paths_and_constants(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(answers.resolve_path(F.lit("a/b/c.js"), F.lit("../d/./e"))) == "a/d/e"
    assert one(answers.resolve_path(F.lit("c.js"), F.lit("../../e"))) == "e"
    rows = spark.createDataFrame([(1, "A", None, "/a"), (1, "B", "A", "/b"), (1, "C", "B", "/c"), (1, "X", "Y", "/x"), (1, "Y", "X", "/y"), (1, "U", "none", "/u")], "f int, name string, base string, suffix string")
    got = {r.name: r.value for r in answers.resolve_constants(rows, ["f"]).collect()}
    assert got == {"A": "/a", "B": "/a/b", "C": "/a/b/c", "X": None, "Y": None, "U": None}


def test_manifests_and_comments(spark):
    rows = spark.createDataFrame([(1, '{"name": "p", "scripts": {"b": "x", "a": "y"}}'), (2, "{no"), (3, None), (4, "{}")], "id int, json string")
    got = {(r.id, r.kind, r.name) for r in documents.manifest(rows).collect()}
    assert got == {(1, "scripts", "a"), (1, "scripts", "b"), (2, "parse_error", ""), (3, "parse_error", "")}
    files = spark.createDataFrame([(1, "// keeps the queue\n// in order of time\ncode()\n// const a = 1;\n\n# hi")], "id int, content string")
    assert [(r.start_line, r.end_line, r.content) for r in documents.comment_blocks(files, ["id"]).collect()] == [(1, 2, "keeps the queue\nin order of time")]


def test_markdown_is_stripped(spark):
    text = "## Head\n- **b** `c` [d](http://e)"
    assert spark.range(1).select(documents.plain(F.lit(text))).first()[0] == "Head\nb c d"
    assert spark.range(1).select(T.slug(F.lit("A b, C d e f"))).first()[0] == "a-b-c-d-e"
