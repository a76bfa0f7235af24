"""Operators on small tables of their own: edge cases and properties."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.operators import chunking, extract, graph, index, lifecycle, ranking, registry
from fathomline.sources import files, sinks
from fathomline.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, T.strip(F.lit("\n a\t"))) == "a"
    assert one(spark, T.unique(F.array(*map(F.lit, ["b", " a", "b ", "", "c"])), 2)) == ["b", "a"]
    assert one(spark, T.normalize(F.lit(" A\r\n  b "))) == "a b"
    assert len(one(spark, T.fingerprint(F.lit("x" * 1000)))) == 361
    assert one(spark, T.normalize_route(F.lit("/A/b//"))) == "/a/b" and one(spark, T.normalize_route(F.lit("/"))) == "/"
    assert one(spark, T.common_prefix(F.lit("a/b/c"), F.lit("a/b/d"))) == 2 and one(spark, T.common_prefix(F.lit("a/b"), F.lit("a/b"))) == 2
    assert one(spark, T.head_tail(F.lit("a" * 10), 2, 3)) == "aa\n...\naaa"
    uuid = one(spark, T.uuid_of(F.sha2(F.lit("x"), 256)))
    assert len(uuid) == 36 and uuid[14] == "5" and uuid[19] in "89ab"


def test_front_matter(spark):
    assert one(spark, T.front_matter(F.lit("---\na: b: c\nd: [x, y]\na: z\n---\ntext"))) == {"a": "z", "d": "x, y"}
    assert one(spark, T.front_matter(F.lit("no front matter"))) == {}


def test_blocks_cover_all_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, ""), (3, None)], "id int, content string")
    out = chunking.blocks(docs, 2).orderBy("id", "start_line").collect()
    assert [(r.id, r.start_line, r.end_line, r.content) for r in out] == [(1, 1, 2, "a\nb"), (1, 3, 4, "c\nd"), (1, 5, 5, "e"), (2, 1, 1, "")]


def test_declarations_cover_all_lines_once(spark):
    code = "import x\n\nfunction a() {\n  if (b) {\n  }\n}\nconst y = 1\nclass C {\n  m() {}\n}\n" + "line\n" * 300
    rows = [("s.ts", code), ("n.ts", None), ("open.php", "<?php\nfunction f() {\n" + "x\n" * 200), ("t.txt", "one")]
    out = chunking.declarations(spark.createDataFrame(rows, "path string, content string")).collect()
    for path, text in rows:
        mine = sorted((r for r in out if r.path == path), key=lambda r: r.start_line)
        assert "\n".join(r.content for r in mine) == (text or "")
        assert all(a.end_line + 1 == b.start_line for a, b in zip(mine, mine[1:]))
        assert all(r.end_line - r.start_line < chunking.MAX_LINES for r in mine)
    assert "function a() {\n  if (b) {\n  }\n}" in {r.content for r in out}


def test_packing_is_greedy(spark):
    docs = spark.createDataFrame([(1, "aaa\nbbb\n\ncccccccccccc\nd")], "id int, content string")
    assert [r.text for r in chunking.pack(docs, 8).orderBy("piece").collect()] == ["aaa\nbbb\n", "cccccccccccc", "d"]


@pytest.mark.parametrize("text,noise", [("#ff00aa", True), ("color: red;", True), ("<div class='x'>", True), ("// auto-generated file", True), ("ab", True), ("const value = compute();", False)])
def test_noise(spark, text, noise):
    assert one(spark, chunking.is_noise(F.lit(text))) is noise


def test_facts_of_a_file(spark):
    code = 'router.post("/users", f)\nINSERT INTO users VALUES (1)\nDB.query("select * from where")\n@Cron("0 * * * *")\nawait fetch("http://x/y")'
    frame = spark.createDataFrame([(1, code)], "file_id int, content string")
    got = {(r.line, r.kind, r.operation, r.name) for r in extract.facts(frame).collect()}
    assert {(1, "route", "declare", "/users"), (2, "table", "insert", "users"), (4, "cron", "decorator", "0 * * * *"), (5, "http", "fetch", "http://x/y")} <= got
    assert not any(k == "table" and n == "where" for _, k, _, n in got)


def test_incremental_run_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "hash string, v int")
    assert index.fresh(rows, rows, "hash").count() == 0 and index.stale(rows, rows, "hash").count() == 0
    assert sorted(index.upsert(rows, rows, "hash").collect()) == sorted(rows.collect())


def test_merge_last_and_adjacent_repeats(spark):
    old = spark.createDataFrame([("k", 1, "x"), ("o", 1, "y")], "key string, pos int, v string")
    new = spark.createDataFrame([("k", 0, "z")], "key string, pos int, v string")
    assert {(r.key, r.v) for r in index.merge_last(old, new, "key", "pos").collect()} == {("k", "z"), ("o", "y")}
    log = spark.createDataFrame([("d", i, v) for i, v in enumerate([None, None, "a", "a", "b", "a"])], "key string, pos int, v string")
    assert [(r.v, r.version) for r in index.drop_adjacent_repeats(log, "key", ["pos"], "v").orderBy("pos").collect()] == [(None, 1), ("a", 2), ("b", 3), ("a", 4)]


def test_shared_identifiers_count_links(spark):
    edges = spark.createDataFrame([("r1", "T"), ("r1", "t"), ("r2", "t"), ("r3", "u")], "repo string, tab string")
    assert sorted(tuple(r) for r in graph.shared_identifiers(edges, F.col("tab")).collect()) == [("t", "r1", 1), ("t", "r2", 1)]


def test_diversity_penalty(spark):
    rows = spark.createDataFrame([(1, i, "g", 100.0 - i) for i in range(6)], "q int, rank int, grp string, score double")
    out = {r.rank: r.score for r in ranking.diversity(rows, ["q"], "grp").collect()}
    assert out == {0: 100.0, 1: 99.0, 2: 68.0, 3: 37.0, 4: 6.0, 5: 5.0}


def test_path_rules(spark):
    for path, rule, want in [("a/b/c", "a/**", True), ("ab/c", "a/**", False), ("a/x.ts", "a/*.ts", True), ("a/b/x.ts", "a/*.ts", False), ("a/b", "a", True), ("ab", "a", False)]:
        assert one(spark, registry.path_rule_matches(F.lit(path), F.lit(rule))) is want


def test_rate_limit_windows_open_at_the_first_event_after_the_end(spark):
    at = [0, 1, 2, 10, 11, 12, 25]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = lifecycle.rate_limit(rows, "user_id", "ts", "event_id", 10, 2).orderBy("event_id").collect()
    assert [r.allowed for r in out] == [True, True, False, False, True, True, True]


def test_repository_scan(spark, tmp_path):
    for name, content in {"src/a.ts": b"const a = 1", "node_modules/x.ts": b"no", "b.bin": b"no", "bin.ts": b"a\x00b", "blank.md": b"  \n", "skip/c.ts": b"no", "Makefile": b"all:"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert {r.path for r in files.repository(spark, str(tmp_path), ["skip/", "# note"]).collect()} == {"src/a.ts", "Makefile"}
    assert {r.path.split("/")[-1] for r in files.markdown(spark, str(tmp_path)).collect()} == {"blank.md"}


def test_git_log(spark):
    text = ["abcdef1|Ann|2024-01-02|fix: a|b", "src/a.ts", "src/b.ts", "", "abcdef2|Bob|2024-01-01|first"]
    out = files.git_log(spark.createDataFrame([("r", i, x) for i, x in enumerate(text)], "repo string, pos int, line string")).orderBy("sha").collect()
    assert [(r.sha, r.author, r.message, r.files) for r in out] == [("abcdef1", "Ann", "fix: a|b", ["src/a.ts", "src/b.ts"]), ("abcdef2", "Bob", "first", [])]


def test_edges_registry_and_sinks(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id": "1", "type": "DEFINES_SYMBOL", "symbol": "f"}\n')
    assert files.edges(spark, str(tmp_path / "e.jsonl")).first().symbol == "f"
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"name": "a"}, {"name": "b"}]}))
    assert files.json_entries(spark, str(tmp_path / "r.json")).count() == 2
    chunks = spark.createDataFrame([("r", "m", "1"), ("r", "n", "2"), ("s", "m", "3")], "repo string, branch string, chunk_id string")
    sinks.write_scopes(chunks, str(tmp_path / "t"))
    sinks.write_scopes(chunks.limit(0).unionByName(spark.createDataFrame([("r", "m", "9")], chunks.schema)), str(tmp_path / "t"))
    assert {r.chunk_id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"9", "2", "3"}
    assert sinks.delete_scope(spark, str(tmp_path / "t"), str(tmp_path / "u"), "r") == 2
    sinks.append_log(chunks, str(tmp_path / "log"))
    sinks.append_log(chunks, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i % 3, i * 700, "a" if i % 2 else "b") for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k in range(3):
        frame.filter((F.col("event_id") >= 20 * k) & (F.col("event_id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), 10)
    q = events.rate_limited(stream, 5000, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.user_id, r.event_id, r.allowed) for r in lifecycle.rate_limit(frame, "user_id", "ts", "event_id", 5000, 2).collect()}
    assert {tuple(r) for r in spark.table("limited").collect()} == want
    q = events.windowed_counts(stream, "1 hour").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("counted").collect()) == 60
