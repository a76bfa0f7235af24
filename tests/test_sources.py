"""Rules on source text against rows written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import asking, doctor, file_chunks, source_rules, vectors

PHP = """<?php
class Pay extends Model {
  const BASE = '/v1';
  public function go($r) {
    $x = $_POST['id'];
    $this->bus->publish('pay.exchange', 'pay.done');
    if ($x >= 3) { throw new ValidationError('bad'); }
    DB::table('payments')->get();
    $this->http->postParams('notify', $x);
  }
}"""
GO = """package main
// SELECT * FROM hidden
func (s *Server) Start(n int) error {
	http.HandleFunc("/up", up)
	rows := db.Query("SELECT id FROM users JOIN roles ON true")
	q := os.Getenv("QUEUE")
	return nil
}"""
ROUTES = """const list = [
  {
    method: ['GET'],
    alias: 'x',
    url: '/a/b/',
    handler: things.list,
  },
  { method: ['POST'], url: '/a', handler: things.add },
  { url: '/orphan', handler: things.none },
];"""


def frame(spark, *files):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(files)], "file_id int, path string, content string")


def test_hints_of_two_languages(spark):
    rows = frame(spark, ("pay.php", PHP), ("main.go", GO), ("none", ""), ("null", None)).withColumn("h", source_rules.hints(F.col("content"))).orderBy("file_id").collect()
    php, go, none, null = (r.h for r in rows)
    assert php.routes == ["/v1"] and php.symbols == ["go", "Pay", "BASE"]
    assert php.message_names == ["pay.exchange", "pay.done"] and php.exchange_names == ["pay.exchange", "pay.done"] and php.queue_names == []
    assert go.routes == ["/up"] and go.db_tables == ["hidden", "users", "roles"] and go.message_names == ["QUEUE"]
    assert all(x == [] for x in none) and all(x is None or x == [] for x in null)


def test_hints_keep_twenty_in_order(spark):
    text = "\n".join(f"function f{k}() {{}}" for k in range(30)) + "\nfunction f0() {}"
    (row,) = frame(spark, ("a.js", text)).select(source_rules.hints(F.col("content")).alias("h")).collect()
    assert row.h.symbols == [f"f{k}" for k in range(20)]


def test_evidence_labels(spark):
    files = [("src/pay.controller.php", PHP), ("main.go", GO), ("README.md", "x"), ("a.bin", "x"), ("db/migration/1.sql", "create table t"), ("run.sh", "crontab -l")]
    rows = frame(spark, *files).select("path", source_rules.evidence(F.col("path"), F.col("content")).alias("e")).collect()
    got = {r.path: r.e for r in rows}
    assert got["src/pay.controller.php"] == ["db_model", "controller", "api_route", "rabbitmq_publisher"]
    assert got["main.go"] == ["env_config", "raw_sql", "api_route"]
    assert got["README.md"] == ["documentation"] and got["a.bin"] == ["unknown"]
    assert got["db/migration/1.sql"] == ["raw_sql", "migration"] and got["run.sh"] == ["cron_job", "shell_script"]


def test_line_facts(spark):
    rows = source_rules.line_facts(frame(spark, ("p", PHP + "\n  $x = $_POST['id'];\n// return nothing here\nimport thing from 'else';\n" + "y" * 221))).orderBy("line").collect()
    assert [(r.line, r.category, r.confidence) for r in rows] == [
        (3, "constant", "confirmed"), (5, "input", "confirmed"), (6, "message", "confirmed"), (7, "validation", "confirmed"), (8, "database", "confirmed"),
    ]
    many = "\n".join(f"return value number {k};" for k in range(40))
    assert source_rules.line_facts(frame(spark, ("p", many))).count() == 24


def test_edges_have_their_definition(spark):
    rows = source_rules.edges(frame(spark, ("p", PHP)), ["file_id"]).collect()
    got = {(r.type, r.line, r.from_symbol, r.receiver, r.name) for r in rows}
    assert ("DEFINES_SYMBOL", 4, None, None, "go") in got
    assert ("CALLS_EXTERNAL_FUNC", 9, "go", None, "notify") in got
    assert not any(r.type == "CALLS_SYMBOL" for r in rows)  # arrows aren't dots
    js = "run(a) {\n  client.send(1);\n  console.log(2);\n  list.map(x);\n  rpc({ func: 'getX' });\n}\nconst t = 'update stock set a';"
    got = {(r.type, r.line, r.from_symbol, r.receiver, r.name) for r in source_rules.edges(frame(spark, ("p", js)), ["file_id"]).collect()}
    assert got == {
        ("DEFINES_SYMBOL", 1, None, None, "run"), ("CALLS_SYMBOL", 2, "run", "client", "send"), ("CALLS_RPC_FUNC", 5, "run", None, "getX"), ("TOUCHES_TABLE", 7, None, None, "stock"),
    }


def test_doctor_facts(spark):
    rows = doctor.doctor_facts(frame(spark, ("g", GO), ("r", ROUTES), ("p", PHP)), ["file_id"]).collect()
    got = {(r.file_id, r.line, r.kind, r.operation, r.name, r.detail) for r in rows}
    assert {x for x in got if x[0] == 0} == {(0, 4, "api", "any", "/up", ""), (0, 5, "database", "select", "users", ""), (0, 5, "database", "select", "roles", ""), (0, 6, "env", "read", "QUEUE", "")}
    assert {x for x in got if x[0] == 1} == {(1, 5, "api", "get", "/a/b/", ""), (1, 8, "api", "post", "/a", "")}
    assert (2, 8, "database", "query", "payments", "") in got
    far = "method: ['GET'],\n" + "\n" * 12 + "url: '/late'"
    assert doctor.doctor_facts(frame(spark, ("f", far)), ["file_id"]).count() == 0


def test_chunks_by_language():
    of = lambda path, text: [c[:6] for c in file_chunks.chunks_of(path, text)]
    body = "".join(f"    step{k}();\n" for k in range(6))
    ts = f"import x;\nexport class A {{\n  a = 1;\n  run(q) {{\n{body}  }}\n  stop() {{\n{body}  }}\n}}\nfunction free() {{\n{body}}}\n"
    kinds = [(c[2], c[3], c[4]) for c in of("a.ts", ts)]
    assert kinds == [("method", "run", "A"), ("method", "stop", "A"), ("function", "free", None)]  # the header alone is too small
    assert of("a.go", GO) == [(3, 8, "method", "Start", "Server", False)]
    assert [c[2:5] for c in of("a.php", PHP)] == [("class", "Pay", None), ("method", "go", "Pay")]
    long = "\n".join("x" * 10 for _ in range(300))
    assert [c[:2] for c in of("a.txt", long)] == [(1, 120), (118, 240), (238, 300)]
    unclosed = "function open() {\n" + "  a;\n" * 200
    assert [c[:2] for c in of("a.js", unclosed)] == [(1, 120)]
    assert of("a.md", "") == [] and of("a.sql", "select 1;") == []
    yaml = "\n".join(f"key{k}:\n" + "  - v\n" * 59 for k in range(3))
    assert len(of("a.yaml", yaml)) == 3


def test_chunks_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "text only\n" * 20, "x"), (2, "a.ts", None, "x"), (2, "a.ts", None, "x")], "file_id int, path string, content string, symbol string")
    out = file_chunks.chunk_files(rows, ["file_id"]).collect()
    assert [(r.file_id, r.chunk_type) for r in out] == [(1, "block")]
    assert file_chunks.chunk_files(rows.limit(0), ["file_id"]).collect() == []


def test_vocabulary_and_trees(spark):
    php = "$states = ['new' => 1, 'paid' => 2, 'late' => 3];\nconst FEW = { A: 1, B: 2 };\nconst MANY = { A: 'x', B: 'y', C: 'z' };"
    rows = asking.vocabulary(frame(spark, ("p", php)), ["file_id"]).collect()
    assert {(r.group_name, r.kind, r.term, r.value) for r in rows} == {
        ("states", "php", "new", "1"), ("states", "php", "paid", "2"), ("states", "php", "late", "3"), ("MANY", "object", "A", "x"), ("MANY", "object", "B", "y"), ("MANY", "object", "C", "z"),
    }
    tree = '{"type":"doc","content":[{"type":"heading","content":[{"type":"text","text":"T"}]},{"type":"paragraph","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]},{"type":"rule"}]}'
    got = spark.createDataFrame([(tree,), ("no tree",), (None,)], "t string").select(asking.adf_text(F.col("t")).alias("x")).collect()
    assert got[0].x == "T\nab\n" and got[2].x in (None, "")


def test_nearest_points_in_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(200, [0.0] * 4), (201, None)]
    frame_ = spark.createDataFrame(points, "vec_id long, embedding array<float>").repartition(5)
    got = vectors.topk(frame_, frame_.filter("vec_id % 20 = 0"), 6, block=3).collect()
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in points[:200]}
    for q in range(0, 200, 20):
        want = sorted((-unit[q] @ unit[i], i) for i in unit if i != q)[:6]
        mine = sorted((r.rank, r.point_id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for _, i in want]


def test_inverted_lists_reach_nine_tenths_of_the_neighbours(spark, tmp_path):
    from .conftest import SF

    points = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = points.filter("vec_id % 50 = 0")
    want = {(r.query_id, r.point_id) for r in vectors.topk(points, queries, 10).collect()}
    lists = vectors.fit_lists(points)
    vectors.build_lists(points, lists, f"file://{tmp_path}/lists")
    stored = spark.read.parquet(f"file://{tmp_path}/lists")
    assert stored.count() == stored.select("id").distinct().count() == points.count()  # every row is in one list
    got = vectors.search_lists(spark, f"file://{tmp_path}/lists", lists, queries, 10).collect()
    assert len({(r.query_id, r.point_id) for r in got} & want) >= 0.9 * len(want)
    # cells and blocks change nothing, and probing all lists is exact
    small = vectors.search_lists(spark, f"file://{tmp_path}/lists", lists, queries, 10, block=2, cell_rows=7).collect()
    assert sorted((r.query_id, r.rank, r.point_id) for r in small) == sorted((r.query_id, r.rank, r.point_id) for r in got)
    every = vectors.Lists(lists.centres, len(lists.centres))
    assert {(r.query_id, r.point_id) for r in vectors.search_lists(spark, f"file://{tmp_path}/lists", every, queries, 10).collect()} == want


def test_lists_of_few_equal_and_no_points(spark, tmp_path):
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(30)] + [(30, [0.0, 0.0]), (31, None)], "vec_id long, embedding array<float>")
    for name, frame_ in (("same", same), ("none", same.limit(0))):
        lists = vectors.fit_lists(frame_, 3)
        vectors.build_lists(frame_, lists, f"file://{tmp_path}/{name}")
        got = vectors.search_lists(spark, f"file://{tmp_path}/{name}", lists, frame_.filter("vec_id < 2 OR vec_id >= 30"), 3).collect()
        assert sorted((r.query_id, r.point_id) for r in got) == ([] if name == "none" else [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3)])
