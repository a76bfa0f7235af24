"""Steps whose work grows with rows, not with pairs of rows: results against plain loops on inputs where all rows share a name."""

from __future__ import annotations

import re

import duckdb
from pyspark.sql import functions as F

from fathomline.operators import asking as A
from fathomline.operators import doctor
from fathomline.operators import extract as E
from fathomline.operators import graph as G
from fathomline.operators import lexical as L
from fathomline.operators import source_rules as R
from fathomline.operators import vectors as V
from fathomline.plans import asking, context, fixtures, inventory, retrieval, sources
from fathomline.plans.hints import points
from fathomline.session import spread

from .conftest import SF


def test_few_bytes_of_many_rows_are_dealt_out(spark):
    assert sources.load(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 4
    assert fixtures.load(spark, "/root/testdata/sf0.1", "files").rdd.getNumPartitions() > 4
    rows = spread(spark.range(0, 5000, 1, 1))
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 5000
    assert spread(spark.range(0)).count() == 0


def test_a_name_that_all_files_call_and_define(spark):
    n = 1500
    found = [("r", f, "DEFINES_SYMBOL", f % 7, None, None, "go") for f in range(n)] + [("r", f, "CALLS_SYMBOL", 9, "main", "x", "go") for f in range(n)]
    found += [("r", 3, "CALLS_SYMBOL", 9, "only", "x", "go"), ("r", 0, "CALLS_SYMBOL", 9, "first", None, "go"), ("r", 0, "CALLS_SYMBOL", 8, "first", None, "go")]
    found += [("s", 5, "DEFINES_SYMBOL", 1, None, None, "own"), ("s", 5, "CALLS_SYMBOL", 2, "own", "x", "own"), ("s", 6, "CALLS_SYMBOL", 2, None, "x", "own"), ("s", 6, "CALLS_SYMBOL", 2, "f", "x", "unknown")]
    df = spark.createDataFrame(found, "repo string, file_id long, type string, line int, from_symbol string, receiver string, name string")
    got = {(r["repo"], r["from_symbol"], r["receiver"], r["callee"], r["n_targets"], r["first_target"]) for r in R.call_targets(df, ["repo"], "file_id").collect()}
    assert got == {("r", "main", "x", "go", n, 0), ("r", "only", "x", "go", n - 1, 0), ("r", "first", None, "go", n - 1, 1)}


def test_patterns_name_a_word_of_their_matches():
    """The line of each pattern holds its word, so no match is passed over."""
    lines = {
        "declare": "APP app.get('/a')", "decorate": "@Get('/a')", "handle": 'http.HandleFunc("/a"', "constant": "const A = '/a'; const AB", "select": "FROM a", "join": "Join a", "insert": "INSERT INTO a", "update": "Update a SET",
        "create": "CREATE TABLE a", "delete": "DELETE FROM a", "publish": "sendToQueue('a') x.publish('a')", "consume": "x.consume('a')", "assert": "assertQueue('a') assertExchange('a')",
        "read": "process.env.A process.env['A'] os.Getenv('A')", "config": "process.env.A || 'b'", "node-cron": "cron.schedule('a')", "decorator": "@Cron('a')", "interval": "setInterval(a", "axios": "axios.get('a')",
        "fetch": "fetch('a')", "call": "rpc.call('a')", "function": "function a", "class": "interface a",
    }
    for p in E.ALL:
        found = re.search(p.regex, lines[p.operation])
        assert found and p.word in found.group(0).lower(), p


def test_facts_are_looked_for_once(spark):
    files = spark.createDataFrame([(1, "x")], "file_id long, content string")
    plan = E.facts(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sendToQueue") == 1


def test_gates_give_the_hints_that_were_left_out(spark):
    rows = {r["question_id"] % 10: r for r in asking.question_gates(spark, SF).collect()}
    assert (rows[7]["platform"], rows[8]["region"], rows[9]["region"], rows[9]["reward"]) == ("P5", "north", "south", 1)
    assert (rows[0]["platform"], rows[0]["region"], rows[0]["reward"]) == (None, None, 0)


def test_entries_of_one_key_share_their_hops(spark):
    edges = [(k, "CALL", None, "k:a" if k % 3 else "k:b") for k in range(60)] + [(100 + k, "STEP", "k:a" if k % 2 else "k:b", f"t:{k % 4}") for k in range(20)]
    edges += [(200 + k, "CALL", f"t:{k % 4}", "k:a") for k in range(12)] + [(300, "STEP", None, None)]
    rows = spark.createDataFrame(edges, "id long, type string, from_key string, to_key string")
    hops = [("STEP", 4), ("CALL", 5), ("STEP", 3)]

    def walk(entry):
        out, seen, front = [(entry[0], 0, entry[0], (entry[0],))], {entry[0]}, [(entry[3], (entry[0],))]
        for hop, (kind, cap) in enumerate(hops, 1):
            new = {}
            for key, path in front:
                for e in edges:
                    if e[1] == kind and e[2] is not None and e[2] == key and e[0] not in seen:
                        new.setdefault(e[0], (e[3], (*path, e[0])))
            some = sorted(new)[:cap]
            out += [(entry[0], hop, e, new[e][1]) for e in some]
            front, seen = [new[e] for e in some], seen | set(some)
        return out

    for kind in ("CALL", "STEP"):
        got = sorted((r["entry"], r["hop"], r["edge"], tuple(r["path"])) for r in G.paths(rows.filter(F.col("type") == kind), rows, hops).collect())
        assert got == sorted(x for e in edges if e[1] == kind for x in walk(e))


def test_entries_of_one_key_are_joined_once(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "CALL", None, "k") for k in range(500)] + [(1000 + k, "STEP", "k", "t") for k in range(3)], "id long, type string, from_key string, to_key string")
    sizes, real = [], G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: sizes.append((made := real(df)).count()) or made)
    assert G.paths(rows.filter("type = 'CALL'"), rows, [("STEP", 3)]).count() == 2000
    assert sizes == [1, 3]


def test_points_of_a_cell_in_several_batches(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.filter("vec_id % 50 = 0")
    near = lambda *a, **b: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in V.topk(*a, **b).collect())
    want = near(e, asked, 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert near(e, asked, 10, block=3) == want
        one = asked.filter("vec_id = 0")  # a single query, whose id is 0
        assert near(e, one, 10) == [x for x in want if x[0] == 0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_that_all_questions_and_routes_hold(spark):
    asked = [(q, [w for w in ("a", "b", f"q{q % 5}", "c") if (q + len(w)) % 4 or w == "a"]) for q in range(40)]
    held = [(f"r{i}", [w for w in ("a", f"q{i % 5}", "b", "z", "c") if (i + ord(w[0])) % 3 or w == "a"]) for i in range(30)]
    got = A.shared_words(spark.createDataFrame(asked, "q long, terms array<string>"), spark.createDataFrame(held, "item string, parts array<string>"), "q", "terms", "item", "parts")
    want = sorted((q, t, i, len(set(t) & set(p))) for q, t in asked for i, p in held if len(set(t) & set(p)) >= 2)
    assert sorted((r["q"], r["terms"], r["item"], r["n"]) for r in got.collect()) == sorted(want)


def test_files_widened_by_shared_tables(spark):
    touched = {(f, f"r{f % 3}", t) for f in range(60) for t in ("stock" if f % 4 else f"own{f}", f"t{f % 7}", f"only{f}", f"pair{f // 2}", f"alone{f}" if f % 5 else "stock")}
    touched |= {(f, f"r{f % 3}", f"lonely{f}") for f in range(60, 66)} | {(66, "r0", "t1"), (66, "r0", "own0")}
    first = [(q, f) for q in range(25) for f in {q, (q * 7) % 66, 60 + q % 7}] + [(99, 1000)]
    tables, files = {}, {}
    for f, r, t in touched:
        tables.setdefault(f, set()).add((r, t))
        files.setdefault((r, t), set()).add(f)
    want = []
    for q in sorted({q for q, _ in first}):
        named = {f for k, f in first if k == q}
        seen = set().union(*(tables.get(f, set()) for f in named))
        more = set().union(*(files[s] for s in seen)) - named if seen else set()
        new = {t for f in more for _, t in tables[f]} - {t for _, t in seen}
        want.append((q, len(named), len(more), len(new)))
    got = A.widened(spark.createDataFrame(first, "question_id long, file_id long"), spark.createDataFrame(sorted(touched), "file_id long, repo string, tab string"))
    assert sorted(map(tuple, got.collect())) == want


def test_questions_of_the_same_terms_are_asked_once(spark):
    p = points(spark, SF)
    name = A.named_points(p).filter("kind = 'table' AND name LIKE 'item%'").agg(F.min("name")).head()[0]
    q = spark.createDataFrame([(k, f"Which services use the database table {name if k % 2 else 'none'}?") for k in range(40)], "question_id long, question string")
    found = A.rerank(q, p, 5)
    one = {(r["rank"], r["file_id"], r["score"]) for r in A.rerank(q.filter("question_id = 1"), p, 5).collect()}
    assert one and all({(r["rank"], r["file_id"], r["score"]) for r in found.filter(f"question_id = {k}").collect()} == one for k in (1, 39))
    assert "min(member" in found._jdf.queryExecution().optimizedPlan().toString()  # one asks for all


def test_names_of_vocabularies_are_counted_before_they_are_asked_for(spark):
    plan = context.vocabulary_hits(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [name")


def test_lists_of_a_point_are_made_once(spark):
    plan = asking.fallback_context(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Schema::(?:create") == 1


def test_best_documents_of_lists_and_own_terms(spark, monkeypatch):
    """Blocks, lists and terms of few questions against all pairs; ties, documents of one kind of term, questions of none."""
    monkeypatch.setattr(L, "FEWEST_DOCS", 20)
    monkeypatch.setattr(L, "LISTS", 3)
    held = [(d, t, w) for d in range(150) for t, w in [("of", 0.25), (f"c{d % 7}", 1.5), (f"c{d % 5}x", 0.75), (f"own{d % 40}", 2.0 + d % 3), (f"own{d % 9}", 0.125)] if (d + len(t)) % 6]
    held = sorted({(d, t): (d, t, w) for d, t, w in held}.values()) + [(500 + d, f"own{d}", 0.5) for d in range(30)]
    asked = [(q, t) for q in range(60) for t in {"of", f"c{q % 7}", f"c{q % 3}x", f"own{q}", f"own{(q * 3) % 60}"} if (q + len(t)) % 5] + [(70, "none"), (71, "own3"), (71, "own4")]
    of = {}
    for d, t, w in held:
        of.setdefault(t, []).append((d, w))
    want = []
    for q in sorted({q for q, _ in asked}):
        sums = {}
        for t in {t for k, t in asked if k == q}:
            for d, w in of.get(t, ()):
                sums[d] = sums.get(d, 0) + w
        want += [(q, d, x, n) for n, (d, x) in enumerate(sorted(sums.items(), key=lambda p: (-p[1], p[0]))[:6], 1)]
    held = [(d, t, w / 2) for d, t, w in held for _ in range(2)]  # what a document holds comes by field
    got = L.best(spark.createDataFrame(held, "doc long, asked string, s double"), spark.createDataFrame(asked, "question_id long, asked string"), 180, 6)
    assert sorted((r["question_id"], r["doc"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)


def test_terms_far_from_those_asked_for_get_no_keys_of_two_edits(spark, monkeypatch):
    made, real = [], L.two_edit_keys
    monkeypatch.setattr(L, "two_edit_keys", lambda term: made.append(term) or real(term))
    found = L.expanded(spark.createDataFrame([("validatesmalrng",)], "asked string"), spark.createDataFrame([("validatesmallring",), *((f"handlepart{10000 + k}",) for k in range(300))], "term string"))
    assert made and [tuple(r)[:2] for r in found.collect()] == [("validatesmalrng", "validatesmallring")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_once_for_a_search(spark, monkeypatch):
    calls, real = [], L.counted
    monkeypatch.setattr(L, "counted", lambda *a, **b: calls.append(1) or real(*a, **b))
    monkeypatch.setattr(L, "lengths", lambda *a: calls.append(1))  # lengths come with the tokens
    found = retrieval.bm25_topk(spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "MapInArrow" not in plan and "Window" not in plan


def test_lengths_come_with_tokens(spark):
    rows = L.counted(spark.createDataFrame([(1, "a b a"), (2, "")], "doc long, text string"), "doc", {"text": F.col("text")}, totals=True)
    assert sorted((r["doc"], r["term"] or "", r["tf"], r["len"]) for r in rows.collect()) == [(1, "", 0, 3), (1, "a", 2, 3), (1, "b", 1, 3), (2, "", 0, 0)]


def test_rows_of_a_block_are_not_gathered_in_lists(spark, monkeypatch):
    """What documents hold streams to a block's task; a list of it would be objects on the heap, 3 GB and more at 250,000 documents."""
    plans, real = [], L.checkpointed
    monkeypatch.setattr(L, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    held = spark.createDataFrame([(d, f"t{d % 3}", 1.0 + d) for d in range(30)], "doc long, asked string, s double")
    asked = spark.createDataFrame([(q, f"t{t}") for q in range(9) for t in range(3)], "question_id long, asked string")
    found = {(r["question_id"], r["doc"]) for r in L.best(held, asked, 30, 2).collect()}
    assert found == {(q, d) for q in range(9) for d in (28, 29)}
    (blocks,) = [p for p in plans if "MapInArrow" in p]
    assert "collect_list" not in blocks.split("MapInArrow")[1].split("Union")[0]


def test_rules_are_tried_on_lines_with_their_words():
    """Each rule's own example holds one of its words, in capitals as well where the rule allows them."""
    lines = ["fastify.all('/a", "@Patch('a", "http.HandleFunc('/a", "SELECT x FROM a", "JOIN a", "INSERT INTO a", "UPDATE a SET", "DELETE FROM a", "CREATE TABLE a", "DB::table('a", "x.sendToQueue('a", "x.QueueDeclare('a", "x.publish('a",
             "process.env.A", "process.env['A", "getenv('A", "process.env.A ?? 'b", "cron.schedule('a", "@Cron('a", "@Cron(CronExpression.A", "setInterval(a, 5", "axios.get('a", "fetch('a", "got.post('a", "httpService.put('a", "curl_init('a"]
    for rule, line in zip(doctor.RULES, lines, strict=True):
        found = re.search(rule.pattern, line)
        assert found and any(w in found.group(0).lower() for w in rule.words), rule


def test_facts_of_some_kinds_are_those_of_all(spark):
    files = sources.load(spark, SF)
    every = {tuple(r) for r in doctor.doctor_facts(files, ["file_id"]).collect()}
    for kinds in (("api",), ("rabbitmq",), ("database", "env"), ("config", "cron", "http")):
        some = doctor.doctor_facts(files, ["file_id"], kinds=kinds)
        assert {tuple(r) for r in some.collect()} == {r for r in every if r[2] in kinds} != set()
    assert "httpService" not in doctor.doctor_facts(files, ["file_id"], kinds=("cron",))._jdf.queryExecution().optimizedPlan().toString()


def test_points_are_never_broadcast(spark, monkeypatch):
    """Spark takes points for as few bytes as the table they are made from has; the driver of 1.2 million had to hold their texts."""

    def nodes(n):
        yield n
        for i in range(n.children().size()):
            yield from nodes(n.children().apply(i))

    def rows(most):
        monkeypatch.setattr(A, "MOST_NAMES", most)
        found = asking.strong_evidence(spark, SF)
        sent = [n for n in nodes(found._jdf.queryExecution().executedPlan().initialPlan()) if n.nodeName() == "BroadcastExchange"]
        assert sent and not any("ExistingRDD" in m.nodeName() for n in sent for m in nodes(n))
        return sorted(map(tuple, found.collect()))

    assert rows(500_000) == rows(0) != []  # names of questions broadcast or dealt out


def test_an_inventory_has_every_kind_with_its_first_and_last_name(spark, monkeypatch):
    files = [(1, "a", "x.ts", "ch.assertExchange('orders')\nch.publish('audit')\nch.publish('orders')\nprocess.env.PORT"), (2, "b", "y.ts", "fetch('http://s')"), (3, "b", "z.md", "nothing")]
    monkeypatch.setattr(inventory, "load", lambda *_: spark.createDataFrame(files, "file_id long, repo string, path string, content string"))
    got = inventory.evidence_inventory(spark, SF)
    rows = {r["repo"]: r.asDict() for r in got.collect()}
    assert {p.kind for p in E.ALL} <= set(got.columns)
    assert [rows["a"][c] for c in ("exchange", "exchange_first", "exchange_last", "env", "env_last", "http")] == [2, "audit", "orders", 1, "PORT", None]
    assert [rows["b"][c] for c in ("exchange", "exchange_last", "http", "http_first")] == [None, None, 1, "http://s"]
    texts = " UNION ALL ".join(f"SELECT {k} AS file_id, '{r}' AS repo, '{p}' AS path, '{c.replace(chr(39), chr(39) * 2)}' AS content" for k, r, p, c in files)
    want = duckdb.sql(inventory.ORACLE["evidence_inventory"].replace(fixtures.FILES, texts))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
