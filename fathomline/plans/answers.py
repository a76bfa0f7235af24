"""Queries: evidence for questions about routes, symbols, queues, schedules, tables and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import extract as E
from ..session import read
from .extraction import _facts_sql
from .fixtures import load, with_sql


def route_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route definitions of parts written as objects; every third has no alias."""
    alias = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("alias: 'a"), "p_size", F.lit("', ")))
    text = F.concat(F.lit("{method: ['GET'], "), alias, F.lit("url: '/p/"), "p_partkey", F.lit("', handler: 'Part.show'}"))
    return read(spark, sf_dir, "part").select("p_partkey", A.route_object(text).alias("r")).select("p_partkey", "r.*")


def required_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative imports against their file's path."""
    relative = F.when(F.col("file_id") % 2 == 0, F.lit("../lib/./util")).otherwise(F.lit("./models//Item"))
    return load(spark, sf_dir, "files").select("file_id", A.resolve_path(F.col("path"), relative).alias("target"))


def constant_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as constants: each builds on the one of a tenth of its key, the first nine on nothing, key 17 on itself."""
    n = F.col("s_suppkey")
    base = F.when(n < 10, None).when(n == 17, "C17").otherwise(F.concat(F.lit("C"), F.floor(n / 10).cast("string")))
    rows = read(spark, sf_dir, "supplier").select(F.lit(1).alias("file"), F.concat(F.lit("C"), n.cast("string")).alias("name"), base.alias("base"), F.concat(F.lit("/"), n.cast("string")).alias("suffix"))
    return A.resolve_constants(rows, ["file"]).select("name", "value")


def object_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.object_blocks(C.lines(load(spark, sf_dir, "files").select("file_id", "content")), ["file_id"])


def json_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of each part split at its top-level keys."""
    text = F.concat(F.lit('{\n  "name": "'), "p_name", F.lit('",\n  "deps": {\n    "a": 1\n  },\n  "size": '), "p_size", F.lit("\n}"))
    return C.at_boundaries(C.lines(read(spark, sf_dir, "part").select("p_partkey", text.alias("content"))), ["p_partkey"], A.begins_json_key(F.col("text")))


def fact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a fact, with a stable hash, by kind of fact."""
    facts = E.facts(load(spark, sf_dir, "files"), E.TABLES + E.SCHEDULES + E.MESSAGING)
    text = F.format_string("[%s] %s %s in %s:%d", "kind", "operation", "name", "path", "line")
    return facts.select("file_id", "kind", text.alias("text"), F.sha2(F.concat(F.lit("doctor-fact-v1:"), text), 256).alias("hash"))


def method_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers by what they do."""
    numbered = C.lines(load(spark, sf_dir, "files").select("file_id", "content"))
    windows = D.method_windows(numbered, ["file_id"], r"^async function ([A-Za-z0-9_]+)\(", 8)
    return windows.select("file_id", "name", F.array_join(A.traits(F.col("content")), ",").alias("traits"))


def endpoint_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every declared route the facts of its file in the eight lines after it, by kind."""
    files = load(spark, sf_dir, "files")
    facts = E.facts(files, E.ALL)
    routes = E.facts(files, tuple(p for p in E.ROUTES if p.operation == "declare")).select("file_id", T.normalize_route(F.col("name")).alias("route"), F.col("line").alias("at"))
    near = facts.join(routes, "file_id").filter((F.col("line") > F.col("at")) & (F.col("line") <= F.col("at") + 8))
    return near.groupBy("route", "kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def symbol_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function: where it is, how long, which tables it uses."""
    files = load(spark, sf_dir, "files")
    windows = D.method_windows(C.lines(files.select("file_id", "path", "content")), ["file_id", "path"], r"^async function ([A-Za-z0-9_]+)\(", 120)
    tables = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:FROM|UPDATE) ([a-z_0-9]+)"), F.lit(1))))
    return windows.select("name", F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("place"), (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), F.array_join(tables, ",").alias("tables"))


def queue_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with the files whose queue is one of the tens, none included."""
    queues = E.facts(load(spark, sf_dir, "files"), E.MESSAGING)
    return A.matched_by_group(queues.select("repo", "name", F.lpad(F.col("file_id").cast("string"), 6, "0").alias("file")), "repo", F.col("name").rlike(r"^queue\.[0-9]0\."), "file")


def schedule_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules by the hint terms that they and their path hold, best fourteen."""
    crons = E.facts(load(spark, sf_dir, "files"), E.SCHEDULES)
    text = F.lower(F.concat_ws(" ", "path", "name"))
    terms = F.array(*map(F.lit, ("brand_11", "*/1", "src/brand_1")))
    scored = crons.select("file_id", "name", A.term_score(text, terms, 12, 20, 60).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "file_id").limit(14)


def table_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's repositories, operations and first file."""
    found = E.facts(load(spark, sf_dir, "files"), E.TABLES)
    return found.groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"), F.min(F.struct("path", "line")).alias("at")
    ).select("name", "repos", "operations", F.concat_ws(":", "at.path", F.col("at.line").cast("string")).alias("first"))


def migration_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by their first event of every type, in order of time; a missing time would count as 0."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("at"))
    w = Window.partitionBy("event_type", F.floor(F.col("at") / 86_400_000_000)).orderBy("at", "event_id")
    return e.withColumn("k", F.row_number().over(w)).filter("k = 1").select("event_type", "event_id", "at")


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories by tables that no other repository uses: number and the first ten."""
    used = E.facts(load(spark, sf_dir, "files"), E.TABLES).select("repo", "name").distinct()
    alone = used.groupBy("name").agg(F.count("*").alias("n"), F.min("repo").alias("repo")).filter("n = 1")
    w = Window.partitionBy("repo").orderBy("name")
    ranked = alone.withColumn("k", F.row_number().over(w))
    return ranked.groupBy("repo").agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.col("name")))), ",").alias("names"))


def auto_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry entry for every repository: kind and its most used tables and queues."""
    facts = E.facts(load(spark, sf_dir, "files"), E.TABLES + E.MESSAGING + E.SCHEDULES).groupBy("repo", "kind", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo", "kind").orderBy(F.desc("n"), "name")
    top = facts.withColumn("k", F.row_number().over(w)).filter("k <= 5")
    names = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("k") <= (3 if kind == "queue" else 5)), F.col("name")))), ",")
    kind = F.when(F.max(F.when(F.col("kind") == "cron", 1)) == 1, "scheduler").when(F.max(F.when(F.col("kind") == "queue", 1)) == 1, "worker").otherwise("service")
    return top.groupBy("repo").agg(kind.alias("kind"), names("table").alias("tables"), names("queue").alias("queues"))


def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the question's terms that they hold, best twenty; ties by repository and id."""
    e = load(spark, sf_dir, "edges")
    terms = F.array(*map(F.lit, ("table_1", "repo-3", "file-12")))
    score = A.term_score(F.lower(F.concat_ws(" ", "repo", "tab", "path")), terms, 12, 30)
    return e.select("id", "repo", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "repo", "id").limit(20)


def concept_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold all concept tokens, with points for routes and symbols; best twelve."""
    f = load(spark, sf_dir, "files")
    low = F.lower("content")
    tokens = F.array(*map(F.lit, ("part", "queue.1", "items")))
    score = A.term_score(low, tokens, 2, 8) + F.when(low.contains("app.get"), 8).otherwise(0) + F.when(F.col("path").contains("brand_1"), 3).otherwise(0)
    return f.filter(F.forall(tokens, lambda t: low.contains(t))).select("file_id", score.alias("score")).orderBy(F.desc("score"), "file_id").limit(12)


def decision_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's decision after its last event, the number of changes, and whether it was rolled back."""
    e = read(spark, sf_dir, "events").withColumn("status", F.expr("CASE event_type WHEN 'signup' THEN 'draft' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rolled_back' END")).filter("status IS NOT NULL")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = e.withColumn("b", F.lag("status").over(w)).filter("b IS NULL OR b <> status")
    return changed.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_changes"), F.bool_or(F.col("status") == "rolled_back").alias("rolled_back"))


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted names that a dictionary knows, in its spelling."""
    known = read(spark, sf_dir, "nation").select(F.col("n_name").alias("known"), F.lower("n_name").alias("k"))
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.concat(F.lit("nation_"), F.col("c_nationkey"))).alias("k"))
    return asked.join(known, "k").select("c_custkey", "known")


QUERIES = {
    f.__name__: f
    for f in (
        route_objects, required_paths, constant_chains, object_blocks, json_sections, fact_chunks, method_traits, endpoint_detail, symbol_answer, queue_answer, schedule_discovery,
        table_explorer, migration_timeline, gap_report, auto_registry, graph_context, concept_anchors, decision_lifecycle, known_names,
    )
}

_LINES = "l AS (SELECT file_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"
_TRAITS = ", ".join("CASE WHEN regexp_matches(c, '" + r.replace("'", "''") + f"') THEN '{n}' END" for n, r in A.TRAITS)
_SCORE = lambda text, terms, each, all_: " + ".join(f"CASE WHEN contains({text}, '{t}') THEN {w} ELSE 0 END" for t, w in zip(terms, each)) + f" + CASE WHEN {' AND '.join(f'contains({text}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN {all_} ELSE 0 END"
ORACLE = {
    "route_objects": "SELECT p_partkey, 'GET' AS method, CASE WHEN p_partkey % 3 <> 0 THEN 'a' || p_size END AS alias, '/p/' || p_partkey AS url, 'Part.show' AS handler FROM part",
    "required_paths": with_sql(
        "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'src/lib/util' ELSE regexp_replace(path, '/[^/]*$', '') || '/models/Item' END AS target FROM files"
    ),
    "constant_chains": """WITH RECURSIVE r AS (SELECT s_suppkey AS k, '/' || s_suppkey AS value FROM supplier WHERE s_suppkey < 10
        UNION ALL SELECT s_suppkey, value || '/' || s_suppkey FROM supplier JOIN r ON s_suppkey // 10 = r.k AND s_suppkey >= 10 AND s_suppkey <> 17)
        SELECT 'C' || s_suppkey AS name, value FROM supplier LEFT JOIN r ON k = s_suppkey""",
    "object_blocks": with_sql("SELECT file_id, 3 AS start_line, 10 AS end_line, 1 AS depth FROM files"),
    "json_sections": """SELECT p_partkey, 1 AS start_line, 1 AS end_line, '{' AS content FROM part UNION ALL SELECT p_partkey, 2, 2, '  "name": "' || p_name || '",' FROM part
        UNION ALL SELECT p_partkey, 3, 5, '  "deps": {' || chr(10) || '    "a": 1' || chr(10) || '  },' FROM part UNION ALL SELECT p_partkey, 6, 7, '  "size": ' || p_size || chr(10) || '}' FROM part""",
    "fact_chunks": with_sql(
        _facts_sql(E.TABLES + E.SCHEDULES + E.MESSAGING)
        + "SELECT file_id, kind, t AS text, sha256('doctor-fact-v1:' || t) AS hash FROM (SELECT *, '[' || kind || '] ' || operation || ' ' || name || ' in ' || path || ':' || line AS t FROM facts)"
    ),
    "method_traits": with_sql(
        f"""WITH {_LINES}, w AS (SELECT file_id, string_agg(text, chr(10) ORDER BY line) AS c FROM l WHERE line BETWEEN 3 AND 10 GROUP BY file_id)
        SELECT file_id, 'handlePart' || file_id AS name, array_to_string(list_filter([{_TRAITS}], lambda x: x IS NOT NULL), ',') AS traits FROM w"""
    ),
    "endpoint_detail": with_sql(
        _facts_sql(E.ALL) + "SELECT '/api/part/' || file_id AS route, kind, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM facts WHERE line BETWEEN 3 AND 10 GROUP BY ALL"
    ),
    "symbol_answer": with_sql(
        """SELECT 'handlePart' || file_id AS name, path || ':3' AS place, 10 AS n_lines, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?:FROM|UPDATE) ([a-z_0-9]+)', 1))), ',') AS tables
        FROM files"""
    ),
    "queue_answer": with_sql(
        _facts_sql(E.MESSAGING).rstrip()
        + """, m AS (SELECT repo, lpad(file_id::VARCHAR, 6, '0') AS file, regexp_matches(name, '^queue[.][0-9]0[.]') AS m FROM facts),
        k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN m THEN 0 ELSE 1 END, file) AS k FROM m)
        SELECT repo, count(*) AS total, count(*) FILTER (WHERE m) AS matched, coalesce(string_agg(file, ',' ORDER BY file) FILTER (WHERE m AND k <= 8), '') AS samples FROM k GROUP BY repo"""
    ),
    "schedule_discovery": with_sql(
        f"""{_facts_sql(E.SCHEDULES)} SELECT file_id, name, score FROM (SELECT file_id, name, ({_SCORE("lower(path || ' ' || name)", ("brand_11", "*/1", "src/brand_1"), (12, 60, 60), 20)}) AS score FROM facts)
        WHERE score > 0 ORDER BY score DESC, file_id LIMIT 14"""
    ),
    "table_explorer": with_sql(
        _facts_sql(E.TABLES)
        + """SELECT name, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations,
        min_by(path || ':' || line, struct_pack(p := path, l := line)) AS first FROM facts GROUP BY name"""
    ),
    "migration_timeline": "SELECT event_type, event_id, epoch_us(ts) AS at FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) = 1",
    "gap_report": with_sql(
        _facts_sql(E.TABLES).rstrip()
        + """, a AS (SELECT name, min(repo) AS repo FROM facts GROUP BY name HAVING count(DISTINCT repo) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY name) AS k FROM a)
        SELECT repo, count(*) AS n_missing, string_agg(name, ',' ORDER BY name) FILTER (WHERE k <= 10) AS names FROM k GROUP BY repo"""
    ),
    "auto_registry": with_sql(
        _facts_sql(E.TABLES + E.MESSAGING + E.SCHEDULES).rstrip()
        + """, n AS (SELECT repo, kind, name, count(*) AS n FROM facts GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY n DESC, name) AS k FROM n QUALIFY k <= 5)
        SELECT repo, CASE WHEN bool_or(kind = 'cron') THEN 'scheduler' WHEN bool_or(kind = 'queue') THEN 'worker' ELSE 'service' END AS kind,
        coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'table'), '') AS tables, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'queue' AND k <= 3), '') AS queues FROM k GROUP BY repo"""
    ),
    "graph_context": with_sql(
        f"""SELECT id, repo, score FROM (SELECT id, repo, ({_SCORE("lower(repo || ' ' || tab || ' ' || path)", ("table_1", "repo-3", "file-12"), (12, 12, 12), 30)}) AS score FROM edges)
        WHERE score > 0 ORDER BY score DESC, repo, id LIMIT 20"""
    ),
    "concept_anchors": with_sql(
        f"""SELECT file_id, ({_SCORE("lower(content)", ("part", "queue.1", "items"), (2, 2, 2), 8)}) + 8 + CASE WHEN contains(path, 'brand_1') THEN 3 ELSE 0 END AS score FROM files
        WHERE contains(lower(content), 'part') AND contains(lower(content), 'queue.1') AND contains(lower(content), 'items') ORDER BY score DESC, file_id LIMIT 12"""
    ),
    "decision_lifecycle": """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'draft' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rolled_back' END AS status FROM events),
        c AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e WHERE status IS NOT NULL)
        SELECT user_id, max_by(status, struct_pack(t := ts, i := event_id)) AS status, count(*) AS n_changes, bool_or(status = 'rolled_back') AS rolled_back FROM c WHERE b IS NULL OR b <> status GROUP BY user_id""",
    "known_names": "SELECT c_custkey, n_name AS known FROM customer JOIN nation ON lower(n_name) = 'nation_' || c_nationkey",
}
