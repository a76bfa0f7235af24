"""Queries: hints, evidence, line facts and edges of source files, each beside SQL with its own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import source_rules as R
from .sources import load, with_sources

HINT_LISTS = ("routes", "symbols", "message_names", "queue_names", "exchange_names", "db_tables")


def points(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """The source files as index points: six name lists and evidence labels beside the file's own columns.

    once: the lists are evaluated before what reads them, so a condition on several isn't put together from their patterns;
    without it, lists that nothing reads are never made.
    """
    files, h = load(spark, sf_dir).withColumn("evidence", R.evidence(F.col("path"), F.col("content"))), R.hints(F.col("content"))
    if once:
        return files.select("*", F.inline(F.array(h)))
    return files.withColumn("h", h).select("*", "h.*").drop("h")


def chunk_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("file_id", *(F.array_join(c, "|").alias(c) for c in HINT_LISTS))


def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("file_id", F.array_join("evidence", ",").alias("labels"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_facts(load(spark, sf_dir).select("file_id", "content"))


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edges(load(spark, sf_dir), ["file_id"])


def bm25_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that an index of identifiers takes: with a name of some kind, or documentation, configuration, migration."""
    p = points(spark, sf_dir, once=True)
    named = (F.size("symbols") > 0) | (F.size("db_tables") > 0) | (F.size("queue_names") > 0) | (F.size("routes") > 0)
    marked = F.arrays_overlap("evidence", F.array(F.lit("documentation"), F.lit("env_config"), F.lit("migration")))
    return p.filter((F.col("content") != "") & (named | marked)).select("file_id", "repo", "path", F.left("content", F.lit(500)).alias("content"))


def shared_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues named in several repositories: members of the class, first file of each and the number of links it has."""
    one = points(spark, sf_dir).select("repo", "file_id", F.explode("queue_names").alias("queue")).withColumn("queue", F.lower("queue"))
    firsts = one.groupBy("queue", "repo").agg(F.min("file_id").alias("first_file"))
    sizes = firsts.groupBy("queue").agg(F.count("*").alias("n_repos")).filter("n_repos > 1")
    return firsts.join(sizes, "queue").select("queue", "repo", "first_file", (F.col("n_repos") - 1).alias("n_links"))


def calls_to_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, the symbol calls below them and the definitions these lead to in other files of the repository."""
    found = R.edges(load(spark, sf_dir), ["repo", "path", "file_id"])
    return R.call_targets(found, ["repo"], "file_id")


def rpc_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote and external calls of each definition, by kind; at most 12 names each."""
    found = R.edges(load(spark, sf_dir), ["file_id"]).filter(F.col("type").isin("CALLS_RPC_FUNC", "CALLS_EXTERNAL_FUNC") & F.col("from_symbol").isNotNull())
    return found.groupBy("from_symbol", "type").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 12), ",").alias("names"), F.countDistinct("name").alias("n"))


def edge_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges a question about projects p1 and p2 may use.

    An edge's own project tags decide; an ambiguous tag source rules it out; without tags its repository has to be of a project.
    """
    e = R.edges(load(spark, sf_dir), ["file_id", "repo"]).filter("type = 'TOUCHES_TABLE'")
    k = F.col("file_id") % 5
    tags = F.when(k < 2, F.array(F.concat(F.lit("p"), (F.col("file_id") % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    ambiguous = k == 2
    wanted = F.array(F.lit("p1"), F.lit("p2"))
    allowed = F.when(F.size(tags) > 0, F.arrays_overlap(tags, wanted)).when(ambiguous, False).otherwise(F.col("repo").isin("repo-1", "repo-2", "repo-5"))
    return e.filter(allowed).select("file_id", "repo", "line", "name")


QUERIES = {
    "chunk_hints": chunk_hints,
    "evidence_labels": evidence_labels,
    "line_facts": line_facts,
    "symbol_edges": symbol_edges,
    "bm25_eligible": bm25_eligible,
    "shared_queues": shared_queues,
    "calls_to_models": calls_to_models,
    "rpc_out": rpc_out,
    "edge_scope": edge_scope,
}

# The SQL states the rules again, in DuckDB's own terms.
_Q = """["''`]"""
_NOTQ = """[^"''`]+"""


def _once(lists: str) -> str:
    return f"list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 20) FROM (SELECT file_id, list_filter(list_transform({lists}, lambda x: trim(x)), lambda x: x <> '') AS l FROM sources)"


def _near(words: str) -> str:
    return f"regexp_extract_all(array_to_string(list_filter(string_split(content, chr(10)), lambda s: regexp_matches(lower(s), '{words}')), chr(10)), '{_Q}([A-Za-z][A-Za-z0-9_.:-]{{1,80}}){_Q}', 1)"


_LISTS = {
    "routes": rf"""list_filter(list_concat(
        regexp_extract_all(content, '(app|router|route)\s*\.\s*(get|post|put|patch|delete|any)\s*\(\s*{_Q}({_NOTQ}){_Q}', 3, 'i'),
        regexp_extract_all(content, '@(Get|Post|Put|Patch|Delete|All)\s*\(\s*{_Q}({_NOTQ}){_Q}', 2),
        regexp_extract_all(content, 'http\.HandleFunc\s*\(\s*{_Q}({_NOTQ}){_Q}', 1),
        regexp_extract_all(content, '\$route\[[^\]]+\]\s*=\s*{_Q}({_NOTQ}){_Q}', 1, 'i'),
        regexp_extract_all(content, '{_Q}(/[A-Za-z0-9_./:{{}}-]+){_Q}', 1)), lambda r: starts_with(r, '/'))""",
    "symbols": r"""list_concat(
        regexp_extract_all(content, '\b(function|func)\s+([A-Za-z_]\w*)\s*\(', 2), regexp_extract_all(content, '\bclass\s+([A-Za-z_]\w*)', 1),
        regexp_extract_all(content, '\bstruct\s+([A-Za-z_]\w*)', 1), regexp_extract_all(content, '\btype\s+([A-Za-z_]\w*)\s+struct\b', 1),
        regexp_extract_all(content, '\b(public|private|protected)\s+function\s+([A-Za-z_]\w*)\s*\(', 2),
        regexp_extract_all(content, '\bconst\s+([A-Z][A-Z0-9_]*)\s*=', 1), regexp_extract_all(content, '\b([A-Za-z_]\w*::[A-Z][A-Z0-9_]*)\b', 1))""",
    "message_names": f"list_concat({_near('rpc|call|command|event|message|handler|publish|consume|routing|queue|amqp|rabbit')}, regexp_extract_all(content, '@(EventPattern|MessagePattern)\\s*\\(\\s*{_Q}({_NOTQ}){_Q}', 2))",
    "queue_names": rf"""list_concat(regexp_extract_all(content, '(queue|queueName|queue_name)\s*[:=]\s*{_Q}({_NOTQ}){_Q}', 2, 'i'),
        regexp_extract_all(content, '(assertQueue|QueueDeclare|queue_declare|basic_consume)\s*\(\s*{_Q}({_NOTQ}){_Q}', 2, 'i'), {_near('queue|basic_consume|assertqueue|queuedeclare')})""",
    "exchange_names": rf"""list_concat(regexp_extract_all(content, '(exchange|exchangeName|exchange_name)\s*[:=]\s*{_Q}({_NOTQ}){_Q}', 2, 'i'),
        regexp_extract_all(content, '(assertExchange|ExchangeDeclare|exchange_declare)\s*\(\s*{_Q}({_NOTQ}){_Q}', 2, 'i'), {_near('exchange|basic_publish|publishexchange')})""",
    "db_tables": rf"""list_concat(regexp_extract_all(content, '\b(from|join|into|update|table)\s+{_Q}?([A-Za-z_][A-Za-z0-9_.]*){_Q}?', 2, 'i'),
        regexp_extract_all(content, '\bcreate\s+table\s+(if\s+not\s+exists\s+)?{_Q}?([A-Za-z_][A-Za-z0-9_.]*){_Q}?', 2, 'i'),
        regexp_extract_all(content, '@Entity\s*\(\s*{_Q}({_NOTQ}){_Q}', 1), regexp_extract_all(content, 'Schema::(create|table)\s*\(\s*{_Q}({_NOTQ}){_Q}', 2))""",
}
_HINTS = tuple(f"h_{k} AS (SELECT file_id, {_once(v)})".replace("1, 20) FROM", f"1, 20) AS {k} FROM") for k, v in _LISTS.items())
_POINTS = (*_HINTS, "hints AS (SELECT * FROM sources " + " ".join(f"JOIN h_{k} USING (file_id)" for k in _LISTS) + ")")

_EVIDENCE = """labels AS (SELECT file_id, list_filter([
    CASE WHEN p LIKE '%.md' THEN 'documentation' END,
    CASE WHEN p LIKE '%test%' OR p LIKE '%phpunit%' OR p LIKE '%.spec.ts' OR t LIKE '%describe(%' OR t LIKE '%it(%' OR t LIKE '%test(%' OR t LIKE '%assert.%' OR t LIKE '%assert::%' THEN 'test' END,
    CASE WHEN regexp_matches(p, 'dockerfile|docker-compose|compose[.]ya?ml') THEN 'docker_config' END,
    CASE WHEN regexp_matches(p, 'jenkinsfile|[.]github/workflows|[.]gitlab-ci') THEN 'ci_config' END,
    CASE WHEN p LIKE '%.env.example' OR p LIKE '%config%' OR regexp_matches(t, 'process[.]env|dotenv|getenv[(]|[$]_env|os[.]getenv|viper[.]') THEN 'env_config' END,
    CASE WHEN p LIKE '%.sql' OR regexp_matches(t, 'select |insert into|update |delete from') THEN 'raw_sql' END,
    CASE WHEN p LIKE '%migration%' OR regexp_matches(t, 'schema::(create|table)|(create|alter) table') THEN 'migration' END,
    CASE WHEN regexp_matches(t, '@entity|typeorm|extends baseentity') THEN 'typeorm_entity' END,
    CASE WHEN regexp_matches(p, 'model|entity') OR regexp_matches(t, 'gorm[.]model|extends model|mysqli|pdo[(]|sqlx[.]|database/sql') THEN 'db_model' END,
    CASE WHEN regexp_matches(t, '@controller|controller[(]|class |func ') AND regexp_matches(p, 'controller|handler|action') THEN 'controller' END,
    CASE WHEN regexp_matches(t, '@(get|post|put|patch|delete)[(]|router[.]|app[.](get|post)|[$]_(get|post)|http[.]handle(func|[(])|[.](get|post|put|delete)[(]') THEN 'api_route' END,
    CASE WHEN broker AND regexp_matches(t, 'publish|sendtoqueue|emit[(]') THEN 'rabbitmq_publisher' END,
    CASE WHEN broker AND regexp_matches(t, 'consume|@(event|message)pattern|subscribe') THEN 'rabbitmq_consumer' END,
    CASE WHEN regexp_matches(t, '@cron|cron[.]schedule|schedulejob|setinterval|crontab|cronexpr') OR regexp_matches(p, 'cron|scheduled') THEN 'cron_job' END,
    CASE WHEN regexp_matches(p, '[.](sh|bash|zsh|ps1)$') THEN 'shell_script' END], lambda x: x IS NOT NULL) AS found
    FROM (SELECT file_id, lower(path) AS p, lower(content) AS t, regexp_matches(lower(content), 'amqp|rabbitmq|routing_?key|exchange|queue|basic_(publish|consume)') AS broker FROM sources))"""
_EVIDENCE_ALL = (_EVIDENCE, "evidence AS (SELECT file_id, CASE WHEN len(found) = 0 THEN ['unknown'] ELSE found END AS evidence FROM labels)")

_FACTS = r"""WITH lines AS (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line,
    regexp_replace(trim(regexp_replace(unnest(string_split(content, chr(10))), '\s+', ' ', 'g')), ',$', '') AS text FROM sources),
clean AS (SELECT * FROM lines WHERE length(text) BETWEEN 12 AND 220 AND NOT regexp_matches(text, '^(//|#|/\*)|^\*\s|^(import|require)\s+|^</?[A-Za-z]')
    AND NOT regexp_matches(text, '!important|console\.log|describe\(|it\(|expect\(|logger\.|//\s*todo', 'i')),
known AS (SELECT *, CASE
    WHEN regexp_matches(text, 'validationerror|joi\.|check\(|validat(or|e)|throw new|missingrequesterror|unauthorized|forbidden', 'i') THEN 'validation'
    WHEN regexp_matches(text, '\b(request|req)\.(body|query|params)|\$_(post|get|request)|input\(|bodyparser', 'i') THEN 'input'
    WHEN regexp_matches(text, '\breturn\b|res\.json|response\.json|reply\.send|echo\s+json_encode', 'i') THEN 'return'
    WHEN regexp_matches(text, '[<>]=|[=!]==|\+\+|--|\bmath\.|(max|min)\(|\*\s*[a-z_][\w.]*', 'i') THEN 'formula'
    WHEN regexp_matches(text, '\b(const|let|var)\s+[A-Z0-9_]{3,}|\b[A-Z0-9_]{3,}\s*[:=]') THEN 'constant'
    WHEN regexp_matches(text, '\b(select|insert|update|delete|from|join)\b|\.query\(|createquerybuilder|table\(', 'i') THEN 'database'
    WHEN regexp_matches(text, 'amqp|rabbit|queue|exchange|routingkey|publish|consume|rpc', 'i') THEN 'message'
    WHEN regexp_matches(text, 'process\.env|config\.|\.env|module\.exports|exports\.', 'i') THEN 'config'
    WHEN regexp_matches(text, '\bif\s*\(|\bswitch\s*\(|\bcase\b|\belse\b', 'i') THEN 'control_flow' END AS category FROM clean),
once AS (SELECT * FROM known WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, category, lower(text) ORDER BY line) = 1)
SELECT file_id, line, category, text, CASE WHEN category IN ('formula', 'control_flow') THEN 'derived' ELSE 'confirmed' END AS confidence
FROM once QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line) <= 24"""

_EDGES = (
    r"""marks AS (SELECT file_id, repo, path, line, type, receiver, name FROM (
    SELECT file_id, repo, path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS x FROM sources) l,
    LATERAL (SELECT 'DEFINES_SYMBOL' AS type, NULL AS receiver, unnest(regexp_extract_all(x, '\b(async\s+)?(public\s+|private\s+|protected\s+)?(function\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{', 4)) AS name
      UNION ALL SELECT 'CALLS_SYMBOL', unnest(regexp_extract_all(x, '\b([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)\s*\(', 1)), unnest(regexp_extract_all(x, '\b([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)\s*\(', 2))
      UNION ALL SELECT 'CALLS_RPC_FUNC', NULL, unnest(regexp_extract_all(x, '\bfunc\s*:\s*["''`]([^"''`]+)["''`]', 1))
      UNION ALL SELECT 'CALLS_EXTERNAL_FUNC', NULL, unnest(regexp_extract_all(x, '\bpostParams(Async)?\(\s*["''`]([^"''`]+)["''`]', 2))
      UNION ALL SELECT 'TOUCHES_TABLE', NULL, unnest(regexp_extract_all(x, '\b(from|join|into|update|table)\s+[`"'']?([A-Za-z_][\w.]*)', 2, 'i'))) m)""",
    """edges AS (SELECT DISTINCT file_id, repo, path, line, type, receiver, name FROM marks WHERE NOT (type = 'DEFINES_SYMBOL' AND name IN ('if', 'for', 'while', 'switch', 'catch', 'function'))
    AND NOT (type = 'CALLS_SYMBOL' AND (receiver IN ('console', 'Math', 'JSON', 'Object', 'Array', 'String', 'Number', 'Promise')
      OR name IN ('log', 'error', 'warn', 'map', 'filter', 'find', 'then', 'catch', 'indexOf', 'includes')))
    AND NOT (type = 'TOUCHES_TABLE' AND lower(name) IN ('on', 'status', 'set', 'where', 'order', 'group', 'select', 'from')))""",
    """definitions AS (SELECT file_id, line, max(name) AS name FROM edges WHERE type = 'DEFINES_SYMBOL' GROUP BY ALL)""",
    """linked AS (SELECT e.*, CASE WHEN e.type LIKE 'CALLS%' THEN d.name END AS from_symbol FROM edges e ASOF LEFT JOIN definitions d ON e.file_id = d.file_id AND e.line >= d.line)""",
)

ORACLE = {
    "chunk_hints": with_sources("SELECT file_id, " + ", ".join(f"array_to_string({k}, '|') AS {k}" for k in HINT_LISTS) + " FROM hints", *_POINTS),
    "evidence_labels": with_sources("SELECT file_id, array_to_string(evidence, ',') AS labels FROM evidence", *_EVIDENCE_ALL),
    "line_facts": with_sources(_FACTS),
    "symbol_edges": with_sources("SELECT file_id, type, line, from_symbol, receiver, name FROM linked", *_EDGES),
    "bm25_eligible": with_sources(
        """SELECT file_id, repo, path, left(content, 500) AS content FROM hints JOIN evidence USING (file_id)
        WHERE content <> '' AND (len(symbols) + len(db_tables) + len(queue_names) + len(routes) > 0 OR list_has_any(evidence, ['documentation', 'env_config', 'migration']))""",
        *_POINTS, *_EVIDENCE_ALL,
    ),
    "shared_queues": with_sources(
        """WITH one AS (SELECT repo, file_id, lower(unnest(queue_names)) AS queue FROM hints)
        SELECT queue, repo, min(file_id) AS first_file, count(*) OVER (PARTITION BY queue) - 1 AS n_links FROM one GROUP BY queue, repo QUALIFY count(*) OVER (PARTITION BY queue) > 1""",
        *_POINTS,
    ),
    "calls_to_models": with_sources(
        """SELECT c.repo, c.from_symbol, c.receiver, c.name AS callee, count(DISTINCT d.file_id) AS n_targets, min(d.file_id) AS first_target
        FROM linked c JOIN edges d ON c.repo = d.repo AND c.name = d.name AND c.file_id <> d.file_id AND d.type = 'DEFINES_SYMBOL'
        WHERE c.type = 'CALLS_SYMBOL' AND c.from_symbol IS NOT NULL GROUP BY ALL""",
        *_EDGES,
    ),
    "rpc_out": with_sources(
        """SELECT from_symbol, type, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 12), ',') AS names, count(DISTINCT name) AS n
        FROM linked WHERE type IN ('CALLS_RPC_FUNC', 'CALLS_EXTERNAL_FUNC') AND from_symbol IS NOT NULL GROUP BY from_symbol, type""",
        *_EDGES,
    ),
    "edge_scope": with_sources(
        """SELECT file_id, repo, line, name FROM edges WHERE type = 'TOUCHES_TABLE' AND
        CASE WHEN file_id % 5 < 2 THEN file_id % 3 IN (1, 2) WHEN file_id % 5 = 2 THEN false ELSE repo IN ('repo-1', 'repo-2', 'repo-5') END""",
        *_EDGES,
    ),
}
