"""Queries: doctor facts, the reports on repositories and the chunks made of facts, each beside SQL with its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import doctor as D
from .sources import load, with_sources

KEYS = ["file_id", "repo", "path"]


def facts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return D.doctor_facts(load(spark, sf_dir), KEYS, kinds=kinds)


def doctor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("file_id", "line", "kind", "operation", "name", "detail")


def _report(kind: str, line: str, order: list[str], title: str):
    """A report of one kind of facts for every repository."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts(spark, sf_dir, kind)
        return D.listed(rows, "repo", order, F.expr(line), F.concat(F.lit(f"# {title} of "), F.col("repo")))

    return query


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_PLACE = "' (', path, ':', line, ')'"
#: Lines as expressions, the order of lines, and titles.
_REPORTS = {
    "env": (f"concat('- ', name, {_PLACE})", ["name", "path", "line"], "Environment"),
    "config": (f"concat('- ', name, ' = ', detail, if(name rlike '{D.BUSINESS}', ' [rule]', ''), {_PLACE})", ["name", "path", "line"], "Settings"),
    "api": (f"concat('- ', upper(operation), ' ', name, {_PLACE})", ["name", "operation", "path", "line"], "Routes"),
    "rabbitmq": (f"concat('- ', detail, ' ', name, ': ', operation, {_PLACE})", ["detail", "name", "operation", "path", "line"], "Messaging"),
    "http": (f"concat('- ', detail, ' ', upper(operation), ' ', name, {_PLACE})", ["name", "detail", "path", "line"], "Clients"),
    "cron": (f"concat('- ', name, ' by ', operation, {_PLACE})", ["name", "operation", "path", "line"], "Schedules"),
}


def report_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's package, files and what kinds of facts it has."""
    files = load(spark, sf_dir)
    package = files.filter("path = 'package.json'").groupBy("repo").agg(F.min(F.struct("file_id", F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", "$.version").alias("version"))).alias("p"))
    kinds = facts(spark, sf_dir).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    counts = files.groupBy("repo").agg(F.count("*").alias("n_files"))
    joined = counts.join(package, "repo", "left").join(kinds, "repo", "left")
    text = _line("# ", F.col("repo"), "\n\nPackage: ", F.coalesce(F.concat("p.name", F.lit("@"), "p.version"), F.lit("none")), "\nFiles: ", F.col("n_files"), "\nFacts: ", F.coalesce("kinds", F.lit("none")))
    return joined.select("repo", text.alias("report"))


def report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a repository with its number of facts by kind."""
    n = facts(spark, sf_dir).groupBy("repo").pivot("kind", [*_REPORTS, "database"]).count().na.fill(0)
    return n.select("repo", _line("| ", F.col("repo"), *(x for k in ("api", "database", "rabbitmq", "http", "cron", "env", "config") for x in (" | ", F.col(k))), " |").alias("row"))


def env_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The environment variables of each file, ordered by name and line."""
    env = facts(spark, sf_dir, "env")
    listed = env.groupBy("repo", "path", "file_id").agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("x"))
    return listed.select("repo", "path", "file_id", F.array_join(F.transform("x", lambda v: F.concat(v["name"], F.lit(":"), v["line"].cast("string"))), ",").alias("variables"))


def fact_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence and an identity for every fact, by kind."""
    f = facts(spark, sf_dir)
    said = {
        "api": _line(F.col("repo"), " serves ", F.upper("operation"), " ", F.col("name")),
        "database": _line(F.col("repo"), " runs ", F.col("operation"), " on table ", F.col("name")),
        "rabbitmq": _line(F.col("repo"), " calls ", F.col("operation"), " for ", F.col("detail"), " ", F.col("name")),
        "env": _line(F.col("repo"), " reads ", F.col("name")),
        "config": _line(F.col("repo"), " sets ", F.col("name"), " to ", F.col("detail"), " by default"),
        "cron": _line(F.col("repo"), " is scheduled by ", F.col("operation"), ": ", F.col("name")),
        "http": _line(F.col("repo"), " requests ", F.upper("operation"), " ", F.col("name"), " with ", F.col("detail")),
    }
    text = None
    for kind, column in said.items():
        text = F.when(F.col("kind") == kind, column) if text is None else text.when(F.col("kind") == kind, column)
    return f.withColumn("content", text).select("kind", "file_id", "line", "content", F.sha2(F.concat_ws(":", F.lit("doctor-fact-v1"), "repo", "kind", "path", "line", "content"), 256).alias("content_hash"))


def cross_repo_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of tables named like item_1 in every repository: at most 20 each."""
    db = facts(spark, sf_dir, "database").filter(F.col("name").contains("item_1"))
    n = F.row_number().over(D.Window.partitionBy("repo").orderBy("path", "file_id", "line", "operation", "name"))
    return db.withColumn("n", n).filter("n <= 20").select("repo", "n", "path", "line", "operation", "name")


def auto_registry_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry entry for each repository: at most 3 queues and 5 tables, its kind and a description."""
    f = facts(spark, sf_dir)
    first = lambda cond, k: F.slice(F.sort_array(F.collect_set(F.when(cond, F.col("name")))), 1, k)
    rows = f.groupBy("repo").agg(
        first((F.col("kind") == "rabbitmq") & (F.col("detail") == "queue"), 3).alias("queues"),
        first(F.col("kind") == "database", 5).alias("tables"),
        F.max(F.when(F.col("kind") == "api", 1).otherwise(0)).alias("serves"),
        F.max(F.when(F.col("kind") == "cron", 1).otherwise(0)).alias("timed"),
    )
    kind = F.when(F.col("serves") == 1, "api").when(F.col("timed") == 1, "cron").when(F.size("queues") > 0, "worker").otherwise("library")
    return rows.select("repo", kind.alias("kind"), F.array_join("queues", ",").alias("queues"), F.array_join("tables", ",").alias("tables"),
                       _line(F.col("repo"), " is of kind ", kind, " with ", F.size("tables"), " tables").alias("description"))


def queue_like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted dotted names on lines about queues, and the names of scheduled functions, by file."""
    files = load(spark, sf_dir)
    near = F.array_join(F.filter(F.split("content", "\n"), lambda x: F.lower(x).rlike("queue|consume|exchange|routing")), "\n")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(near, F.lit(r"""['"`]([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+)['"`]"""), F.lit(1))))
    jobs = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"cron\.schedule\([^,]+,\s*([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))
    return files.select("file_id", F.array_join(names, ",").alias("queues"), F.array_join(jobs, ",").alias("jobs")).filter("queues <> '' OR jobs <> ''")


QUERIES = {
    "doctor_facts": doctor_facts,
    "report_services": report_services,
    "report_overview": report_overview,
    **{f"report_{k}": _report(k, *v) for k, v in _REPORTS.items()},
    "env_by_source": env_by_source,
    "fact_chunk_texts": fact_chunk_texts,
    "cross_repo_tables": cross_repo_tables,
    "auto_registry_full": auto_registry_full,
    "queue_like_names": queue_like_names,
}

_Q, _N = """["''`]""", """[^"''`]"""


def _each(kind: str, regex: str, operation: str, name: int, detail: str = "''", flags: str = "", where: str = "true") -> str:
    """Facts of one rule; operation and detail are SQL texts or {n} for a group."""
    group = lambda k: f"unnest(regexp_extract_all(x, '{regex}', {k}{flags}))"
    fill = lambda t: group(t[1:-1]) if t.startswith("{") else t
    return f"SELECT file_id, repo, path, line, x, '{kind}' AS kind, {fill(operation)} AS operation, {group(name)} AS name, {fill(detail)} AS detail FROM lines WHERE {where}"


_I = ", 'i'"
_CODE = r"NOT regexp_matches(x, '^\s*(//|#|\*|--|/\*)')"
_RULES = [
    _each("api", rf"\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|all)\(\s*{_Q}(/{_N}*)", "{1}", 2),
    _each("api", rf"@(Get|Post|Put|Patch|Delete)\(\s*{_Q}({_N}*)", "{1}", 2),
    _each("api", rf"http\.HandleFunc\(\s*{_Q}(/{_N}*)", "'any'", 1),
    _each("database", r"\bselect\b.*?\bfrom\s+([a-z_]\w*)", "'select'", 1, flags=_I, where=_CODE),
    _each("database", r"\bjoin\s+([a-z_]\w*)", "'select'", 1, flags=_I, where=_CODE),
    _each("database", r"\binsert\s+into\s+([a-z_]\w*)", "'insert'", 1, flags=_I, where=_CODE),
    _each("database", r"\bupdate\s+([a-z_]\w*)\s+set\b", "'update'", 1, flags=_I, where=_CODE),
    _each("database", r"\bdelete\s+from\s+([a-z_]\w*)", "'delete'", 1, flags=_I, where=_CODE),
    _each("database", r"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([a-z_]\w*)", "'create'", 1, flags=_I, where=_CODE),
    _each("database", rf"\bDB::table\(\s*{_Q}(\w+)", "'query'", 1, where=_CODE),
    _each("rabbitmq", rf"\.(assertQueue|sendToQueue|consume|QueueDeclare)\(\s*{_Q}({_N}+)", "{1}", 2, "'queue'"),
    _each("rabbitmq", rf"\.(assertExchange|publish)\(\s*{_Q}({_N}+)", "{1}", 2, "'exchange'"),
    _each("env", r"\bprocess\.env\.([A-Z_][A-Z0-9_]*)", "'read'", 1),
    _each("env", rf"(?:\bprocess\.env\[|\bos\.Getenv\(|\bgetenv\()\s*{_Q}([A-Z_][A-Z0-9_]*)", "'read'", 1),
    _each("config", rf"\bprocess\.env\.([A-Z_][A-Z0-9_]*)\s*(?:\|\||\?\?)\s*{_Q}?([^''\"`;,)\s]+)", "'default'", 1, "{2}"),
    _each("cron", rf"\bcron\.schedule\(\s*{_Q}({_N}+)", "'node-cron'", 1),
    _each("cron", rf"@Cron\(\s*(?:{_Q}|CronExpression\.)([^''\"`)]+)", "'decorator'", 1),
    _each("cron", r"\bsetInterval\([^,]+,\s*([0-9]+)", "'interval'", 1),
    _each("http", rf"\baxios\.(get|post|put|patch|delete)\(\s*{_Q}({_N}+)", "{1}", 2, "'axios'"),
    _each("http", rf"\bfetch\(\s*{_Q}({_N}+)", "'get'", 1, "'fetch'"),
]
_FACTS = (
    "lines AS (SELECT file_id, repo, path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS x FROM sources)",
    f"plain AS ({' UNION ALL '.join(_RULES)})",
    # every url of the files stands on the line of its method
    rf"""objects AS (SELECT file_id, repo, path, line, lower(regexp_extract(x, '\bmethod\s*:\s*\[?\s*{_Q}([A-Za-z]+)', 1)) AS operation, regexp_extract(x, '\burl\s*:\s*{_Q}(/{_N}*)', 1) AS name FROM lines)""",
    r"""facts AS (SELECT DISTINCT file_id, repo, path, line, kind, lower(operation) AS operation, CASE WHEN kind = 'http' THEN regexp_replace(name, '\$\{[^}]*\}', '*', 'g') ELSE name END AS name, detail FROM plain
        WHERE NOT (kind = 'database' AND lower(name) IN ('select', 'where', 'set', 'values', 'the', 'a', 'an', 'this'))
        UNION SELECT file_id, repo, path, line, 'api', operation, name, '' FROM objects WHERE name <> '' AND operation <> '')""",
)
_P = "path || ':' || line || ')'"
_SQL_REPORTS = {
    "env": (f"'- ' || name || ' (' || {_P}", "name, path, line", "Environment"),
    "config": (f"'- ' || name || ' = ' || detail || CASE WHEN regexp_matches(name, 'LIMIT|MAX|MIN|RATE|FEE|PERCENT|TIMEOUT|RETRY|AMOUNT') THEN ' [rule]' ELSE '' END || ' (' || {_P}", "name, path, line", "Settings"),
    "api": (f"'- ' || upper(operation) || ' ' || name || ' (' || {_P}", "name, operation, path, line", "Routes"),
    "rabbitmq": (f"'- ' || detail || ' ' || name || ': ' || operation || ' (' || {_P}", "detail, name, operation, path, line", "Messaging"),
    "http": (f"'- ' || detail || ' ' || upper(operation) || ' ' || name || ' (' || {_P}", "name, detail, path, line", "Clients"),
    "cron": (f"'- ' || name || ' by ' || operation || ' (' || {_P}", "name, operation, path, line", "Schedules"),
}
_SAID = """CASE kind WHEN 'api' THEN repo || ' serves ' || upper(operation) || ' ' || name WHEN 'database' THEN repo || ' runs ' || operation || ' on table ' || name
    WHEN 'rabbitmq' THEN repo || ' calls ' || operation || ' for ' || detail || ' ' || name WHEN 'env' THEN repo || ' reads ' || name
    WHEN 'config' THEN repo || ' sets ' || name || ' to ' || detail || ' by default' WHEN 'cron' THEN repo || ' is scheduled by ' || operation || ': ' || name
    WHEN 'http' THEN repo || ' requests ' || upper(operation) || ' ' || name || ' with ' || detail END"""


def _sql(body: str) -> str:
    return with_sources(body, *_FACTS)


ORACLE = {
    "doctor_facts": _sql("SELECT file_id, line, kind, operation, name, detail FROM facts"),
    "report_services": _sql(
        """SELECT c.repo, '# ' || c.repo || chr(10) || chr(10) || 'Package: ' || coalesce(p.name || '@' || p.version, 'none') || chr(10) || 'Files: ' || n || chr(10) || 'Facts: ' || coalesce(kinds, 'none') AS report
        FROM (SELECT repo, count(*) AS n FROM sources GROUP BY repo) c
        LEFT JOIN (SELECT repo, json_extract_string(min_by(content, file_id), '$.name') AS name, json_extract_string(min_by(content, file_id), '$.version') AS version FROM sources WHERE path = 'package.json' GROUP BY repo) p ON c.repo = p.repo
        LEFT JOIN (SELECT repo, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM facts GROUP BY repo) k ON c.repo = k.repo"""
    ),
    "report_overview": _sql("SELECT repo, '| ' || repo" + "".join(f" || ' | ' || count(*) FILTER (WHERE kind = '{k}')" for k in ("api", "database", "rabbitmq", "http", "cron", "env", "config")) + " || ' |' AS row FROM facts GROUP BY repo"),
    **{
        f"report_{k}": _sql(f"SELECT repo, '# {title} of ' || repo || chr(10) || chr(10) || string_agg({line}, chr(10) ORDER BY {order}, {line}) AS report FROM facts WHERE kind = '{k}' GROUP BY repo")
        for k, (line, order, title) in _SQL_REPORTS.items()
    },
    "env_by_source": _sql("SELECT repo, path, file_id, string_agg(name || ':' || line, ',' ORDER BY name, line) AS variables FROM facts WHERE kind = 'env' GROUP BY ALL"),
    "fact_chunk_texts": _sql(f"SELECT kind, file_id, line, {_SAID} AS content, sha256('doctor-fact-v1:' || repo || ':' || kind || ':' || path || ':' || line || ':' || {_SAID}) AS content_hash FROM facts"),
    "cross_repo_tables": _sql("SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY path, file_id, line, operation, name) AS n, path, line, operation, name FROM facts WHERE kind = 'database' AND name LIKE '%item_1%' QUALIFY n <= 20".replace("item_1", "item\\_1").replace("LIKE '%item\\_1%'", "LIKE '%item\\_1%' ESCAPE '\\'")),
    "auto_registry_full": _sql(
        """WITH r AS (SELECT repo, list_slice(list_sort(list_distinct(coalesce(list(name) FILTER (WHERE kind = 'rabbitmq' AND detail = 'queue'), []))), 1, 3) AS q,
            list_slice(list_sort(list_distinct(coalesce(list(name) FILTER (WHERE kind = 'database'), []))), 1, 5) AS t, bool_or(kind = 'api') AS serves, bool_or(kind = 'cron') AS timed FROM facts GROUP BY repo),
        k AS (SELECT *, CASE WHEN serves THEN 'api' WHEN timed THEN 'cron' WHEN len(q) > 0 THEN 'worker' ELSE 'library' END AS kind FROM r)
        SELECT repo, kind, array_to_string(q, ',') AS queues, array_to_string(t, ',') AS tables, repo || ' is of kind ' || kind || ' with ' || len(t) || ' tables' AS description FROM k"""
    ),
    "queue_like_names": _sql(
        rf"""WITH n AS (SELECT file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(array_to_string(list_filter(string_split(content, chr(10)), lambda s: regexp_matches(lower(s), 'queue|consume|exchange|routing')), chr(10)),
            '{_Q}([\w-]+(?:\.[\w-]+)+){_Q}', 1))), ',') AS queues, array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'cron\.schedule\([^,]+,\s*([A-Za-z_]\w*)', 1))), ',') AS jobs FROM sources)
        SELECT * FROM n WHERE queues <> '' OR jobs <> ''"""
    ),
}
