"""Queries: facts, evidence, configuration and relations extracted from source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as E
from .fixtures import load, with_sql


def _facts(spark: SparkSession, sf_dir: str, patterns) -> DataFrame:
    return E.facts(load(spark, sf_dir, "files"), patterns)


def _group(patterns):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _facts(spark, sf_dir, patterns).select("file_id", "line", "kind", "operation", "name", "detail")

    return query


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _facts_sql(patterns) -> str:
    parts = []
    for p in patterns:
        pairs = f"list_zip(regexp_extract_all(x, {_lit(p.regex)}, 1), regexp_extract_all(x, {_lit(p.regex)}, {2 if p.detail else 1}))"
        parts.append(
            f"SELECT file_id, repo, path, line, {_lit(p.kind)} AS kind, {_lit(p.operation)} AS operation, m[1] AS name, {'trim(m[2])' if p.detail else _lit('')} AS detail "
            f"FROM lines, unnest({pairs}) AS t(m)"
        )
    stop = ", ".join(map(_lit, E.STOP_NAMES))
    return (
        "WITH lines AS (SELECT file_id, repo, path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files), "
        f"facts AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE kind <> 'table' OR lower(name) NOT IN ({stop})) "
    )


def _group_sql(patterns) -> str:
    return with_sql(_facts_sql(patterns) + "SELECT file_id, line, kind, operation, name, detail FROM facts")


def relationship_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six name lists of a file, each distinct in order and capped at 20."""
    found = _facts(spark, sf_dir, E.ALL)
    ordered = found.groupBy("file_id", "kind").agg(F.sort_array(F.collect_list(F.struct("line", "rank", "name"))).alias("x"))
    return ordered.select("file_id", "kind", F.array_join(T.unique(F.col("x.name"), 20), ",").alias("names"))


_HINTS = with_sql(
    _facts_sql(E.ALL).rstrip()
    + """, firsts AS (SELECT file_id, kind, name, min(line) AS line FROM facts GROUP BY ALL)
    SELECT file_id, kind, string_agg(name, ',' ORDER BY line, name) AS names FROM firsts GROUP BY ALL"""
)


def evidence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "files").select("file_id", F.array_join(E.evidence(F.col("path"), F.col("content")), ",").alias("labels"))


def _evidence_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower({where}), {_lit(regex)}) THEN {_lit(name)} END" for name, where, regex in E.EVIDENCE)
    return f"SELECT file_id, repo, coalesce(nullif(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ','), ''), 'unknown') AS labels FROM files"


def evidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each evidence label, the twelve most frequent."""
    labels = load(spark, sf_dir, "files").select(F.explode(E.evidence(F.col("path"), F.col("content"))).alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(12)


def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.structured_facts(load(spark, sf_dir, "files").select("file_id", "content"), 4)


def _structured_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, {_lit(regex)}) THEN {_lit(name)}" for name, regex in E.CATEGORIES)
    return with_sql(
        f"""WITH lines AS (SELECT file_id, trim(unnest(string_split(content, chr(10)))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files),
        known AS (SELECT *, CASE {cases} END AS category FROM lines WHERE length(text) BETWEEN 12 AND 220),
        once AS (SELECT * FROM known WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, category, lower(text) ORDER BY line) = 1)
        SELECT file_id, line, category, text FROM once QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line, category) <= 4"""
    )


def env_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each environment variable: files and repositories that read it, first place."""
    found = _facts(spark, sf_dir, E.ENVIRONMENT)
    return found.groupBy("name").agg(
        F.countDistinct("file_id").alias("n_files"),
        F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"),
        F.min(F.struct("path", "line")).alias("first"),
    ).select("name", "n_files", "repos", F.concat_ws(":", "first.path", "first.line").alias("first_place"))


def config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults by variable and value, and whether a variable has several."""
    found = _facts(spark, sf_dir, E.DEFAULTS).groupBy("name").agg(F.countDistinct("detail").alias("n_values"), F.min("detail").alias("value"), F.count("*").alias("n"))
    return found.withColumn("conflict", F.col("n_values") > 1)


def database_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table: its operations, files and uses."""
    return _facts(spark, sf_dir, E.TABLES).groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"), F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n")
    )


def messaging_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues and exchanges, one row for each name, operation and repository, at its first place."""
    found = E.first_of(_facts(spark, sf_dir, E.MESSAGING), ["kind", "name", "operation", "repo"], ["path", "line", "rank"])
    return found.select("kind", "name", "operation", "repo", "path", "line")


def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table use with the function around it."""
    files = load(spark, sf_dir, "files")
    uses = E.facts(files, E.TABLES).select("file_id", "line", "operation", "name")
    functions = E.facts(files, E.SYMBOLS[:1]).select("file_id", "line", F.col("name").alias("symbol"))
    return E.enclosing(uses, functions, ["file_id"]).select("file_id", "line", "operation", "name", "symbol")


def feature_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a repository by kind: names, files."""
    found = _facts(spark, sf_dir, E.ALL).filter(F.length("name") > 2)
    return found.groupBy("repo", "kind").agg(F.countDistinct("name").alias("n_names"), F.countDistinct("file_id").alias("n_files"))


def doctor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by kind over all repositories."""
    return _facts(spark, sf_dir, E.ALL).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("n_repos"))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown list of the tables of every repository."""
    rows = _facts(spark, sf_dir, E.TABLES).groupBy("repo", "name").agg(F.array_join(F.array_sort(F.collect_set("operation")), ", ").alias("ops"), F.count("*").alias("n"))
    item = F.concat(F.lit("- `"), "name", F.lit("` ("), "ops", F.lit("): "), F.col("n").cast("string"))
    listed = rows.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("name", item.alias("item")))).alias("items"))
    return listed.select("repo", F.concat(F.lit("# "), "repo", F.lit("\n"), F.array_join("items.item", "\n")).alias("report"))


QUERIES = {
    "extract_routes": _group(E.ROUTES),
    "extract_tables": _group(E.TABLES),
    "extract_messaging": _group(E.MESSAGING),
    "extract_env": _group(E.ENVIRONMENT),
    "extract_defaults": _group(E.DEFAULTS),
    "extract_schedules": _group(E.SCHEDULES),
    "extract_calls": _group(E.CALLS),
    "extract_symbols": _group(E.SYMBOLS),
    "relationship_hints": relationship_hints,
    "evidence_types": evidence_types,
    "evidence_histogram": evidence_histogram,
    "structured_facts": structured_facts,
    "env_usage": env_usage,
    "config_defaults": config_defaults,
    "database_summary": database_summary,
    "messaging_unique": messaging_unique,
    "enclosing_symbol": enclosing_symbol,
    "feature_inventory": feature_inventory,
    "doctor_summary": doctor_summary,
    "report_markdown": report_markdown,
}
ORACLE = {
    "extract_routes": _group_sql(E.ROUTES),
    "extract_tables": _group_sql(E.TABLES),
    "extract_messaging": _group_sql(E.MESSAGING),
    "extract_env": _group_sql(E.ENVIRONMENT),
    "extract_defaults": _group_sql(E.DEFAULTS),
    "extract_schedules": _group_sql(E.SCHEDULES),
    "extract_calls": _group_sql(E.CALLS),
    "extract_symbols": _group_sql(E.SYMBOLS),
    "relationship_hints": _HINTS,
    "evidence_types": with_sql(f"SELECT file_id, labels FROM ({_evidence_sql()})"),
    "evidence_histogram": with_sql(f"SELECT label, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS label FROM ({_evidence_sql()})) GROUP BY label ORDER BY n DESC, label LIMIT 12"),
    "structured_facts": _structured_sql(),
    "env_usage": with_sql(
        _facts_sql(E.ENVIRONMENT)
        + """SELECT name, count(DISTINCT file_id) AS n_files, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos,
        min_by(path || ':' || line, struct_pack(p := path, l := line)) AS first_place FROM facts GROUP BY name"""
    ),
    "config_defaults": with_sql(_facts_sql(E.DEFAULTS) + "SELECT name, count(DISTINCT detail) AS n_values, min(detail) AS value, count(*) AS n, count(DISTINCT detail) > 1 AS conflict FROM facts GROUP BY name"),
    "database_summary": with_sql(_facts_sql(E.TABLES) + "SELECT name, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, count(DISTINCT file_id) AS n_files, count(*) AS n FROM facts GROUP BY name"),
    "messaging_unique": with_sql(
        _facts_sql(E.MESSAGING) + "SELECT kind, name, operation, repo, path, line FROM facts QUALIFY row_number() OVER (PARTITION BY kind, name, operation, repo ORDER BY path, line) = 1"
    ),
    "enclosing_symbol": with_sql(
        _facts_sql(E.TABLES + E.SYMBOLS[:1])
        + """SELECT u.file_id, u.line, u.operation, u.name, d.name AS symbol FROM (SELECT * FROM facts WHERE kind = 'table') u
        ASOF LEFT JOIN (SELECT * FROM facts WHERE kind = 'symbol') d ON u.file_id = d.file_id AND u.line >= d.line"""
    ),
    "feature_inventory": with_sql(_facts_sql(E.ALL) + "SELECT repo, kind, count(DISTINCT name) AS n_names, count(DISTINCT file_id) AS n_files FROM facts WHERE length(name) > 2 GROUP BY ALL"),
    "doctor_summary": with_sql(_facts_sql(E.ALL) + "SELECT kind, count(*) AS n, count(DISTINCT repo) AS n_repos FROM facts GROUP BY kind"),
    "report_markdown": with_sql(
        _facts_sql(E.TABLES).rstrip()
        + """, r AS (SELECT repo, name, string_agg(DISTINCT operation, ', ' ORDER BY operation) AS ops, count(*) AS n FROM facts GROUP BY ALL)
        SELECT repo, '# ' || repo || chr(10) || string_agg('- `' || name || '` (' || ops || '): ' || n, chr(10) ORDER BY name) AS report FROM r GROUP BY repo"""
    ),
}
