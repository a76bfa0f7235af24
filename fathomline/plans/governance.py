"""Queries: registry, reports, decisions, rules and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import registry as G
from ..session import read
from ..sources.ignore import ignored
from .fixtures import load, with_sql

#: Registry entries from the nations; aliases are words of the invented prose.
REGISTRY = """SELECT n_name AS name, concat('region-', n_regionkey) AS kind,
 string_split(concat('the,than,thand,ther,enthe,', lower(n_name)), ',')[n_nationkey % 5 + 1] AS alias FROM nation"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat(F.lit("the,than,thand,ther,enthe,"), F.lower("n_name")), ",")
    return read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("region-"), "n_regionkey").alias("kind"), F.array(F.get(words, F.col("n_nationkey") % 5)).alias("aliases")
    )


def registry_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries that a question names."""
    return G.mentions(read(spark, sf_dir, "benchmark"), _registry(spark, sf_dir), "item_id")


def project_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _registry(spark, sf_dir).select(F.col("kind").alias("project"), F.explode("aliases").alias("term"), F.lit(8.0).alias("weight")).groupBy("project", "term").agg(F.sum("weight").alias("weight"))
    return G.project_tags(load(spark, sf_dir, "chunks"), terms, "chunk_id", 12, 3).select("chunk_id", "project", "score", "rank")


def registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' repositories against those that edges name, by status."""
    expected = read(spark, sf_dir, "supplier").select(F.concat(F.lit("REPO-"), F.col("s_suppkey") % 60).alias("repo"))
    return G.coverage(expected, load(spark, sf_dir, "edges"), "repo")


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries after changes: debtors change their kind, those of one segment go."""
    c = read(spark, sf_dir, "customer")
    base = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    changes = c.filter("c_acctbal < 0 OR c_mktsegment = 'BUILDING'").select(
        F.lower("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, "debtor").alias("kind"), (F.col("c_mktsegment") == "BUILDING").alias("deleted")
    )
    return G.upsert_entries(base, changes)


#: Paths and ignore files of a tree for each size of part: a root file, and one two folders down that takes some back.
TREE = """SELECT concat('repo-', p_size) AS repo, concat(CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/gen/' ELSE '' END, CASE p_partkey % 2 WHEN 0 THEN 'logs/' ELSE 'app/' END,
 'part', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tmp' WHEN 2 THEN '.md' WHEN 3 THEN '.png' ELSE '.d.ts' END) AS path FROM part"""
_ROOT_RULES, _DEEP_RULES = "*.tmp\n*.d.ts\n!part1*.tmp\n/src/logs/part?.ts\n!logs/", "*.ts\n!part*2*.ts\napp/*.md\n!*.tmp"


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the last matching rule of their folders ignores."""
    read(spark, sf_dir, "part").createOrReplaceTempView("_part")
    files = spark.sql(TREE.replace(" FROM part", " FROM _part"))
    repos = files.select("repo").distinct()
    rules = [repos.select("repo", F.lit(folder).alias("folder"), F.lit(text).alias("content")) for folder, text in (("", _ROOT_RULES), ("src/gen", _DEEP_RULES))]
    return ignored(files, rules[0].union(rules[1].filter("repo <> 'repo-3'")))


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the path rules that they match."""
    files = load(spark, sf_dir, "files").select("path")
    out = None
    for rule in ("src/brand_11/**", "src/*/part7.ts", "src/brand_12"):
        part = files.filter(G.path_rule_matches(F.col("path"), F.lit(rule))).groupBy(F.lit(rule).alias("rule")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by the repositories that use them and the files that change them: an outer merge of aggregates."""
    edges = load(spark, sf_dir, "edges").groupBy(F.col("tab").alias("name")).agg(F.countDistinct("repo").alias("n_repos"), F.count("*").alias("n_uses"))
    changed = read(spark, sf_dir, "part").groupBy(F.concat(F.lit("table_"), F.col("p_size") * 7).alias("name")).agg(F.count("*").alias("n_changes"))
    return edges.join(changed, "name", "full_outer").select("name", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_repos", "n_uses", "n_changes")))


def decision_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions (events) by type, month and maker in one pass of grouping sets; long form."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM").alias("month"), (F.col("user_id") % 10).cast("string").alias("maker"))
    facets = e.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("type", "month", "maker")))).alias("f"))
    return facets.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def related_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For orders divisible by 50 the five orders (first by key) that share most parts."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    asked = items.filter("l_orderkey % 50 = 0").withColumnRenamed("l_orderkey", "order")
    shared = asked.join(items, "l_partkey").filter("l_orderkey <> order").groupBy("order", "l_orderkey").agg(F.count("*").alias("n_shared"))
    w = Window.partitionBy("order").orderBy(F.desc("n_shared"), "l_orderkey")
    return shared.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


def docs_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names that no document holds, by number of parts."""
    names = read(spark, sf_dir, "part").select(F.explode(F.array_distinct(T.tokens(F.col("p_type")))).alias("word"))
    known = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return names.groupBy("word").agg(F.count("*").alias("n_parts")).join(known, "word", "left_anti")


def rules_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.lower(F.col("user_id").cast("string")).alias("trigger"), "ts")
    return L.supersede(rules, ["trigger", "type"], ["ts", "event_id"]).select("event_id", "valid_to", "active")


def rule_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the terms of the active rules whose trigger they hold as a word."""
    rules = spark.createDataFrame([("the", "boost-a"), ("thand", "boost-b"), ("ther", "boost-c")], "trigger string, term string")
    words = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("trigger"))
    return words.join(F.broadcast(rules), "trigger").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return L.rate_limit(events, "user_id", "ts", "event_id", 86_400, 3).select("event_id", "user_id", "allowed")


_RATE = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, event_id, k, ts, ts + INTERVAL 1 DAY AS until, 1 AS n FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, e.ts, CASE WHEN e.ts > f.until THEN e.ts + INTERVAL 1 DAY ELSE f.until END, CASE WHEN e.ts > f.until THEN 1 ELSE f.n + 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
 SELECT event_id, user_id, n <= 3 AS allowed FROM f"""


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid turns of a conversation: count, last question, whether it follows up on an answer."""
    turns = read(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant") & (T.strip(F.col("text")) != ""))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.max(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("q"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"),
    ).select("conv_id", "n_turns", F.col("q.text").alias("last_question"), F.coalesce(F.col("a") < F.col("q.turn"), F.lit(False)).alias("follows_up"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of labelled documents by source and the share that would be retried."""
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    mean = L.mean_score([F.col("quality").cast("double"), 1 - F.col("toxic").cast("double"), F.lit(None).cast("double"), F.lit(1.0)])
    scored = joined.select("source", mean.alias("mean"))
    return scored.groupBy("source").agg(F.round(F.avg("mean"), 6).alias("mean"), F.count_if(F.col("mean") < 0.5).alias("n_retry"))


def code_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories whose newest order differs from the last one seen, with up to five new files."""
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("repo-"), F.col("o_custkey") % 50).alias("repo"), "o_orderkey", "o_orderdate")
    seen = orders.filter("o_orderdate < '1997-01-01'").groupBy("repo").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("s"))
    new = orders.join(seen, "repo", "left").filter(F.col("s").isNull() | (F.struct("o_orderdate", "o_orderkey") > F.col("s")))
    return new.groupBy("repo").agg(F.count("*").alias("n_new"), F.array_join(F.slice(F.array_sort(F.collect_set("o_orderkey")), 1, 5), ",").alias("files"))


def model_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the model class that would answer them."""
    n = F.size(T.tokens(F.col("text")))
    route = F.when(n < 15, "small").when(F.col("text").rlike("[0-9]"), "code").when(n > 40, "deep").otherwise("default")
    return read(spark, sf_dir, "benchmark").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in a scope: one of several repositories and not a branch, pushed to the scan."""
    docs = read(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src2", "src3") & (F.col("lang") != "fr") & (F.col("n_chars") >= 200))
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def migration_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "files").groupBy(L.migration_kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"), F.min("file_id").alias("first"))


def events_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type (an extension)."""
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision notes with front matter, parsed to columns."""
    note = F.concat(F.lit("---\nstatus: "), "o_orderstatus", F.lit("\nservices: ["), "o_orderpriority", F.lit("]\ntime: 10:"), (F.col("o_orderkey") % 60).cast("string"), F.lit("\n---\n# Note "), F.col("o_orderkey").cast("string"))
    parsed = read(spark, sf_dir, "orders").select("o_orderkey", T.front_matter(note).alias("m"), F.regexp_extract(note, r"(?m)^# (.*)$", 1).alias("title"))
    return parsed.select("o_orderkey", "title", F.col("m")["status"].alias("status"), F.col("m")["services"].alias("services"), F.col("m")["time"].alias("time"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and number of links of every page."""
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


QUERIES = {
    f.__name__: f
    for f in (
        registry_expand, project_tags, registry_coverage, registry_upsert, ignored_files, path_rules, schema_tables, decision_analytics, related_by_overlap, docs_gap, rules_supersede,
        rule_application, rate_limit, chat_history, quality_gate, code_changes, model_router, scope_filter, migration_kinds, events_windowed, front_matter, page_titles,
    )
}

_R = f"r AS ({REGISTRY})"
_TOK = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
# The rules written out by hand. By default *.png and a folder `logs` are ignored; the root takes `logs` back; below src/gen, but in repo-3, the
# second file comes last. Kinds of names: 1 ts, 2 tmp, 3 md, 4 png, 5 d.ts.
_IGNORED = f"""WITH files AS ({TREE}), f AS (SELECT *, regexp_extract(path, '[^/]+$') AS name, starts_with(path, 'src/gen/') AND repo <> 'repo-3' AS deep FROM files)
 SELECT repo, path FROM f WHERE CASE
  WHEN deep AND ends_with(name, '.tmp') THEN false
  WHEN deep AND regexp_matches(name, '^part.*2.*[.]ts$') THEN false
  WHEN deep AND ends_with(name, '.ts') THEN true
  WHEN deep AND regexp_matches(path, '^src/gen/app/[^/]*[.]md$') THEN true
  WHEN regexp_matches(path, '^src/logs/part[^/][.]ts$') THEN true
  WHEN starts_with(name, 'part1') AND ends_with(name, '.tmp') THEN false
  ELSE ends_with(name, '.d.ts') OR ends_with(name, '.tmp') OR ends_with(name, '.png') END"""

ORACLE = {
    "ignored_files": _IGNORED,
    "registry_expand": f"WITH {_R} SELECT DISTINCT item_id, name FROM (SELECT item_id, unnest({_TOK.format('text')}) AS alias FROM benchmark) JOIN r USING (alias) WHERE length(alias) >= 3",
    "project_tags": with_sql(
        f"""WITH {_R}, t AS (SELECT kind AS project, alias AS term, 8.0 * count(*) AS weight FROM r GROUP BY ALL),
        w AS (SELECT DISTINCT chunk_id, unnest({_TOK.format('content')}) AS term FROM chunks),
        s AS (SELECT chunk_id, project, sum(weight)::DOUBLE AS score FROM w JOIN t USING (term) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, project) AS rank FROM s WHERE score >= 12 QUALIFY rank <= 3"""
    ),
    "registry_coverage": with_sql(
        """WITH e AS (SELECT DISTINCT 'repo-' || s_suppkey % 60 AS repo FROM supplier), i AS (SELECT DISTINCT repo FROM edges)
        SELECT coalesce(e.repo, i.repo) AS repo, CASE WHEN e.repo IS NULL THEN 'extra' WHEN i.repo IS NULL THEN 'missing' ELSE 'covered' END AS status FROM e FULL JOIN i ON e.repo = i.repo"""
    ),
    "registry_upsert": """SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS kind FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "path_rules": with_sql(
        """SELECT rule, count(*) AS n FROM files, (VALUES ('src/brand_11/**', '^src/brand_11/'), ('src/*/part7.ts', '^src/[^/]*/part7[.]ts$'), ('src/brand_12', '^src/brand_12(/|$)')) AS v(rule, re)
        WHERE regexp_matches(path, re) GROUP BY rule"""
    ),
    "schema_tables": with_sql(
        """WITH e AS (SELECT tab AS name, count(DISTINCT repo) AS r, count(*) AS u FROM edges GROUP BY tab), c AS (SELECT 'table_' || p_size * 7 AS name, count(*) AS n FROM part GROUP BY 1)
        SELECT coalesce(e.name, c.name) AS name, coalesce(r, 0) AS n_repos, coalesce(u, 0) AS n_uses, coalesce(n, 0) AS n_changes FROM e FULL JOIN c ON e.name = c.name"""
    ),
    "decision_analytics": """SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY ALL
        UNION ALL SELECT 'maker', (user_id % 10)::VARCHAR, count(*) FROM events GROUP BY ALL""",
    "related_by_overlap": """WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT a.l_orderkey AS "order", b.l_orderkey, count(*) AS n_shared FROM i a JOIN i b USING (l_partkey)
        WHERE a.l_orderkey % 50 = 0 AND a.l_orderkey <> b.l_orderkey GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY "order" ORDER BY n_shared DESC, l_orderkey) AS rank FROM s QUALIFY rank <= 5""",
    "docs_gap": f"""SELECT word, count(*) AS n_parts FROM (SELECT DISTINCT p_partkey, unnest({_TOK.format('p_type')}) AS word FROM part)
        WHERE word NOT IN (SELECT unnest({_TOK.format('text')}) FROM documents) GROUP BY word""",
    "rules_supersede": """SELECT event_id, lead(ts) OVER w AS valid_to, lead(1) OVER w IS NULL AS active FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
    "rule_application": f"""SELECT item_id, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT DISTINCT item_id, unnest({_TOK.format('text')}) AS trigger FROM benchmark)
        JOIN (VALUES ('the', 'boost-a'), ('thand', 'boost-b'), ('ther', 'boost-c')) AS v(trigger, term) USING (trigger) GROUP BY item_id""",
    "rate_limit": _RATE,
    "chat_history": """SELECT conv_id, count(*) AS n_turns, max_by(text, turn) FILTER (WHERE role = 'user') AS last_question,
        coalesce(max(turn) FILTER (WHERE role = 'assistant') < max(turn) FILTER (WHERE role = 'user'), false) AS follows_up
        FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id""",
    "quality_gate": """SELECT source, round(avg(m), 6) AS mean, count(*) FILTER (WHERE m < 0.5) AS n_retry FROM (SELECT source, (quality + (1 - toxic) + 0.5::DOUBLE + 1.0::DOUBLE) / 4 AS m
        FROM labels JOIN documents USING (doc_id)) GROUP BY source""",
    "code_changes": """WITH o AS (SELECT 'repo-' || o_custkey % 50 AS repo, o_orderkey, o_orderdate FROM orders),
        s AS (SELECT repo, max(row(o_orderdate, o_orderkey)) AS s FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY repo),
        n AS (SELECT repo, o_orderkey FROM o LEFT JOIN s USING (repo) WHERE s IS NULL OR row(o_orderdate, o_orderkey) > s)
        SELECT repo, count(*) AS n_new, array_to_string(list_sort(list_distinct(list(o_orderkey)))[1:5], ',') AS files FROM n GROUP BY repo""",
    "model_router": f"""SELECT CASE WHEN n < 15 THEN 'small' WHEN regexp_matches(text, '[0-9]') THEN 'code' WHEN n > 40 THEN 'deep' ELSE 'default' END AS route, count(*) AS n
        FROM (SELECT text, len({_TOK.format('text')}) AS n FROM benchmark) GROUP BY 1""",
    "scope_filter": "SELECT source, lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang <> 'fr' AND n_chars >= 200 GROUP BY ALL",
    "migration_kinds": with_sql("SELECT CASE WHEN regexp_matches(lower(content), 'update ') THEN 'update' ELSE 'other' END AS kind, count(*) AS n, min(file_id) AS first FROM files GROUP BY 1"),
    "events_windowed": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "front_matter": """SELECT o_orderkey, 'Note ' || o_orderkey AS title, o_orderstatus AS status, o_orderpriority AS services, '10:' || o_orderkey % 60 AS time FROM orders""",
    "page_titles": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS n_links FROM pages""",
}
