"""Queries: context of answers, scopes, registries, decisions and small text rules, each beside SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asking as A
from ..operators import source_rules as R
from ..operators import vectors
from ..session import checkpointed, read
from . import search
from .asking import _ASKS, _RERANK, _ROUTE, _TERMS, _VOCABULARY, questions
from .hints import _EDGES, _EVIDENCE_ALL, _POINTS, points
from .reports import _FACTS, facts
from .sources import load, with_sources


def any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with any of some tables."""
    wanted = F.array(*(F.lit(f"item_{k}") for k in range(1, 21)))
    return points(spark, sf_dir).filter(F.arrays_overlap("db_tables", wanted)).select("file_id", F.array_join(F.array_sort(F.array_intersect("db_tables", wanted)), ",").alias("tables"))


def unbranched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of repositories that were indexed with branches but have none themselves: the ones to delete."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("repo"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("branch"))
    branched = o.filter("branch IS NOT NULL").select("repo").distinct()
    return o.filter("branch IS NULL").join(branched, "repo", "left_semi").select("o_orderkey", "repo")


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text by which a point is matched: its places, names and content in lower case; length and digest."""
    names = ("routes", "symbols", "message_names", "queue_names", "exchange_names", "db_tables")
    text = F.lower(F.concat_ws("\n", "repo", "path", *(F.array_join(c, "\n") for c in names), "content"))
    return points(spark, sf_dir).select("file_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("digest"))


def table_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables touched whose names can be tables: snake case, five characters at least; files of each."""
    e = R.edges(load(spark, sf_dir), ["file_id"]).filter("type = 'TOUCHES_TABLE'")
    return e.filter(F.col("name").rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$") & (F.length("name") >= 5)).groupBy("name").agg(F.countDistinct("file_id").alias("n_files"))


def own_repo_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for each repository asked for: the tool's own repository (repo-6) only if it is the one."""
    asked = spark.createDataFrame([("repo-1",), ("repo-6",), (None,)], "asked string")
    n = load(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n"))
    met = asked.join(F.broadcast(n), F.col("asked").isNull() | (F.col("asked") == F.col("repo")))  # one row a repository
    return met.filter((F.col("repo") != "repo-6") | (F.col("asked") == "repo-6")).select(F.coalesce("asked", F.lit("any")).alias("asked"), "repo", "n")


def uncovered_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback whose kind no rule's trigger covers, by user; a rule is active if its last change isn't an error."""
    e = read(spark, sf_dir, "events")
    last = e.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))).filter("n = 1 AND user_id % 2 = 0").select("event_type")
    return e.join(last, "event_type", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def handler_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers of route objects, and the file that the alias in the same file requires, if the repository has it."""
    files = load(spark, sf_dir)
    alias = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(r"const\s+([A-Za-z_]\w*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]"), F.lit(1)).alias("alias"),
        F.regexp_extract_all("content", F.lit(r"const\s+([A-Za-z_]\w*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]"), F.lit(2)).alias("target"),
    )
    needs = files.select("file_id", "repo", F.explode(alias).alias("a")).select("file_id", "repo", "a.alias", "a.target")
    handlers = files.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"handler\s*:\s*([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)"), F.lit(1)))).alias("handler"))
    named = handlers.withColumn("alias", F.split("handler", r"\.")[0]).join(needs, ["file_id", "alias"], "left")
    stem = F.regexp_extract("target", r"([^/]+)$", 1)
    known = files.select("repo", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[a-z.]+$", "").alias("stem"), F.col("file_id").alias("found")).groupBy("repo", "stem").agg(F.min("found").alias("found"))
    return named.withColumn("stem", stem).join(known, ["repo", "stem"], "left").select("file_id", "handler", F.element_at(F.split("handler", r"\."), -1).alias("method"), "target", F.col("found").cast("string").alias("found"))


def doc_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how they match a subject: 70 for the title, 45 for a heading, 30 for the path, 12 a mention up to five; English first."""
    subject = "items"
    docs = load(spark, sf_dir).filter("path LIKE '%.md'")
    low = F.lower("content")
    title, headings = F.lower(F.regexp_extract("content", r"title: (.*)", 1)), F.array_join(F.regexp_extract_all(low, F.lit(r"(?m)^#+ (.*)$"), F.lit(1)), "\n")
    mentions = F.least(F.size(F.regexp_extract_all(low, F.lit(subject), F.lit(0))), F.lit(5))
    score = (
        F.when(F.contains(title, F.lit(subject)), 70).otherwise(0)
        + F.when(F.contains(headings, F.lit(subject)), 45).otherwise(0)
        + F.when(F.contains(F.lower("path"), F.lit(subject)), 30).otherwise(0)
        + 12 * mentions
        + F.when(F.contains("path", F.lit("/en/")), 15).otherwise(0)
    )
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "file_id"))
    return docs.withColumn("score", score).filter("score > 0").withColumn("rank", rank).filter("rank <= 10").select("repo", "rank", "file_id", "score")


def vocabulary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary terms whose value or term a question names exactly."""
    v = A.vocabulary(load(spark, sf_dir), ["file_id"]).select("file_id", "group_name", F.lower("term").alias("name")).distinct()
    asked = questions(spark, sf_dir).select("question_id", F.explode(F.array_union(A.terms_of(F.col("question")), F.array(F.lit("pro"), F.lit("silver")))).alias("name")).filter("question_id % 10 = 6")
    # a row a name on one side, so a name that all files and questions have makes no pair of them
    known = v.groupBy("name").agg(F.countDistinct("file_id").alias("n_files"), F.min("file_id").alias("first_file"))
    return asked.distinct().join(known, "name").select("question_id", "name", "n_files", "first_file")


def locale_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points of a preferred label to the points whose id is divisible by 50, five each."""
    e = read(spark, sf_dir, "embeddings")
    found = vectors.topk(e.filter("label = 1"), search.asked(e), 5)
    return found.select("query_id", "rank", F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"))


def domain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that hold the words of a domain's rule, by a table of rules."""
    rules = {"accounts": ("account", "minimum"), "limits": ("max_", "limit"), "platform": ("cron", "report")}
    low = F.lower("content")
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)), name) for name, (a, b) in rules.items())))
    return load(spark, sf_dir).select("file_id", F.explode(found).alias("domain"))


def call_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls worth following for two words: 4 a word in the edge, 8 in the caller, 30 in two repositories, 8 for external calls; 35 at least, the first five by kind and name."""
    e = R.edges(load(spark, sf_dir), ["file_id", "repo", "path"]).filter("type LIKE 'CALLS%'")
    text = F.lower(F.concat_ws("\n", "repo", "path", "from_symbol", "receiver", "name"))
    words = ("load", "part")
    score = sum((F.when(F.contains(text, F.lit(w)), 4).otherwise(0) for w in words), F.lit(0))
    score = score + F.when(F.lower(F.coalesce("from_symbol", F.lit(""))).rlike("|".join(words)), 8).otherwise(0) + F.when(F.col("repo").isin("repo-1", "repo-2"), 30).otherwise(0) + F.when(F.col("type") == "CALLS_EXTERNAL_FUNC", 8).otherwise(0)
    best = e.withColumn("score", score).filter("score >= 35").groupBy("type", "name").agg(F.max(F.struct("score", (-F.col("file_id")).alias("f"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("b.score"), F.desc("b.f"), "name"))
    return best.withColumn("rank", rank).filter("rank <= 5").select("type", "rank", "name", F.col("b.score").alias("score"), (-F.col("b.f")).alias("file_id"))


def asked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of a question in the order it names them, each with its files."""
    q = F.lit("compare /v7/items and /items/12 with /health/4 or /legacy/8")
    asked = load(spark, sf_dir).limit(1).select(F.posexplode(A.routes_of(q)).alias("place", "route")).withColumn("route", T.normalize_route(F.col("route")))
    held = points(spark, sf_dir).select("file_id", F.explode(F.transform("routes", T.normalize_route)).alias("route")).distinct()
    return held.join(F.broadcast(asked), "route").groupBy("place", "route").agg(F.count("*").alias("n_files"))


def alias_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without marks, aliases in single spaces, project ids split, lower-cased and valid, at most 24."""
    c = read(spark, sf_dir, "customer")
    raw = F.concat(F.lit(" "), "c_name", F.lit("-X ; "), "c_mktsegment", F.lit(",Bad Id!,"), "c_mktsegment")
    ids = F.slice(F.array_distinct(F.filter(F.transform(F.split(raw, "[,;]"), lambda x: F.lower(F.trim(x))), lambda x: x.rlike("^[a-z0-9][a-z0-9_#-]*$"))), 1, 24)
    return c.select("c_custkey", F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", "")).alias("token"), F.lower(F.trim(F.regexp_replace(raw, r"[\s_-]+", " "))).alias("alias"), F.array_join(ids, ",").alias("project_ids"))


def method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of each handler's dotted name and a label of its place."""
    files = load(spark, sf_dir)
    h = files.select("file_id", "repo", "path", F.explode(F.regexp_extract_all("content", F.lit(r"handler\s*:\s*([\w$.]+)"), F.lit(1))).alias("handler"))
    return h.select("file_id", "handler", F.element_at(F.split("handler", r"\."), -1).alias("method"), F.format_string("%s:%s#%s", "repo", "path", "handler").alias("label"))


#: Fixed values of a localisation: phrases and what stands for them, in this order.
PHRASES = (("Which services use", "Layanan apa yang memakai"), ("database table", "tabel database"), ("How does the flow of", "Bagaimana alur"), ("work", "berjalan"), ("what is", "apa itu"))


def localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("question")
    for a, b in PHRASES:
        text = F.regexp_replace(text, rf"\b{a}\b", b)
    return questions(spark, sf_dir).select("question_id", text.alias("text"))


def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled text that would be embedded for a point, its two ends if long."""
    p = points(spark, sf_dir)
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    text = F.concat_ws("\n", F.concat(F.lit("Repository: "), "repo"), F.concat(F.lit("File: "), "path"), line("Routes", "routes"), line("Symbols", "symbols"), line("Tables", "db_tables"), "content")
    return p.select("file_id", F.length(text).alias("n_chars"), T.head_tail(text, 230, 100).alias("text"))


def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and their sources apart: what stands before the last line `Sources:` and the list below it."""
    q = read(spark, sf_dir, "nation")
    out = F.concat(F.lit("Answer for "), "n_name", F.lit("\nSources:\n- a/"), "n_name", F.lit("\n- b/"), F.col("n_nationkey").cast("string"), F.lit("\n"))
    return q.select("n_nationkey", F.trim(F.regexp_extract(out, r"(?s)^(.*)\nSources:\n", 1)).alias("answer"), F.array_join(F.regexp_extract_all(F.regexp_extract(out, r"(?s)\nSources:\n(.*)$", 1), F.lit(r"(?m)^- (.+)$"), F.lit(1)), ",").alias("sources"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of a question: its terms less noise, known prefixes cut, and what an alias stands for; at most 24."""
    noise, alias = ("response", "payload", "meaning"), {"env": "environment", "vars": "variables"}
    t = F.filter(A.terms_of(F.col("question")), lambda w: ~w.isin(*noise))
    short = F.transform(t, lambda w: F.regexp_replace(w, "^(repo-|item_)", ""))
    named = F.transform(short, lambda w: F.coalesce(*(F.when(w == k, v) for k, v in alias.items()), w))
    return questions(spark, sf_dir).select("question_id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.concat(t, named))), 1, 24), ",").alias("terms"))


def structural_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the points of each repository hold by structure: lists of names, at most eight, and how many there are."""
    rows = facts(spark, sf_dir, "api", "database", "rabbitmq", "cron", "env")
    names = rows.groupBy("repo", "kind").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return names.select("repo", "kind", F.size("names").alias("n"), F.array_join(F.slice("names", 1, 8), ", ").alias("sample"))


def coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many percent of a repository's files hold evidence other than unknown, rounded."""
    p = points(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(~F.array_contains("evidence", "unknown")).alias("known"))
    return p.select("repo", "n", "known", F.floor(F.col("known") * 100 / F.col("n") + 0.5).alias("percent"))


def index_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored count of a repository's points still holds: within one percent."""
    n = load(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n")).withColumn("stored", F.col("n") + F.substring("repo", 6, 1).cast("int") - 2)
    return n.select("repo", "n", "stored", (F.abs(F.col("n") - F.col("stored")) * 100 <= F.col("n")).alias("fresh"))


def project_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the project ids of a repository's files."""
    p = load(spark, sf_dir).select("repo", F.array(F.concat(F.lit("p"), (F.col("file_id") % 3).cast("string")), F.when(F.col("branch") == "develop", F.lit("next")).otherwise(F.lit("live"))).alias("ids"))
    return p.groupBy("repo").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))), ",").alias("project_ids"))


def affected_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that an entry of a registry names, that its path rules match or that hold its paths; at most 100."""
    entry = F.concat(F.lit("entry-"), F.col("s_suppkey") % 4)
    s = read(spark, sf_dir, "supplier").select(entry.alias("entry"), F.concat(F.lit("repo-"), (F.col("s_suppkey") % 7).cast("string")).alias("repo"))
    named = s.filter("entry IN ('entry-0', 'entry-1')")
    paths = load(spark, sf_dir).select("repo", "path").distinct()
    matched = paths.select("repo", F.when(F.col("path").startswith("cmd/"), "entry-2").when(F.col("path").rlike(r"^docs/[^/]*/guide"), "entry-3").alias("entry")).filter("entry IS NOT NULL").distinct()
    both = named.unionByName(matched).distinct()
    return both.groupBy("entry").agg(F.array_join(F.slice(F.array_sort(F.collect_set("repo")), 1, 100), ",").alias("repos"))


def prompt_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All active directives, newest first, as one text a user; no trigger is tested."""
    e = read(spark, sf_dir, "events").filter("event_type IN ('click', 'view')")
    newest = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("event_id")))).filter("n = 1")
    line = F.concat(F.lit("- "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
    return newest.groupBy("user_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))).alias("x")).select("user_id", F.array_join("x.line", "\n").alias("directives"))


def deep_investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of an investigation: named points, other files of their repositories that share a table, then tables only those touch."""
    q = questions(spark, sf_dir).filter("question_id % 10 IN (0, 2)")
    known = checkpointed(points(spark, sf_dir))  # thirty patterns a file, evaluated once
    first = A.rerank(q, known, 4).select("question_id", "file_id")
    t = known.select("file_id", "repo", F.explode("db_tables").alias("tab")).withColumn("tab", F.lower("tab")).distinct()
    return A.widened(first, checkpointed(t)).select("question_id", "n_named", "n_shared", "n_new_tables")


def account_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account types with their codes and least deposits, in preferred order, then by name."""
    v = A.vocabulary(load(spark, sf_dir), ["file_id"]).filter("group_name = 'ACCOUNT_TYPES'")
    code, least = F.regexp_extract("value", r"code: '([^']*)'", 1), F.regexp_extract("value", r"minimum: (\d+)", 1).cast("int")
    place = F.array_position(F.array(F.lit("Silver"), F.lit("Pro")), F.col("term"))
    order = F.row_number().over(Window.partitionBy("file_id").orderBy(F.when(place > 0, place).otherwise(99), "term"))
    return v.select("file_id", order.alias("place"), "term", code.alias("code"), least.alias("minimum"))


def registry_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each registry entry a question names: the entry, its kind and repositories."""
    entry = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.concat(F.lit("kind-"), F.col("n_regionkey").cast("string")).alias("kind"), F.concat(F.lit("repo-"), (F.col("n_nationkey") % 7).cast("string")).alias("repo"))
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("orders of nation_"), F.col("c_nationkey").cast("string"), F.lit(" please")).alias("question"))
    words = asked.select("c_custkey", F.explode(F.split("question", " ")).alias("name"))
    return words.join(entry, "name").select("c_custkey", F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit("): "), "repo").alias("line"))


def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision records in Markdown: number, title, status, context and consequences from orders of high priority."""
    o = read(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("superseded")
    text = F.concat(F.lit("# ADR "), F.col("o_orderkey").cast("string"), F.lit(": order of customer "), F.col("o_custkey").cast("string"), F.lit("\n\n## Status\n"), status,
                    F.lit("\n\n## Context\nPriority "), "o_orderpriority", F.lit("\n\n## Consequences\nDated "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", text.alias("record"))


QUERIES = {
    f.__name__: f
    for f in (
        any_match, unbranched, search_texts, table_name_check, own_repo_excluded, uncovered_feedback, handler_resolution, doc_subjects, vocabulary_hits, locale_points,
        domain_terms, call_scores, asked_order, alias_norms, method_names, localised, embedding_inputs, answer_parts, search_terms, structural_answer, coverage_percent,
        index_tolerance, project_unions, affected_repos, prompt_directives, deep_investigation, account_types, registry_context, decision_records,
    )
}

ORACLE = {
    "any_match": with_sources(
        "WITH w AS (SELECT file_id, list_sort(list_filter(db_tables, lambda t: regexp_full_match(t, 'item_([1-9]|1[0-9]|20)'))) AS t FROM hints) SELECT file_id, array_to_string(t, ',') AS tables FROM w WHERE len(t) > 0", *_POINTS
    ),
    "unbranched": "WITH o AS (SELECT o_orderkey, o_custkey % 50 AS repo, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS branch FROM orders) SELECT o_orderkey, repo FROM o WHERE branch IS NULL AND repo IN (SELECT repo FROM o WHERE branch IS NOT NULL)",
    "search_texts": with_sources(
        "WITH t AS (SELECT file_id, lower(concat_ws(chr(10), repo, path, " + ", ".join(f"array_to_string({c}, chr(10))" for c in ("routes", "symbols", "message_names", "queue_names", "exchange_names", "db_tables"))
        + ", content)) AS x FROM hints) SELECT file_id, length(x) AS n_chars, sha256(x) AS digest FROM t", *_POINTS
    ),
    "table_name_check": with_sources("SELECT name, count(DISTINCT file_id) AS n_files FROM edges WHERE type = 'TOUCHES_TABLE' AND regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*') AND length(name) >= 5 GROUP BY name", *_EDGES),
    "own_repo_excluded": with_sources(
        "SELECT a AS asked, repo, count(*) AS n FROM sources, (VALUES ('repo-1'), ('repo-6'), ('any')) v(a) WHERE (a = 'any' AND repo <> 'repo-6') OR a = repo GROUP BY ALL"
    ),
    "uncovered_feedback": """WITH l AS (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1 AND user_id % 2 = 0)
        SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events WHERE event_type NOT IN (SELECT event_type FROM l) GROUP BY user_id""",
    "handler_resolution": with_sources(
        r"""WITH n AS (SELECT file_id, unnest(regexp_extract_all(content, 'const\s+([A-Za-z_]\w*)\s*=\s*require\(\s*["'']([^"'']+)["'']', 1)) AS alias, unnest(regexp_extract_all(content, 'const\s+([A-Za-z_]\w*)\s*=\s*require\(\s*["'']([^"'']+)["'']', 2)) AS target FROM sources),
        h AS (SELECT file_id, repo, unnest(list_distinct(regexp_extract_all(content, 'handler\s*:\s*([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)', 1))) AS handler FROM sources),
        k AS (SELECT repo, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[a-z.]+$', '') AS stem, min(file_id) AS found FROM sources GROUP BY ALL)
        SELECT h.file_id, handler, string_split(handler, '.')[-1] AS method, target, found::VARCHAR AS found FROM h LEFT JOIN n ON h.file_id = n.file_id AND string_split(handler, '.')[1] = alias
        LEFT JOIN k ON h.repo = k.repo AND regexp_extract(target, '([^/]+)$', 1) = k.stem"""
    ),
    "doc_subjects": with_sources(
        r"""WITH s AS (SELECT repo, file_id, CASE WHEN contains(lower(regexp_extract(content, 'title: (.*)', 1)), 'items') THEN 70 ELSE 0 END
            + CASE WHEN contains(array_to_string(regexp_extract_all(lower(content), '(?m)^#+ (.*)$', 1), chr(10)), 'items') THEN 45 ELSE 0 END + CASE WHEN contains(lower(path), 'items') THEN 30 ELSE 0 END
            + 12 * least(len(regexp_extract_all(lower(content), 'items')), 5) + CASE WHEN contains(path, '/en/') THEN 15 ELSE 0 END AS score FROM sources WHERE path LIKE '%.md')
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY score DESC, file_id) AS rank, file_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
    ),
    "vocabulary_hits": with_sources(
        f"""WITH a AS (SELECT DISTINCT question_id, unnest(list_concat({_TERMS}, ['pro', 'silver'])) AS name FROM questions WHERE question_id % 10 = 6)
        SELECT question_id, name, count(DISTINCT file_id) AS n_files, min(file_id) AS first_file FROM a JOIN (SELECT file_id, lower(term) AS name FROM vocabulary) USING (name) GROUP BY ALL""",
        _ASKS, _VOCABULARY,
    ),
    "locale_points": f"WITH {search.nearest_sql('p.label = 1', 5)} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM near",
    "domain_terms": with_sources(
        """SELECT file_id, domain FROM sources, (VALUES ('accounts', 'account', 'minimum'), ('limits', 'max_', 'limit'), ('platform', 'cron', 'report')) r(domain, a, b)
        WHERE contains(lower(content), a) AND contains(lower(content), b)"""
    ),
    "call_scores": with_sources(
        """WITH s AS (SELECT *, 4 * (contains(t, 'load')::INT + contains(t, 'part')::INT) + CASE WHEN regexp_matches(lower(coalesce(from_symbol, '')), 'load|part') THEN 8 ELSE 0 END
            + CASE WHEN repo IN ('repo-1', 'repo-2') THEN 30 ELSE 0 END + CASE WHEN type = 'CALLS_EXTERNAL_FUNC' THEN 8 ELSE 0 END AS score
            FROM (SELECT *, lower(concat_ws(chr(10), repo, path, from_symbol, receiver, name)) AS t FROM linked WHERE type LIKE 'CALLS%')),
        b AS (SELECT type, name, score, file_id FROM s WHERE score >= 35 QUALIFY row_number() OVER (PARTITION BY type, name ORDER BY score DESC, file_id) = 1)
        SELECT type, row_number() OVER (PARTITION BY type ORDER BY score DESC, file_id, name) AS rank, name, score, file_id FROM b QUALIFY rank <= 5""",
        *_EDGES,
    ),
    "asked_order": with_sources(
        f"""SELECT place, route, count(DISTINCT file_id) AS n_files FROM (VALUES (0, '/v7/items'), (1, '/items/12'), (2, '/health/4'), (3, '/legacy/8')) a(place, route)
        JOIN (SELECT file_id, {_ROUTE.format("r")} AS route FROM (SELECT file_id, unnest(routes) AS r FROM hints)) USING (route) GROUP BY ALL""",
        *_POINTS,
    ),
    "alias_norms": r"""WITH c AS (SELECT c_custkey, ' ' || c_name || '-X ; ' || c_mktsegment || ',Bad Id!,' || c_mktsegment AS raw FROM customer),
        i AS (SELECT *, list_filter(list_transform(string_split_regex(raw, '[,;]'), lambda x: lower(trim(x))), lambda x: regexp_full_match(x, '[a-z0-9][a-z0-9_#-]*')) AS ids FROM c)
        SELECT c_custkey, lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS token, lower(trim(regexp_replace(raw, '[\s_-]+', ' ', 'g'))) AS alias,
        array_to_string(list_slice(list_filter(ids, lambda x, k: list_position(ids, x) = k), 1, 24), ',') AS project_ids FROM i""",
    "method_names": with_sources(
        r"""SELECT file_id, handler, string_split(handler, '.')[-1] AS method, repo || ':' || path || '#' || handler AS label FROM (SELECT file_id, repo, path, unnest(regexp_extract_all(content, 'handler\s*:\s*([\w$.]+)', 1)) AS handler FROM sources)"""
    ),
    "localised": with_sources(
        r"""SELECT question_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '\bWhich services use\b', 'Layanan apa yang memakai', 'g'), '\bdatabase table\b', 'tabel database', 'g'),
        '\bHow does the flow of\b', 'Bagaimana alur', 'g'), '\bwork\b', 'berjalan', 'g'), '\bwhat is\b', 'apa itu', 'g') AS text FROM questions""",
        _ASKS,
    ),
    "embedding_inputs": with_sources(
        """WITH t AS (SELECT file_id, concat_ws(chr(10), 'Repository: ' || repo, 'File: ' || path, CASE WHEN len(routes) > 0 THEN 'Routes: ' || array_to_string(routes, ', ') END,
            CASE WHEN len(symbols) > 0 THEN 'Symbols: ' || array_to_string(symbols, ', ') END, CASE WHEN len(db_tables) > 0 THEN 'Tables: ' || array_to_string(db_tables, ', ') END, content) AS x FROM hints)
        SELECT file_id, length(x) AS n_chars, CASE WHEN length(x) > 330 THEN left(x, 230) || chr(10) || '...' || chr(10) || right(x, 100) ELSE x END AS text FROM t""",
        *_POINTS,
    ),
    "answer_parts": "SELECT n_nationkey, 'Answer for ' || n_name AS answer, 'a/' || n_name || ',b/' || n_nationkey AS sources FROM nation",
    "search_terms": with_sources(
        f"""WITH t AS (SELECT question_id, list_filter({_TERMS}, lambda w: w NOT IN ('response', 'payload', 'meaning')) AS t FROM questions)
        SELECT question_id, array_to_string(list_slice(list_sort(list_distinct(list_concat(t, list_transform(t, lambda w: CASE regexp_replace(w, '^(repo-|item_)', '') WHEN 'env' THEN 'environment' WHEN 'vars' THEN 'variables'
        ELSE regexp_replace(w, '^(repo-|item_)', '') END)))), 1, 24), ',') AS terms FROM t""",
        _ASKS,
    ),
    "structural_answer": with_sources(
        """SELECT repo, kind, count(DISTINCT name) AS n, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 8), ', ') AS sample FROM facts WHERE kind IN ('api', 'database', 'rabbitmq', 'cron', 'env') GROUP BY ALL""", *_FACTS
    ),
    "coverage_percent": with_sources(
        "SELECT s.repo, count(*) AS n, count(*) FILTER (WHERE NOT list_contains(evidence, 'unknown')) AS known, floor(count(*) FILTER (WHERE NOT list_contains(evidence, 'unknown')) * 100 / count(*) + 0.5)::BIGINT AS percent FROM sources s JOIN evidence USING (file_id) GROUP BY s.repo",
        *_EVIDENCE_ALL,
    ),
    "index_tolerance": with_sources("SELECT repo, n, n + repo[6]::INT - 2 AS stored, abs(repo[6]::INT - 2) * 100 <= n AS fresh FROM (SELECT repo, count(*) AS n FROM sources GROUP BY repo)"),
    "project_unions": with_sources(
        "SELECT repo, string_agg(DISTINCT i, ',' ORDER BY i) AS project_ids FROM (SELECT repo, unnest(['p' || file_id % 3, CASE WHEN branch = 'develop' THEN 'next' ELSE 'live' END]) AS i FROM sources) GROUP BY repo"
    ),
    "affected_repos": with_sources(
        r"""WITH b AS (SELECT 'entry-' || s_suppkey % 4 AS entry, 'repo-' || s_suppkey % 7 AS repo FROM supplier WHERE s_suppkey % 4 < 2
            UNION SELECT 'entry-2', repo FROM sources WHERE path LIKE 'cmd/%' UNION SELECT 'entry-3', repo FROM sources WHERE regexp_matches(path, '^docs/[^/]*/guide'))
        SELECT entry, string_agg(repo, ',' ORDER BY repo) AS repos FROM b GROUP BY entry"""
    ),
    "prompt_directives": """WITH n AS (SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
        SELECT user_id, string_agg('- ' || event_type || ' ' || event_id, chr(10) ORDER BY event_id DESC) AS directives FROM n GROUP BY user_id""",
    "deep_investigation": with_sources(
        """WITH f AS (SELECT question_id, file_id FROM ranked WHERE rank <= 4 AND question_id % 10 IN (0, 2)), t AS (SELECT DISTINCT file_id, repo, lower(unnest(db_tables)) AS tab FROM hints),
        s AS (SELECT DISTINCT question_id, repo, tab FROM f JOIN t USING (file_id)), g AS (SELECT DISTINCT question_id, t.file_id FROM s JOIN t USING (repo, tab)),
        c AS (SELECT * FROM g ANTI JOIN f USING (question_id, file_id)), w AS (SELECT DISTINCT question_id, tab FROM c JOIN t USING (file_id)), x AS (SELECT * FROM w ANTI JOIN s USING (question_id, tab))
        SELECT question_id, count(*) AS n_named, coalesce((SELECT count(*) FROM c WHERE c.question_id = f.question_id), 0) AS n_shared, coalesce((SELECT count(*) FROM x WHERE x.question_id = f.question_id), 0) AS n_new_tables FROM f GROUP BY question_id""",
        *_POINTS, *_EVIDENCE_ALL, *_RERANK,
    ),
    "account_types": with_sources(
        r"""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY CASE term WHEN 'Silver' THEN 1 WHEN 'Pro' THEN 2 ELSE 99 END, term) AS place, term, regexp_extract(value, 'code: ''([^'']*)''', 1) AS code,
        regexp_extract(value, 'minimum: (\d+)', 1)::INT AS minimum FROM vocabulary WHERE group_name = 'ACCOUNT_TYPES'""",
        _VOCABULARY,
    ),
    "registry_context": """SELECT c_custkey, '- ' || lower(n_name) || ' (kind-' || n_regionkey || '): repo-' || n_nationkey % 7 AS line FROM customer JOIN nation ON lower(n_name) = 'nation_' || c_nationkey""",
    "decision_records": """SELECT o_orderkey, '# ADR ' || o_orderkey || ': order of customer ' || o_custkey || chr(10) || chr(10) || '## Status' || chr(10) || CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' ELSE 'superseded' END
        || chr(10) || chr(10) || '## Context' || chr(10) || 'Priority ' || o_orderpriority || chr(10) || chr(10) || '## Consequences' || chr(10) || 'Dated ' || strftime(o_orderdate, '%Y-%m-%d') AS record FROM orders WHERE o_orderpriority LIKE '1%'""",
}
