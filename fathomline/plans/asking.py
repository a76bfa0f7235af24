"""Queries: gates of questions, exact names, reranking, context, vocabularies, notes and trees, each beside SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asking as A
from ..session import checkpointed, read
from .hints import _EVIDENCE_ALL, _POINTS, points
from .sources import load, with_sources

#: Questions from suppliers; part 12 * key has a controller file.
_S, _K = "CAST(s_suppkey % 50 + 1 AS VARCHAR(20))", "CAST(s_suppkey * 12 AS VARCHAR(20))"
QUESTIONS = f"""SELECT s_suppkey AS question_id, CASE s_suppkey % 10
 WHEN 0 THEN concat('Which services use the database table item_', {_S}, '?')
 WHEN 1 THEN concat('How does the flow of /items/', {_K}, ' work')
 WHEN 2 THEN concat('What does item', {_K}, 'controller do and what is its response payload')
 WHEN 3 THEN 'Which database tables are used?'
 WHEN 4 THEN 'Hello!'
 WHEN 5 THEN concat('What is the meaning of queue jobs.', {_S}, ' and item.created.', {_S})
 WHEN 6 THEN 'what env vars are read by repo-3'
 WHEN 7 THEN 'what is P5'
 WHEN 8 THEN concat('North: call of /v', {_S}, '/items in the glossary')
 ELSE 'how to gain a level at south' END AS question FROM supplier"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "supplier").createOrReplaceTempView("_supplier_questions")
    return spark.sql(QUESTIONS.removesuffix("supplier") + "_supplier_questions")


def question_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of questions, and the hints they give: a region, a platform, a reward."""
    asked = questions(spark, sf_dir)
    given = A.domain_hints(asked, spark.createDataFrame(HINTS, HINT_RULES))
    one = lambda *names: F.max(F.when(F.col("hint").isin(*names), F.col("hint")))
    regions = F.count_if(F.col("hint").isin("north", "south")) == 1
    hints = given.groupBy("question_id").agg(F.when(regions, one("north", "south")).alias("region"), one("P4", "P5").alias("platform"), F.count_if(F.col("hint") == "reward").alias("reward"))
    flags = asked.select("question_id", *(v.cast("int").alias(k) for k, v in A.gates(F.col("question")).items()))
    return flags.join(hints, "question_id", "left").withColumn("reward", F.coalesce(F.col("reward"), F.lit(0)).cast("int"))


HINT_RULES = "hint string, any array<string>, also array<string>, none array<string>, alone boolean"
#: A table of hints: (hint, any, also, none, alone).
HINTS = [
    ("north", ["north"], [], ["south", "southern"], False),
    ("south", ["south", "southern"], [], ["north"], False),
    ("P4", ["p4"], [], ["p5"], True),
    ("P5", ["p5"], [], [], True),
    ("reward", ["level", "rank", "points"], ["how", "gain", "get", "earn"], [], False),
    ("tables", ["database", "tables"], None, None, False),
]


def domain_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints that questions give, by a table of rules."""
    rules = spark.createDataFrame(HINTS, HINT_RULES)
    return A.domain_hints(questions(spark, sf_dir), rules)


def exact_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that have a route of the question, after normalisation."""
    asked = questions(spark, sf_dir).select("question_id", F.explode(F.transform(A.routes_of(F.col("question")), T.normalize_route)).alias("route")).distinct()
    held = points(spark, sf_dir).select("file_id", F.explode(F.transform("routes", T.normalize_route)).alias("route")).distinct()
    return asked.join(held, "route").select("question_id", "route", "file_id")


def rerank_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rerank(questions(spark, sf_dir), points(spark, sf_dir))


def strong_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked points whose text or names hold a term of the question."""
    known = checkpointed(points(spark, sf_dir))  # thirty patterns a file, evaluated once
    text = F.lower(F.concat_ws("\n", "repo", "path", "content"))
    held = F.size(F.filter("terms", lambda t: F.contains(text, t)))
    return A.rerank(questions(spark, sf_dir), known, 5, {"n_terms": held}).filter("n_terms > 0").select("question_id", "file_id", "n_terms")


def fallback_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best points of every repository by their own evidence, none at -40 or below."""
    p = points(spark, sf_dir, once=True).withColumn("score", A.fallback_score(None)).filter("score > -40")
    rank = F.row_number().over(A.Window.partitionBy("repo").orderBy(F.desc("score"), "file_id"))
    return p.withColumn("rank", rank).filter("rank <= 12").select("repo", "rank", "file_id", "score")


def vocabulary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vocabulary(load(spark, sf_dir), ["file_id"])


def glossary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each vocabulary: its name, kind, source and terms in order."""
    rows = A.vocabulary(load(spark, sf_dir), ["file_id", "path"])
    item = F.concat(F.lit("- "), "term", F.when(F.col("value") != "", F.concat(F.lit(": "), "value")).otherwise(F.lit("")))
    listed = rows.groupBy("file_id", "path", "group_name", "kind").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("items"))
    head = F.concat(F.lit("Vocabulary: "), "group_name", F.lit("\nKind: "), "kind", F.lit("\nSource: "), "path", F.lit("\nTerms:\n"))
    return listed.select("file_id", "group_name", F.concat(head, F.array_join("items.item", "\n")).alias("content"))


def vocabulary_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each term the entry with the longest value, the first file on a tie, and how many files have it."""
    rows = A.vocabulary(load(spark, sf_dir), ["file_id"]).withColumn("key", F.lower("term"))
    best = F.max_by(F.struct("file_id", "group_name", "value"), F.struct(F.length("value"), -F.col("file_id")))
    return rows.groupBy("key").agg(F.countDistinct("file_id").alias("n_files"), best.alias("b")).select("key", "n_files", "b.file_id", "b.group_name", "b.value")


def documentation_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that documents define: bold names or list items with a colon below a glossary heading."""
    docs = load(spark, sf_dir).filter("path LIKE '%.md'")
    part = F.regexp_extract("content", r"(?s)## Glossary\n(.*?)(?:\n##|$)", 1)
    lines = docs.select("file_id", F.explode(F.split(part, "\n")).alias("x"))
    term = F.regexp_extract("x", r"^\*\s+(?:\*\*)?([^:*]+?)(?:\*\*)?:\s*(.+)$", 1)
    return lines.select("file_id", term.alias("term"), F.regexp_extract("x", r"^\*\s+(?:\*\*)?([^:*]+?)(?:\*\*)?:\s*(.+)$", 2).alias("definition")).filter("term <> ''")


def comment_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment line of each repository that says most about orders: 3 a word of the question, 5 a pair of words, 6 at least."""
    words = ["every", "order", "days", "status", "twice"]
    lines = load(spark, sf_dir).select("repo", "file_id", F.posexplode(F.split("content", "\n")).alias("line", "x")).filter(F.col("x").rlike(r"^\s*(//|/\*|\*|--|#)"))
    low = F.lower("x")
    score = sum((F.when(F.contains(low, F.lit(w)), 3).otherwise(0) for w in words), F.lit(0)) + sum((F.when(F.contains(low, F.lit(f"{a} {b}")), 5).otherwise(0) for a, b in zip(words, words[1:])), F.lit(0))
    best = F.max_by(F.struct("file_id", (F.col("line") + 1).alias("line"), "x"), F.struct("score", -F.col("file_id"), -F.col("line")))
    return lines.withColumn("score", score).filter("score >= 6").groupBy("repo").agg(F.max("score").alias("score"), best.alias("b")).select("repo", "score", "b.file_id", "b.line", F.trim("b.x").alias("text"))


def route_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that hold at least two terms of a question: 20 a term, 40 if the route holds all, the six best."""
    asked = questions(spark, sf_dir).select("question_id", F.slice(F.flatten(F.transform(A.terms_of(F.col("question")), lambda t: F.filter(F.split(t, "[/.]+"), lambda w: w != ""))), 1, 8).alias("terms"))
    asked = asked.withColumn("terms", F.array_distinct("terms")).filter(F.size("terms") >= 2)
    held = points(spark, sf_dir).select(F.explode("routes").alias("route")).distinct().withColumn("parts", F.array_distinct(F.filter(F.split(F.lower("route"), "[/.]+"), lambda w: w != "")))
    scored = A.shared_words(asked, held, "question_id", "terms", "route", "parts").withColumn("score", F.col("n") * 20 + F.when(F.col("n") == F.size("terms"), 40).otherwise(0))
    rank = F.row_number().over(A.Window.partitionBy("question_id").orderBy(F.desc("score"), "route"))
    return scored.withColumn("rank", rank).filter("rank <= 6").select("question_id", "rank", "route", "score")


def adf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of document trees made of orders."""
    o = read(spark, sf_dir, "orders")
    leaf = lambda x: F.concat(F.lit('{"type":"text","text":"'), x.cast("string"), F.lit('"}'))
    box = lambda kind, *xs: F.concat(F.lit(f'{{"type":"{kind}","content":['), F.concat_ws(",", *xs), F.lit("]}"))
    item = box("listItem", box("paragraph", leaf(F.col("o_orderpriority"))))
    tree = box("doc", box("heading", leaf(F.col("o_orderkey"))), box("paragraph", leaf(F.col("o_orderstatus")), leaf(F.lit(" of ")), leaf(F.col("o_custkey"))), box("bulletList", item, item))
    return o.select("o_orderkey", A.adf_text(tree).alias("text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after the events of their users: sign-ups create, errors delete, others change them."""
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return A.note_state(e.select(F.col("user_id").alias("note_id"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("title"), F.col("event_id").alias("at")))


def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of asked ids that also meet a filter and have content."""
    ids = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("file_id")).distinct()
    return load(spark, sf_dir).join(ids, "file_id", "left_semi").filter("branch = 'main' AND trim(content) <> ''").select("file_id", "repo", "path")


def file_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of the files that hold a hit: equal repository, branch and path, in order of lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 40).alias("file"), (F.col("doc_id") % 100 * 10).alias("line"))
    hits = docs.filter("doc_id % 97 = 3").select("source", "lang", "file").distinct()
    held = docs.join(hits, ["source", "lang", "file"], "left_semi")
    place = F.row_number().over(A.Window.partitionBy("source", "lang", "file").orderBy("line", "doc_id"))
    return held.select("source", "lang", "file", "doc_id", place.alias("place"))


def docs_to_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files of a repository that share an identifier with one of its documents."""
    p = points(spark, sf_dir)
    names = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(r"\b([A-Z][A-Za-z0-9]+::[A-Z_]+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+[0-9]*[A-Za-z]*)\b"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"`([a-z]+(?:_[a-z0-9]+)+)`"), F.lit(1))))
    docs = p.filter("path LIKE '%.md'").select("repo", F.col("file_id").alias("doc_file"), F.explode(names).alias("name"))
    code = p.filter("path NOT LIKE '%.md'").select("repo", "file_id", F.explode(F.array_distinct(F.concat("symbols", "db_tables"))).alias("name")).distinct()
    return docs.join(code, ["repo", "name"]).groupBy("doc_file", "file_id").agg(F.count("*").alias("n_names"))


def comparison_of_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes served by several repositories: which, with how many files each."""
    r = points(spark, sf_dir).select("repo", "file_id", F.explode(F.transform("routes", T.normalize_route)).alias("route")).distinct()
    per = r.groupBy("route", "repo").agg(F.count("*").alias("n"))
    many = per.groupBy("route").agg(F.count("*").alias("n_repos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo", "n"))), lambda x: F.concat(x["repo"], F.lit(":"), x["n"].cast("string"))), ",").alias("served"))
    return many.filter("n_repos > 1")


QUERIES = {
    "question_gates": question_gates,
    "domain_hints": domain_hints,
    "exact_routes": exact_routes,
    "rerank_named": rerank_named,
    "strong_evidence": strong_evidence,
    "fallback_context": fallback_context,
    "vocabulary_groups": vocabulary_groups,
    "glossary_text": glossary_text,
    "vocabulary_answer": vocabulary_answer,
    "documentation_glossary": documentation_glossary,
    "comment_rule": comment_rule,
    "route_anchors": route_anchors,
    "adf_texts": adf_texts,
    "notes": notes,
    "lookup_by_ids": lookup_by_ids,
    "file_expansion": file_expansion,
    "docs_to_code": docs_to_code,
    "comparison_of_routes": comparison_of_routes,
}

_ASKS = f"questions AS ({QUESTIONS})"
_ROUTES_OF = "list_distinct(regexp_extract_all(question, '/[A-Za-z0-9_./:{}-]+'))"
_STOP = "'" + "', '".join(A.STOP) + "'"
_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9_./-]*[a-z0-9_]'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))"
_ROUTE = "CASE WHEN regexp_replace(trim({0}), '/+$', '') = '' THEN '/' ELSE lower(regexp_replace(trim({0}), '/+$', '')) END"
_VOCABULARY = r"""vocabulary AS (SELECT file_id, path, group_name, kind, generate_subscripts(terms, 1) - 1 AS position, trim(unnest(terms)) AS term, trim(unnest(values_)) AS value FROM (
    SELECT file_id, path, regexp_extract(g, 'const\s+([A-Z][A-Z0-9_]*)', 1) AS group_name, 'object' AS kind, regexp_extract_all(body, '([A-Za-z_]\w*)\s*:\s*["''`]?([^"''`,}]*)["''`]?', 1) AS terms,
        regexp_extract_all(body, '([A-Za-z_]\w*)\s*:\s*["''`]?([^"''`,}]*)["''`]?', 2) AS values_
    FROM (SELECT file_id, path, unnest(regexp_extract_all(content, '\bconst\s+[A-Z][A-Z0-9_]*\s*=\s*\{[^{}]*\}')) AS g, regexp_extract(g, '\{([^{}]*)\}', 1) AS body FROM sources)
    UNION ALL SELECT file_id, path, regexp_extract(g, 'const\s+([A-Z][A-Z0-9_]*)', 1), 'records', regexp_extract_all(g, '\{\s*name\s*:\s*["''`]([^"''`]+)["''`]\s*,\s*([^}]*)\}', 1),
        regexp_extract_all(g, '\{\s*name\s*:\s*["''`]([^"''`]+)["''`]\s*,\s*([^}]*)\}', 2)
    FROM (SELECT file_id, path, unnest(regexp_extract_all(content, '\bconst\s+[A-Z][A-Z0-9_]*\s*=\s*\[(?:\s*\{[^{}]*\}\s*,?)+\s*\]')) AS g FROM sources)
    UNION ALL SELECT file_id, path, regexp_extract(g, '\$([a-z_]+)', 1), 'php', regexp_extract_all(g, '["'']([^"'']+)["'']\s*=>\s*["'']?([^"'',\]]*)["'']?', 1),
        regexp_extract_all(g, '["'']([^"'']+)["'']\s*=>\s*["'']?([^"'',\]]*)["'']?', 2)
    FROM (SELECT file_id, path, unnest(regexp_extract_all(content, '\$[a-z_]+\s*=\s*\[[^\[\]]*=>[^\[\]]*\]')) AS g FROM sources))
    WHERE len(list_distinct(list_transform(terms, lambda t: lower(t)))) >= 3)"""
_RERANK = (
    _ASKS,
    f"asked AS (SELECT question_id, question, {_TERMS} AS terms FROM questions)",
    f"""named AS (SELECT DISTINCT file_id, kind, name FROM (SELECT file_id, 'route' AS kind, {_ROUTE.format("r")} AS name FROM (SELECT file_id, unnest(routes) AS r FROM hints)
        UNION ALL SELECT file_id, 'symbol', lower(unnest(symbols)) FROM hints UNION ALL SELECT file_id, 'queue', lower(unnest(queue_names)) FROM hints
        UNION ALL SELECT file_id, 'table', lower(unnest(db_tables)) FROM hints))""",
    """matched AS (SELECT question_id, file_id, sum(CASE kind WHEN 'route' THEN 100 WHEN 'symbol' THEN 45 ELSE 55 END) AS names
        FROM (SELECT question_id, unnest(terms) AS name FROM asked) a JOIN named USING (name) GROUP BY ALL)""",
    """texts AS (SELECT *, lower(concat_ws(chr(10), repo, path, content, array_to_string(routes, chr(10)), array_to_string(symbols, chr(10)), array_to_string(queue_names, chr(10)), array_to_string(db_tables, chr(10)))) AS t FROM hints)""",
    r"""scored AS (SELECT question_id, file_id, repo, names + list_sum(list_transform(list_filter(terms, lambda w: contains(t, w)), lambda w: CASE WHEN contains(w, '/') THEN 75 ELSE 18 END))
        + CASE WHEN regexp_matches(lower(question), 'database|table|query') AND len(db_tables) > 0 THEN 35 ELSE 0 END
        + CASE WHEN regexp_matches(lower(question), 'service|flow|call') AND len(routes) + len(message_names) + len(queue_names) > 0 THEN 30 ELSE 0 END
        + CASE WHEN regexp_matches(lower(question), 'glossary|meaning|definition') AND list_contains(evidence, 'documentation') THEN 22 ELSE 0 END AS score
        FROM matched JOIN asked USING (question_id) JOIN texts USING (file_id) JOIN evidence USING (file_id))""",
    """fair AS (SELECT question_id, file_id, score - CASE WHEN nth >= 3 THEN least(30 * (nth - 2), 90) ELSE 0 END AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id, repo ORDER BY score DESC, file_id) AS nth FROM scored))""",
    """ranked AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id) AS rank, file_id, score::BIGINT AS score FROM fair)""",
)
_WORD = r"regexp_matches(lower(question), '\b({0})\b')"
_ANY = lambda words: "(" + " OR ".join(f"contains(lower(question), '{w}')" for w in words) + ")"

ORACLE = {
    "question_gates": with_sources(
        rf"""SELECT question_id, ({_ANY(A.EXPAND)} OR regexp_matches(question, '/[A-Za-z0-9_./:{{}}-]+'))::INT AS expand, {_ANY(A.EXPAND_ROUTE)}::INT AS expand_route,
        ({_ANY(A.DETAILS)} OR regexp_matches(lower(question), '\bwhat does\b.*\bdo\b'))::INT AS inspect,
        (len(string_split(trim(question), ' ')) <= 4 AND regexp_matches(lower(trim(question)), '^(hello|hi|hey|thanks|bye|test)[!.?]*$'))::INT AS greeting,
        {_WORD.format("what services|services? (?:detected|list|available)|detected (?:services?|repos?)")}::INT AS asks_services,
        {_WORD.format("environment variables?|env vars?|what env|which env")}::INT AS asks_env,
        {_WORD.format("database tables?|db tables?|which tables?|what tables?")}::INT AS asks_tables,
        CASE WHEN {_WORD.format("north")} AND NOT {_WORD.format("south|southern")} THEN 'north' WHEN {_WORD.format("south|southern")} AND NOT {_WORD.format("north")} THEN 'south' END AS region,
        CASE WHEN {_ANY(A.FLOW_CONTEXT)} THEN NULL WHEN {_WORD.format("p5")} THEN 'P5' WHEN {_WORD.format("p4")} THEN 'P4' END AS platform,
        ({_WORD.format("level|rank|points")} AND {_WORD.format("how|gain|get|earn")})::INT AS reward FROM questions""",
        _ASKS,
    ),
    # worked out by hand for the ten kinds of questions
    "domain_hints": f"""WITH questions AS ({QUESTIONS}) SELECT question_id, unnest(CASE s WHEN 0 THEN ['tables'] WHEN 3 THEN ['tables'] WHEN 7 THEN ['P5'] WHEN 8 THEN ['north'] WHEN 9 THEN ['south', 'reward'] ELSE [] END) AS hint
        FROM (SELECT question_id, question_id % 10 AS s FROM questions)""",
    "exact_routes": with_sources(
        f"""SELECT DISTINCT question_id, route, file_id FROM (SELECT question_id, {_ROUTE.format("r")} AS route FROM (SELECT question_id, unnest({_ROUTES_OF}) AS r FROM questions))
        JOIN (SELECT file_id, {_ROUTE.format("r")} AS route FROM (SELECT file_id, unnest(routes) AS r FROM hints)) USING (route)""",
        _ASKS, *_POINTS,
    ),
    "rerank_named": with_sources("SELECT * FROM ranked WHERE rank <= 10", *_POINTS, *_EVIDENCE_ALL, *_RERANK),
    "strong_evidence": with_sources(
        """SELECT * FROM (SELECT r.question_id, r.file_id, len(list_filter(a.terms, lambda w: contains(lower(concat_ws(chr(10), s.repo, s.path, s.content)), w))) AS n_terms
        FROM ranked r JOIN asked a USING (question_id) JOIN sources s USING (file_id) WHERE rank <= 5) WHERE n_terms > 0""",
        *_POINTS, *_EVIDENCE_ALL, *_RERANK,
    ),
    "fallback_context": with_sources(
        """WITH s AS (SELECT repo, file_id, CASE WHEN list_contains(evidence, 'documentation') THEN -12 ELSE 0 END + CASE WHEN len(routes) > 0 THEN 28 ELSE 0 END + CASE WHEN len(symbols) > 0 THEN 18 ELSE 0 END
            + CASE WHEN len(message_names) + len(queue_names) + len(exchange_names) > 0 THEN 24 ELSE 0 END + CASE WHEN len(db_tables) > 0 THEN 12 ELSE 0 END
            + CASE WHEN list_contains(evidence, 'env_config') THEN 4 ELSE 0 END - CASE WHEN list_contains(evidence, 'test') THEN 10 ELSE 0 END AS score FROM hints JOIN evidence USING (file_id))
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY score DESC, file_id) AS rank, file_id, score FROM s WHERE score > -40 QUALIFY rank <= 12""",
        *_POINTS, *_EVIDENCE_ALL,
    ),
    "vocabulary_groups": with_sources("SELECT file_id, group_name, kind, position, term, value FROM vocabulary", _VOCABULARY),
    "glossary_text": with_sources(
        """SELECT file_id, group_name, 'Vocabulary: ' || group_name || chr(10) || 'Kind: ' || kind || chr(10) || 'Source: ' || path || chr(10) || 'Terms:' || chr(10)
        || string_agg('- ' || term || CASE WHEN value <> '' THEN ': ' || value ELSE '' END, chr(10) ORDER BY position) AS content FROM vocabulary GROUP BY file_id, path, group_name, kind""",
        _VOCABULARY,
    ),
    "vocabulary_answer": with_sources(
        """SELECT lower(term) AS key, count(DISTINCT file_id) AS n_files, arg_max(file_id, (length(value), -file_id)) AS file_id, arg_max(group_name, (length(value), -file_id)) AS group_name,
        arg_max(value, (length(value), -file_id)) AS value FROM vocabulary GROUP BY key""",
        _VOCABULARY,
    ),
    "documentation_glossary": with_sources(
        r"""WITH l AS (SELECT file_id, unnest(string_split(regexp_extract(content, '(?s)## Glossary\n(.*?)(?:\n##|$)', 1), chr(10))) AS x FROM sources WHERE path LIKE '%.md')
        SELECT file_id, regexp_extract(x, '^\*\s+(?:\*\*)?([^:*]+?)(?:\*\*)?:\s*(.+)$', 1) AS term, regexp_extract(x, '^\*\s+(?:\*\*)?([^:*]+?)(?:\*\*)?:\s*(.+)$', 2) AS definition FROM l WHERE term <> ''"""
    ),
    "comment_rule": with_sources(
        r"""WITH l AS (SELECT repo, file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS x FROM sources),
        s AS (SELECT *, 3 * (contains(lower(x), 'every')::INT + contains(lower(x), 'order')::INT + contains(lower(x), 'days')::INT + contains(lower(x), 'status')::INT + contains(lower(x), 'twice')::INT)
            + 5 * (contains(lower(x), 'every order')::INT + contains(lower(x), 'order days')::INT + contains(lower(x), 'days status')::INT + contains(lower(x), 'status twice')::INT) AS score
            FROM l WHERE regexp_matches(x, '^\s*(//|/\*|\*|--|#)'))
        SELECT repo, score, file_id, line, trim(x) AS text FROM s WHERE score >= 6 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, file_id, line) = 1"""
    ),
    "route_anchors": with_sources(
        f"""WITH a AS (SELECT question_id, list_distinct(list_slice(flatten(list_transform({_TERMS.replace("list_distinct(", "(", 1)}, lambda t: list_filter(string_split_regex(t, '[/.]+'), lambda w: w <> ''))), 1, 8)) AS terms FROM questions),
        r AS (SELECT DISTINCT unnest(routes) AS route FROM hints), p AS (SELECT route, unnest(list_distinct(list_filter(string_split_regex(lower(route), '[/.]+'), lambda w: w <> ''))) AS w FROM r),
        m AS (SELECT question_id, route, count(*) AS n FROM (SELECT question_id, unnest(terms) AS w FROM a WHERE len(terms) >= 2) JOIN p USING (w) GROUP BY ALL),
        s AS (SELECT question_id, route, n * 20 + CASE WHEN n = len(terms) THEN 40 ELSE 0 END AS score FROM m JOIN a USING (question_id) WHERE n >= 2)
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, route) AS rank, route, score FROM s QUALIFY rank <= 6""",
        _ASKS, *_POINTS,
    ),
    "adf_texts": "SELECT o_orderkey, o_orderkey || chr(10) || o_orderstatus || ' of ' || o_custkey || chr(10) || repeat(o_orderpriority || chr(10) || chr(10), 2) AS text FROM orders",
    "notes": """WITH l AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        SELECT user_id AS note_id, 'note ' || event_id AS title, CASE WHEN event_type = 'signup' THEN 'draft' ELSE 'final' END AS status, event_id AS updated FROM l WHERE event_type <> 'error'""",
    "lookup_by_ids": with_sources("SELECT file_id, repo, path FROM sources WHERE file_id IN (SELECT s_suppkey * 7 FROM supplier) AND branch = 'main' AND trim(content) <> ''"),
    "file_expansion": """WITH d AS (SELECT doc_id, source, lang, doc_id % 40 AS file, doc_id % 100 * 10 AS line FROM documents), h AS (SELECT DISTINCT source, lang, file FROM d WHERE doc_id % 97 = 3)
        SELECT source, lang, file, doc_id, row_number() OVER (PARTITION BY source, lang, file ORDER BY line, doc_id) AS place FROM d SEMI JOIN h USING (source, lang, file)""",
    "docs_to_code": with_sources(
        r"""WITH d AS (SELECT repo, file_id AS doc_file, unnest(list_distinct(list_concat(regexp_extract_all(content, '\b([A-Z][A-Za-z0-9]+::[A-Z_]+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+[0-9]*[A-Za-z]*)\b', 1),
            regexp_extract_all(content, '`([a-z]+(?:_[a-z0-9]+)+)`', 1)))) AS name FROM sources WHERE path LIKE '%.md'),
        c AS (SELECT DISTINCT repo, file_id, unnest(list_concat(symbols, db_tables)) AS name FROM hints WHERE path NOT LIKE '%.md')
        SELECT doc_file, file_id, count(*) AS n_names FROM d JOIN c USING (repo, name) GROUP BY ALL""",
        *_POINTS,
    ),
    "comparison_of_routes": with_sources(
        f"""WITH r AS (SELECT DISTINCT repo, file_id, {_ROUTE.format("r")} AS route FROM (SELECT repo, file_id, unnest(routes) AS r FROM hints)), p AS (SELECT route, repo, count(*) AS n FROM r GROUP BY ALL)
        SELECT route, count(*) AS n_repos, string_agg(repo || ':' || n, ',' ORDER BY repo) AS served FROM p GROUP BY route HAVING count(*) > 1""",
        *_POINTS,
    ),
}
