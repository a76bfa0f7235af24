"""Queries: edges, comments, manifests, diagrams, dictionaries, reranking and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import extract as E
from ..operators import vectors as V
from ..operators.lexical import small
from ..session import checkpointed, read
from ..sources import files as S
from . import extraction, retrieval, search
from .fixtures import load, with_sql


def edge_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of files with the function around them and an id over their key."""
    types = {"route": "HANDLES_HTTP_ENDPOINT", "table": "TOUCHES_TABLE", "symbol": "DEFINES_SYMBOL", "rpc": "CALLS_RPC_FUNC", "http": "CALLS_HTTP_ENDPOINT"}
    facts = E.facts(load(spark, sf_dir, "files"), E.ALL)
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in types.items()))
    edges = facts.withColumn("type", kind).filter("type IS NOT NULL").select("file_id", "repo", "path", "line", "type", "name")
    functions = facts.filter("kind = 'symbol' AND operation = 'function'").select("file_id", "line", F.col("name").alias("symbol"))
    within = E.enclosing(edges, functions, ["file_id"]).withColumnRenamed("symbol", "from_symbol")
    key = F.concat_ws(":", "type", "repo", "path", F.col("line").cast("string"), "name", F.coalesce("from_symbol", F.lit("")))
    return within.select("file_id", "line", "type", "name", "from_symbol", F.sha2(key, 256).alias("id"))


_EDGE_SQL = (
    extraction._facts_sql(E.ALL).rstrip()
    + """, x AS (SELECT *, CASE kind WHEN 'route' THEN 'HANDLES_HTTP_ENDPOINT' WHEN 'table' THEN 'TOUCHES_TABLE' WHEN 'symbol' THEN 'DEFINES_SYMBOL'
 WHEN 'rpc' THEN 'CALLS_RPC_FUNC' WHEN 'http' THEN 'CALLS_HTTP_ENDPOINT' END AS type FROM facts),
 g AS (SELECT file_id, line, name AS symbol FROM facts WHERE kind = 'symbol' AND operation = 'function')
 SELECT x.file_id, x.line, type, name, symbol AS from_symbol, sha256(type || ':' || repo || ':' || path || ':' || x.line || ':' || name || ':' || coalesce(symbol, '')) AS id
 FROM (SELECT * FROM x WHERE type IS NOT NULL) x ASOF LEFT JOIN g ON x.file_id = g.file_id AND x.line >= g.line"""
)


def route_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by constants of their files and the declarations that repeat the value."""
    files = load(spark, sf_dir, "files")
    constants = files.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"const ([A-Z_0-9]+ = '/[^']*')"), F.lit(1))).alias("c"))
    named = constants.select("file_id", F.regexp_extract("c", "^([A-Z_0-9]+)", 1).alias("constant"), T.normalize_route(F.regexp_extract("c", "'([^']*)'", 1)).alias("route"))
    declared = E.facts(files, E.ROUTES[:1]).select(T.normalize_route(F.col("name")).alias("route"), F.col("line").alias("declared_at"), F.col("file_id").alias("declaring_file"))
    return named.join(declared, "route", "left")


def comment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.comment_blocks(load(spark, sf_dir, "files").select("file_id", "content"), ["file_id"])


def variable_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").select("file_id", "content")
    return D.look_back(files, ["file_id"], r"sendToQueue\([^,]*, ([a-z]+)\)", r"const ([a-z]+) = await ([a-z.]+)\(", 5)


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits parsed from a log: an order is a commit, its lines are files."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 20).alias("repo"), "o_orderkey", "o_orderpriority")
    head = F.concat_ws("|", F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), F.lit("ann"), F.lit("2024-01-01"), "o_orderpriority")
    heads = o.select("repo", (F.col("o_orderkey") * 100).alias("pos"), head.alias("line"))
    items = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    names = items.select("repo", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("src/part"), "l_partkey").alias("line"))
    parsed = S.git_log(heads.unionByName(names))
    return parsed.select("repo", "sha", "message", F.size("files").cast("long").alias("n_files"), F.array_join("files", ",").alias("files"))


def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 10 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.col("p_name").alias("name"), F.create_map(F.lit("lib-b"), F.lit("^1.0"), F.concat(F.lit("lib-"), F.col("p_size").cast("string")), F.lit("2.0")).alias("dependencies")))
    )
    return D.manifest(read(spark, sf_dir, "part").select("p_partkey", text.alias("json")))


def mermaid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("text\n```mermaid\ngraph TD\nA"), n, F.lit(" --> B\nB --> C\n```\nmore\n```mermaid\nunknown "), n, F.lit("\n```\n```mermaid\nsequenceDiagram\nA->>B: x\n```"))
    return D.mermaid(read(spark, sf_dir, "part").select("p_partkey", text.alias("content"))).select("p_partkey", "pos", "kind", "n_arrows")


def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary constants of the parts' files: number of terms, the last by name."""
    text = F.concat(F.lit("const STATUS_"), F.upper(F.regexp_replace("p_brand", "[^A-Za-z]", "_")), F.lit(" = {ACTIVE: 'a', CLOSED: '"), "p_type", F.lit("'};\nconst ONE = {ONLY: 'x'};"))
    terms = D.vocabulary(read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(text, "[0-9]", "_").alias("content")))
    return terms.groupBy("p_partkey").agg(F.countDistinct("name").alias("n_names"), F.count("*").alias("n_terms"), F.max("term").alias("last_term"))


def method_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = C.lines(load(spark, sf_dir, "files").select("file_id", "content"))
    return D.method_windows(numbered, ["file_id"], r"^async function ([A-Za-z0-9_]+)\(", 5)


def rerank_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 results by n - rank plus 18 for each question term in the path or text and 100 for the exact path; ties by rank."""
    chunks = load(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("doc"), "path", "content")
    asked = retrieval._questions(spark, sf_dir).select("question_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    rows = chunks.join(small(retrieval.bm25_topk(spark, sf_dir)), "doc").join(asked, "question_id")
    text = F.lower(F.concat_ws("\n", "path", "content"))
    bonus = F.aggregate("terms", F.lit(0), lambda s, t: s + F.when(text.contains(t), 18).otherwise(0))
    score = 10 - F.col("rank") + bonus + F.when(F.array_contains("terms", F.lower("path")), 100).otherwise(0)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    return rows.withColumn("score", score).withColumn("place", F.row_number().over(w)).select("question_id", "doc", "score", "place")


def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of a question until their characters fill the budget; the first always fits."""
    ranked = checkpointed(rerank_heuristic(spark, sf_dir))
    sized = load(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("doc"), F.length("content").alias("n")).join(small(ranked), "doc")
    w = Window.partitionBy("question_id").orderBy("place")
    upto = sized.withColumn("upto", F.sum("n").over(w))
    return upto.filter((F.col("upto") <= 6000) | (F.col("place") == 1)).select("question_id", "doc", "place", "upto")


def vector_overfetch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty nearest points of each query, at most three of a label, the first ten."""
    points = read(spark, sf_dir, "embeddings")
    near = V.topk(points, search.asked(points), 30).join(points.select(F.col("vec_id").alias("point_id"), "label"), "point_id")
    few = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "label").orderBy("rank"))).filter("n <= 3")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return few.withColumn("place", place).filter("place <= 10").select("query_id", "place", F.col("point_id").alias("vec_id"), "label", F.round("score", 6).alias("score"))


def score_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's object inside prose, parsed: sum and missing values by event type."""
    text = F.concat(F.lit("Result: "), "props", F.lit(" end"))
    k = D.json_in_text(text, "k long")["k"]
    return read(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("n_missing"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six queries of a question: its first names in three templates."""
    names = F.slice(T.tokens(F.col("text")), 1, 16)
    made = F.flatten(F.transform(names, lambda n: F.array(F.concat(n, F.lit(" implementation")), F.concat(n, F.lit(" route handler")), F.concat(n, F.lit(" table")))))
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.unique(made, 6)).alias("pos", "query"))


def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("## Head "), "p_brand", F.lit("\n- **bold** `"), "p_type", F.lit("` [link](http://x/"), F.col("p_partkey").cast("string"), F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", D.plain(text).alias("text"))


def decision_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a type in a range of dates whose maker holds a string, pushed to the scan; newest first, the first twenty."""
    o = read(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderdate").between("1996-01-01", "1997-06-30"))
    found = o.filter(F.lower("o_orderpriority").contains("high"))
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the confidence that their kind and size give."""
    label = F.when(F.col("path").startswith("src1/"), "primary").when(F.length("content") > 5000, "broad").when(F.col("branch") == "en", "direct").when(F.length("content") < 60, "weak").otherwise("supporting")
    return load(spark, sf_dir, "chunks").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def section_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every file the chunks of its folder's other files: their number and the first.

    Counts of files and folders are joined instead of chunks with chunks, so a large folder stays linear.
    """
    files = load(spark, sf_dir, "chunks").groupBy("repo", "branch", "path").agg(F.count("*").alias("own"), F.min("chunk_id").alias("first_own"))
    w = Window.partitionBy("repo", "branch").orderBy("first_own", "path")
    two = files.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("repo", "branch").agg(F.max(F.when(F.col("k") == 1, F.col("path"))).alias("lead"), F.min("first_own").alias("first"), F.max("first_own").alias("second"))
    folders = files.groupBy("repo", "branch").agg(F.sum("own").alias("total")).join(two, ["repo", "branch"])
    joined = files.join(folders, ["repo", "branch"]).filter(F.col("total") > F.col("own"))
    return joined.select("repo", "branch", "path", (F.col("total") - F.col("own")).alias("n"), F.when(F.col("path") == F.col("lead"), F.col("second")).otherwise(F.col("first")).alias("first"))


def feedback_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest events of each type, newest first."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).filter("k <= 5").select("event_type", "event_id", "k")


def collect_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each kind in a repository in order of first file and line, at most eight.

    Names are reduced to their first place before anything is gathered.
    """
    found = E.facts(load(spark, sf_dir, "files"), E.ALL).groupBy("repo", "kind", "name").agg(F.min(F.struct("file_id", "line", "rank")).alias("at"))
    w = Window.partitionBy("repo", "kind").orderBy("at.file_id", "at.line", "at.rank", "name")
    first = found.withColumn("k", F.row_number().over(w)).filter("k <= 8").groupBy("repo", "kind").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("x"))
    return first.select("repo", "kind", F.array_join("x.name", ",").alias("names"))


def question_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns by the language whose function words lead."""
    words = T.tokens(F.col("text"))
    count = lambda *known: F.size(F.filter(words, lambda w: w.isin(*known)))
    en, de = count("the", "of", "and", "is", "to"), count("der", "die", "und", "den", "zu")
    lang = F.when((en == 0) & (de == 0), "unknown").when(en >= de, "en").otherwise("de")
    return read(spark, sf_dir, "conversations").groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))


def folder_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the repositories of their folder; a document's own mapping wins over the folder's."""
    docs = load(spark, sf_dir, "chunks").select("chunk_id", "repo", F.when(F.col("chunk_id") % 10 == 0, F.array(F.lit("own"))).alias("own"))
    folders = docs.select("repo").distinct().filter("repo < 'src15'").withColumn("mapped", F.array(F.concat("repo", F.lit("-a")), F.concat("repo", F.lit("-b"))))
    joined = docs.join(folders, "repo", "left").select("chunk_id", F.explode(F.coalesce("own", "mapped", F.array(F.lit("unassigned")))).alias("target"))
    return joined.groupBy("target").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_extraction, route_constants, comment_chunks, variable_look_back, commit_log, package_manifests, mermaid_blocks, vocabulary_terms, method_windows, rerank_heuristic,
        context_selection, vector_overfetch_rerank, score_json, query_expansion, markdown_plain, decision_filter, confidence_labels, section_siblings, feedback_recent,
        collect_hints, question_language, folder_mapping,
    )
}

_TOK = retrieval._TOKENS
_BM = retrieval.ORACLE["bm25_topk"]
_LINES = "l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"
_RERANK = """rr AS (SELECT question_id, doc, rank, (10 - rank + list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(path || chr(10) || content), t) THEN 18 ELSE 0 END))
 + CASE WHEN list_contains(terms, lower(path)) THEN 100 ELSE 0 END)::BIGINT AS score, length(content) AS n FROM top JOIN chunks ON chunk_id = doc JOIN q USING (question_id)),
 rp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS place FROM rr)"""
_BM_CTE = _BM[: _BM.rindex(" SELECT * FROM top")]
ORACLE = {
    "edge_extraction": with_sql(_EDGE_SQL),
    "route_constants": with_sql(
        """SELECT c.file_id, constant, c.route, d.line AS declared_at, d.file_id AS declaring_file FROM (SELECT file_id, 'ROUTE_' || file_id AS constant, '/api/part/' || file_id AS route FROM files) c
        LEFT JOIN (SELECT file_id, 2 AS line, '/api/part/' || file_id AS route FROM files) d USING (route)"""
    ),
    "comment_chunks": with_sql(f"WITH {_LINES} SELECT file_id, line AS start_line, line AS end_line, trim(substr(text, 3)) AS content FROM l WHERE text LIKE '//%'"),
    "variable_look_back": with_sql("SELECT file_id, 7 AS line, 'rows' AS name, 'db.query' AS value, 4 AS assigned_at FROM files"),
    "commit_log": """SELECT 'r' || o_custkey % 20 AS repo, lpad(lower(to_hex(o_orderkey)), 8, '0') AS sha, o_orderpriority AS message, count(l_partkey) AS n_files,
        coalesce(string_agg('src/part' || l_partkey, ',' ORDER BY l_linenumber, 'src/part' || l_partkey), '') AS files FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority""",
    "package_manifests": """SELECT p_partkey, NULL AS package, 'parse_error' AS kind, '' AS name, '' AS value FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT p_partkey, p_name, 'dependencies', 'lib-b', '^1.0' FROM part WHERE p_partkey % 10 <> 0
        UNION ALL SELECT p_partkey, p_name, 'dependencies', 'lib-' || p_size, '2.0' FROM part WHERE p_partkey % 10 <> 0""",
    "mermaid_blocks": "SELECT p_partkey, 0 AS pos, 'graph' AS kind, 2 AS n_arrows FROM part UNION ALL SELECT p_partkey, 2, 'sequenceDiagram', 1 FROM part",
    "vocabulary_terms": "SELECT p_partkey, 1 AS n_names, 2 AS n_terms, 'CLOSED' AS last_term FROM part",
    "method_windows": with_sql(
        f"WITH {_LINES} SELECT file_id, 'handlePart' || file_id AS name, 3 AS start_line, 7 AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM l WHERE line BETWEEN 3 AND 7 GROUP BY file_id"
    ),
    "rerank_heuristic": f"{_BM_CTE}, {_RERANK} SELECT question_id, doc, score, place FROM rp",
    "context_selection": f"{_BM_CTE}, {_RERANK} SELECT question_id, doc, place, (sum(n) OVER (PARTITION BY question_id ORDER BY place))::BIGINT AS upto FROM rp QUALIFY upto <= 6000 OR place = 1",
    "vector_overfetch_rerank": f"""WITH {search.nearest_sql("true", 30)}, f AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) <= 3)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, vec_id, label, round(score, 6) AS score FROM f QUALIFY place <= 10""",
    "score_json": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, count(*) FILTER (WHERE props::JSON->>'k' IS NULL) AS n_missing FROM events GROUP BY event_type",
    "query_expansion": f"""WITH n AS (SELECT item_id, {_TOK.format('text')}[1:16] AS t FROM benchmark), u AS (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:2] AS t FROM n)
        SELECT item_id, k AS pos, t[k // 3 + 1] || [' implementation', ' route handler', ' table'][k % 3 + 1] AS query FROM u, unnest(range(0, 3 * len(t))) AS r(k)""",
    "markdown_plain": "SELECT p_partkey, 'Head ' || p_brand || chr(10) || 'bold ' || p_type || ' link' AS text FROM part",
    "decision_filter": """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30' AND contains(lower(o_orderpriority), 'high')
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
    "confidence_labels": with_sql(
        """SELECT CASE WHEN starts_with(path, 'src1/') THEN 'primary' WHEN length(content) > 5000 THEN 'broad' WHEN branch = 'en' THEN 'direct' WHEN length(content) < 60 THEN 'weak' ELSE 'supporting' END AS label,
        count(*) AS n FROM chunks GROUP BY 1"""
    ),
    "section_siblings": with_sql(
        """SELECT a.repo, a.branch, a.path, count(*) AS n, min(c.chunk_id) AS first FROM (SELECT DISTINCT repo, branch, path FROM chunks) a JOIN chunks c ON a.repo = c.repo AND a.branch = c.branch AND a.path <> c.path
        GROUP BY ALL"""
    ),
    "feedback_recent": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k <= 5",
    "collect_hints": with_sql(
        extraction._facts_sql(E.ALL).rstrip()
        + """, f AS (SELECT repo, kind, name, min(file_id * 1000 + line) AS a FROM facts GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY a, name) AS k FROM f QUALIFY k <= 8) SELECT repo, kind, string_agg(name, ',' ORDER BY k) AS names FROM k GROUP BY ALL"""
    ),
    "question_language": f"""SELECT CASE WHEN en = 0 AND de = 0 THEN 'unknown' WHEN en >= de THEN 'en' ELSE 'de' END AS lang, count(*) AS n FROM (
        SELECT len(list_filter(t, lambda x: x IN ('the', 'of', 'and', 'is', 'to'))) AS en, len(list_filter(t, lambda x: x IN ('der', 'die', 'und', 'den', 'zu'))) AS de
        FROM (SELECT {_TOK.format('text')} AS t FROM conversations)) GROUP BY 1""",
    "folder_mapping": with_sql(
        """SELECT target, count(*) AS n FROM (SELECT unnest(CASE WHEN chunk_id % 10 = 0 THEN ['own'] WHEN repo < 'src15' THEN [repo || '-a', repo || '-b'] ELSE ['unassigned'] END) AS target FROM chunks) GROUP BY target"""
    ),
}
