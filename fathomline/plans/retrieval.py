"""Queries: lexical retrieval, reranking, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..operators.lexical import small
from ..session import checkpointed, read
from .fixtures import load, with_sql


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each benchmark item."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


#: Candidates of the exact rerankers.
CANDIDATES = 300

_TOKENS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_Q = f"q AS (SELECT item_id AS question_id, list_distinct({_TOKENS.format('text')}) AS terms FROM benchmark)"
_BM25 = f"""d AS (SELECT chunk_id AS doc, unnest([{{'field': 'content', 'boost': 1.0, 't': {_TOKENS.format('content')}}}, {{'field': 'path', 'boost': 1.5, 't': {_TOKENS.format('path')}}}]) AS f FROM chunks),
 f AS (SELECT doc, f.field AS field, f.boost::DOUBLE AS boost, f.t AS t, len(f.t) AS len FROM d),
 avgs AS (SELECT field, avg(nullif(len, 0)) AS mean, count(*) AS n FROM f GROUP BY field),
 p AS (SELECT doc, field, boost, len, term, count(*) AS tf FROM (SELECT doc, field, boost, len, unnest(t) AS term FROM f) GROUP BY ALL),
 df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
 {_Q}, qt AS (SELECT question_id, unnest(terms) AS term FROM q),
 bm AS (SELECT question_id, doc, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len / mean)))), 6) AS score
 FROM p JOIN df USING (field, term) JOIN avgs USING (field) JOIN qt USING (term) GROUP BY question_id, doc),
 many AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 300),
 top AS (SELECT * FROM many WHERE rank <= 10)"""


def bm25_topk(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    fields = {"content": (F.col("content"), 1.0), "path": (F.col("path"), 1.5)}
    found = R.bm25(load(spark, sf_dir, "chunks"), _questions(spark, sf_dir), "chunk_id", fields, most).select("question_id", "doc", "score", "rank")
    return checkpointed(found)  # few rows, which others join with texts more than once


def _with_text(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("doc"), "repo", "branch", "content")
    return chunks.join(small(ranked), "doc")


def _exact(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    asked = _questions(spark, sf_dir).select("question_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    # a chunk's first two words stand for its symbols
    docs = load(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("doc"), F.col("content").alias("text"), "path", F.slice(T.tokens(F.col("content")), 1, 2).alias("names"))
    exact = R.exact_scores(candidates, docs, asked)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc"))
    return exact.withColumn("n", place).filter("n <= 10").drop("n")


def exact_term_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of 300 BM25 candidates by exact terms and phrases."""
    return _exact(spark, sf_dir, bm25_topk(spark, sf_dir, CANDIDATES))


def repo_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 results after the penalty on many chunks of one repository."""
    rows = _with_text(spark, sf_dir, bm25_topk(spark, sf_dir)).select("question_id", "doc", "branch", "rank", F.col("score"))
    return R.diversity(rows, ["question_id"], "branch").select("question_id", "doc", F.round("score", 6).alias("score"))


def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of BM25 pinned before the order of exact terms, the first eight."""
    best = bm25_topk(spark, sf_dir, CANDIDATES)  # one search for both lists
    exact = _exact(spark, sf_dir, best)
    order = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc"))
    lists = [best.filter("rank <= 3").withColumn("pos", F.col("rank")), exact.withColumn("pos", order)]
    return R.union_by_priority(lists, ["question_id"], "doc", 8)


def compacted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 results without near copies of better ones, the first five."""
    rows = _with_text(spark, sf_dir, bm25_topk(spark, sf_dir))
    return R.compact(rows, ["question_id"], "doc", F.col("content"), 5)


def mirror_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk of each normalised text."""
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "content")
    return R.drop_mirrors(chunks, [], F.col("content"), ["chunk_id"]).select("chunk_id")


def sources_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each branch the first short, medium and long chunk."""
    role = F.when(F.length("content") < 200, "short").when(F.length("content") < 2000, "medium").otherwise("long")
    return R.one_per_role(load(spark, sf_dir, "chunks"), ["branch"], role, ["chunk_id"]).select("branch", "role", "chunk_id")


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of questions: long, asks about an identifier, asks for a list, greeting."""
    t = F.col("text")
    return read(spark, sf_dir, "benchmark").select(
        "item_id", (F.size(T.tokens(t)) > 30).alias("is_long"), t.rlike("[a-z][A-Z]|_|/").alias("is_identifier"), F.lower(t).rlike("(^|[^a-z])(list|all|which|the)([^a-z]|$)").alias("asks_list"),
        F.lower(t).rlike("^(hi|hello|hey)([^a-z]|$)").alias("is_greeting"), F.array_join(T.unique(T.tokens(t), 12), ",").alias("terms"),
    )


QUERIES = {f.__name__: f for f in (bm25_topk, exact_term_rerank, repo_diversity, hybrid_union, compacted_context, mirror_dedup, sources_by_role, question_intents)}

_EXACT = f"""tl AS MATERIALIZED (SELECT chunk_id AS doc, lower(content) AS low, {_TOKENS.format('content')}[1:2] AS names FROM chunks),
 tw AS MATERIALIZED (SELECT DISTINCT doc, unnest(string_split_regex(low, '[^a-z0-9_]+')) AS term FROM tl),
 ut AS MATERIALIZED (SELECT question_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM q),
 ph AS MATERIALIZED (SELECT question_id, term || ' ' || lead(term) OVER w AS two, term || ' ' || lead(term) OVER w || ' ' || lead(term, 2) OVER w AS three
  FROM ut WHERE length(term) >= 3 WINDOW w AS (PARTITION BY question_id ORDER BY i)),
 ea AS (SELECT question_id, many.doc, sum(CASE WHEN list_contains(names, ut.term) THEN 5 WHEN tw.doc IS NOT NULL
   THEN 4 + CASE WHEN regexp_matches(low, '["'']' || ut.term || '["'']') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(low, '(^|[^a-z0-9_])' || ut.term || '[ \n\t\r]*:') THEN 4 ELSE 0 END
   WHEN contains(low, ut.term) THEN 1 ELSE 0 END) AS score
  FROM many JOIN ut USING (question_id) JOIN tl ON tl.doc = many.doc LEFT JOIN tw ON tw.doc = many.doc AND tw.term = ut.term GROUP BY ALL),
 eb AS (SELECT question_id, many.doc, sum(CASE WHEN contains(low, two) THEN 12 ELSE 0 END + CASE WHEN contains(low, three) THEN 20 ELSE 0 END) AS score
  FROM many JOIN ph USING (question_id) JOIN tl ON tl.doc = many.doc GROUP BY ALL),
 ex AS (SELECT question_id, doc, (ea.score + coalesce(eb.score, 0))::DOUBLE AS score FROM ea LEFT JOIN eb USING (question_id, doc) WHERE ea.score + coalesce(eb.score, 0) > 0
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY ea.score + coalesce(eb.score, 0) DESC, doc) <= 10)"""
ORACLE = {
    "bm25_topk": with_sql(f"WITH {_BM25} SELECT * FROM top"),
    "exact_term_rerank": with_sql(f"WITH {_BM25}, {_EXACT} SELECT * FROM ex"),
    "repo_diversity": with_sql(
        f"""WITH {_BM25} SELECT question_id, doc, round(score - CASE WHEN n >= 3 THEN least((n - 2) * 30, 90) ELSE 0 END, 6) AS score
        FROM (SELECT question_id, doc, score, row_number() OVER (PARTITION BY question_id, branch ORDER BY score DESC, rank) AS n FROM top JOIN chunks ON chunk_id = doc)"""
    ),
    "hybrid_union": with_sql(
        f"""WITH {_BM25}, {_EXACT}, a AS (SELECT question_id, doc, 0 AS prio, rank AS pos FROM top WHERE rank <= 3
        UNION ALL SELECT question_id, doc, 1, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) FROM ex),
        o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question_id, doc ORDER BY prio, pos) = 1)
        SELECT question_id, doc, prio, row_number() OVER (PARTITION BY question_id ORDER BY prio, pos, doc) AS rank FROM o QUALIFY rank <= 8"""
    ),
    "compacted_context": with_sql(
        f"""WITH {_BM25}, c AS (SELECT question_id, rank, doc, lower(trim(regexp_replace(content, '[ \n\t\r]+', ' ', 'g'))) AS t FROM top JOIN chunks ON chunk_id = doc),
        fold AS (SELECT question_id, 1 AS k, [{{'doc': doc, 't': t}}] AS s FROM c WHERE rank = 1
         UNION ALL SELECT fold.question_id, k + 1, CASE WHEN len(s) < 5 AND len(list_filter(s, lambda a: a.t = c.t OR (length(a.t) >= 160 AND length(c.t) >= 160 AND (contains(a.t, c.t) OR contains(c.t, a.t))))) = 0
          THEN list_append(s, {{'doc': c.doc, 't': c.t}}) ELSE s END FROM fold JOIN c ON c.question_id = fold.question_id AND c.rank = k + 1),
        e AS (SELECT question_id, s FROM fold QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY k DESC) = 1)
        SELECT question_id, s[i].doc AS doc, i AS place FROM e, unnest(range(1, len(s) + 1)) AS r(i)"""
    ).replace("WITH chunks AS", "WITH RECURSIVE chunks AS"),
    "mirror_dedup": with_sql("SELECT min(chunk_id) AS chunk_id FROM chunks GROUP BY lower(trim(regexp_replace(content, '[ \n\t\r]+', ' ', 'g')))"),
    "sources_by_role": with_sql(
        """SELECT branch, role, min(chunk_id) AS chunk_id FROM (SELECT *, CASE WHEN length(content) < 200 THEN 'short' WHEN length(content) < 2000 THEN 'medium' ELSE 'long' END AS role FROM chunks) GROUP BY ALL"""
    ),
    "question_intents": f"""SELECT item_id, len(t) > 30 AS is_long, regexp_matches(text, '[a-z][A-Z]|_|/') AS is_identifier, regexp_matches(lower(text), '(^|[^a-z])(list|all|which|the)([^a-z]|$)') AS asks_list,
        regexp_matches(lower(text), '^(hi|hello|hey)([^a-z]|$)') AS is_greeting,
        array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda x: struct_pack(p := list_position(t, x), w := x)))[1:12], lambda s: s.w), ',') AS terms
        FROM (SELECT item_id, text, {_TOKENS.format('text')} AS t FROM benchmark)""",
}
# list_distinct of DuckDB has no order, so the terms are put into theirs
ORACLE = {k: v.replace(f"list_distinct({_TOKENS.format('text')})", f"list_filter({_TOKENS.format('text')}, lambda x, i: list_position({_TOKENS.format('text')}, x) = i)") for k, v in ORACLE.items()}
