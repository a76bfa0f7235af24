"""Queries: the stored lexical index, its updates, and terms that match inexactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical as L
from ..session import read, shared_folder, spread

#: Index entries of eight fields, one a part: a fifth has no identifiers, of which half has evidence that goes without.
ENTRIES = """SELECT p_partkey AS doc, concat('repo-', p_size % 7) AS repo, concat('src/', lower(replace(p_brand, '#', '_')), '/part', p_partkey, '.ts') AS path,
 CASE WHEN p_partkey % 5 IN (1, 2) THEN concat('handle_', replace(p_name, ' ', '_'), '_', p_partkey) END AS symbol_name,
 CASE WHEN p_partkey % 5 IN (1, 3) THEN concat('handlepart', p_partkey, ' load', lower(p_type), 'items validate', replace(p_name, ' ', '')) END AS symbols,
 CASE WHEN p_partkey % 5 = 2 THEN concat(replace(p_name, ' ', '_'), '_items ', lower(replace(p_brand, '#', ''))) END AS tables,
 CASE WHEN p_partkey % 5 = 3 THEN concat('queue.', p_size, '.jobs') END AS queues,
 CASE WHEN p_partkey % 5 = 4 THEN concat('/api/', lower(p_type), '/part', p_partkey) END AS routes,
 concat('The ', p_name, ' of ', p_brand, ' is sold in size ', p_size, chr(10), 'recalculateoutstandingquantities', p_partkey % 3) AS content,
 CASE p_partkey % 10 WHEN 0 THEN 'documentation' WHEN 5 THEN 'service' ELSE 'route' END AS evidence FROM part"""

#: Questions with words cut short and misspelt, one a supplier.
QUESTIONS = """SELECT s_suppkey AS question_id, concat('Which handler valdates part', s_suppkey * 3, ' of bran', s_suppkey % 25, ' and lod', CASE s_suppkey % 2 WHEN 0 THEN 'economyitems' ELSE 'standarditem' END,
 ' from queue ', s_nationkey, ', validatesmalrng, recalculateoutstandngquantitees', s_suppkey % 3, '?') AS text FROM supplier"""


def _fields() -> dict:
    return {name: (F.col(name), boost) for name, boost in L.BOOSTS.items()}


def _made(spark: SparkSession, sf_dir: str, sql: str, base: str) -> DataFrame:
    spread(read(spark, sf_dir, base)).createOrReplaceTempView(f"_{base}")
    return spark.sql(sql.replace(f" FROM {base}", f" FROM _{base}"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    identifiers = [F.col(c) for c in ("symbol_name", "symbols", "tables", "queues", "routes")]
    return _made(spark, sf_dir, ENTRIES, "part").filter(L.eligible(identifiers, F.col("evidence")))


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best entries of each question from an index of eight fields, by equal, begun and near terms."""
    index = L.build(_entries(spark, sf_dir), shared_folder(spark, "index"), "doc", _fields())
    return L.search(spark, index, _made(spark, sf_dir, QUESTIONS, "supplier"), 20).select("question_id", "doc", "score", "rank")


def index_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that was built when a seventh of the entries was missing and an eleventh other, and updated since; a thirteenth is gone."""
    entries = _entries(spark, sf_dir)
    before = entries.filter("doc % 7 <> 0").withColumn("content", F.when(F.col("doc") % 11 == 0, F.concat("content", F.lit(" outdated"))).otherwise(F.col("content")))
    L.update(entries.filter("doc % 13 <> 0"), L.build(before, folder := shared_folder(spark, "index"), "doc", _fields()), "doc", _fields())
    return L.search(spark, L.latest(spark, folder), _made(spark, sf_dir, QUESTIONS, "supplier"), 20).select("question_id", "doc", "score", "rank")


def bm25_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of documents that terms of benchmark items start or nearly equal, with their weights."""
    documents = L.counted(read(spark, sf_dir, "documents"), "doc_id", {"text": F.col("text")})
    asked = L.asked_terms(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text"))
    return L.expanded(asked, documents).select("asked", "term", F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (bm25_index, index_increment, bm25_fuzzy)}

_TOKENS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_EXPANDED = """matched AS (SELECT asked, term, CASE WHEN asked = term THEN 1.0
  WHEN starts_with(term, asked) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(asked)))
  ELSE 0.45 * length(term) / (length(term) + levenshtein(asked, term)) END::DOUBLE AS weight
 FROM wanted JOIN vocabulary ON starts_with(term, asked) OR (abs(length(term) - length(asked)) <= most AND levenshtein(asked, term) <= most))"""
_MOST = "least(floor(length(asked) * 0.1 + 0.5), 6)"


def _search_sql(condition: str) -> str:
    fields = ", ".join(f"{{'field': '{name}', 'boost': {boost}, 't': {_TOKENS.format(name)}}}" for name, boost in L.BOOSTS.items())
    return f"""WITH e AS ({ENTRIES}), d AS (SELECT doc, unnest([{fields}]) AS f FROM e
  WHERE {condition} AND (coalesce(symbol_name, symbols, tables, queues, routes) IS NOT NULL OR evidence IN ('documentation', 'env_config', 'migration'))),
 f AS (SELECT doc, f.field AS field, f.boost::DOUBLE AS boost, f.t AS t, len(f.t) AS len FROM d),
 avgs AS (SELECT field, avg(nullif(len, 0)) AS mean, count(*) AS n FROM f GROUP BY field),
 p AS (SELECT doc, field, boost, len, term, count(*) AS tf FROM (SELECT doc, field, boost, len, unnest(t) AS term FROM f) GROUP BY ALL),
 df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), vocabulary AS (SELECT DISTINCT term FROM p),
 questions AS ({QUESTIONS}), q AS (SELECT DISTINCT question_id, unnest({_TOKENS.format('text')}) AS asked FROM questions),
 wanted AS (SELECT DISTINCT asked, {_MOST} AS most FROM q), {_EXPANDED},
 w AS (SELECT question_id, term, sum(weight) AS weight FROM q JOIN matched USING (asked) GROUP BY ALL),
 s AS (SELECT question_id, doc, round(sum(weight * boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len / mean)))), 6) AS score
  FROM p JOIN df USING (field, term) JOIN avgs USING (field) JOIN w USING (term) GROUP BY question_id, doc)
 SELECT question_id, doc, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 20"""


ORACLE = {
    "bm25_index": _search_sql("true"),
    "index_increment": _search_sql("doc % 13 <> 0"),
    "bm25_fuzzy": f"""WITH vocabulary AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS term FROM documents),
 wanted AS (SELECT asked, {_MOST} AS most FROM (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS asked FROM benchmark)), {_EXPANDED}
 SELECT asked, term, round(weight, 6) AS weight FROM matched""",
}
