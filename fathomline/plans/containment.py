"""Queries: names within texts, for the registry, the audit of documentation and the rules of feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containment as C
from ..operators import tagging
from ..session import read
from .fixtures import load, with_sql

_PARTS = ("the", "than", "thand", "ther", "entheri")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry entry for each nation, with an alias that is part of a word and a repository."""
    part = F.get(F.array(*map(F.lit, _PARTS)), F.col("n_nationkey") % 5)
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(F.upper(part), F.lit("re")).alias("aliases"), F.array(F.concat(F.lit("repo-"), "n_nationkey")).alias("repos"))


def registry_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries that benchmark items, and questions that are no more than part of a repository's name, contain or are contained in."""
    whole = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    short = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("question_id"), F.concat(F.lit(" Repo-"), F.col("n_nationkey") % 10, F.lit(" ")).alias("text"))
    return C.loose_matches(whole.union(short), _entries(spark, sf_dir))


def feature_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items and names of parts that no English document contains, with the number of their places."""
    words = read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.explode(F.split("text", r"[^\p{L}]+")).alias("name"))
    parts = read(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"))
    features = words.union(parts).filter("name <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))
    return C.not_contained(features, read(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "text").select("kind", "name", "n")


def feedback_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that contain no trigger of an active rule; triggers are the first nine characters of benchmark items, two in three active."""
    triggers = read(spark, sf_dir, "benchmark").filter("item_id % 3 <> 0").select(F.substring("text", 1, 9).alias("name"))
    return C.not_triggered(read(spark, sf_dir, "conversations").filter("role = 'user'"), ["conv_id", "turn"], "text", triggers)


def chunk_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of chunks by path rules, names in paths and texts, else by their repository."""
    part = F.get(F.array(*map(F.lit, _PARTS)), F.col("n_nationkey") % 5)
    number = F.col("n_nationkey").cast("string")
    entries = read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("p"), number).alias("project"), F.array(F.concat(F.lit("src-"), number), part, F.lit("entheres"), F.lit("of")).alias("terms"), F.array(F.concat(F.lit("SRC"), number)).alias("repos")
    )
    rules = spark.createDataFrame([("src1", "src1/en/**", "english"), ("src2", "*/de/1*.md", "german"), ("src3", "src3/fr", "french")], "repo string, pattern string, project string")
    fallback = F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit("x"))).when(F.col("chunk_id") % 3 == 1, F.array(F.lit("x"), F.lit("y"))).alias("fallback")
    found = tagging.projects(load(spark, sf_dir, "chunks").select("chunk_id", "repo", "path", "content", fallback), entries, rules)
    return found.select("chunk_id", F.array_join("projects", ",").alias("projects"), "how")


QUERIES = {f.__name__: f for f in (registry_mentions, feature_gaps, feedback_gaps, chunk_projects)}

ORACLE = {
    "registry_mentions": f"""WITH q AS (SELECT item_id AS question_id, lower(text) AS t FROM benchmark UNION ALL SELECT n_nationkey + 1000000, lower(concat(' Repo-', n_nationkey % 10, ' ')) FROM nation),
 e AS (SELECT n_name AS entry, unnest([lower(n_name), [{', '.join(f"'{p}'" for p in _PARTS)}][n_nationkey % 5 + 1], 're', 'repo-' || n_nationkey]) AS name FROM nation)
 SELECT DISTINCT question_id, entry FROM q JOIN e ON length(name) >= 3 AND contains(t, name)
 UNION SELECT question_id, n_name FROM q JOIN nation ON length(trim(t)) >= 3 AND contains('repo-' || n_nationkey, trim(t))""",
    "feature_gaps": """WITH f AS (SELECT 'benchmark' AS kind, unnest(string_split_regex(text, '[^\\p{L}]+')) AS name FROM benchmark UNION ALL SELECT 'part', p_name FROM part),
 g AS (SELECT kind, name, count(*) AS n FROM f WHERE name <> '' GROUP BY ALL), d AS MATERIALIZED (SELECT lower(text) AS t FROM documents WHERE lang = 'en')
 SELECT kind, name, n FROM g WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(t, lower(name)))""",
    "chunk_projects": with_sql(
        f"""WITH c AS (SELECT chunk_id, repo, path, regexp_replace(lower(path), '[^a-z0-9]+', '', 'g') AS p, regexp_replace(lower(content), '[^a-z0-9]+', '', 'g') AS t FROM chunks),
 e AS (SELECT 'p' || n_nationkey AS project, 'src' || n_nationkey AS repo, unnest(['src' || n_nationkey, [{', '.join(f"'{p}'" for p in _PARTS)}][n_nationkey % 5 + 1], 'entheres']) AS name FROM nation),
 s AS (SELECT chunk_id, project, 30 AS points FROM c JOIN e ON contains(p, name)
  UNION ALL SELECT chunk_id, project, CASE WHEN length(name) >= 6 THEN 8 ELSE 4 END FROM c JOIN e ON c.repo = e.repo AND contains(t, name)
  UNION ALL SELECT chunk_id, CASE repo WHEN 'src1' THEN 'english' WHEN 'src2' THEN 'german' ELSE 'french' END, 100 FROM c
  WHERE starts_with(path, 'src1/en') AND repo = 'src1' OR repo = 'src2' AND regexp_matches(path, '/de/1.*[.]md$') OR repo = 'src3' AND starts_with(path, 'src3/fr/')),
 g AS (SELECT chunk_id, project, sum(points) AS score FROM s GROUP BY ALL HAVING sum(points) >= 12),
 h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, project) <= 6),
 l AS (SELECT chunk_id, string_agg(project, ',' ORDER BY score DESC, project) AS projects FROM h GROUP BY chunk_id)
 SELECT chunk_id, coalesce(projects, CASE WHEN chunk_id % 3 = 0 THEN 'x' ELSE '' END) AS projects,
  CASE WHEN projects IS NOT NULL THEN 'scored' WHEN chunk_id % 3 = 0 THEN 'repo' WHEN chunk_id % 3 = 1 THEN 'ambiguous' ELSE 'none' END AS how FROM c LEFT JOIN l USING (chunk_id)"""
    ),
    "feedback_gaps": """WITH r AS (SELECT DISTINCT lower(substring(text, 1, 9)) AS name FROM benchmark WHERE item_id % 3 <> 0)
 SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM r WHERE contains(lower(c.text), name))""",
}
