"""Vector retrieval queries: every point whose id is divisible by 50 asks all points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..session import read, shared_folder


def asked(points: DataFrame) -> DataFrame:
    """The stated query set."""
    return points.filter("vec_id % 50 = 0")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest points of five labels for each query."""
    points = read(spark, sf_dir, "embeddings")
    found = vectors.topk(points.filter(F.col("label") < 5), asked(points), 10)
    return found.select("query_id", "rank", F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest points for each query from an inverted-file index of all points; tests compare it with all pairs (recall at ten)."""
    points = read(spark, sf_dir, "embeddings")
    lists, path = vectors.fit_lists(points), shared_folder(spark, "lists")
    vectors.build_lists(points, lists, path)
    found = vectors.search_lists(spark, path, lists, asked(points), 10)
    return found.select("query_id", "rank", F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"))


def nearest_sql(condition: str, most: int) -> str:
    """Common table expression `near`: the nearest points of each query."""
    return f"""near AS (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, p.vec_id) AS rank,
        p.vec_id, p.label, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
        FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND {condition} QUALIFY rank <= {most})"""


QUERIES = {"vector_topk": vector_topk, "vector_index": vector_index}
ORACLE = {"vector_topk": f"WITH {nearest_sql('p.label < 5', 10)} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM near"}
