"""The service registry as a dimension: expansion of questions, tagging, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Registries beyond this are joined without a broadcast.
SMALL = 100_000


def _small(dim: DataFrame) -> DataFrame:
    """A dimension, broadcast once its size is known to be small."""
    return F.broadcast(dim) if dim.limit(SMALL + 1).count() <= SMALL else dim


def mentions(texts: DataFrame, registry: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, name) of the entries one of whose aliases is a word of the text: tokens meet aliases in an equi-join."""
    aliases = registry.select("name", F.explode("aliases").alias("alias")).select("name", F.lower("alias").alias("alias")).filter(F.length("alias") >= 3)
    words = texts.select(F.col(id_col), F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("alias"))
    return words.join(_small(aliases), "alias").select(id_col, "name").distinct()


def path_rule_matches(path: Column, pattern: Column) -> Column:
    """`dir/**` matches by prefix, `*` anything in a segment, otherwise the path itself or below it."""
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(pattern, r"([.+?^$(){}|\[\]\\])", r"\\$1"), r"\*", "[^/]*"), F.lit("$"))
    return (
        F.when(pattern.endswith("/**"), path.startswith(F.regexp_replace(pattern, r"\*\*$", "")))
        .when(pattern.contains("*"), F.regexp_like(path, glob))
        .otherwise((path == pattern) | path.startswith(F.concat(pattern, F.lit("/"))))
    )


def project_tags(chunks: DataFrame, terms: DataFrame, id_col: str, least: float, most: int) -> DataFrame:
    """Projects of a chunk by the summed weights of their terms among its words: at least `least`, the best `most`."""
    words = chunks.select(id_col, F.explode(F.array_distinct(F.split(F.lower("content"), "[^a-z0-9]+"))).alias("term"))
    scores = words.join(_small(terms), "term").groupBy(id_col, "project").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "project")
    return scores.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def coverage(expected: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Each key as covered, missing from the index, or extra in it."""
    a, b = expected.select(F.lower(key).alias(key)).distinct().withColumn("_e", F.lit(True)), indexed.select(F.lower(key).alias(key)).distinct().withColumn("_i", F.lit(True))
    status = F.when(F.col("_e") & F.col("_i"), "covered").when(F.col("_e"), "missing").otherwise("extra")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert_entries(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries by lower-cased name after changes: a changed field wins where it isn't null; `deleted` removes; case of the old name stays."""
    r, c = registry.withColumn("_k", F.lower("name")), changes.withColumn("_k", F.lower("name"))
    fields = [f for f in registry.columns if f != "name"]
    both = r.alias("r").join(c.alias("c"), F.col("r._k") == F.col("c._k"), "full_outer").filter(~F.coalesce(F.col("c.deleted"), F.lit(False)))
    return both.select(F.coalesce("r.name", "c.name").alias("name"), *(F.coalesce(f"c.{f}", f"r.{f}").alias(f) for f in fields))
