"""Projects of chunks: path rules, names in paths and texts, thresholds and fallbacks.

Names meet paths and texts through automata (`containment`), so their number costs nothing a
text; distinct paths are looked at once. A path rule is keyed by its repository and by the folders
that stand before its first wild card, and meets the paths below that folder by an equi-join;
only those are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import LEAST, contained

#: Points of a path rule, of a name in the path, of a long and a short name in the text; the length that is long (fixed values).
RULE, IN_PATH, LONG, SHORT, LONG_NAME = 100, 30, 8, 4, 6
#: The score from which a project holds, and projects of a chunk at most (fixed values).
ENOUGH, MOST = 12, 6


def bare(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def _slashed(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"\\", "/"))


def rule_fits(path: Column, pattern: Column) -> Column:
    """`x/**` by its start, `*` for anything, else the path itself or below it; both in lower case."""
    parts = F.transform(F.split(pattern, r"\*"), lambda p: F.regexp_replace(p, r"([.+?^$(){}|\[\]\\])", r"\\$1"))
    glob = F.concat(F.lit("(?s)^"), F.array_join(parts, ".*"), F.lit("$"))
    return (
        F.when(F.endswith(pattern, F.lit("/**")), F.startswith(path, F.left(pattern, F.length(pattern) - 3)))
        .when(F.contains(pattern, F.lit("*")), F.regexp_like(path, glob))
        .otherwise((path == pattern) | F.startswith(path, F.concat(pattern, F.lit("/"))))
    )


def rule_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, project, pattern) of the rules (repo, pattern, project) that fit paths (repo, path)."""
    pattern = _slashed(F.col("pattern"))
    fixed = F.element_at(F.split(F.regexp_replace(pattern, r"/\*\*$", ""), r"\*"), 1)
    keyed = rules.select(F.lower("repo").alias("_repo"), pattern.alias("pattern"), "project", F.regexp_extract(fixed, "^(.*)/", 1).alias("folder")).distinct()
    low = _slashed(F.col("path"))
    parts = F.split(low, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    there = paths.select("repo", "path", F.lower("repo").alias("_repo"), low.alias("_low"), F.explode(F.array_distinct(folders)).alias("folder"))
    return there.join(keyed, ["_repo", "folder"]).filter(rule_fits(F.col("_low"), F.col("pattern"))).select("repo", "path", "project", "pattern")


def projects(chunks: DataFrame, entries: DataFrame, rules: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, projects, how): the best projects of chunks (id, repo, path, content, fallback).

    entries: (name, project, terms, repos); rules: (repo, pattern, project). A rule counts RULE, a term in the path IN_PATH, a
    term in the text LONG or SHORT if the entry has the chunk's repository. Projects of ENOUGH points, the best MOST, ties by
    name: `how` is scored. Else a single fallback project: `repo`; several: none, `ambiguous`; none: `none`.
    """
    terms = entries.select(F.coalesce("project", "name").alias("project"), F.transform(F.coalesce("repos", F.array()), F.lower).alias("repos"), F.explode(F.array_distinct("terms")).alias("term"))
    terms = terms.withColumn("name", bare(F.col("term"))).filter(F.length("name") >= LEAST)
    paths = chunks.select("repo", "path").filter("path IS NOT NULL").distinct()
    named = paths.select("path").distinct().select("path", bare(F.col("path")).alias("_bare"))
    in_path = contained(named, "path", "_bare", terms).join(terms, "name").groupBy("path", "project").agg((F.count("*") * IN_PATH).alias("points"))
    by_path = in_path.join(paths, "path").select("repo", "path", "project", "points")
    by_rule = rule_hits(paths, rules).groupBy("repo", "path", "project").agg((F.count("*") * RULE).alias("points"))
    placed = chunks.select(id_col, "repo", "path").join(by_path.union(by_rule).groupBy("repo", "path", "project").agg(F.sum("points").alias("points")), ["repo", "path"]).select(id_col, "project", "points")
    texts = chunks.select(id_col, bare(F.col("content")).alias("_bare"))
    said = contained(texts, id_col, "_bare", terms).join(chunks.select(id_col, F.lower("repo").alias("repo")), id_col).join(terms, "name").filter(F.array_contains("repos", F.col("repo")))
    in_text = said.groupBy(id_col, "project").agg(F.sum(F.when(F.length("name") >= LONG_NAME, LONG).otherwise(SHORT)).alias("points"))
    scored = placed.union(in_text).groupBy(id_col, "project").agg(F.sum("points").alias("score")).filter(F.col("score") >= ENOUGH)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "project"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= MOST)
    listed = best.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "project")))["project"].alias("best"))
    fallback = F.coalesce("fallback", F.array().cast("array<string>"))
    few = F.size(fallback) <= 1
    how = F.when(F.col("best").isNotNull(), "scored").when(F.size(fallback) == 0, "none").when(few, "repo").otherwise("ambiguous")
    none = F.array().cast("array<string>")
    return chunks.join(listed, id_col, "left").select(id_col, F.coalesce("best", F.when(few, fallback).otherwise(none)).alias("projects"), how.alias("how"))
