"""Queries: objects in named sections of source text, with rows counted by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import named_objects
from ..session import read

#: A file of each part; `~` stands for a single quote. Brackets stand in strings, templates and comments.
_LINES = (
    ("// LEVELS [ { name: ~none~ } ]", None),
    ("export const LEVELS = [", None),
    ("  { name: ~Basic } %~, code: \"B]%\", least: 10 }, // }", "p_partkey"),
    ("  /* { name: ~gone~ }", None),
    ("     ] */", None),
    ("  { ~name~: `Plus ]`, code: codes.plus,", None),
    ("    least: % },", "p_size"),
    ("];", None),
    ("show(LEVELS, [{ name: ~again %~ }]);", "p_partkey"),
)


def _content() -> str:
    parts = []
    for text, column in _LINES:
        pieces = [f"'{p}'" for p in text.replace("~", "', chr(39), '").split("%")]
        parts.append(f"concat({f', CAST({column} AS VARCHAR(20)), '.join(pieces)})")
    return f"concat_ws(chr(10), {', '.join(parts)})"


def section_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the objects of two sections of each file."""
    read(spark, sf_dir, "part").createOrReplaceTempView("_part")
    files = spark.sql(f"SELECT p_partkey AS file_id, {_content()} AS content FROM _part")
    found = named_objects(files, ["file_id"], ["LEVELS"])
    value = lambda k: F.coalesce(F.col("properties")[k], F.lit("")).alias(k)
    return found.select("file_id", "section", "place", "start_line", "end_line", F.col("properties")["name"].alias("level"), value("code"), value("least"))


QUERIES = {"section_objects": section_objects}

ORACLE = {
    "section_objects": """SELECT p_partkey AS file_id, unnest([1, 1, 2]) AS section, unnest([1, 2, 1]) AS place, unnest([3, 6, 9]) AS start_line, unnest([3, 7, 9]) AS end_line,
        unnest(['Basic } ' || p_partkey, 'Plus ]', 'again ' || p_partkey]) AS level, unnest(['B]' || p_partkey, 'codes.plus', '']) AS code, unnest(['10', p_size::VARCHAR, '']) AS least FROM part"""
}
