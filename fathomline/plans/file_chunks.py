"""Query: source files in chunks by language. The SQL states the line ranges of each shape of file, counted by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import file_chunks as C
from .sources import SHAPES, load, with_sources


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.chunk_files(load(spark, sf_dir), ["file_id", "repo", "branch", "path"])
    identity = F.concat_ws(":", F.lit("branches-v2"), "repo", "branch", "path", "start_line", "end_line", "content")
    return found.select("file_id", "start_line", "end_line", "chunk_type", "symbol", "parent", "has_overlap", "content", F.sha2(identity, 256).alias("content_hash"))


QUERIES = {"chunk_files": chunk_files}

#: (shape, first line, last line, type, symbol, enclosing symbol, overlap); {k} is the file's number.
EXPECTED = (
    (0, 4, 7, "class", "Item{k}Controller", None, False),
    (0, 5, 21, "method", "findOne", "Item{k}Controller", True),
    (1, 4, 9, "class", "Order{k}Action", None, False),
    (1, 6, 16, "method", "handle", "Order{k}Action", True),
    (1, 15, 22, "method", "check", "Order{k}Action", True),
    (2, 1, 9, "statement", None, None, False),
    (3, 1, 8, "section", None, None, False),
    (3, 6, 16, "section", "How items flow", None, True),
    (3, 14, 26, "section", "Glossary", None, True),
    (4, 4, 11, "function", "main", None, True),
    (4, 10, 18, "method", "Run", "Worker{k}", True),
    (5, 1, 7, "config", None, None, False),
    (6, 1, 11, "config", None, None, False),
    (7, 1, 6, "config", None, None, False),
    (8, 9, 17, "function", "load{k}", None, False),
    (9, 7, 15, "function", "runNightly{k}", None, False),
    (10, 1, 7, "const", "ACCOUNT_TYPES", None, False),
    (11, 1, 6, "block", None, None, False),
)


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_VALUES = ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in EXPECTED)
ORACLE = {
    "chunk_files": with_sources(
        f"""WITH e(shape, a, b, kind, symbol, parent, overlap) AS (VALUES {_VALUES}),
        c AS (SELECT *, trim(array_to_string(list_slice(string_split(content, chr(10)), a, b), chr(10)), ' ' || chr(9) || chr(10)) AS text FROM sources JOIN e ON file_id % {len(SHAPES)} = shape)
        SELECT file_id, a::INT AS start_line, b::INT AS end_line, kind AS chunk_type, replace(symbol, '{{k}}', file_id::VARCHAR) AS symbol, replace(parent, '{{k}}', file_id::VARCHAR) AS parent, overlap AS has_overlap,
        text AS content, sha256('branches-v2:' || repo || ':' || branch || ':' || path || ':' || a || ':' || b || ':' || text) AS content_hash FROM c"""
    )
}
