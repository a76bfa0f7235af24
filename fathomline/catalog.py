"""All registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answers, asking, containment, context, documents, extraction, file_chunks, governance, hints, indexing, inventory, lexical, linking, reports, retrieval, search, sections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _module in (search, extraction, indexing, linking, retrieval, governance, documents, answers, inventory, hints, reports, asking, context, file_chunks, lexical, containment, sections):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
