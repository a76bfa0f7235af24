"""Sinks: index tables by scope, append-only logs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scopes(chunks: DataFrame, path: str) -> None:
    """Chunks by repository and branch; only the scopes that the rows hold are exchanged."""
    (
        chunks.repartition("repo", "branch", F.pmod(F.xxhash64("chunk_id"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo", "branch")
        .parquet(path)
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Rows at the end of a log of JSON lines."""
    rows.write.mode("append").json(path)


def delete_scope(spark: SparkSession, path: str, target: str, repo: str, branch: str | None = None) -> int:
    """Writes the table without a scope to `target` and returns the number of rows left out."""
    table = spark.read.parquet(path)
    scope = F.col("repo") == repo
    if branch is not None:
        scope = scope & (F.col("branch") == branch)
    gone = table.filter(scope).count()
    table.filter(~F.coalesce(scope, F.lit(False))).write.partitionBy("repo", "branch").parquet(target)
    return gone


def reports(rows: DataFrame, path: str) -> None:
    """One text per row of (name, report), partitioned by name."""
    rows.select("name", F.col("report").alias("value")).write.mode("overwrite").partitionBy("name").text(path)
