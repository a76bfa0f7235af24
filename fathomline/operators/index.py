"""Incremental index maintenance: what to delete, what to insert, how edges are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key is no longer current."""
    return existing.join(current.select(key), key, "left_anti")


def fresh(current: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Current rows whose key isn't in the index."""
    return current.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The index after a run: what stays of it and what is new."""
    return existing.join(current.select(key), key, "left_semi").unionByName(fresh(current, existing, key))


def replace_scope(existing: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """All rows of a scope exchanged for new ones; a null condition is outside."""
    return existing.filter(~F.coalesce(scope, F.lit(False))).unionByName(new)


def merge_last(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by (generation, order); new rows win over existing ones."""
    both = existing.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_g"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_g")


def drop_adjacent_repeats(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A version log without entries equal to the one before them; the version counts what stays."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = log.withColumn("_b", F.lag(F.struct(value)).over(w)).filter(F.col("_b").isNull() | ~F.col("_b").getField(value).eqNullSafe(F.col(value))).drop("_b")
    return changed.withColumn("version", F.row_number().over(w))
