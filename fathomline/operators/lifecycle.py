"""Stateful rules over event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supersede(rules: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rules with valid_to, the time of the rule that rolls them back, and active."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rules.withColumn("valid_to", F.lead(order[0]).over(w)).withColumn("active", F.lead(F.lit(1)).over(w).isNull())


def rate_limit(events: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """events with allowed: a key's window opens at its first event and at the first event after a window's end.

    Windows depend on one another, so a key's events are folded in order, streamed
    in sorted batches: memory is one counter, whatever the number of events.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, until, count = object(), None, 0
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[key], pdf[at], strict=True):
                if k != now_key or t > until:
                    now_key, until, count = k, t + pd.Timedelta(seconds=seconds), 0
                count += 1
                allowed.append(count <= most)
            yield pdf.assign(allowed=allowed)

    known = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return known.repartition(key).sortWithinPartitions(key, at, order).mapInPandas(fold, f"{columns}, allowed boolean")


def mean_score(scores: list[Column]) -> Column:
    """The mean of quality scores; missing ones count as 0.5."""
    total = None
    for s in scores:
        v = F.coalesce(s, F.lit(0.5))
        total = v if total is None else total + v
    return total / len(scores)


def migration_kind(text: Column) -> Column:
    """What a migration does, by the first pattern that holds (fixed values)."""
    low = F.lower(text)
    kinds = (
        ("create_table", r"create\s+table|createtable"), ("drop_table", r"drop\s+table|droptable"), ("add_column", r"add\s+column|addcolumn"),
        ("drop_column", r"drop\s+column|removecolumn"), ("add_index", r"create\s+index|addindex"), ("update", r"update\s"), ("insert", r"insert\s+into"),
    )
    out = None
    for name, regex in kinds:
        out = F.when(low.rlike(regex), name) if out is None else out.when(low.rlike(regex), name)
    return out.otherwise("other")
