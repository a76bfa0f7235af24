"""Tables by scope: loads swapped at once, stopped and repeated runs, a stream that merges into one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomline.sources.versions import ScopedTable, buckets, merged_by

SCHEMA = "id bigint, repo string, branch string, text string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _found(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return ScopedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("repo", "branch"))


def test_loads_replace_their_scopes(spark, table):
    first = [(1, "a", "main", "x"), (2, "a", "dev", "y"), (3, "b/c d=e:%", "main", "z"), (4, None, "main", "n")]
    assert _found(table) == [] and table.replace(_rows(spark, first)) == 1
    assert _found(table) == sorted(first, key=str)
    table.replace(_rows(spark, [(5, "a", "main", "new"), (6, "b/c d=e:%", "main", "w"), (7, None, "main", "m")]))
    assert _found(table) == sorted([(2, "a", "dev", "y"), (5, "a", "main", "new"), (6, "b/c d=e:%", "main", "w"), (7, None, "main", "m")], key=str)
    table.delete(lambda scope: scope[0] == "a")
    assert [r[0] for r in _found(table)] == [6, 7]
    table.replace(_rows(spark, []), also=[{"repo": None, "branch": "main"}])
    assert [r[0] for r in _found(table)] == [6]
    assert _found(table, 1) == sorted(first, key=str)  # versions before stay readable until they are cleaned
    assert table.clean() > 0 and [r[0] for r in _found(table)] == [6]


def test_a_stopped_load_changes_nothing(spark, table, monkeypatch):
    table.replace(_rows(spark, [(1, "a", "main", "x")]))

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(ScopedTable, "_commit", stop)
        with pytest.raises(RuntimeError, match="killed"):
            table.replace(_rows(spark, [(2, "a", "main", "half")]))
    assert _found(table) == [(1, "a", "main", "x")] and table.version() == 1
    again = [(2, "a", "main", "whole")]
    table.replace(_rows(spark, again))
    table.replace(_rows(spark, again))  # a rerun leaves the same table
    assert _found(table) == again and table.clean() == 3


def test_a_stream_merges_and_replays(spark, tmp_path):
    schema = "user bigint, at bigint, value string, bucket int"
    source, state = tmp_path / "in", ScopedTable(spark, f"file://{tmp_path}/state", schema, ("bucket",))
    for k, rows in enumerate([[(1, 5, "a"), (2, 1, "b")], [(1, 3, "late"), (3, 9, "c")], [(2, 7, "d"), (1, 6, "e")]]):
        spark.createDataFrame(rows, "user bigint, at bigint, value string").coalesce(1).write.mode("append").json(f"file://{source}/{k}")
    merge = merged_by(state, ["user"], ["at"])

    def run(checkpoint):
        files = spark.readStream.schema("user bigint, at bigint, value string").option("maxFilesPerTrigger", 1).json(f"file://{source}/*")
        rows = files.select("user", "at", "value", buckets(["user"], 4))
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    run("first")
    want = [(1, 6, "e"), (2, 7, "d"), (3, 9, "c")]
    assert sorted(tuple(r) for r in state.read().select("user", "at", "value").collect()) == want
    version = state.version()
    run("second")  # all batches once more, as after a lost checkpoint
    assert state.version() == version
    merge(spark.createDataFrame([(1, 99, "x")], "user bigint, at bigint, value string").select("*", buckets(["user"], 4)), 1)
    assert sorted(tuple(r) for r in state.read().select("user", "at", "value").collect()) == want
    merge(spark.createDataFrame([(1, 99, "x")], "user bigint, at bigint, value string").select("*", buckets(["user"], 4)), version + 10)
    assert state.read().filter("user = 1").select(F.col("value")).head()[0] == "x"
