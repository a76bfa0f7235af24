"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rules: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session on one machine (master local) may go without: it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Paths of the tables written inside `scratch`, innermost block last.
_OPEN: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and lost executors cost one reread."""
    path = new_folder(df.sparkSession, what)
    if _OPEN:
        _OPEN[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables written inside once the block ends; yields a `written` whose tables outlive it."""
    _OPEN.append([])

    def lasting(df: DataFrame, what: str) -> DataFrame:
        out = written(df, what)
        mine = _OPEN[-1].pop()
        if len(_OPEN) > 1:
            _OPEN[-2].append(mine)
        return out

    try:
        yield lasting
    finally:
        for spark, path in _OPEN.pop():
            discard(spark, path)


#: Rows of one key that a task may get before a join splits the key.
HOT = 20_000
#: So many hot keys at most go to every executor (two to four numbers each).
MAX_HOT = 200_000


def hot_keys(rows: DataFrame, keys: list[str], weight: Column | None = None, least: int = HOT) -> tuple[DataFrame, int]:
    """(keys, n) of the keys with more than a bound of rows (or weight), and that bound; 0 if there are none.

    The bound is `least`, raised until at most MAX_HOT keys are above it, so the table may be broadcast.
    """
    n = (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")
    found = rows.groupBy(*keys).agg(n).filter(F.col("n") > least)
    size = found.count()
    if size:
        found = written(found, "hot")
    while size > MAX_HOT:
        least *= 8
        found = found.filter(F.col("n") > least)
        size = found.count()
    return found, least if size else 0


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", least: int = HOT, rows: int | None = None
) -> DataFrame:
    """left joined with right on keys (null-safe); a key with many rows of left is dealt over tasks by column `by`.

    The rows of right with such a key are copied once for every share. `by` has to vary among the rows of a key.
    rows: the number of rows of left, if known; no key can be hot in a small table.
    """
    hot, bound = hot_keys(left, keys, least=least) if rows is None or rows > least else (left, 0)
    twin = {k: f"_right_{k}" for k in keys}
    kept = [*left.columns, *(c for c in right.columns if c not in keys)]
    right = right.withColumnsRenamed(twin)
    shares = bound > 0
    if shares:
        hot = F.broadcast(hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.ceil(F.col("n") / bound).alias("_shares")))
        n = F.coalesce("_shares", F.lit(1))
        meets = lambda side: reduce(lambda x, y: x & y, (F.col(side.get(k, k)).eqNullSafe(F.col(f"_hot_{k}")) for k in keys))
        left = left.join(hot, meets({}), "left").select(*left.columns, F.pmod(F.xxhash64(by), n).alias("_share"))
        right = right.join(hot, meets(twin), "left").select(
            *right.columns, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("_part")
        )
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(t)) for k, t in twin.items()))
    return left.join(right, on & (F.col("_share") == F.col("_part")) if shares else on, how).select(*kept)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often a lambda inside body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between white space of the whole text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


#: What to call when a worker is used for another stage: it lives on between stages, its memories shouldn't.
FORGET: list[Callable[[], None]] = []
_STAGE: list[int | None] = [None]


def new_stage() -> None:
    """Empties the registered memories of this worker if its last task was of another stage."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _STAGE[0]:
        _STAGE[0] = stage
        for forget in FORGET:
            forget()
        pa.default_memory_pool().release_unused()


#: Bytes of a column that a Python task turns into objects at once.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `size` bytes of a column, one row at least."""
    new_stage()
    for batch in batches:
        sizes = batch.column(column).nbytes / max(1, batch.num_rows)
        rows = max(1, int(size / max(1.0, sizes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()  # a worker lives on between stages


class Memo(dict):
    """A bounded memory in two generations: what isn't used while one fills up is forgotten."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def recall(self, key):
        """The value of a key that isn't in the young generation, or None."""
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def age(self) -> None:
        """To be called between pieces of work."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


#: Rows of a run's block.
RUN_ROWS = 4096


def _changes(column: pa.Array) -> np.ndarray:
    """Places where a sorted column's value differs from the one before (null equals null)."""
    if len(column) < 2:
        return np.zeros(min(len(column), 1), np.int64)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    plain = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = np.asarray(a.is_null().to_numpy(zero_copy_only=False)) != np.asarray(b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate([[0], 1 + np.flatnonzero(plain | nulls)])


def _cut_runs(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    new_stage()
    run, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = _changes(batch.column(0))
        ends = np.append(cuts[1:], batch.num_rows)
        starts = np.concatenate([np.arange(a, b, size) for a, b in zip(cuts, ends, strict=True)])
        items = pa.StructArray.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), items)
        n = len(starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(starts)), pa.array(np.full(n, run), pa.int32()), pa.array(np.arange(seq, seq + n), pa.int64()), lists],
            names=[batch.schema.names[0], "run", "seq", "items"],
        )
        seq += n


def runs(rows: DataFrame, key: str, order: list[str], size: int = RUN_ROWS) -> DataFrame:
    """(key, run, seq, items): the rows of every key in their order, in blocks of at most `size`; (run, seq) orders a key's blocks.

    Rows are dealt by ranges of key, order and their own place, so a key with a third of all rows, or a row that
    repeats as often, is spread over many tasks. Write the result before it is read twice.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c != key]
    by = [key, *order, "_place"]
    dealt = (
        rows.select("*", F.monotonically_increasing_id().alias("_place"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
        .sortWithinPartitions(*by)
        .select(key, *rest)
    )
    fields = ", ".join(f"{c}: {t}" for c, t in dealt.select(*rest).dtypes)
    return dealt.mapInArrow(partial(_cut_runs, size), f"{key} {dict(rows.dtypes)[key]}, run int, seq bigint, items array<struct<{fields}>>")


def _digests(sep: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    new_stage()
    key, digest, done = None, None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest is None or k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(sep)
            digest.update(data.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.column(0).type if i == 0 else pa.string()) for i, c in enumerate(zip(*done, strict=True))], names=[batch.schema.names[0], "sha256"])
            done = []
        schema = batch.schema
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], schema.types[0]), pa.array([digest.hexdigest()])], names=[schema.names[0], "sha256"])


def joined_digests(blocks: DataFrame, key: str, data: str, sep: str) -> DataFrame:
    """(key, sha256): SHA-256 of a key's data joined by sep in the order of (run, seq).

    The hash goes from one byte to the next, so a key's blocks pass one task, but one at a time.
    """
    dealt = blocks.select(key, "run", "seq", F.col(data).cast("binary").alias("data")).repartition(key).sortWithinPartitions(key, "run", "seq")
    return dealt.select(key, "data").mapInArrow(partial(_digests, sep.encode()), f"{key} {dict(blocks.dtypes)[key]}, sha256 string")


def running(rows: DataFrame, key: str, place: str, sums: dict[str, str], span: int = 1024) -> DataFrame:
    """rows with, for each {new: column} of sums, the sum of the column over the key's rows of lower place.

    Sums go over `span` places, then over the sums of spans, so a long key is summed by many tasks; places are distinct in a key.
    """
    part = F.floor(F.col(place) / span).cast("long")
    totals = rows.groupBy(key, part.alias("_span")).agg(*(F.sum(c).alias(f"_{new}") for new, c in sums.items()))
    upto = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_span", *(F.sum(f"_{new}").over(upto).alias(f"_{new}") for new in sums))
    inner = Window.partitionBy(key, "_span").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_span", part)
    for new, c in sums.items():
        placed = placed.withColumn(f"_in_{new}", F.sum(c).over(inner))
    zero = F.lit(0)
    return placed.join(before, [key, "_span"]).select(
        *rows.columns, *((F.coalesce(f"_in_{new}", zero) + F.coalesce(f"_{new}", zero)).alias(new) for new in sums)
    )
