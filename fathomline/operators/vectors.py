"""Vector search over an embedding column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries that meet a cell of points at once, points of a cell, and points in a slice of a batch.
QUERY_BLOCK, CELL_ROWS, POINT_SLICE = 2048, 200_000, 4096
FOUND = "query_id bigint, point_id bigint, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; those without a length of their own as zeros."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    sizes = np.sqrt((rows**2).sum(axis=1))
    return rows / np.where(sizes > 0, sizes, 1)[:, None]


class _Cell:
    """The k best points so far for the queries of a cell."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.vectors = k, [], []
        self.best = self.who = None

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def meet(self, names: np.ndarray, points: np.ndarray) -> None:
        if self.best is None:
            if not self.ids:
                return
            self.ids, self.vectors = np.concatenate(self.ids), np.concatenate(self.vectors)
            self.best, self.who = np.full((len(self.ids), self.k), -np.inf), np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        for at in range(0, len(names), POINT_SLICE):
            some = names[at : at + POINT_SLICE]
            scores = self.vectors @ points[at : at + POINT_SLICE].T
            scores[:, ~points[at : at + POINT_SLICE].any(axis=1)] = -np.inf
            scores[self.ids[:, None] == some[None, :]] = -np.inf
            both = np.concatenate((self.best, scores), axis=1)
            known = np.concatenate((self.who, np.broadcast_to(some, scores.shape)), axis=1)
            order = np.lexsort((known, -both), axis=1)[:, : self.k]  # ties by id
            self.best, self.who = np.take_along_axis(both, order, 1), np.take_along_axis(known, order, 1)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            row, place = np.nonzero(self.best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.who[row, place]), pa.array(self.best[row, place])], names=["query_id", "point_id", "score"])


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best points of each cell for its queries, from rows (cell, block, kind, id, v) sorted by these; queries are of kind 0."""
    key, cell = None, _Cell(k)
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "block", "kind")], axis=1)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        for at, end in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            if key != tuple(keys[at, :2]):
                yield from cell.found()
                key, cell = tuple(keys[at, :2]), _Cell(k)
            part = batch.slice(at, end - at)
            (cell.meet if keys[at, 2] else cell.ask)(part.column("id").to_numpy(), _matrix(part.column("v")))
    yield from cell.found()


def _nearest(asked: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, point_id, score) from queries and points (cell, block, id, v): those that share cell and block meet."""
    rows = asked.select("cell", "block", F.lit(0).alias("kind"), "id", "v").union(points.select("cell", "block", F.lit(1).alias("kind"), "id", "v"))
    dealt = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = dealt.mapInArrow(partial(_search, k), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "point_id", "score")


def _vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def topk(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, point_id, score): the k points most like each query by cosine, ties by id, the query itself left out.

    Queries are a stated set. They are dealt in blocks and points in cells; every block goes to every cell, as rows of a
    shuffle, and each cell keeps k points a query, so only those are merged. Nothing passes the driver but two counts.
    Scores are compared unrounded. Vectors are of one length; those that are zero match nothing.
    """
    spark = points.sparkSession
    asked, read = _vectors(queries, id_col, vector), _vectors(points, id_col, vector)
    blocks = max(1, -(-asked.count() // block))
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // CELL_ROWS))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    return _nearest(
        asked.filter(F.exists("v", lambda x: x != 0)).select(_numbers(cells).alias("cell"), at(blocks).alias("block"), "id", "v"),
        read.select(at(cells).alias("cell"), _numbers(blocks).alias("block"), "id", "v"),
        k,
    )


# an inverted-file index

#: Points that lists are fitted on (by expectation), lists at most, rounds of fitting, and the share of near neighbours that probes must reach in the sample.
SAMPLE, MOST_LISTS, ROUNDS, REACH = 20_000, 1024, 12, 0.97


@dataclass(frozen=True)
class Lists:
    """Centres of the lists, and how many lists a query probes."""

    centres: np.ndarray
    probes: int


def fit_lists(points: DataFrame, k: int = 10, vector: str = "embedding", id_col: str = "vec_id", sample: int = SAMPLE) -> Lists:
    """Lists fitted on a sample of `sample` points by expectation, taken by a hash of the id; every point is then put into one.

    There are as many lists as the root of the number of points. Probes are as many as reach REACH of the k nearest
    neighbours inside the sample; neighbours in all points are nearer, so it is a cautious figure.
    """
    read = _vectors(points, id_col, vector).filter(F.exists("v", lambda x: x != 0))
    n = read.count()
    share = min(1.0, sample / max(1, n))
    rows = read.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).orderBy("id").collect()
    if not rows:
        return Lists(np.zeros((1, 1)), 1)
    x = np.array([r["v"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.random.default_rng(0).permutation(len(x))[: max(1, min(MOST_LISTS, len(x), int(n**0.5)))]]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), centres)
    own = (x @ centres.T).argmax(axis=1)
    asked = x[:: max(1, len(x) // 500)]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list in each query's order
    ranks = np.take_along_axis(place, own[near], axis=1)
    return Lists(centres, min(len(centres), int(np.quantile(ranks, REACH)) + 1 if ranks.size else 1))


def _assign(centres: np.ndarray, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, POINT_SLICE):
            part = batch.slice(at, POINT_SLICE)
            scores = _matrix(part.column("v")) @ centres.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, n), pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists], names=["id", "v", "lists"])


def assign(rows: DataFrame, lists: Lists, n: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(list, id, v): rows in each of their n nearest lists; zero vectors are in none."""
    there = _vectors(rows, id_col, vector).filter(F.exists("v", lambda x: x != 0))
    placed = there.mapInArrow(partial(_assign, lists.centres, n), "id bigint, v array<float>, lists array<bigint>")
    return placed.select(F.explode("lists").alias("list"), "id", "v")


def build_lists(points: DataFrame, lists: Lists, path: str, vector: str = "embedding", id_col: str = "vec_id") -> None:
    """Writes every point into its list, a partition of the table at `path`."""
    dealt = assign(points, lists, 1, vector, id_col)
    parts = F.pmod(F.xxhash64("id"), F.lit(16))  # a crowded list is written by many tasks
    dealt.repartition("list", parts).write.mode("overwrite").partitionBy("list").parquet(path)


def search_lists(spark: SparkSession, path: str, lists: Lists, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id", block: int = QUERY_BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, point_id, score): the k best points of the lists that each query probes; ties and scores as in `topk`.

    Queries go to the cells of their lists by join; a crowded list is several cells, and a list with many queries meets
    them in blocks.
    """
    stored = spark.read.schema("id bigint, v array<float>, list bigint").parquet(path)
    probes = assign(queries, lists, lists.probes, vector, id_col)
    sizes = stored.groupBy("list").agg(F.ceil(F.count("*") / cell_rows).alias("cells"))
    wanted = probes.groupBy("list").agg(F.ceil(F.count("*") / block).alias("blocks"))
    plan = F.broadcast(sizes.join(wanted, "list"))  # a row a list, MOST_LISTS at most
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    at = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    cell = lambda part: (F.col("list") * 1_000_000 + part).alias("cell")
    asked = probes.join(plan, "list").select("list", "id", "v", at("blocks").alias("block"), numbers("cells").alias("part"))
    points = stored.join(plan, "list").select("list", "id", "v", at("cells").alias("part"), numbers("blocks").alias("block"))
    return _nearest(asked.select(cell(F.col("part")), "block", "id", "v"), points.select(cell(F.col("part")), "block", "id", "v"), k)
