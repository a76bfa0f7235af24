"""MinHash near-duplicates with sequential Bayesian verification.

1. Sketch: each text becomes its set of distinct word shingles (64-bit
   fingerprints), a MinHash signature of 128 values, 32 band keys of 4 values
   each, and a digest of the whole set. At a similarity of 0.8 the chance that
   two texts share no band is (1 - 0.8^4)^32 = 5e-8.
2. Classes: texts with the same set are one class from here on, named by its
   smallest doc_id, so exact copies never make pairs.
3. Candidates: the leader of a band bucket is the class whose buckets are the
   largest together, so in a group of near copies the text they come from. In
   every bucket each class meets the leader, a number of pairs linear in the
   bucket; then, `ROUNDS` times, the classes that are still apart meet a leader
   of their own. What is apart after that is compared in full, so no link is
   lost: signatures in parts of `BLOCK` classes, and the full sets of survivors
   in blocks of about `TEXT_BLOCK` texts or `TEXT_SHINGLES` shingles, where a pair that is joined
   meanwhile is skipped. Pairs travel packed by block and only links leave a block.
4. Sequential Bayesian verification: signature bytes are compared in batches
   of 16. With a uniform prior, a pair is pruned as soon as the posterior
   probability that its similarity reaches the threshold is below `miss`.
5. Exact verification: survivors are confirmed on the full shingle sets,
   recomputed from the text. The shared side of a star is read once a group of
   at most `STAR` partners, so a hub is salted over tasks.
6. Components: the smallest doc_id reachable over confirmed links.

Joins on a bucket, a leader or a hub split hot keys (common.spread_join).
Tables written on the way are deleted, but for the three the result reads.

Defined cases: null or empty text and text without words has an empty set and
links with nothing, copies of it neither; a text of fewer words than a shingle
is one shingle; a very long text costs memory by its own length in the task
that holds it; rows that share a doc_id count as one document; rows without a
doc_id are returned unjudged (n_shingles and component_id null, kept false); an
empty table gives an empty table. Other columns stay; result columns replace columns of the
same name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, spread_join, written
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
BATCH = 16
#: Chance to prune a pair that reaches the threshold, after each batch.
MISS = 1e-6
ROUNDS = 2
BLOCK = 512
TEXT_BLOCK, TEXT_SHINGLES = 512, 1 << 19
STAR = 128
#: A table of ids goes to every executor only up to so many rows (8 bytes each).
BROADCAST_IDS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(7))
_XOR = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64) | np.uint64(1)

SKETCH = "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>, sig binary"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of SIZE for each non-empty set."""
    out = np.empty((len(sets), SIZE), np.uint64)
    at = 0
    while at < len(sets):  # pieces that fit a core's cache
        upto, n = at, 0
        while upto < len(sets) and (upto == at or n + len(sets[upto]) <= 16_384):
            n += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[at:upto])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : upto - 1]], dtype=np.int64)))
        for k in range(SIZE):
            out[at:upto, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        at = upto
    return out


def sketch(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SKETCH rows of (doc_id, text) batches; empty sets have nulls for set_id, bands and sig."""
    for batch in slices(batches, 1):
        sets = list(shingle_sets(batch.column(1), size))
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in full])
        keys = mix((sig * _BAND).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        small = ((sig >> np.uint64(24)) & np.uint64(0xFF)).astype(np.uint8)
        row = dict(zip(full, range(len(full)), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([keys[row[i]].view(np.int64) if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                pa.array([small[row[i]].tobytes() if i in row else None for i in range(len(sets))], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_id", "bands", "sig"],
        )


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m equal ones is pruned.

    With a uniform prior the posterior of the match rate p after m of n is
    Beta(m+1, n-m+1), and P(p >= t) = P(Binomial(n+1, t) <= m). One byte of a
    value also agrees by chance, so t is the match rate at the threshold.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices survive all batches; a row is compared no further once pruned."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in bounds:
        part = slice(n - BATCH, n)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SIZE)


def prune(percent: int, miss: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, sig_a, sig_b) that may reach the threshold."""
    bounds = least_matches(percent, miss)
    for batch in batches:
        if batch.num_rows:
            keep = plausible(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[list]]:
    """Runs of rows with equal first n_keys columns, across batches, as columns of Python values."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = 0
        while at < batch.num_rows:
            key = tuple(c[at] for c in columns[:n_keys])
            upto = at + 1
            while upto < batch.num_rows and all(c[upto] == k for c, k in zip(columns, key)):
                upto += 1
            part = [c[at:upto] for c in columns]
            if held is not None and tuple(c[0] for c in held[:n_keys]) == key:
                for h, p in zip(held, part):
                    h.extend(p)
            else:
                if held is not None:
                    yield held
                held = part
            at = upto
    if held is not None:
        yield held


PAIRS = "bx bigint, by bigint, a array<bigint>, b array<bigint>"


def block_pairs(percent: int, miss: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PAIRS rows, plausible pairs of different components by the text blocks (bx <= by) that hold them.

    Takes sorted rows (bucket, i, j, node, component, part, text_block, sig): all classes of parts i and j of a bucket.
    """
    bounds = least_matches(percent, miss)
    for _, i, j, node, component, part, text_block, sig in _groups(batches, 3):
        nodes, comps, parts, homes = (np.array(x, np.int64) for x in (node, component, part, text_block))
        sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, SIZE)
        left = np.flatnonzero(parts == i[0])
        right = left if i[0] == j[0] else np.flatnonzero(parts == j[0])
        firsts, seconds = [], []
        for x in left:
            ys = right[(comps[right] != comps[x]) & ((nodes[right] > nodes[x]) if i[0] == j[0] else True)]
            if len(ys):
                ys = ys[plausible(np.broadcast_to(sigs[x], (len(ys), SIZE)), sigs[ys], bounds)]
                swap = homes[ys] < homes[x]
                firsts.append(np.where(swap, ys, x))
                seconds.append(np.where(swap, x, ys))
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
        if len(u):
            order = np.lexsort((homes[v], homes[u]))
            u, v = u[order], v[order]
            bx, by = homes[u], homes[v]
            begin = np.flatnonzero(np.concatenate(([True], (bx[1:] != bx[:-1]) | (by[1:] != by[:-1]))))
            cuts = pa.array(np.append(begin, len(u)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bx[begin]), pa.array(by[begin]), *(pa.ListArray.from_arrays(cuts, pa.array(nodes[k])) for k in (u, v))],
                names=["bx", "by", "a", "b"],
            )


def _similar(s: np.ndarray, other: np.ndarray, percent: int) -> bool:
    if min(len(s), len(other)) * 100 < percent * max(len(s), len(other)):
        return False
    both = len(np.intersect1d(s, other, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(other) - both)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of pieces of the incidence matrix."""
    sizes = [len(s) for s in sets]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, (1 << 22) // len(sets))
    for first in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, (first, first + width))
        piece = np.zeros((len(sets), width), np.float32)
        piece[row[lo:hi], column[lo:hi] - first] = 1
        out += piece @ piece.T
    return out


#: Pairs of a block that are compared at once, those of joined texts apart.
ROUND = 8192


def confirm_blocks(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links from sorted rows (bx, by, role, node, component, text, a, b): role 0 texts, then role 1 pairs.

    Pairs whose sides are already joined by links of the same block pair aren't compared again.
    """
    key, sets, parent, comp = None, {}, {}, {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def linked(pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for at in range(0, len(pairs), ROUND):
            apart = [(a, b) for a, b in pairs[at : at + ROUND] if top(comp[a]) != top(comp[b])]
            nodes = sorted({x for pair in apart for x in pair})
            together = None
            if 8 * len(apart) > len(nodes) ** 1.5:
                together, place = _overlaps([sets[x] for x in nodes]), {x: k for k, x in enumerate(nodes)}
            for a, b in apart:
                if top(comp[a]) == top(comp[b]):
                    continue
                if together is None:
                    holds = _similar(sets[a], sets[b], percent)
                else:
                    both = int(together[place[a], place[b]])
                    holds = 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
                if holds:
                    parent[top(comp[a])] = top(comp[b])
                    yield min(a, b), max(a, b)

    pairs: set[tuple[int, int]] = set()
    for batch in slices(batches, 5):
        bx, by, role, node, component = (batch.column(k).to_pylist() for k in range(5))
        found: list[tuple[int, int]] = []
        for k, s in enumerate(shingle_sets(batch.column(5), size)):
            if key != (bx[k], by[k]):
                found.extend(linked(sorted(pairs)))
                key, sets, parent, comp, pairs = (bx[k], by[k]), {}, {}, {}, set()
            if role[k] == 0:
                sets[node[k]], comp[node[k]] = s, component[k]
            else:  # one block's pairs at most, as they come from every shared bucket
                pairs.update(zip(batch.column(6)[k].as_py(), batch.column(7)[k].as_py(), strict=True))
        yield _links(found)
    yield _links(list(linked(sorted(pairs))))


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def confirm(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed (a, b) from rows (a, salt, role, id, text) sorted so that the shared side (role 0) comes first."""
    key, shared = None, []
    for batch in slices(batches, 4):
        a, salt, role, ids = (batch.column(k).to_pylist() for k in range(4))
        left, right = [], []
        for k, s in enumerate(shingle_sets(batch.column(4), size)):
            if key != (a[k], salt[k]):
                key, shared = (a[k], salt[k]), []
            if role[k] == 0:
                shared.append(s)
                continue
            if any(_similar(s, other, percent) for other in shared):
                left.append(a[k])
                right.append(ids[k])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """spread_join of a written table, whose size is known at once."""
    return spread_join(left, right, keys, by, how, rows=left.count())


def _small(ids: DataFrame) -> DataFrame:
    """ids, broadcast if the table is within BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text) of the given doc_id rows, written."""
    return written(texts.join(_small(written(ids.distinct(), "ids")), "doc_id", "left_semi"), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets; texts: (doc_id, text)."""
    pairs = written(pairs, "survivors")
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = written(
        _join(pairs, degree, ["a"], by="b").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).alias("salt")), "salted"
    )
    found = _texts_of(salted.select("a").union(salted.select("b")).select(F.col("a").alias("doc_id")), texts)
    right = _join(salted, found.withColumnRenamed("doc_id", "b"), ["b"], by="a").select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"), "text")
    hubs = written(salted.select("a", "salt").distinct(), "hubs")
    left = _join(hubs, found.withColumnRenamed("doc_id", "a"), ["a"], by="salt").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"), "text")
    stars = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return written(stars.mapInArrow(partial(confirm, size, percent), "a bigint, b bigint").distinct(), "links")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, weight, component) of the buckets whose classes are in more than one component."""
    known = _join(members, labels, ["node"], by="bucket", how="left").select(
        "bucket", "node", "weight", F.coalesce("component", "node").alias("component")
    )
    split = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    return written(spread_join(known, split.select("bucket", "n"), ["bucket"], by="node"), "apart")


def _stars(members: DataFrame, tried: int) -> DataFrame:
    """Pairs (a, b) of each bucket's weightiest class and every class of another component.

    tried: number of earlier rounds, whose leaders' components stay out.
    """
    first = F.struct("weight", (-F.col("node")).alias("last"), "component")
    for k in range(tried + 1):
        leaders = members.groupBy("bucket").agg(F.max(first).alias("top"))
        members = spread_join(members, leaders, ["bucket"], by="node").filter(F.col("component") != F.col("top.component"))
        if k < tried:
            members = members.drop("top")
    return members.select((-F.col("top.last")).alias("a"), F.col("node").alias("b")).distinct()


def _rest(apart: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """Links between classes that share a bucket and are still in different components."""
    # texts are dealt in blocks of classes that share a bucket, the largest they are in
    home = apart.groupBy("node").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"), F.first("component").alias("component"))
    home = written(home.join(nodes.select("node", "n_shingles", "sig"), "node"), "home")
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / TEXT_SHINGLES), F.ceil(F.count("*") / TEXT_BLOCK)).alias("blocks")
    crowd = home.groupBy("home").agg(blocks)
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks")))
    homes = written(_join(home, crowd, ["home"], by="node").select("node", "component", "sig", block.alias("text_block")), "homes")
    width = F.ceil(F.col("n") / BLOCK)
    dealt = (
        spread_join(
            apart.select("bucket", "node", width.alias("width"), F.pmod(F.xxhash64("node"), width).alias("part")), homes, ["node"], by="bucket"
        )
        .withColumn(
            "ij",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), F.col("width") - 1),
                    lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")),
                )
            ),
        )
        .select("bucket", "ij.i", "ij.j", "node", "component", "part", "text_block", "sig")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )
    pairs = written(dealt.mapInArrow(partial(block_pairs, percent, miss), PAIRS), "pairs")
    met = pairs.select("bx", "by").distinct()
    sides = met.select("bx", "by", F.explode(F.array_distinct(F.array("bx", "by"))).alias("text_block"))
    homes = homes.drop("sig")
    found = _texts_of(sides.select("text_block").distinct().join(homes, "text_block").select(F.col("node").alias("doc_id")), texts)
    role_texts = spread_join(
        spread_join(sides, homes, ["text_block"], by="bx"), found.withColumnRenamed("doc_id", "node"), ["node"], by="bx"
    ).select("bx", "by", F.lit(0).alias("role"), "node", "component", "text", F.lit(None).cast("array<bigint>").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    none = F.lit(None).cast("bigint")
    role_pairs = pairs.select("bx", "by", F.lit(1).alias("role"), none.alias("node"), none.alias("component"), F.lit(None).cast("string").alias("text"), "a", "b")
    blocks = role_texts.union(role_pairs).repartition("bx", "by").sortWithinPartitions("bx", "by", "role")
    return written(blocks.mapInArrow(partial(confirm_blocks, size, percent), "a bigint, b bigint").distinct(), "links")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", miss: float = MISS, rounds: int = ROUNDS
) -> DataFrame:
    """docs with n_shingles, component_id and kept (one document of each component).

    miss: chance to lose a link at each batch of the verification; rounds: rounds of stars before the rest is compared in blocks.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch() as lasting:
        sketches = lasting(texts.mapInArrow(partial(sketch, size), SKETCH), "sketches")
        named = sketches.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
        nodes = lasting(
            named.groupBy("set_id").agg(
                F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
            ),
            "nodes",
        )
        banded = nodes.select(F.explode("bands").alias("bucket"), "node")
        buckets = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        members = written(spread_join(banded, buckets, ["bucket"], by="node"), "members")
        # a class is the more central the larger its buckets are together
        weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
        apart = written(
            members.join(weights, "node").select("bucket", "node", "weight", F.col("node").alias("component")), "weighted"
        )
        members = apart.drop("component")

        def tested(pairs: DataFrame) -> DataFrame:
            a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
            b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
            signed = spread_join(_join(pairs, b, ["b"], by="a"), a, ["a"], by="b").select("a", "b", "sig_a", "sig_b")
            return signed.mapInArrow(partial(prune, percent, miss), "a bigint, b bigint")

        links = labels = None
        for tried in range(rounds):
            found = _confirmed(tested(written(_stars(apart, tried), "stars")), texts, size, percent)
            links = found if links is None else links.union(found)
            labels = components(links)
            apart = _apart(members, labels)
            if not apart.limit(1).count():
                break
        else:
            links = links.union(_rest(apart, nodes, texts, size, percent, miss))
            labels = components(links)
        labels = lasting(labels, "labels")

    classes = nodes.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    # two documents of one id are one: its smallest component holds for all its rows
    per_doc = (
        spread_join(named.select("doc_id", "set_id"), classes, ["set_id"], by="doc_id").groupBy("doc_id").agg(F.min("component").alias("component_id"))
    )
    counts = sketches.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    found = counts.join(per_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    rest_cols = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    key = "_key_" + "_".join(rest_cols)  # a name that no column has
    joined = docs.select(*rest_cols).join(found.withColumnRenamed("doc_id", key), F.col(id_col).cast("long") == F.col(key), "left")
    return joined.select(
        *rest_cols,
        "n_shingles",
        "component_id",
        F.coalesce(F.col(id_col).cast("long") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
