"""Best-fit packing of tokenised documents into sequences of a fixed size.

Documents become pieces of at most `size` tokens. How the pieces go into
sequences is a configuration linear program over the histogram of their lengths:
a configuration is a multiset of lengths that fits a sequence, and as few
configurations as possible have to cover all pieces. Multiplicative weights solve
it: every length has a price; a knapsack dynamic program finds the configurations
worth most at these prices, one for each length that it has to hold; lengths
covered more lose price. Prices give a lower bound, the mean of the chosen
configurations a solution. It is rounded down and what is left is solved again,
for as many times as make the fewest sequences; the last remainder is filled
best-fit or by further knapsacks, whichever takes fewer.

Scale: texts are encoded where they are read, and only numbers of pieces are
shuffled. The histogram, at most `size` rows, is all that reaches the driver, so
the program takes the same time for any number of documents. A piece's place
follows by arithmetic from its rank among the pieces of its length, which is its
rank in its task and a running sum over (task, length) counts; no length, however
frequent, is gathered anywhere. The table of pieces is written once, so ranks hold
when tasks are repeated.

Defined cases: null and empty texts are the end id alone; rows without a doc_id
and repeated rows are packed like others; a very long text is encoded whole, its
pieces are dealt like others; an empty table gives an empty table; lengths with equal
prices are taken in ascending order; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_stage, scratch, slices
from .token_files import ENCODE_BYTES, ChunkEncoder, encoder

SIZE = 1024
END_ID = 2
#: Steps of the multiplicative weights and configurations taken in a step.
STEPS, COLUMNS = 50, 64
#: Ways to solve and round: strength of the weights, share of the best worth that a step's configurations may lack, what
#: rounded ones may lack at the prices of the bound, and whether prices carry over to the next solution. The first suits
#: lengths that leave gaps, the second such as fill sequences to the brim.
WAYS = ((2.0, 0.01, 1.0, True), (0.2, 0.001, 0.0005, False))
#: Lengths whose token is worth less than this share of the dearest are covered well enough to be left out of a step.
CHEAP = 0.01
#: How often what rounding leaves is solved again, and configurations of a solution that are rounded; the rest stays for the next one.
AGAIN, SUPPORT = 3, 8192
#: Sequences of the remainder that are also filled by knapsacks one after the other.
LAST = 400

PIECES = "task int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, ids binary"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

#: A number of sequences and the number of pieces of each length that every one of them holds.
Filling = tuple[int, dict[int, int]]


def price(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, step) of the unbounded knapsack for each capacity: greatest value and the length added last (0: none, one less).

    values[l] is what a piece of length l is worth, -inf if there is none.
    """
    size = len(values) - 1
    best, step = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        found = best[room - 1 :: -1] + values[1 : room + 1] if room < size else best[size - 1 :: -1] + values[1:]
        at = int(found.argmax())
        if found[at] > best[room - 1]:
            best[room], step[room] = found[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, step


def _columns(lengths: np.ndarray, forced: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best configuration that holds a length, for each forced one (places in lengths), as rows of counts."""
    size = len(step) - 1
    place = np.full(size + 1, -1)
    place[lengths] = np.arange(len(lengths))
    taken = np.maximum.accumulate(np.where(step > 0, np.arange(size + 1), 0))  # the largest room, at most this, that a piece is taken from
    made = np.zeros((len(forced), len(lengths)), np.int32)
    made[np.arange(len(forced)), forced] = 1
    room, row = taken[size - lengths[forced]], np.arange(len(forced))
    while (live := room > 0).any():
        room, row = room[live], row[live]
        made[row, place[step[room]]] += 1
        room = taken[room - step[room]]
    return np.unique(made, axis=0)


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, prices: np.ndarray, eta: float, slack: float) -> tuple[float, dict[bytes, tuple[float, float]], np.ndarray]:
    """(lower bound, solution, prices).

    The solution says how often each configuration (counts by length, as int32 bytes) is used, no length being covered
    twice, and its worth at the prices of the bound, 1 at most: as complementary slackness has it, the best are worth 1.
    """
    goal = counts.astype(float)
    cover, used, bound = np.zeros(len(lengths)), {}, 0.0
    for _ in range(STEPS):
        values = np.full(size + 1, -np.inf)
        dear = prices / lengths
        values[lengths] = np.where(dear >= CHEAP * dear.max(), prices, -np.inf)
        best, step = price(values)
        worth = values[lengths] + best[size - lengths]
        least = float(goal @ np.maximum(values[lengths], 0)) / best[size]
        if least > bound:
            bound, dual = least, np.maximum(values[lengths], 0) / best[size]
        near = np.flatnonzero(worth >= best[size] * (1 - slack))
        near = near[np.argsort(cover[near] / goal[near], kind="stable")[:COLUMNS]]
        chosen = _columns(lengths, near, step)
        share = np.where(chosen > 0, goal / np.maximum(chosen, 1), np.inf).min(axis=1)  # each alone covers its scarcest length
        got = share @ chosen
        scale = (got / goal).max()
        for c, s in zip(chosen, share / scale, strict=True):
            used[c.tobytes()] = used.get(c.tobytes(), 0.0) + s
        cover += got / scale
        prices = prices * np.exp(-eta * got / scale / goal)
        prices /= prices.max()
    most = (cover / goal).max()
    return bound, {c: (s / most, float(np.frombuffer(c, np.int32) @ dual)) for c, s in used.items()}, prices


def best_fit(left: dict[int, int], size: int) -> list[Filling]:
    """Best-fit decreasing over a histogram: sequences that hold the same are one group."""
    groups: dict[int, list[Filling]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in [r for r in sorted(groups) if r >= length]:
            k, rest = room // length, []
            for many, held in groups.pop(room):
                full = min(many, n // k)
                more = n - full * k if full < many else 0
                for times, pieces in ((full, k), (1 if more else 0, more)):
                    if times:
                        groups.setdefault(room - pieces * length, []).append((times, held | {length: pieces}))
                        n -= times * pieces
                if many - full - bool(more):
                    rest.append((many - full - bool(more), held))
            if rest:
                groups[room] = groups.get(room, []) + rest
            if not n:
                break
        k = size // length
        if n >= k:
            groups.setdefault(size - k * length, []).append((n // k, {length: k}))
        if n % k:
            groups.setdefault(size - n % k * length, []).append((1, {length: n % k}))
    return [g for room in groups for g in groups[room]]


def _knapsacks(left: dict[int, int], size: int, prices: dict[int, float]) -> list[Filling]:
    """Fills one sequence after the other with what is worth most of the pieces left."""
    left, out = dict(left), []
    while left:
        best, picks = np.zeros(size + 1), []
        for length in sorted(left):
            n, k = min(left[length], size // length), 1
            while n:  # k copies at once: 1, 2, 4, ...
                take = min(k, n)
                w, v = take * length, take * prices[length]
                better = best[:-w] + v > best[w:] if w <= size else np.zeros(0, bool)
                best[w:] = np.where(better, best[:-w] + v, best[w:])
                picks.append((length, take, better))
                n, k = n - take, k * 2
        room, held = size, {}
        for length, take, better in reversed(picks):
            w = take * length
            if room >= w and better[room - w]:
                held[length] = held.get(length, 0) + take
                room -= w
        many = min(left[x] // k for x, k in held.items())
        out.append((many, held))
        for x, k in held.items():
            left[x] -= many * k
            if not left[x]:
                del left[x]
    return out


def _rest(left: dict[int, int], size: int) -> list[Filling]:
    """Fillings of the remainder, best-fit or by knapsacks, whichever are fewer."""
    fitted = best_fit(left, size)
    if -(-sum(x * n for x, n in left.items()) // size) < sum(n for n, _ in fitted) <= LAST:
        other = _knapsacks(left, size, {x: x / size * (1 + x / size / 8) for x in left})
        return min(fitted, other, key=_number)
    return fitted


def _number(fillings: list[Filling]) -> int:
    return sum(n for n, _ in fillings)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[Filling], int]:
    """(fillings, lower bound on their number) for the pieces of a histogram {length: number}."""
    whole = {x: n for x, n in sorted(histogram.items()) if n}
    bound = -(-sum(x * n for x, n in whole.items()) // size)
    alone = whole.pop(size, 0)  # nothing fits beside these
    best: list[Filling] | None = None if whole else []
    for eta, slack, loss, carry in WAYS if whole else ():
        left, out, prices = dict(whole), [], np.arange(size + 1) / size
        for k in range(AGAIN):
            lengths = np.array(list(left), np.int64)
            counts = np.array(list(left.values()), np.int64)
            least, used, now = solve(lengths, counts, size, prices[lengths], eta, slack)
            if carry:
                prices[lengths] = now
            if not k:
                bound = max(bound, alone + int(np.ceil(least - 1e-6)))
            tight = [c for c in used if used[c][1] >= 1 - loss]
            for raw in sorted(tight, key=lambda c: (-used[c][0], c))[:SUPPORT]:
                made = np.frombuffer(raw, np.int32)
                held = np.flatnonzero(made)
                many = min(int(used[raw][0]), int((counts[held] // made[held]).min()))
                if many:
                    out.append((many, {int(lengths[i]): int(made[i]) for i in held}))
                    counts[held] -= many * made[held]
            left = {int(x): int(n) for x, n in zip(lengths, counts, strict=True) if n}
            done = out + _rest(left, size)
            if best is None or _number(done) < _number(best):
                best = done
            if not left or alone + _number(best) <= bound:
                break
        if alone + _number(best) <= bound:
            break
    return [(alone, {size: 1})] * bool(alone) + best, bound


class Places:
    """Sequence and offset of every piece by its length and rank, as arrays over runs of ranks."""

    def __init__(self, fillings: list[Filling]) -> None:
        runs, sequences = [], 0
        for many, held in fillings:
            offset = 0
            for length in sorted(held, reverse=True):
                runs.append((length, many, held[length], sequences, offset))
                offset += held[length] * length
            sequences += many
        runs.sort()
        self.n_sequences = sequences
        self.length, self.many, self.copies, self.sequence, self.offset = np.array(runs, np.int64).reshape(-1, 5).T
        sizes = self.many * self.copies
        self.begin = np.cumsum(sizes) - sizes  # place of the run's first piece among all pieces by length and rank
        lengths, first = np.unique(self.length, return_index=True)
        self.base = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
        self.base[lengths] = self.begin[first]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        run = np.searchsorted(self.begin, at, "right") - 1
        nth = at - self.begin[run]
        copy = nth % self.copies[run]
        return self.sequence[run] + nth // self.copies[run], self.offset[run] + copy * length


def cut(make: Callable[[], ChunkEncoder], end_id: int, size: int, ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of (doc_id, text) rows with their ranks in this task; a document's first piece is its shorter one."""
    task, seen, codec = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), make()
    end = np.array([end_id], codec.kind).tobytes()
    for batch in slices(batches, 1, ENCODE_BYTES):
        rows: list[tuple] = []
        raws = []
        for doc, raw in zip(batch.column(0).to_pylist(), codec.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
            wide = np.frombuffer(raw + end, codec.kind).astype("<u4")
            start, stop = 0, (len(wide) - 1) % size + 1
            for piece in range(-(-len(wide) // size)):
                some = wide[start:stop].tobytes()
                rows.append((doc, piece, start, stop - start, zlib.crc32(some)))
                if ids:
                    raws.append(some)
                start, stop = stop, stop + size
        if not rows:
            continue
        doc, piece, start, length, crc = zip(*rows, strict=True)
        length = np.array(length, np.int64)
        order = np.argsort(length, kind="stable")
        held = length[order]
        first = np.searchsorted(held, held)  # where the length's run begins
        rank = np.empty(len(length), np.int64)
        rank[order] = seen[held] + np.arange(len(held)) - first
        seen += np.bincount(length, minlength=size + 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(length), task), pa.int32()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length), pa.array(crc, pa.int64()), pa.array(rank), pa.array(raws, pa.binary()) if ids else pa.nulls(len(length), pa.binary()),
            ],
            names=["task", "doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids"],
        )


def _place(places: Places, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    new_stage()
    for batch in batches:
        sequence, offset = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        kept = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; with_ids adds its ids (little-endian 32-bit integers)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch() as lasting:
        pieces = lasting(rows.mapInArrow(partial(cut, partial(encoder, tokenizer), end_id, size, with_ids), PIECES), "pieces")
        counts = lasting(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = Places(plan(histogram, size)[0])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"), *(["ids"] if with_ids else [])
    )
    more = PLACED.replace("sequence_id", "ids binary, sequence_id") if with_ids else PLACED
    return ranked.mapInArrow(partial(_place, places), more)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids, doc_ids, offsets): every sequence of a packing with ids, its pieces in order; a group holds one sequence."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), held.alias("held")).select(
        "sequence_id",
        "n_ids",
        F.aggregate("held", F.lit(b""), lambda a, h: F.concat(a, h["ids"])).alias("ids"),
        F.col("held.doc_id").alias("doc_ids"),
        F.col("held.offset").alias("offsets"),
    )
