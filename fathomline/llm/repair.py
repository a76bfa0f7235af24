"""Repair of conversation structure by cost DP and prefix-doubling path ranking.

A conversation is in order if its roles, by their initials, read `(s?(ua)+)?`.
Edits lead there: Keep, Rerole to user or assistant, Delete, Insert an empty user
or assistant turn. A node is a place between turns and a state (begin, after
system, after user, after assistant); an arc is an edit with its cost. The cost DP
gives every node what it costs from there to the end, and arcs that keep to it are
optimal. Among paths of optimal arcs the least audit (initials of the edits) is
wanted. A state allows one role to be inserted or changed to, so a node and an
initial name one arc. Nodes are ranked by their audits of 1, 2, 4, ... edits: an
audit twice as long is a pair of ranks, the node's own and that of the node its
pointer leads to, and the pointer is doubled. Ranks pick the arc at each node, and
the path is read off the doubled pointers, all conversations of a batch at once.

Scale: turns are dealt by ranges, so a conversation with a third of all rows is
spread over tasks in blocks of `ROWS` turns. Nearly all conversations are one block
and are done where they are read. For the others a block is a table of costs from
each state to each; costs from the end and states from the begin are passed from
block to block, sorted and one at a time, and so are the SHA-256 and the audit, which the
result holds whole. Turns seen in earlier blocks come from windows over (conversation, MD5).

Defined cases: null roles and texts are one space, as are a null conv_id or turn where the damage is drawn; turns
without a number come first; turns of the same number are ordered by the MD5 of role and text; repeated rows are turns of
their own (and duplicates); rows without a conv_id are one conversation; a role without one of the initials is never kept; a
conversation that loses all turns has zeros, an empty audit and the hash of the empty string; a very long text is hashed whole;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_stage, runs, scratch, slices, spread_join

#: Turns of a block.
ROWS = 256
#: Costs of the edits, and of keeping a truncated turn.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"
#: States: begin, after system, after user, after assistant. Where a user or assistant turn leads from each, and what a kept initial does.
TO = np.array([2, 2, 3, 2])
NO = 4
KEPT = np.full((4, 4), NO)  # by state and initial (0 other, 1 s, 2 u, 3 a)
KEPT[0, 1], KEPT[[0, 1, 3], 2], KEPT[2, 3] = 1, 2, 3
ROLE = {2: "user", 3: "assistant"}
FAR = 1 << 50
ACCEPTED = np.array([0, FAR, FAR, 0])

SPACES = " \t\n\x0b\x0c\r"
WIDTHS = "conv_id bigint, run int, seq bigint, home string, nth bigint"
PIECE = (
    f"{WIDTHS}, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, n_turns bigint, audit string, n_lines bigint, text string"
)
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults drawn by the CRC-32 of `conv_id:turn` modulo 20."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        word(role).alias("role"),
        word(text).alias("text"),
        (F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20).alias("draw"),
    )
    d = F.col("draw")
    said = F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    who = F.when(d == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(d != 0).select("conv_id", "turn", who.alias("role"), said.alias("text"), F.explode(copies).alias("copy")).drop("copy")


class Graph:
    """The edit graphs of the blocks of a batch. Node 4p + s is place p with state s; a block of n turns has n + 1 places."""

    def __init__(self, counts: np.ndarray, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, last: np.ndarray) -> None:
        """By block: number of turns, whether it is its conversation's last; by turn: initial, whether it must go, whether it is truncated."""
        self.counts, self.last = counts, last
        self.first = np.cumsum(counts + 1) - (counts + 1)  # a block's first place
        self.end = self.first + counts
        n = int((counts + 1).sum())
        self.turn = np.full(n, -1)  # the turn after a place
        place = np.delete(np.arange(n), self.end)
        self.turn[place] = np.arange(len(place))
        far = np.where(gone, FAR, 0)
        stay = KEEP + np.where(cut, TRUNCATED, 0) + far
        self.keep_to = KEPT[:, initial].T  # by turn and state
        self.keep = np.where(self.keep_to == NO, FAR, stay[:, None])
        self.rerole = np.broadcast_to((stay - KEEP + REROLE)[:, None], (len(initial), 4))

    def costs(self, exits: np.ndarray) -> np.ndarray:
        """What it costs from every place and state to the block's end, exits being what it costs from there."""
        costs = np.full((len(self.turn), 5), FAR)
        ends = np.where(self.last[:, None], _inserted(exits), exits)
        costs[self.end, :4] = ends
        order = np.argsort(-self.counts, kind="stable")
        sizes = self.counts[order]
        for i in range(int(sizes.max(initial=0)) - 1, -1, -1):
            at = self.first[order[: np.searchsorted(-sizes, -i, "left")]] + i  # blocks with more than i turns
            t, after = self.turn[at], costs[at + 1]
            best = np.minimum(after[:, :4] + DELETE, after[:, TO] + self.rerole[t])
            best = np.minimum(best, np.take_along_axis(after, self.keep_to[t], 1) + self.keep[t])
            costs[at, :4] = _inserted(best)
        return np.minimum(costs[:, :4], FAR)

    def paths(self, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(letter, rank, pointers): the edit of each node's least audit (0 at the end, else its place in LETTERS from 1),
        the node's rank by that audit, and the pointers over 1, 2, 4, ... edits."""
        n = len(self.turn)
        place, state = np.arange(n)[:, None], np.arange(4)[None, :]
        inner = self.turn >= 0
        t = np.where(inner, self.turn, 0)
        many = len(self.keep) > 0
        after = np.minimum(place + 1, n - 1)
        wide = np.column_stack([costs, np.full(n, FAR)])
        closing = np.zeros(n, bool)
        closing[self.end[self.last]] = True
        arcs = []  # (node led to, optimal), by letter
        for letter in LETTERS:
            if letter == "I":
                to_place, to_state, price, allowed = place, TO[state], INSERT, (inner | closing)[:, None]
            else:
                to_place, allowed = after, inner[:, None]
                if letter == "D":
                    to_state, price = state, DELETE
                elif letter == "R":
                    to_state, price = TO[state], self.rerole[t] if many else FAR
                else:
                    to_state, price = (self.keep_to[t], self.keep[t]) if many else (state, FAR)
            to_state = np.broadcast_to(to_state, (n, 4))
            good = allowed & (wide[to_place, to_state] + price == costs) & (costs < FAR)
            arcs.append((np.where(good, 4 * to_place + np.minimum(to_state, 3), 4 * place + state).ravel(), good.ravel()))
        nodes = np.arange(4 * n)
        letter, pointer = np.zeros(4 * n, np.int64), nodes
        for k in range(len(LETTERS) - 1, -1, -1):
            letter = np.where(arcs[k][1], k + 1, letter)
            pointer = np.where(arcs[k][1], arcs[k][0], pointer)
        rank, step = letter, pointer
        while (letter[step] > 0).any():
            rank = np.unique(rank * (int(rank.max()) + 1) + rank[step], return_inverse=True)[1]
            step = step[step]
        # the arc to the least initial and, behind it, the least rank
        worst = (len(LETTERS) + 2) * (int(rank.max(initial=0)) + 1)
        score = np.stack([np.where(good, (k + 1) * (int(rank.max(initial=0)) + 1) + rank[to], worst) for k, (to, good) in enumerate(arcs)])
        pick = score.argmin(axis=0)
        some = score.min(axis=0) < worst
        letter = np.where(some, pick + 1, 0)
        pointers = [np.where(some, np.stack([to for to, _ in arcs])[pick, nodes], nodes)]
        while (letter[pointers[-1]] > 0).any():
            pointers.append(pointers[-1][pointers[-1]])
        return letter, rank, pointers

    def walks(self, letter: np.ndarray, pointers: list[np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, node) of all edits, from each block's entry state on, in order: 2k edits are k and those their pointers lead to."""
        block, step, node = np.arange(len(entry)), np.zeros(len(entry), np.int64), 4 * self.first + entry
        for k, jump in enumerate(pointers):
            block, step, node = np.tile(block, 2), np.concatenate([step, step + (1 << k)]), np.concatenate([node, jump[node]])
            live = letter[node] > 0
            block, step, node = block[live], step[live], node[live]
        order = np.lexsort((step, block))
        return block[order], node[order]

    def exits(self, pointers: list[np.ndarray], entry: np.ndarray) -> np.ndarray:
        """The state in which each block is left if entered in a state."""
        node = 4 * self.first + entry
        return pointers[-1][pointers[-1][node]] % 4


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs with turns inserted before going on."""
    for _ in range(3):
        costs = np.minimum(costs, costs[:, TO] + INSERT)
    return costs


class Blocks:
    """The blocks of a batch with the faults of their turns."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.keys = [batch.column(n).to_pylist() for n in ("conv_id", "run", "seq", "home", "nth")]
        items = batch.column("items")
        self.counts = np.diff(items.offsets.to_numpy())
        flat = items.flatten()
        self.turns, self.roles, marks, empty, cut = (flat.field(n).to_pylist() for n in ("turn", "role", "mark", "empty", "cut"))
        self.texts = flat.field("text").to_pylist() if any(f.name == "text" for f in flat.type) else None
        seen = batch.column("seen").to_pylist()
        self.at = np.cumsum(self.counts) - self.counts
        self.fault = np.zeros(len(marks), np.int8)  # 1 blank, 2 duplicate, 3 truncated
        for at, n, known in zip(self.at.tolist(), self.counts.tolist(), seen, strict=True):
            known = set(known or ())
            for i in range(at, at + n):
                self.fault[i] = 1 if empty[i] else 2 if marks[i] in known else 3 if cut[i] else 0
                known.add(marks[i])
        self.initial = np.array(["?sua".find(r[:1]) if r else 0 for r in self.roles], np.int64).clip(0)
        last = batch.column("last").to_numpy(zero_copy_only=False)
        # a turn counts as truncated only if nothing else is wrong with it, and turns that must go are never kept
        self.graph = Graph(self.counts, self.initial, (self.fault == 1) | (self.fault == 2), self.fault == 3, last)

    def pieces(self, exits: np.ndarray, entry: np.ndarray) -> Iterator[tuple]:
        """One row a block, as PIECE has it."""
        costs = self.graph.costs(exits)
        letter, _, pointers = self.graph.paths(costs)
        block, node = self.graph.walks(letter, pointers, entry)
        edit, place, state = letter[node], node // 4, node % 4
        bounds = np.searchsorted(block, np.arange(len(self.counts) + 1))
        pair = np.array(["su", "ua", "au"])
        for b, (at, n) in enumerate(zip(self.at.tolist(), self.counts.tolist(), strict=True)):
            lines, audit = [], []
            for k in range(bounds[b], bounds[b + 1]):
                what = LETTERS[edit[k] - 1]
                audit.append(what)
                if what != "D":
                    t = self.graph.turn[place[k]]
                    role = self.roles[t] if what == "K" else ROLE[int(TO[state[k]])]
                    lines.append(f"{role}:" if what == "I" else f"{role}:{self.texts[t]}")
            fault = self.fault[at : at + n]
            firsts = [r[:1] for r in self.roles[at : at + n]]
            known = [t for t in self.turns[at : at + n] if t is not None]
            yield (
                *(c[b] for c in self.keys), int(costs[self.graph.first[b], entry[b]]), *(int((fault == f).sum()) for f in (1, 2, 3)),
                sum(x + y not in pair for x, y in zip(firsts, firsts[1:])), firsts[0], firsts[-1],
                known[0] if known else None, known[-1] if known else None, len(set(known)), "".join(audit), len(lines), "\n".join(lines),
            )


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def fold(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """The results of conversations whose pieces come in order, one conversation after the other."""
    home = None
    for conv, _, _, key, _, cost, blank, duplicate, truncated, illegal, first, last, low, high, n_turns, audit, n_lines, text in pieces:
        if key != home:
            if home is not None:
                yield _closed(total, digest, audits)
            home, total, digest, audits = key, [conv, cost, 0, 0, 0, 0, None, None, 0, None, 0], hashlib.sha256(), []
        else:
            total[5] += total[9] + first not in ("su", "ua", "au")
            n_turns -= low is not None and low == total[7]
        total[2:6] = [a + b for a, b in zip(total[2:6], (blank, duplicate, truncated, illegal), strict=True)]
        total[6] = low if total[6] is None else total[6]
        total[7] = total[7] if high is None else high
        total[8] += n_turns
        total[9] = last
        if n_lines:
            digest.update(("\n" if total[10] else "").encode() + text.encode())
            total[10] += n_lines
        audits.append(audit)
    if home is not None:
        yield _closed(total, digest, audits)


def _closed(total: list, digest, audits: list[str]) -> tuple:
    conv, cost, blank, duplicate, truncated, illegal, low, high, n_turns, *_ = total
    return conv, 0 if low is None else high - low + 1 - n_turns, blank, duplicate, truncated, illegal, cost, "".join(audits), digest.hexdigest()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of one block."""
    for batch in slices(batches, batch_column("items")):
        blocks = Blocks(batch)
        n = len(blocks.counts)
        rows = list(fold(blocks.pieces(np.tile(ACCEPTED, (n, 1)), np.zeros(n, np.int64))))
        if rows:
            yield _columns(rows, RESULT)


FIELDS = ("conv_id", "run", "seq", "home", "nth", "last", "seen", "items")


def batch_column(name: str) -> int:
    return FIELDS.index(name)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What it costs to get through a block, from each state (4 times) to each."""
    for batch in slices(batches, batch_column("items")):
        blocks = Blocks(batch)
        n = len(blocks.counts)
        first = blocks.graph.first
        through = np.stack([blocks.graph.costs(np.tile(np.where(np.arange(4) == e, 0, FAR), (n, 1)))[first] for e in range(4)], axis=2)
        yield _columns([(*(c[b] for c in blocks.keys), through[b].ravel().tolist()) for b in range(n)], f"{WIDTHS}, through array<bigint>")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from the end of every block; blocks of a conversation come last first."""
    new_stage()
    home, costs = None, ACCEPTED
    for batch in batches:
        rows = []
        for *key, through in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            costs = ACCEPTED if key[3] != home else costs
            home = key[3]
            rows.append((*key, costs.tolist()))
            costs = np.minimum((np.array(through).reshape(4, 4) + costs).min(axis=1), FAR)
        if rows:
            yield _columns(rows, f"{WIDTHS}, exits array<bigint>")


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which a block is left, by the one it is entered in."""
    for batch in slices(batches, batch_column("items")):
        blocks = Blocks(batch)
        n = len(blocks.counts)
        exits = np.array(batch.column("exits").to_pylist())
        _, _, pointers = blocks.graph.paths(blocks.graph.costs(exits))
        left = np.stack([blocks.graph.exits(pointers, np.full(n, s)) for s in range(4)], axis=1)
        yield _columns([(*(c[b] for c in blocks.keys), exits[b].tolist(), left[b].tolist()) for b in range(n)], f"{WIDTHS}, exits array<bigint>, left array<bigint>")


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which every block is entered; blocks of a conversation come in order."""
    new_stage()
    home, state = None, 0
    for batch in batches:
        rows = []
        for *key, exits, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state = 0 if key[3] != home else state
            home = key[3]
            rows.append((*key, exits, state))
            state = left[state]
        if rows:
            yield _columns(rows, f"{WIDTHS}, exits array<bigint>, entry bigint")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, batch_column("items")):
        rows = list(Blocks(batch).pieces(np.array(batch.column("exits").to_pylist()), batch.column("entry").to_numpy()))
        yield _columns(rows, PIECE)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    new_stage()
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for row in fold(rows):
        yield _columns([row], RESULT)


def repair(turns: DataFrame, rows: int = ROWS) -> DataFrame:
    """The faults and the cheapest repair of every conversation of turns (conv_id, turn, role, text; none null but conv_id and turn).

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    ready = turns.select(
        "conv_id", "turn", "role", "text",
        F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("mark"),
        (trimmed == "").alias("empty"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    with scratch() as lasting:
        blocks = lasting(runs(ready, "conv_id", ["turn", "mark"], size=rows), "blocks")
        order = Window.partitionBy("conv_id").orderBy("run", "seq")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = blocks.select("conv_id", "run", "seq").select(
            "run", "seq", F.count("*").over(every).alias("n"), F.row_number().over(order).cast("long").alias("nth"),
            F.concat_ws(":", F.first("run").over(every), F.first("seq").over(every)).alias("home"),
        )
        places = lasting(placed.filter("n > 1").select("run", "seq", "home", "nth", (F.col("nth") == F.col("n")).alias("last")), "places")
        none = F.lit(None).cast("array<string>")
        single = blocks.join(places.select("run", "seq"), ["run", "seq"], "left_anti").select(
            "conv_id", "run", "seq", F.concat_ws(":", "run", "seq").alias("home"), F.lit(1).cast("long").alias("nth"), F.lit(True).alias("last"), none.alias("seen"), "items"
        )
        done = single.mapInArrow(_whole, RESULT)
        if places.limit(1).count():
            long = blocks.join(places, ["run", "seq"])
            marks = long.select("home", "run", "seq", "nth", F.explode(F.array_distinct(F.col("items.mark"))).alias("mark"))
            earlier = marks.withColumn("since", F.min("nth").over(Window.partitionBy("home", "mark"))).filter("nth > since")
            seen = earlier.groupBy("run", "seq").agg(F.collect_list("mark").alias("seen"))
            long = lasting(long.join(seen, ["run", "seq"], "left").select(*FIELDS), "long")
            key = ["run", "seq"]
            tables = long.mapInArrow(_tables, f"{WIDTHS}, through array<bigint>").repartition("home").sortWithinPartitions("home", F.desc("nth"))
            exits = lasting(tables.mapInArrow(_backward, f"{WIDTHS}, exits array<bigint>"), "exits")
            leaves = long.join(exits.select(*key, "exits"), key).select(*FIELDS, "exits").mapInArrow(_leaves, f"{WIDTHS}, exits array<bigint>, left array<bigint>")
            entered = leaves.repartition("home").sortWithinPartitions("home", "nth").mapInArrow(_forward, f"{WIDTHS}, exits array<bigint>, entry bigint")
            entered = lasting(entered, "entered")
            pieces = long.join(entered.select(*key, "exits", "entry"), key).select(*FIELDS, "exits", "entry").mapInArrow(_pieces, PIECE)
            done = done.union(pieces.repartition("home").sortWithinPartitions("home", "nth").mapInArrow(_folded, RESULT))
        return lasting(done, "repaired")


def damage_and_repair(conversations: DataFrame, rows: int = ROWS) -> DataFrame:
    """repair of the damaged turns of a table (conv_id, turn, role, text), with a row for every conversation of the table."""
    done = repair(damaged(conversations), rows)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return spread_join(ids, done, ["conv_id"], by="conv_id", how="left", rows=0).select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
