"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of `BLOCK` turns. Its prefix after a block has
a digest: a sum, over its blocks, of 60-bit numbers drawn twice from the MD5 of a
block's place and content, so prefixes come from running sums and not from a
chain. Conversations are grouped by the digest before a block and the block's
content first; one representative of each group goes on. Where a prefix continues
with one block only, the turns in it have that block's members. Where sibling
blocks diverge, and only there, their leading turns are grouped to find out how
far they agree; that work is by distinct block, not by conversation.

Sums over subtrees need no walk over the trie. Every node belongs to its smallest
member, so a conversation owns the nodes from some depth to its end. A subtree's
sum is then the sum, over the members, of what each owns altogether, less what
the node's owner owns above it; the first is a second grouping of the same
blocks, the second a running sum. A trie as deep as the longest conversation
costs no more rounds than a flat one.

Scale: texts are hashed where they are read and not shuffled. Turns are numbered
by runs over ranges, so a conversation that holds a third of all rows is spread
over tasks. Groups by digest are aggregated before the shuffle; joins on parents
and owners split hot keys. The list of members that end at a node is hashed in
pieces of 1,024 ids, one at a time.

Defined cases: null roles and texts are empty; turns without a number come first;
turns of the same number are ordered by the MD5 of role and text; repeated rows
are turns of their own; rows without a conv_id belong to no conversation; a very
long text counts by its bytes; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined_digests, running, runs, scratch, spread_join, written

#: Turns of a block.
BLOCK = 4
ROOT = "0:0:0"
#: First turns that a conversation may share with the one it is rebuilt from.
MOST_SHARED = 9


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, mark, bytes): every turn's place from 0, MD5 of role and text, and the text's bytes in UTF-8."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    slim = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary")).alias("mark"),
        F.octet_length(said).cast("long").alias("bytes"),
    )
    cut = written(runs(slim, "conv_id", ["turn", "mark"]), "runs")
    before = Window.partitionBy("conv_id").orderBy("run", "seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.select("conv_id", "run", "seq", F.size("items").alias("n"))
    begun = sizes.select("conv_id", "run", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    one = cut.join(begun, ["conv_id", "run", "seq"]).select("conv_id", "base", F.posexplode("items").alias("i", "item"))
    return one.select("conv_id", (F.col("base") + F.col("i")).alias("place"), "item.mark", "item.bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of the rebuilt conversations: h first turns of conversation c - c % 5, then the own ones after the first h.

    turns: numbered_turns; h is crc32 of the decimal c modulo 9; conversations: (conv_id, length).
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = sizes.select("conv_id", "n", (c - c % 5).alias("base"), (F.crc32(c.cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    there = sizes.select(c.alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(there, "base", "left").select("*", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    heads = turns.filter(F.col("place") < MOST_SHARED).select(c.alias("base"), "place", "mark", "bytes")
    lent = ids.join(heads, "base").filter(F.col("place") < F.col("h")).select("conv_id", "place", "mark", "bytes")
    own = spread_join(turns, ids.select("conv_id", "h", "taken"), ["conv_id"], by="place").filter(F.col("place") >= F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "mark", "bytes")
    return lent.union(own), ids.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _number(word: Column, part: int) -> Column:
    """One of the two numbers below 2^60 of an MD5 in hexadecimal."""
    return F.conv(F.substring(word, 1 + 15 * part, 15), 16, 10).cast("decimal(20,0)")


def _leading(turns: Column, t: Column) -> Column:
    """MD5 of the marks of the first t turns of a block."""
    return F.md5(F.array_join(F.transform(F.slice(turns, F.lit(1), t), lambda x: x["mark"]), "").cast("binary"))


def _key(depth: Column, j: Column, content: Column | None = None) -> Column:
    """Key of the node at a depth: its depth and the digest before block j with the block's leading content added."""
    sums = [F.col("pre0").cast("decimal(38,0)"), F.col("pre1").cast("decimal(38,0)")]
    if content is not None:
        word = F.md5(F.concat_ws(":", j, content).cast("binary"))
        sums = [(s + _number(word, k)).cast("decimal(38,0)") for k, s in enumerate(sums)]
    return F.concat_ws(":", depth.cast("string"), *(s.cast("string") for s in sums))


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of turns (conv_id, place, mark, bytes) over conversations (conv_id, length).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    with scratch() as lasting:
        cut = turns.groupBy("conv_id", F.floor(F.col("place") / block).cast("long").alias("j")).agg(
            F.sort_array(F.collect_list(F.struct("place", "mark", "bytes"))).alias("turns")
        )
        cut = cut.withColumn("content", _leading(F.col("turns"), F.size("turns")))
        word = F.md5(F.concat_ws(":", "j", "content").cast("binary"))
        drawn = written(cut.select("*", _number(word, 0).alias("x0"), _number(word, 1).alias("x1")), "blocks")
        slim = drawn.select("conv_id", "j", "x0", "x1")
        placed = running(slim, "conv_id", "j", {"pre0": "x0", "pre1": "x1"}).drop("x0", "x1")
        blocks = written(drawn.drop("x0", "x1").join(placed, ["conv_id", "j"]), "placed")

        # by blocks first: what follows on each digest, one representative a group
        same = ["j", "pre0", "pre1", "content"]
        kinds = written(blocks.groupBy(*same).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.first("turns").alias("turns")), "kinds")
        several = kinds.groupBy("j", "pre0", "pre1").agg(F.count("*").alias("siblings")).filter("siblings > 1")
        marked = spread_join(kinds, several, ["j", "pre0", "pre1"], by="content", how="left")
        # then by turns
        t = F.col("i") + 1
        depth = F.col("j") * block + t
        inner = marked.select("*", F.posexplode("turns").alias("i", "turn")).select(
            *same,
            "n_convs",
            "owner",
            F.col("siblings").isNotNull().alias("diverge"),
            depth.alias("depth"),
            F.col("turn.bytes").alias("bytes"),
            _key(depth, F.col("j"), _leading(F.col("turns"), t)).alias("key"),
            F.when(t == 1, _key(depth - 1, F.col("j"))).otherwise(_key(depth - 1, F.col("j"), _leading(F.col("turns"), t - 1))).alias("parent"),
        )
        inner = written(inner, "inner")
        alone = inner.filter(~F.col("diverge")).select("key", "parent", "depth", "bytes", "n_convs", "owner")
        refined = inner.filter("diverge").groupBy("key", "parent", "depth", "bytes").agg(F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"))
        root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0")
        none = F.lit(None).cast("string")
        root = root.select(F.lit(ROOT).alias("key"), none.alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "n_convs", "owner")
        found = written(alone.union(refined.select(*alone.columns)).union(root), "found")

        children = found.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
        n_children = F.coalesce("n_children", F.lit(0).cast("long"))
        nodes = found.join(children, "key", "left").select(
            *found.columns, n_children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (n_children == 0).cast("long").alias("leaf")
        )
        nodes = written(nodes, "nodes")

        # what a conversation owns, summed over members, less what is owned above
        owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved_all"), F.sum("leaf").alias("leaf_all"))
        owned = written(owned, "owned")
        shares = spread_join(blocks.select("conv_id", *same), owned, ["conv_id"], by="j").groupBy(*same).agg(F.sum("saved_all").alias("saved_all"), F.sum("leaf_all").alias("leaf_all"))
        held = inner.select(*same, "key", "diverge").join(shares, same)
        within = held.filter(~F.col("diverge")).select("key", "saved_all", "leaf_all")
        meet = held.filter("diverge").groupBy("key").agg(F.sum("saved_all").alias("saved_all"), F.sum("leaf_all").alias("leaf_all"))
        top = owned.agg(F.sum("saved_all").alias("saved_all"), F.sum("leaf_all").alias("leaf_all")).select(F.lit(ROOT).alias("key"), "saved_all", "leaf_all")
        below = within.union(meet).union(top)
        above = running(nodes.select("key", "owner", "depth", "saved", "leaf"), "owner", "depth", {"saved_above": "saved", "leaf_above": "leaf"})
        sums = above.select("key", "saved_above", "leaf_above").join(below, "key").select(
            "key", (F.col("saved_all") - F.col("saved_above")).alias("saved_tokens"), (F.col("leaf_all") - F.col("leaf_above")).alias("n_leaves")
        )

        # members that end at a node
        last = F.floor((F.col("length") - 1) / block).cast("long")
        final = conversations.filter("length > 0").select("conv_id", "length", last.alias("j"))
        ends = blocks.join(final, ["conv_id", "j"]).select(_key(F.col("length"), F.col("j"), F.col("content")).alias("key"), "conv_id")
        ends = ends.union(conversations.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
        pieces = written(runs(ends, "key", ["conv_id"], size=1024), "ends")
        listed = pieces.select("key", "run", "seq", F.array_join(F.transform("items", lambda x: x["conv_id"].cast("string")), ",").alias("ids"))
        hashes = joined_digests(listed, "key", "ids", ",")

        parents = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"))
        linked = spread_join(nodes, parents, ["parent"], by="key", how="left")
        out = linked.join(sums, "key").join(hashes, "key", "left").select(
            F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
        return lasting(out, "trie")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    with scratch() as lasting:
        turns, convs = rebuilt(written(numbered_turns(conversations), "turns"))
        return lasting(trie(written(turns, "rebuilt"), written(convs, "convs"), block), "trie")
