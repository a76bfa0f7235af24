"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that
speaker as `assistant`, all others as named users, and a loss mask over the
speaker's own text. System turns stay system turns and are never masked in.

A rendering comes in numbered parts of `BLOCK` consecutive turn numbers; the
parts in order are the whole dialogue, and masks are offsets in the whole
dialogue's rendering, so a part needs no other to be placed. A conversation that
holds a third of all rows is thus spread over many groups of bounded size. A part
with more than `4 * BLOCK` turns, as numbers may repeat or be missing, is
divided further by number, copies of the same turn and a hash of the turn.

Texts are shuffled once. Offsets are running sums over a table of part sizes
(three numbers a part and participant, no text), over spans of parts, parts and
what crowded parts were divided into where a dialogue has many. Parts meet their
participants by a join that splits parts with very many of them; views are never collected.

Defined cases: null text is empty; a null role is the speaker `unknown`; turns
without a number come first; turns with the same number are ordered by the MD5
of role, U+0001 and text, in a divided part after blocks of 64 copies of one
turn; repeated rows are all kept; rows without a conv_id are one conversation; a
dialogue with only system turns has no participant and no rendering; a very long
text stays whole in its part; markers can't be forged, as `<|` becomes `< |` in
texts and names and a line end in a name becomes a space; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT, hot_keys, spread_join

BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PLACE = ["part", "t", "chunk", "sub"]


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(speaker: Column, me: Column) -> Column:
    name = F.translate(_safe(speaker), "\r\n", "  ")
    return (
        F.when(speaker == "system", F.lit(OPEN + "system\n"))
        .when(speaker == me, F.lit(OPEN + "assistant\n"))
        .otherwise(F.concat(F.lit(OPEN + "user name="), name, F.lit("\n")))
    )


def _dealt(said: DataFrame, block: int) -> DataFrame:
    """said with the place of each turn (PLACE) and its number of copies; only turns of crowded parts are divided."""
    crowded, bound = hot_keys(said, ["conv_id", "part"], least=4 * block)
    mark = F.md5(F.concat_ws("\u0001", "speaker", "text").cast("binary")).alias("mark")
    plain = said.select(
        "conv_id", "part", F.lit(None).cast(said.schema["turn"].dataType).alias("t"), F.lit(0).cast("long").alias("chunk"),
        F.lit(0).cast("long").alias("sub"), "turn", "speaker", "text", mark, F.lit(1).cast("long").alias("copies"),
    )
    if not bound:
        return plain
    crowded = F.broadcast(crowded.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "n"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("part").eqNullSafe(F.col("_p"))
    rest = plain.join(crowded, same, "left_anti")
    n = F.col("m")
    divided = (
        said.join(crowded, same)
        .groupBy("conv_id", "part", "turn", "speaker", "text", "n")
        .agg(F.count("*").alias("m"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias("chunk"))
        .select("*", mark, F.least(F.lit(block), n - F.col("chunk") * block).cast("long").alias("copies"))
    )
    share = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(1 << 32)
    sub = F.floor(share * F.ceil(F.col("n") / block)).cast("long").alias("sub")
    return rest.union(divided.select("conv_id", "part", F.col("turn").alias("t"), "chunk", sub, "turn", "speaker", "text", "mark", "copies"))


def _offsets(sized: DataFrame, most: int = HOT, span: int = 256) -> DataFrame:
    """sized with number and start: how many parts, and characters, a participant's dialogue has before a part.

    Sums in a window of a dialogue's parts; if some dialogue has more than `most`, sums over `span` parts first, then over
    the parts of a span, then over what a crowded part was divided into, so no window holds a whole dialogue.
    """
    keys, sums = ["conv_id", "perspective"], ("number", "start")
    counted = sized.withColumns({"_number": F.lit(1).cast("long"), "_start": F.col("n_chars")})
    upto = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    if not hot_keys(sized, keys, least=most)[1]:
        own = {c: F.coalesce(F.sum(f"_{c}").over(upto(keys, PLACE)), zero) for c in sums}
        return counted.withColumns(own).drop("_number", "_start")
    levels = {"_l0": [F.floor(F.col("part") / span)], "_l1": [F.col("part")], "_l2": [F.col("t"), F.col("chunk"), F.floor(F.col("sub") / span)]}
    rows = counted.withColumns({k: F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cs))) for k, cs in levels.items()})
    names = list(levels)
    for k, level in enumerate(names):
        above, here = [*keys, *names[:k]], [*keys, *names[: k + 1]]
        totals = rows.groupBy(*here).agg(*(F.sum(f"_{c}").alias(f"_s_{c}") for c in sums))
        before = totals.select(*here, *(F.coalesce(F.sum(f"_s_{c}").over(upto(above, [level])), zero).alias(f"_{level}_{c}") for c in sums))
        rows = spread_join(rows, before, here, by="sub")
    last = {c: F.coalesce(F.sum(f"_{c}").over(upto([*keys, *names], PLACE)), zero) for c in sums}
    total = {c: sum((F.col(f"_{level}_{c}") for level in names), last[c]) for c in sums}
    return rows.select(*sized.columns, *(total[c].alias(c) for c in sums))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_trained, start, n_chars, text, mask): one row per dialogue, participant and part.

    start: offset of the part in the dialogue's rendering; mask: (start, end) offsets in code points of the
    dialogue's rendering, end exclusive, in order.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.floor(F.col(turn) / block).alias("part"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    people = said.filter(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    one = F.struct("turn", "chunk", "mark", "speaker", "text", "copies")
    parts = _dealt(said, block).groupBy("conv_id", *PLACE).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    # offsets: what a part takes if nobody in it is the assistant, and what each speaker's turns take less
    def size(t: Column, me: Column) -> Column:
        return t["copies"] * (F.length(_head(t["speaker"], me)) + F.length(_safe(t["text"])) + len(CLOSE))

    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    nobody = F.lit(None).cast("string")
    slim = parts.select("conv_id", *PLACE, F.xxhash64(*PLACE).alias("place"), total(F.transform("turns", lambda t: size(t, nobody))).alias("size"),
        F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["copies"].alias("copies"))).alias("speakers"),
    )
    less = len(OPEN + "assistant\n") - F.length(_head(F.col("perspective"), nobody))
    own = total(F.transform(F.filter("speakers", lambda s: s["speaker"] == F.col("perspective")), lambda s: s["copies"]))
    sized = spread_join(slim, people, ["conv_id"], by="place").select("conv_id", *PLACE, "perspective", (F.col("size") + less * own).alias("n_chars"))
    placed = _offsets(sized).select("conv_id", *PLACE, "perspective", F.struct("perspective", "number", "start", "n_chars").alias("view"))
    # a part's text meets its participants' views; a part with very many of them is copied to several tasks
    seen = spread_join(placed, parts, ["conv_id", *PLACE], by="perspective").select("conv_id", "turns", "view")

    me = F.col("view.perspective")
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array_repeat(
                F.struct(_head(t["speaker"], me).alias("head"), _safe(t["text"]).alias("body"), ((t["speaker"] == me) & (t["speaker"] != "system")).alias("trained")),
                t["copies"].cast("int"),
            ),
        )
    )
    cut = seen.select("conv_id", "view", pieces.alias("pieces"))
    cut = cut.withColumn("sizes", F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("long")))
    until = lambda i: F.col("view.start") + total(F.slice("sizes", 1, i))
    spans = F.filter(
        F.transform(
            "pieces",
            lambda p, i: F.struct((until(i) + F.length(p["head"])).alias("start"), (until(i + 1) - len(CLOSE)).alias("end"), p["trained"].alias("trained")),
        ),
        lambda s: s["trained"],
    )
    return cut.select(
        "conv_id",
        F.col("view.perspective").alias("perspective"),
        F.col("view.number").alias("part"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["trained"])).cast("long").alias("n_trained"),
        F.col("view.start").alias("start"),
        F.col("view.n_chars").alias("n_chars"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("mask"),
    )
