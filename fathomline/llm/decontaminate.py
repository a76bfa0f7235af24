"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Windows of 10 words of the test items (an item of fewer words is one window)
become a set of 64-bit keys, each a hash of all the window's words. The set is broadcast as the hashed side of a join; every token window of
every document streams past it, and of those found the words are compared with
the windows themselves, so hits are verified exactly.

Scale: windows of documents are never shuffled, hits are. Up to `FEW_KEYS` keys are also
tested inside the scan, where only windows that hit become rows; the result is the same without. Hits of one text are
gathered under the MD5 of the text, so equal texts count once and a task that
is repeated gives the same rows. The set is broadcast in pieces of at most
`MAX_KEYS` keys (some 50 MB), one scan of the documents for each; texts of
windows and results are broadcast up to `MAX_BYTES`, counted before, and joined
with hot keys split beyond that. All ways give the same result. A document
costs memory by its own length.

Defined cases: null and empty texts have no words and no hits; items without
words have no windows; very long texts are scanned whole; repeated documents are judged row by row; an item found
in several places counts once; empty tables give empty results. Result columns
replace columns of the same name in the input, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, scratch, spread_join

#: Characters between words: ASCII other than letters and digits. Texts are split before A-Z become a-z, so both cases count.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Keys in a broadcast set.
MAX_KEYS = 1_000_000
#: Keys that also go into the plan as a hash set, which tasks test before they make a row of a window.
FEW_KEYS = 16_384
#: Bytes of another table that is broadcast.
MAX_BYTES = 32 << 20


def item_words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != ""), ascii_lower
    )


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_key(hashes: Column, start: Column, n: Column | int) -> Column:
    """Key of the n words from the 1-based start: a hash of the hashes of all of them, as in `_windows_of`."""
    return F.xxhash64(F.slice(hashes, start, n))


def window_text(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def item_windows(items: DataFrame, id_col: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(n, window, key, item_ids): the distinct windows of all items and the items that hold each."""
    sized = items.select(F.col(id_col).alias("item_id"), item_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    one = sized.select(
        "item_id",
        "w",
        F.least(F.size("w"), F.lit(n)).alias("n"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))).alias("at"),
    )
    key = window_key(word_hashes(F.col("w")), F.col("at"), F.col("n"))
    return (
        one.select("item_id", "n", window_text(F.col("w"), F.col("at"), F.col("n")).alias("window"), key.alias("key"))
        .groupBy("n", "window", "key")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    )


def _windows_of(n: int, known: list[int] | None) -> str:
    """SQL of the structs (at, n, key) of the windows of n words of column h, their hashes; only of those with a known key, if keys are given."""
    found = f"sequence(1, greatest(size(h) - {n - 1}, 1))"
    if known is not None:
        found = f"filter({found}, i -> xxhash64(slice(h, i, {n})) IN ({', '.join(f'{k}L' for k in known)}))"
    made = f"transform({found}, i -> struct(i AS at, {n} AS n, xxhash64(slice(h, i, {n})) AS key))"
    return f"if(size(h) >= {n}, {made}, CAST(array() AS array<struct<at: int, n: int, key: bigint>>))"


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def find_hits(docs: DataFrame, windows: DataFrame, text: str, max_keys: int, few_keys: int = FEW_KEYS) -> DataFrame:
    """(text_key, at, n, window, key) of the windows of docs whose keys are in the set; windows: (n, key)."""
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # at most WINDOW rows
    keys = windows.select(F.col("key").alias("known")).distinct()
    n_keys = keys.count()
    passes = max(1, -(-n_keys // max_keys))
    # a small set is a hash set in the plan, so windows that miss it never become rows
    known = [r["known"] for r in keys.collect()] if 0 < n_keys <= few_keys else None
    scanned = docs.select(_text_key(text).alias("text_key"), item_words(F.col(text)).alias("w"))
    hashed = scanned.withColumn("h", word_hashes(F.col("w")))
    streamed = hashed.select("text_key", "w", F.explode(F.concat(*(F.expr(_windows_of(k, known)) for k in sorted(sizes)))).alias("f")) if sizes else None
    found = None
    for k in range(passes if sizes else 0):
        some = keys.filter(F.pmod(F.xxhash64("known"), F.lit(passes)) == k) if passes > 1 else keys
        hits = streamed.join(F.broadcast(some), F.col("f.key") == F.col("known")).select(
            "text_key", "f.at", "f.n", window_text(F.col("w"), F.col("f.at"), F.col("f.n")).alias("window"), "f.key"
        )
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "text_key string, at int, n int, window string, key bigint")
    return found


def _bytes(rows: DataFrame, size: Column) -> int:
    return rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).head()["b"]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    max_keys: int = MAX_KEYS,
    max_bytes: int = MAX_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_hit, n_items, item_ids (sorted as strings), hit_spans and contaminated.

    hit_spans: sorted disjoint (first, last) 1-based word positions inside windows that occur.
    """
    made = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")
    rest = [c for c in keep or docs.columns if c not in made]
    ids = F.aggregate("item_ids", F.lit(0).cast("long"), lambda a, x: a + 16 + F.octet_length(x))
    with scratch() as lasting:
        windows = lasting(item_windows(items, item_id, item_text, n), "windows")
        hits = lasting(find_hits(docs, windows, text, max_keys), "hits")
        # verification: the words themselves
        if _bytes(windows, F.octet_length("window") + ids + 40) <= max_bytes:
            known = F.broadcast(windows.select("key", "window", "item_ids"))
            verified = hits.join(known, ["key", "window"])
        else:
            verified = spread_join(hits, windows.select("key", "window", "item_ids"), ["key", "window"], by="text_key")
        per_text = verified.groupBy("text_key").agg(
            F.collect_set(F.struct("at", "n")).alias("spots"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        )
        covered = F.array_sort(
            F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
        )

        def spans(pos: Column) -> Column:
            first = F.filter(pos, lambda p, i: (i == 0) | (F.get(pos, i - 1) != p - 1))
            last = F.filter(pos, lambda p, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) != p + 1))
            return F.struct(
                F.size(pos).cast("long").alias("n_hit"),
                F.transform(F.arrays_zip(first.alias("first"), last.alias("last")), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("hit_spans"),
            )

        found = lasting(
            per_text.select("text_key", F.struct("item_ids", let(covered, spans).alias("c")).alias("found")).withColumnRenamed("text_key", "_text_key"),
            "found",
        )
    own = [] if text in rest else [F.col(text).alias("_text")]
    placed = docs.select(F.struct(*rest).alias("row"), *own, _text_key(text).alias("_text_key"), F.monotonically_increasing_id().alias("_place"))
    whole = F.col("row")[text] if text in rest else F.col("_text")
    # counted last: a filter on the result counts the words of what it keeps
    n_words = F.regexp_count(F.coalesce(whole, F.lit("")), F.lit(WORD)).cast("long")
    size = 64 + 8 * F.size("found.c.hit_spans") + F.aggregate("found.item_ids", F.lit(0).cast("long"), lambda a, x: a + 16 + F.octet_length(x))
    if _bytes(found, size) <= max_bytes:
        judged = placed.join(F.broadcast(found), "_text_key", "left")
    else:
        judged = spread_join(placed, found, ["_text_key"], by="_place", how="left")
    n_hit = F.coalesce(F.col("found.c.n_hit"), F.lit(0).cast("long"))
    item_ids = F.coalesce(F.col("found.item_ids"), F.array().cast("array<string>"))
    return judged.select(
        *(F.col("row")[c].alias(c) for c in rest),
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"),
        F.coalesce(F.col("found.c.hit_spans"), F.array().cast("array<struct<first:int,last:int>>")).alias("hit_spans"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the given spans (sorted, disjoint) and what stands between them; linear in the text."""
    pieces = F.regexp_extract_all(text, F.lit(WORD + "|" + NOT_WORD), F.lit(0))

    def cut(ps: Column) -> Column:
        # pieces alternate, so word k is piece 2k-1, or 2k after a leading gap (1-based)
        lead = F.when(F.get(ps, F.lit(0)).rlike("^" + NOT_WORD), 1).otherwise(0)
        begin = lambda k: F.when(k == 0, F.lit(1)).otherwise(2 * F.get(spans, k - 1)["last"] + lead)
        end = lambda k: F.when(k == F.size(spans), F.size(ps)).otherwise(2 * F.get(spans, k)["first"] - 2 + lead)
        kept = F.transform(
            F.sequence(F.lit(0), F.size(spans)), lambda k: F.array_join(F.slice(ps, begin(k), F.greatest(end(k) - begin(k) + 1, F.lit(0))), "")
        )
        return F.array_join(kept, "")

    return F.when(F.size(spans) > 0, let(pieces, cut)).otherwise(text)
