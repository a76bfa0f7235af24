"""URL filters as a sort-merge range join over canonical keys.

The canonical key of a rule is its host's labels in reverse order, each closed
by U+0001, then U+0002 and its path: `m.example.com` with `/en/` is
`com<1>example<1>m<1><2>/en/`. With U+0002 after the host a rule covers exactly
the keys that begin with its own, one interval, and intervals of two rules are
nested or disjoint. A URL is looked up once for each of the hosts that enclose
it and have rules, as `<that host><2><path>`.

The sweep runs over the sorted union of rules and URL keys. A rule opens with
the stack of the rules around it, so the stack at a URL key is the last one
opened, and the topmost rule on it that still covers the key is the best of its
host; the longest of all hosts wins.

Equal (host, path) pairs are looked up once. The sweep's buckets are hosts: a
host with more than `SHARE` keys is dealt over several buckets, each with a copy
of that host's rules only, so neither a hot host nor a list of any length ends
up in one task. No user function; only hosts too hot for a task are broadcast.

Defined cases: a null URL or one without `://` has an empty host and path and
matches nothing; a very long URL is a key like any other; of rules of one
length, which differ in where host and path meet, the one with the greater text wins, then the greater verdict;
repeated rows are judged alike; without rules all URLs get the
default verdict; an empty table gives an empty table. The four result columns
replace columns of the same name in the input, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, hot_keys, spread_join

END, PATH = "\u0001", "\u0002"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Keys of one host in a bucket of the sweep.
SHARE = 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL_PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by U+0001; empty for no host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))
    )


def enclosing(key: Column) -> Column:
    """The keys of a host key's own host and of all hosts around it."""
    labels = F.split(key, END)
    return F.when(key == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), END), F.lit(END)))
    )


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(host_key, path, stack): for each rule, the rules of its host whose paths begin its own, the longest last."""
    ranked = rules.select(host_key(ascii_lower(F.col("host"))).alias("host_key"), "path", "rule", "verdict")
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    one = ranked.groupBy("host_key", "path").agg(best)
    prefixes = one.select(
        "host_key", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left(F.col("path"), n))).alias("outer_path")
    )
    outer = one.select("host_key", F.col("path").alias("outer_path"), "best")
    return (
        prefixes.join(outer, ["host_key", "outer_path"])
        .groupBy("host_key", "path")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("outer_path").alias("size"), F.col("outer_path").alias("path"), "best"))).alias("stack"))
    )


def lookups(places: DataFrame, rules: DataFrame, share: int) -> DataFrame:
    """(host, path, best) of the distinct (host, path) that a rule covers."""
    stacks = rule_stacks(rules)
    probes = places.select("host", "path", F.explode(enclosing(host_key(F.col("host")))).alias("host_key"))
    probes = spread_join(probes, stacks.select("host_key").distinct(), ["host_key"], by="path", least=share)
    hot, bound = hot_keys(probes, ["host_key"], least=share)
    if bound:
        shares = F.broadcast(hot.select("host_key", F.ceil(F.col("n") / bound).alias("shares")))
        probes = probes.join(shares, "host_key", "left").withColumn("share", F.pmod(F.xxhash64("host", "path"), F.coalesce("shares", F.lit(1))))
        last = F.coalesce(F.col("shares"), F.lit(1)).cast("long") - 1
        stacks = stacks.join(shares, "host_key", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    else:
        probes, stacks = probes.withColumn("share", F.lit(0).cast("long")), stacks.withColumn("share", F.lit(0).cast("long"))
    key = F.concat("host_key", F.lit(PATH), "path").alias("key")
    union = (
        probes.select("host_key", "share", key, F.lit(1).alias("kind"), "host", "path")
        .unionByName(stacks.select("host_key", "share", key, F.lit(0).alias("kind"), "stack"), allowMissingColumns=True)
    )
    sweep = Window.partitionBy("host_key", "share").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = union.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter(F.col("kind") == 1)
    active = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    top = F.element_at(active, -1)["best"]
    return swept.filter(F.size(active) > 0).groupBy("host", "path").agg(F.max(top).alias("best"))


def url_filter(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", share: int = SHARE) -> DataFrame:
    """urls with host, path, rule and verdict. rules: (host, path, rule, verdict)."""
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    keyed = urls.select(F.struct(*rest).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = lookups(keyed.select("host", "path").distinct(), rules, share)
    # rows of one URL are dealt by their place in the input
    placed = keyed.withColumn("place", F.monotonically_increasing_id())
    return spread_join(placed, found, ["host", "path"], by="place", how="left", least=share).select(
        *(F.col("row")[c].alias(c) for c in rest),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
