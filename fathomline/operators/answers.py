"""Parameterised evidence queries: each filters, scores and formats rows instead of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def route_object(text: Column) -> Column:
    """method, alias, url and handler of a `{method: ['GET'], alias: '..', url: '..', handler: '..'}` object."""
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"{name}:\s*{value}", 1), F.lit("")).alias(name)
    return F.struct(field("method", r"\[?['\"]([A-Z]+)['\"]"), field("alias", r"['\"]([^'\"]*)['\"]"), field("url", r"['\"]([^'\"]*)['\"]"), field("handler", r"['\"]?([A-Za-z_.]+)"))


def resolve_path(base: Column, relative: Column) -> Column:
    """A relative path against a file's folder, with `.` and `..` taken away; `..` above the root is dropped."""
    folder = F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1)
    parts = F.concat(folder, F.split(relative, "/"))
    empty = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(walked, "/")


def resolve_constants(constants: DataFrame, keys: list[str]) -> DataFrame:
    """Constants (name, base, suffix) with the texts of their bases put in, base by base; a cycle or an unknown base stays null.

    Chains of any length: each round puts the base's own base and text in place of the base, so what is left of a chain
    halves; rounds end when no constant has a base that can still be put in. Only that count comes to the driver.
    """
    now = constants.select(*keys, "name", "base", F.col("suffix").alias("value"), F.lit(1).cast("long").alias("steps"))
    size = constants.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0
    while True:
        into = now.select(*keys, F.col("name").alias("base"), F.col("base").alias("_base"), F.col("value").alias("_value"), F.col("steps").alias("_steps"))
        met = now.join(into, [*keys, "base"], "left")
        found = F.col("_value").isNotNull()
        now = checkpointed(
            met.select(
                *keys,
                "name",
                F.when(found, F.col("_base")).otherwise(F.col("base")).alias("base"),
                F.when(found, F.concat("_value", "value")).otherwise(F.col("value")).alias("value"),
                F.when(found, F.col("steps") + F.col("_steps")).otherwise(F.col("steps")).alias("steps"),
            )
        )
        # a chain of more steps than there are constants goes in a circle
        now = now.withColumn("value", F.when(F.col("steps") <= size, F.col("value"))).filter(F.col("value").isNotNull())
        waiting = now.filter("base IS NOT NULL").select(*keys, F.col("base").alias("name"))
        if not waiting.join(now.select(*keys, "name"), [*keys, "name"], "left_semi").limit(1).count():
            break
    return constants.select(*keys, "name").join(now.filter("base IS NULL").select(*keys, "name", "value"), [*keys, "name"], "left")


def object_blocks(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Outermost brace blocks of line tables: start_line, end_line, depth reached; blocks left open end with the file."""
    w = Window.partitionBy(*keys).orderBy("line")
    step = F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}"))
    deep = numbered.withColumn("_d", F.sum(step).over(w)).withColumn("_b", F.coalesce(F.lag("_d").over(w), F.lit(0)))
    begun = deep.withColumn("_g", F.sum(F.when((F.col("_b") <= 0) & F.col("text").contains("{"), 1).otherwise(0)).over(w))
    inside = begun.filter(((F.col("_b") > 0) | F.col("text").contains("{")) & (F.col("_g") > 0))
    return inside.groupBy(*keys, "_g").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.max("_d").alias("depth")).drop("_g")


def begins_json_key(text: Column) -> Column:
    """Whether a line of JSON, indented by two, begins a top-level key."""
    return text.rlike(r'^ {2}"[^"]+":')


#: What a method does, by patterns on its text (fixed values).
TRAITS = (
    ("reads", r"(?i)select\s"), ("writes", r"(?i)(insert\s|update\s|delete\s)"), ("publishes", r"sendToQueue|\.publish\("), ("calls_http", r"axios\.|fetch\("),
    ("calls_rpc", r"rpc\.call"), ("configured", r"process\.env"), ("returns", r"return\s"), ("throws", r"throw\s"),
)


def traits(text: Column) -> Column:
    """Names of the traits that a method's text shows, in the table's order."""
    return F.array_compact(F.array(*(F.when(text.rlike(regex), name) for name, regex in TRAITS)))


def matched_by_group(rows: DataFrame, group: str, condition: Column, sample: str, most: int = 8) -> DataFrame:
    """Rows and matches of every group, groups without a match too, with the first samples by order."""
    w = Window.partitionBy(group).orderBy(F.when(F.col("_m"), 0).otherwise(1), sample)
    marked = rows.withColumn("_m", condition).withColumn("_k", F.row_number().over(w))
    return marked.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if("_m").alias("matched"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_m") & (F.col("_k") <= most), F.col(sample)))), ",").alias("samples")
    )


def term_score(text: Column, terms: Column, each: int, all_: int, path: int = 0) -> Column:
    """`each` for every term that the text holds (`path` for terms with a slash), `all_` more if it holds all."""
    worth = lambda t: F.when(t.contains("/") & F.lit(path > 0), path).otherwise(each)
    total = F.aggregate(terms, F.lit(0), lambda s, t: s + F.when((t != "") & text.contains(t), worth(t)).otherwise(0))
    return total + F.when((F.size(terms) > 0) & F.forall(terms, lambda t: (t != "") & text.contains(t)), all_).otherwise(0)
