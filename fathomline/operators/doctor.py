"""Facts for reports on a repository: routes, tables, queues, settings, schedules and clients, one pass over all lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Facts of `kind`; name and at most one of operation and detail are groups of the pattern, the rest are fixed texts.

    words: a match holds one of them in lower case, so that lines without any aren't searched.
    """

    kind: str
    words: tuple[str, ...]
    pattern: str
    operation: int | str
    name: int
    detail: int | str = ""


# How the facts are written in source code.
RULES = (
    Rule("api", ("app.", "router.", "server.", "fastify."), r"\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|all)\(\s*['\"`](/[^'\"`]*)", 1, 2),
    Rule("api", ("@get(", "@post(", "@put(", "@patch(", "@delete("), r"@(Get|Post|Put|Patch|Delete)\(\s*['\"`]([^'\"`]*)", 1, 2),
    Rule("api", ("http.handlefunc(",), r"http\.HandleFunc\(\s*['\"`](/[^'\"`]*)", "any", 1),
    Rule("database", ("select",), r"(?i)\bselect\b.*?\bfrom\s+([a-z_][a-z0-9_]*)", "select", 1),
    Rule("database", ("join",), r"(?i)\bjoin\s+([a-z_][a-z0-9_]*)", "select", 1),
    Rule("database", ("insert",), r"(?i)\binsert\s+into\s+([a-z_][a-z0-9_]*)", "insert", 1),
    Rule("database", ("update",), r"(?i)\bupdate\s+([a-z_][a-z0-9_]*)\s+set\b", "update", 1),
    Rule("database", ("delete",), r"(?i)\bdelete\s+from\s+([a-z_][a-z0-9_]*)", "delete", 1),
    Rule("database", ("create",), r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([a-z_][a-z0-9_]*)", "create", 1),
    Rule("database", ("db::table(",), r"\bDB::table\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)", "query", 1),
    Rule("rabbitmq", (".assertqueue(", ".sendtoqueue(", ".consume("), r"\.(assertQueue|sendToQueue|consume)\(\s*['\"`]([^'\"`]+)", 1, 2, "queue"),
    Rule("rabbitmq", (".queuedeclare(",), r"\.(QueueDeclare)\(\s*['\"`]([^'\"`]+)", 1, 2, "queue"),
    Rule("rabbitmq", (".assertexchange(", ".publish("), r"\.(assertExchange|publish)\(\s*['\"`]([^'\"`]+)", 1, 2, "exchange"),
    Rule("env", ("process.env.",), r"\bprocess\.env\.([A-Z_][A-Z0-9_]*)", "read", 1),
    Rule("env", ("process.env[",), r"\bprocess\.env\[\s*['\"]([A-Z_][A-Z0-9_]*)", "read", 1),
    Rule("env", ("getenv(",), r"\b(?:os\.Getenv|getenv)\(\s*['\"]([A-Z_][A-Z0-9_]*)", "read", 1),
    Rule("config", ("process.env.",), r"\bprocess\.env\.([A-Z_][A-Z0-9_]*)\s*(?:\|\||\?\?)\s*['\"`]?([^'\"`;,)\s]+)", "default", 1, 2),
    Rule("cron", ("cron.schedule(",), r"\bcron\.schedule\(\s*['\"`]([^'\"`]+)", "node-cron", 1),
    Rule("cron", ("@cron(",), r"@Cron\(\s*['\"`]([^'\"`]+)", "decorator", 1),
    Rule("cron", ("@cron(",), r"@Cron\(\s*CronExpression\.([A-Z0-9_]+)", "decorator", 1),
    Rule("cron", ("setinterval(",), r"\bsetInterval\([^,]+,\s*([0-9]+)", "interval", 1),
    Rule("http", ("axios.",), r"\baxios\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)", 1, 2, "axios"),
    Rule("http", ("fetch(",), r"\bfetch\(\s*['\"`]([^'\"`]+)", "get", 1, "fetch"),
    Rule("http", ("got",), r"\bgot(?:\.(?:get|post))?\(\s*['\"`]([^'\"`]+)", "get", 1, "got"),
    Rule("http", ("httpservice.",), r"\bhttpService\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)", 1, 2, "httpService"),
    Rule("http", ("curl_init(",), r"\bcurl_init\(\s*['\"]([^'\"]+)", "get", 1, "curl"),
)
#: Words that follow a keyword of SQL without naming a table.
NOT_TABLES = ("select", "where", "set", "values", "the", "a", "an", "this")
#: Settings whose defaults are rules of the business.
BUSINESS = r"(?i)LIMIT|MAX|MIN|RATE|FEE|PERCENT|TIMEOUT|RETRY|AMOUNT"
COMMENT = r"^\s*(?://|#|\*|--|/\*)"
#: An object route's method holds for a url within so many lines.
REACH = 10


def _holds(low: Column, rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in dict.fromkeys(w for r in rules for w in r.words)))


def _found(line: Column, rule: Rule) -> Column:
    every = lambda group: F.regexp_extract_all(line, F.lit(rule.pattern), F.lit(group))

    def row(name: Column, operation: Column, detail: Column) -> Column:
        return F.struct(F.lit(rule.kind).alias("kind"), F.lower(operation).alias("operation"), name.alias("name"), detail.alias("detail"))

    if isinstance(rule.operation, int):
        return F.zip_with(every(rule.name), every(rule.operation), lambda n, o: row(n, o, F.lit(rule.detail)))
    if isinstance(rule.detail, int):
        return F.zip_with(every(rule.name), every(rule.detail), lambda n, d: row(n, F.lit(rule.operation), d))
    return F.transform(every(rule.name), lambda n: row(n, F.lit(rule.operation), F.lit(rule.detail)))


def doctor_facts(files: DataFrame, keys: list[str], content: str = "content", kinds: tuple[str, ...] = ()) -> DataFrame:
    """(keys, line, kind, operation, name, detail); detail: the client, queue or exchange, or a setting's default; of some kinds, or all.

    Tables in comment lines don't count. In route objects a url takes the last method named within REACH lines above it,
    once. `${...}` in a client's address becomes `*`.
    """
    lines = files.select(*keys, F.posexplode(F.split(content, "\n")).alias("line", "x")).withColumn("line", F.col("line") + 1)
    rules = tuple(r for r in RULES if r.kind in kinds or not kinds)
    tried = F.array(*(F.when(_holds(F.col("low"), (r,)), _found(F.col("x"), r)) for r in rules))
    plain = (
        lines.withColumn("low", F.lower("x"))
        .filter(_holds(F.col("low"), rules))
        .select(*keys, "line", "x", F.explode(F.flatten(F.array_compact(tried))).alias("f"))
        .select(*keys, "line", "x", "f.*")
        .filter((F.col("kind") != "database") | (~F.col("x").rlike(COMMENT) & ~F.lower("name").isin(*NOT_TABLES)))
        .withColumn("name", F.when(F.col("kind") == "http", F.regexp_replace("name", r"\$\{[^}]*\}", "*")).otherwise(F.col("name")))
        .drop("x")
    )
    if kinds and "api" not in kinds:
        return plain.distinct()
    marked = lines.filter(F.contains("x", F.lit("method")) | F.contains("x", F.lit("url"))).select(
        *keys,
        "line",
        F.regexp_extract("x", r"\bmethod\s*:\s*\[?\s*['\"`]([A-Za-z]+)", 1).alias("method"),
        F.regexp_extract("x", r"\burl\s*:\s*['\"`](/[^'\"`]*)", 1).alias("url"),
    ).filter("method <> '' OR url <> ''")
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("method") != "", F.struct("line", "method"))
    objects = (
        marked.withColumn("m", F.last(named, ignorenulls=True).over(before))
        .withColumn("used", F.max(F.when(F.col("url") != "", F.col("line"))).over(earlier))
        .filter((F.col("url") != "") & (F.col("line") - F.col("m.line") <= REACH) & (F.coalesce(F.col("used"), F.lit(0)) < F.col("m.line")))
        .select(*keys, "line", F.lit("api").alias("kind"), F.lower("m.method").alias("operation"), F.col("url").alias("name"), F.lit("").alias("detail"))
    )
    return plain.union(objects).distinct()


def listed(rows: DataFrame, key: str, order: list[str], line: Column, title: Column) -> DataFrame:
    """(key, report): Markdown with the title and one line a row, in order."""
    items = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("item")))).alias("items"))
    return items.select(key, F.concat(title, F.lit("\n\n"), F.array_join("items.item", "\n")).alias("report"))
