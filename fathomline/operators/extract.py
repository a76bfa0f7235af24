"""Typed facts from source text by tables of line patterns: one pass, no user function."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A fact of `kind` and `operation`; the first group is its name, the second, if any, its detail.

    word: what a match holds in lower case, so that lines without it aren't searched; words: it holds one of these.
    """

    kind: str
    operation: str
    regex: str
    detail: bool = False
    word: str = ""
    words: tuple[str, ...] = ()


_QUOTED = r"""['"`]([^'"`]+)['"`]"""
_SQL_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"

ROUTES = (
    Pattern("route", "declare", rf"(?:app|router|server|fastify)\.(?:get|post|put|patch|delete)\(\s*['\"`](/[^'\"`]*)['\"`]", word="/"),
    Pattern("route", "decorate", r"@(?:Get|Post|Put|Patch|Delete)\(\s*['\"`](/[^'\"`]*)['\"`]", word="@"),
    Pattern("route", "handle", r"(?:http\.)?HandleFunc\(\s*\"(/[^\"]*)\"", word="handlefunc("),
    Pattern("route", "constant", r"const [A-Z_0-9]+ = ['\"](/[^'\"]*)['\"]", word="const "),
)
TABLES = (
    Pattern("table", "select", rf"(?i)from\s+{_SQL_NAME}", word="from"),
    Pattern("table", "join", rf"(?i)join\s+{_SQL_NAME}", word="join"),
    Pattern("table", "insert", rf"(?i)insert\s+into\s+{_SQL_NAME}", word="insert"),
    Pattern("table", "update", rf"(?i)update\s+{_SQL_NAME}\s+set", word="update"),
    Pattern("table", "create", rf"(?i)create\s+table\s+{_SQL_NAME}", word="create"),
    Pattern("table", "delete", rf"(?i)delete\s+from\s+{_SQL_NAME}", word="delete"),
)
MESSAGING = (
    Pattern("queue", "publish", rf"sendToQueue\(\s*{_QUOTED}", word="sendtoqueue("),
    Pattern("queue", "consume", rf"\.consume\(\s*{_QUOTED}", word=".consume("),
    Pattern("queue", "assert", rf"assertQueue\(\s*{_QUOTED}", word="assertqueue("),
    Pattern("exchange", "assert", rf"assertExchange\(\s*{_QUOTED}", word="assertexchange("),
    Pattern("exchange", "publish", rf"\.publish\(\s*{_QUOTED}", word=".publish("),
)
ENVIRONMENT = (
    Pattern("env", "read", r"process\.env\.([A-Z][A-Z0-9_]*)", word="process.env."),
    Pattern("env", "read", r"process\.env\[['\"]([A-Z][A-Z0-9_]*)['\"]\]", word="process.env["),
    Pattern("env", "read", r"(?:getenv|os\.Getenv)\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]", word="getenv("),
)
DEFAULTS = (Pattern("default", "config", r"process\.env\.([A-Z][A-Z0-9_]*)\s*(?:\|\||\?\?)\s*['\"]?([^'\";,)]+)", True, "process.env."),)
SCHEDULES = (
    Pattern("cron", "node-cron", rf"cron\.schedule\(\s*{_QUOTED}", word="cron.schedule("),
    Pattern("cron", "decorator", rf"@Cron\(\s*{_QUOTED}", word="@cron("),
    Pattern("cron", "interval", r"setInterval\(\s*([A-Za-z0-9_.]+)", word="setinterval("),
)
CALLS = (
    Pattern("http", "axios", rf"axios\.(?:get|post|put|patch|delete)\(\s*{_QUOTED}", word="axios."),
    Pattern("http", "fetch", rf"fetch\(\s*{_QUOTED}", word="fetch("),
    Pattern("rpc", "call", rf"rpc\.call\(\s*{_QUOTED}", word="rpc.call("),
)
SYMBOLS = (
    Pattern("symbol", "function", r"(?:^|[^A-Za-z0-9_])(?:function|func)\s+([A-Za-z_][A-Za-z0-9_]*)", word="func"),
    Pattern("symbol", "class", r"(?:^|[^A-Za-z0-9_])(?:class|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", words=("class", "struct", "interface")),
    Pattern("symbol", "constant", r"(?:^|[^A-Za-z0-9_])const ([A-Z][A-Z0-9_]+)", word="const "),
)
ALL = ROUTES + TABLES + MESSAGING + ENVIRONMENT + DEFAULTS + SCHEDULES + CALLS + SYMBOLS

#: Words that follow `from` and the like without naming a table (fixed values).
STOP_NAMES = ("select", "where", "set", "the", "a", "an", "this", "values", "into", "table", "if", "not", "exists")


def _row(rank: int, p: Pattern):
    return lambda name, detail: F.struct(
        F.lit(rank).alias("rank"), F.lit(p.kind).alias("kind"), F.lit(p.operation).alias("operation"), name.alias("name"), F.trim(detail).alias("detail")
    )


def facts(files: DataFrame, patterns: tuple[Pattern, ...] = ALL, content: str = "content") -> DataFrame:
    """files without `content`, one row a match: line (1-based), rank of the pattern, kind, operation, name, detail."""

    def found(line: Column, low: Column) -> Column:
        out = []
        for k, p in enumerate(patterns):
            names, row = F.regexp_extract_all(line, F.lit(p.regex), F.lit(1)), _row(k, p)
            if p.detail:
                rows = F.zip_with(names, F.regexp_extract_all(line, F.lit(p.regex), F.lit(2)), row)
            else:
                rows = F.transform(names, lambda name: row(name, F.lit("")))  # noqa: B023
            words = (p.word,) if p.word else p.words
            out.append(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), rows) if words else rows)
        return F.flatten(F.array_compact(F.array(*out)))

    rest = [c for c in files.columns if c != content]
    lines = files.select(*rest, F.posexplode(F.split(content, "\n")).alias("line", "_text")).withColumn("_low", F.lower("_text"))
    return (
        lines.select(*rest, (F.col("line") + 1).alias("line"), F.explode(found(F.col("_text"), F.col("_low"))).alias("f"))
        .select(*rest, "line", "f.*")
        .filter((F.col("kind") != "table") | ~F.lower("name").isin(*STOP_NAMES))
    )


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; Spark limits the groups before its shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


#: Evidence labels in order: name, where it is looked for, pattern on lower-cased text.
EVIDENCE = (
    ("http_route", "content", r"(app|router)\.(get|post|put|delete)\("),
    ("database", "content", r"(select |insert into |update |delete from )"),
    ("message_queue", "content", r"(sendtoqueue|\.consume\(|assertqueue)"),
    ("cron_job", "content", r"(cron\.schedule|@cron|setinterval)"),
    ("env_config", "content", r"process\.env"),
    ("http_client", "content", r"(axios\.|fetch\()"),
    ("rpc_call", "content", r"rpc\.call"),
    ("migration", "path", r"migration"),
    ("documentation", "path", r"\.mdx?$"),
    ("test", "path", r"(\.test\.|\.spec\.|/tests?/)"),
)


def evidence(path: Column, content: Column) -> Column:
    """The labels that hold, in the table's order; `unknown` if none does."""
    text = {"path": F.lower(path), "content": F.lower(content)}
    labels = F.array_compact(F.array(*(F.when(text[where].rlike(regex), name) for name, where, regex in EVIDENCE)))
    return F.when(F.size(labels) == 0, F.array(F.lit("unknown"))).otherwise(labels)


#: Fact categories in order; a line belongs to the first whose pattern it holds.
CATEGORIES = (
    ("limit", r"(?i)(must not exceed|at most|maximum|minimum|limit)"),
    ("schedule", r"(?i)(cron|every|interval|schedule)"),
    ("config", r"(?i)(process\.env|config)"),
    ("status", r"(?i)(status|state|active|pending)"),
    ("route", r"(?i)(app\.|router\.|/api/)"),
    ("storage", r"(?i)(select |insert |update |delete )"),
)


def structured_facts(files: DataFrame, most: int = 24, content: str = "content") -> DataFrame:
    """Categorised lines of 12 to 220 characters, one of each category and text, the first `most` of a file."""
    rest = [c for c in files.columns if c != content]
    lines = files.select(*rest, F.posexplode(F.split(content, "\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    category = None
    for name, regex in CATEGORIES:
        category = F.when(F.col("text").rlike(regex), name) if category is None else category.when(F.col("text").rlike(regex), name)
    known = lines.filter(F.length("text").between(12, 220)).withColumn("category", category).filter("category IS NOT NULL")
    once = first_of(known.withColumn("_low", F.lower("text")), [*rest, "category", "_low"], ["line"]).drop("_low")
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy(*rest).orderBy("line", "category")))
    return ranked.filter(F.col("_n") <= most).select(*rest, (F.col("line") + 1).alias("line"), "category", "text")


def enclosing(marks: DataFrame, declarations: DataFrame, keys: list[str]) -> DataFrame:
    """marks with the last declaration at or before their line: an as-of join as one sorted pass over both.

    Both have keys and line, declarations also symbol. A declaration on a mark's own line counts.
    """
    both = marks.withColumn("_mark", F.lit(1)).unionByName(declarations.select(*keys, "line", "symbol").withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("line", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("symbol", F.last("symbol", ignorenulls=True).over(before)).filter("_mark = 1").drop("_mark")
