"""Rules on source text: name hints, evidence labels, line facts and relationship edges, as built-in expressions over whole files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns and words by which names are recognised.
QUOTED_NAME = r"""["'`]([A-Za-z][A-Za-z0-9_.:-]{1,80})["'`]"""
ROUTE_PATTERNS = (
    r"""(?i)(?:app|router|route)\s*\.\s*(?:get|post|put|patch|delete|any)\s*\(\s*["'`]([^"'`]+)["'`]""",
    r"""@(?:Get|Post|Put|Patch|Delete|All)\s*\(\s*["'`]([^"'`]+)["'`]""",
    r"""http\.HandleFunc\s*\(\s*["'`]([^"'`]+)["'`]""",
    r"""(?i)\$route\[[^\]]+\]\s*=\s*["'`]([^"'`]+)["'`]""",
    r"""["'`](/[A-Za-z0-9_./:{}-]+)["'`]""",
)
SYMBOL_PATTERNS = (
    r"\b(?:function|func)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    r"\bstruct\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    r"\btype\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct\b",
    r"\b(?:public|private|protected)\s+function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"\bconst\s+([A-Z][A-Z0-9_]*)\s*=",
    r"\b([A-Za-z_][A-Za-z0-9_]*::[A-Z][A-Z0-9_]*)\b",
)
TABLE_PATTERNS = (
    r"""(?i)\b(?:from|join|into|update|table)\s+[`"']?([A-Za-z_][A-Za-z0-9_.]*)[`"']?""",
    r"""(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`"']?([A-Za-z_][A-Za-z0-9_.]*)[`"']?""",
    r"""@Entity\s*\(\s*["'`]([^"'`]+)["'`]""",
    r"""Schema::(?:create|table)\s*\(\s*["'`]([^"'`]+)["'`]""",
)
MESSAGE_WORDS = ("rpc", "call", "command", "event", "message", "handler", "publish", "consume", "routing", "queue", "amqp", "rabbit")
MESSAGE_PATTERNS = (r"""@(?:EventPattern|MessagePattern)\s*\(\s*["'`]([^"'`]+)["'`]""",)
QUEUE_WORDS = ("queue", "basic_consume", "assertqueue", "queuedeclare")
QUEUE_PATTERNS = (
    r"""(?i)(?:queue|queueName|queue_name)\s*[:=]\s*["'`]([^"'`]+)["'`]""",
    r"""(?i)(?:assertQueue|QueueDeclare|queue_declare|basic_consume)\s*\(\s*["'`]([^"'`]+)["'`]""",
)
EXCHANGE_WORDS = ("exchange", "basic_publish", "publishexchange")
EXCHANGE_PATTERNS = (
    r"""(?i)(?:exchange|exchangeName|exchange_name)\s*[:=]\s*["'`]([^"'`]+)["'`]""",
    r"""(?i)(?:assertExchange|ExchangeDeclare|exchange_declare)\s*\(\s*["'`]([^"'`]+)["'`]""",
)
MOST_HINTS = 20


def _all(text: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]


def _near(text: Column, words: tuple[str, ...]) -> Column:
    """Quoted names on lines that hold one of the words."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("|".join(words)))
    return F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(QUOTED_NAME), F.lit(1))


def hints(content: Column, constant_routes: Column | None = None) -> Column:
    """Struct of six name lists, each distinct in order of its rules and at most MOST_HINTS; constant_routes: resolved elsewhere."""
    routes = [constant_routes] if constant_routes is not None else []
    lists = {
        "routes": F.filter(F.concat(*routes, *_all(content, ROUTE_PATTERNS)), lambda r: F.startswith(r, F.lit("/"))),
        "symbols": F.concat(*_all(content, SYMBOL_PATTERNS)),
        "message_names": F.concat(_near(content, MESSAGE_WORDS), *_all(content, MESSAGE_PATTERNS)),
        "queue_names": F.concat(*_all(content, QUEUE_PATTERNS), _near(content, QUEUE_WORDS)),
        "exchange_names": F.concat(*_all(content, EXCHANGE_PATTERNS), _near(content, EXCHANGE_WORDS)),
        "db_tables": F.concat(*_all(content, TABLE_PATTERNS)),
    }
    return F.struct(*(T.unique(v, MOST_HINTS).alias(k) for k, v in lists.items()))


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def evidence(path: Column, content: Column) -> Column:
    """Labels of a file by its lower-cased path and content, in this table's order; `unknown` if none holds."""
    low = F.array(F.struct(F.lower(path).alias("path"), F.lower(content).alias("content")))
    return F.transform(low, lambda x: _labels(x["path"], x["content"]))[0]  # lower case once, not for every word


def _labels(p: Column, t: Column) -> Column:
    ends = lambda *xs: reduce(lambda a, b: a | b, (F.endswith(p, F.lit(x)) for x in xs))
    # fixed values: what tells a label
    broker = _has(t, "amqp", "rabbitmq", "routingkey", "routing_key", "exchange", "queue", "basic_publish", "basic_consume")
    rules = (
        ("documentation", ends(".md")),
        ("test", _has(p, "test", "phpunit") | ends(".spec.ts") | _has(t, "describe(", "it(", "test(", "assert.", "assert::")),
        ("docker_config", _has(p, "dockerfile", "docker-compose", "compose.yml", "compose.yaml")),
        ("ci_config", _has(p, "jenkinsfile", ".github/workflows", ".gitlab-ci")),
        ("env_config", ends(".env.example") | _has(p, "config") | _has(t, "process.env", "dotenv", "getenv(", "$_env", "os.getenv", "viper.", "std::getenv")),
        ("raw_sql", ends(".sql") | _has(t, "select ", "insert into", "update ", "delete from")),
        ("migration", _has(p, "migration") | _has(t, "schema::create", "schema::table", "create table", "alter table")),
        ("typeorm_entity", _has(t, "@entity", "typeorm", "extends baseentity")),
        ("db_model", _has(p, "model", "entity") | _has(t, "gorm.model", "extends model", "mysqli", "pdo(", "sqlx.", "database/sql")),
        ("controller", _has(t, "@controller", "controller(", "class ", "func ") & _has(p, "controller", "handler", "action")),
        (
            "api_route",
            _has(t, "@get(", "@post(", "@put(", "@patch(", "@delete(", "router.", "app.get", "app.post", "$_server['request_method']", '$_server["request_method"]',
                 "$_get", "$_post", "http.handlefunc", "http.handle(", ".get(", ".post(", ".put(", ".delete("),
        ),
        ("rabbitmq_publisher", broker & _has(t, "publish", "sendtoqueue", "emit(")),
        ("rabbitmq_consumer", broker & _has(t, "consume", "@eventpattern", "@messagepattern", "subscribe")),
        ("cron_job", _has(t, "@cron", "cron.schedule", "schedulejob", "setinterval", "crontab", "cronexpr") | _has(p, "cron", "scheduled")),
        ("shell_script", ends(".sh", ".bash", ".zsh", ".ps1")),
    )
    labels = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
    return F.when(F.size(labels) == 0, F.array(F.lit("unknown"))).otherwise(labels)


#: Categories of line facts, the first that matches holds.
FACT_PATTERNS = (
    ("validation", r"(?i)validationError|Joi\.|check\(|validator|validate|throw new|MissingRequestError|Unauthorized|Forbidden"),
    ("input", r"(?i)\b(?:request|req)\.(?:body|query|params)|\$_(?:POST|GET|REQUEST)|input\(|bodyParser"),
    ("return", r"(?i)\breturn\b|res\.json|response\.json|reply\.send|echo\s+json_encode"),
    ("formula", r"(?i)>=|<=|===|!==|\+\+|--|\bMath\.|max\(|min\(|\*\s*[a-zA-Z_][\w.]*"),
    ("constant", r"\b(?:const|let|var)\s+[A-Z0-9_]{3,}|\b[A-Z0-9_]{3,}\s*[:=]"),
    ("database", r"(?i)\bselect\b|\binsert\b|\bupdate\b|\bdelete\b|\bfrom\b|\bjoin\b|\.query\(|createQueryBuilder|table\("),
    ("message", r"(?i)amqp|rabbit|queue|exchange|routingKey|publish|consume|sendToQueue|assertQueue|rpc"),
    ("config", r"(?i)process\.env|config\.|\.env|module\.exports|exports\."),
    ("control_flow", r"(?i)\bif\s*\(|\bswitch\s*\(|\bcase\b|\belse\b"),
)
DERIVED = ("formula", "control_flow")
NOISE = (
    r"^(?://|#|/\*)|^\*\s|^(?:import|require)\s+|^</?[A-Za-z]",
    r"(?i)!important|console\.log|describe\(|it\(|expect\(|logger\.|//\s*todo",
)
MOST_FACTS = 24


def line_facts(files: DataFrame, content: str = "content", first_line: int = 1, most: int = MOST_FACTS) -> DataFrame:
    """files without content, one row a fact: line, category, text, confidence; the first `most` of a file.

    A line of 12 to 220 characters that isn't a comment, an import, markup or a log call is a fact of the first category
    it matches; of lines equal but for case in one category the first counts.
    """
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), ",$", "")
    category = reduce(lambda a, c: a.when(F.col("x.text").rlike(c[1]), c[0]), FACT_PATTERNS[1:], F.when(F.col("x.text").rlike(FACT_PATTERNS[0][1]), FACT_PATTERNS[0][0]))

    def facts_of(lines: Column) -> Column:
        numbered = F.transform(lines, lambda s, i: F.struct((i + first_line).alias("line"), clean(s).alias("text")))
        return F.filter(numbered, lambda x: F.length(x["text"]).between(12, 220) & ~x["text"].rlike(NOISE[0]) & ~x["text"].rlike(NOISE[1]))

    rest = [c for c in files.columns if c != content]
    numbered = files.withColumn("_row", F.monotonically_increasing_id())  # before the lines are taken apart: one number a file
    rows = numbered.select(*rest, "_row", F.explode(facts_of(F.split(content, r"\r?\n"))).alias("x"))
    found = rows.withColumn("category", category).filter("category IS NOT NULL")
    key = Window.partitionBy("_row", "category", F.lower("x.text")).orderBy("x.line")
    once = found.withColumn("_n", F.row_number().over(key)).filter("_n = 1")
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("x.line"))).filter(F.col("_n") <= most)
    sure = F.when(F.col("category").isin(*DERIVED), "derived").otherwise("confirmed")
    return ranked.select(*rest, F.col("x.line").alias("line"), "category", F.col("x.text").alias("text"), sure.alias("confidence"))


# Edges that a line may hold; names are the groups.
NOT_RECEIVERS = ("console", "Math", "JSON", "Object", "Array", "String", "Number", "Promise")
NOT_CALLEES = ("log", "error", "warn", "map", "filter", "find", "then", "catch", "indexOf", "includes")
NOT_DEFINED = ("if", "for", "while", "switch", "catch", "function")
NOT_TABLES = ("on", "status", "set", "where", "order", "group", "select", "from")
DEFINITION = r"\b(?:async\s+)?(?:public\s+|private\s+|protected\s+)?(?:function\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{"
CALL = r"\b([A-Za-z_$][A-Za-z0-9_$]*)\.([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
EDGE_PATTERNS = {
    "CALLS_RPC_FUNC": r"""\bfunc\s*:\s*["'`]([^"'`]+)["'`]""",
    "CALLS_EXTERNAL_FUNC": r"""\bpostParams(?:Async)?\(\s*["'`]([^"'`]+)["'`]""",
    "TOUCHES_TABLE": r"""(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+[`"']?([A-Za-z_][A-Za-z0-9_.]*)[`"']?""",
}
MOST_TABLES = 100


def edges(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, type, line, from_symbol, receiver, name): definitions, symbol calls, RPC and external calls, tables.

    from_symbol is the last definition at or before the line; a table counts once a line and MOST_TABLES times a file.
    """
    lines = files.select(*keys, F.posexplode(F.split(content, "\n")).alias("line", "_text")).withColumn("line", F.col("line") + 1)
    text = F.col("_text")

    def found(kind: str, names: Column, receivers: Column | None = None) -> Column:
        pairs = F.arrays_zip((receivers if receivers is not None else F.transform(names, lambda _: F.lit(None).cast("string"))).alias("receiver"), names.alias("name"))
        return F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("type"), x["receiver"].alias("receiver"), x["name"].alias("name")))

    every = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    marks = F.concat(
        found("DEFINES_SYMBOL", every(DEFINITION)),
        found("CALLS_SYMBOL", every(CALL, 2), every(CALL, 1)),
        *(found(kind, every(p)) for kind, p in EDGE_PATTERNS.items()),
    )
    kind, low = F.col("m.type"), F.lower("m.name")
    noise = (
        ((kind == "DEFINES_SYMBOL") & F.col("m.name").isin(*NOT_DEFINED))
        | ((kind == "CALLS_SYMBOL") & (F.col("m.receiver").isin(*NOT_RECEIVERS) | F.col("m.name").isin(*NOT_CALLEES)))
        | ((kind == "TOUCHES_TABLE") & low.isin(*NOT_TABLES))
    )
    all_marks = lines.select(*keys, "line", F.explode(marks).alias("m")).filter(~noise).select(*keys, "line", "m.*").distinct()
    # one sorted pass gives every mark the definition above it
    order = Window.partitionBy(*keys).orderBy("line", F.when(F.col("type") == "DEFINES_SYMBOL", 0).otherwise(1), "name")
    above = F.last(F.when(F.col("type") == "DEFINES_SYMBOL", F.col("name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = F.col("type").isin("DEFINES_SYMBOL", "TOUCHES_TABLE")
    ranked = all_marks.withColumn("from_symbol", F.when(~own, above)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "type").orderBy("line", "name")))
    kept = ranked.filter((F.col("type") != "TOUCHES_TABLE") | (F.col("_n") <= MOST_TABLES))
    return kept.select(*keys, "type", "line", "from_symbol", "receiver", "name")


def call_targets(found: DataFrame, keys: list[str], file: str) -> DataFrame:
    """(keys, from_symbol, receiver, callee, n_targets, first_target): the files other than a call's own that define what it names.

    From edges with keys and file. Calls and definitions are reduced to a row a name before they meet, so a name that many
    files call and define makes no pair of them: calls from several files reach every file that defines the name, calls
    from one file all but that one, and the first two files tell which comes first.
    """
    calls = found.filter("type = 'CALLS_SYMBOL' AND from_symbol IS NOT NULL").groupBy(*keys, "from_symbol", "receiver", F.col("name").alias("callee"))
    callers = calls.agg(F.min(file).alias("_one"), (F.min(file) != F.max(file)).alias("_several")).filter("_one IS NOT NULL")
    defined = found.filter("type = 'DEFINES_SYMBOL'").select(*keys, F.col("name").alias("callee"), F.col(file).alias("_file")).filter("_file IS NOT NULL").distinct()
    sizes = defined.groupBy(*keys, "callee").agg(F.count("*").alias("_n"), F.min("_file").alias("_first"))
    second = defined.join(sizes, [*keys, "callee"]).filter("_file <> _first").groupBy(*keys, "callee").agg(F.min("_file").alias("_second"))
    own = callers.join(defined.withColumn("_own", F.lit(1)).withColumnRenamed("_file", "_one"), [*keys, "callee", "_one"], "left")
    met = own.join(sizes.join(second, [*keys, "callee"], "left"), [*keys, "callee"])
    left_out = ~F.col("_several") & F.col("_own").isNotNull()
    n = F.col("_n") - left_out.cast("long")
    first = F.when(left_out & (F.col("_first") == F.col("_one")), F.col("_second")).otherwise(F.col("_first"))
    return met.filter(n > 0).select(*keys, "from_symbol", "receiver", "callee", n.alias("n_targets"), first.alias("first_target"))
