"""From questions to rows: gates, exact names, scores with bonuses, context choice, glossaries and comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that open a gate.
EXPAND = ("flow", "endpoint", "route", "rpc", "amqp", "rabbit", "queue", "exchange", "publish", "consume", "consumer", "handler", "call", "database", "table", "migration", "service")
EXPAND_ROUTE = ("flow", "rpc", "amqp", "rabbit", "queue", "exchange", "publish", "consume", "consumer", "handler", "call")
DETAILS = ("body", "validation", "validate", "return", "response", "payload", "service", "services", "database", "table", "tables", "affected", "involved", "flow")
FLOW_CONTEXT = (
    "flow", "how does", "how do", "deposit", "withdraw", "transfer", "from", "to ", "endpoint", "route", "handler", "controller", "service", "consume", "publish", "queue",
    "function", "method",
)
GREETING = r"^(hello|hi|hey|halo|hallo|hai|thanks|thank you|terima kasih|bye|good (morning|afternoon|evening)|apa kabar|test|oi|yo|sup)\b[!.?\s]*$"
STOP = ("the", "and", "for", "what", "which", "does", "how", "are", "used", "use", "with", "its", "why", "list", "that", "from", "this", "all", "work", "works")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def routes_of(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(r"/[A-Za-z0-9_./:{}-]+"), F.lit(0)))


def terms_of(question: Column) -> Column:
    """Distinct lower-cased words, names and routes of at least three characters, without stop words."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9_./-]*[a-z0-9_]"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP)))


def gates(question: Column) -> dict[str, Column]:
    """Flags and hints of a question by name."""
    low = F.lower(question)
    word = lambda p: low.rlike(rf"\b({p})\b")
    return {
        "expand": _has(low, EXPAND) | (F.size(routes_of(question)) > 0),
        "expand_route": _has(low, EXPAND_ROUTE),
        "inspect": _has(low, DETAILS) | low.rlike(r"\bwhat does\b.*\bdo\b"),
        "greeting": (F.size(F.filter(F.split(F.trim(low), r"\s+"), lambda w: w != "")) <= 4) & F.trim(low).rlike(GREETING),
        "asks_services": word("what services|services? (detected|list|available)|detected (services?|repos?)"),
        "asks_env": word("environment variables?|env vars?|what env|which env"),
        "asks_tables": word("database tables?|db tables?|which tables?|what tables?"),
    }


def domain_hints(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(question_id, hint): the hints of a table of rules that a question (question_id, question) gives.

    rules: (hint, any, also, none, alone): a question gives a hint if it has a word of `any`, one of `also` unless that is
    empty, and none of `none`; where `alone` is set, only if nothing in it speaks of a flow. Words are runs of letters, digits
    and underscores in lower case; each meets the rules' words in an equi-join, so rules may be many.
    """
    words = F.split(F.lower("question"), "[^a-z0-9_]+")
    said = questions.select("question_id", _has(F.lower("question"), FLOW_CONTEXT).alias("flow"), F.explode(F.array_distinct(words)).alias("word"))
    tagged = lambda c: F.transform(F.coalesce(c, F.array()), lambda w: F.struct(F.lit(c).alias("part"), F.lower(w).alias("word")))
    needs = F.size(F.coalesce("also", F.array())) > 0
    spread = rules.select("hint", "alone", needs.alias("needs"), F.explode(F.concat(*(tagged(c) for c in ("any", "also", "none")))).alias("w")).select("hint", "alone", "needs", "w.*")
    met = said.join(spread, "word").groupBy("question_id", "hint").agg(
        *(F.max((F.col("part") == c).cast("int")).alias(f"_{c}") for c in ("any", "also", "none")), F.first("alone").alias("alone"), F.first("needs").alias("needs"), F.first("flow").alias("flow")
    )
    given = (F.col("_any") == 1) & ((F.col("_also") == 1) | ~F.col("needs")) & (F.col("_none") == 0) & ~(F.coalesce("alone", F.lit(False)) & F.col("flow"))
    return met.filter(given).select("question_id", "hint")


def named_points(points: DataFrame) -> DataFrame:
    """(file_id, kind, name): every name of a point in lower case, routes normalised."""
    kinds = {"route": "routes", "symbol": "symbols", "queue": "queue_names", "table": "db_tables"}

    def named(kind: str, names: str) -> Column:
        same = T.normalize_route if kind == "route" else F.lower
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), same(n).alias("name")))

    lists = F.concat(*(named(k, c) for k, c in kinds.items()))
    return points.select("file_id", F.explode(F.array_distinct(lists)).alias("n")).select("file_id", "n.*")


#: What an equal name of a kind adds, and a term in the text, a route in the text.
NAME_WEIGHTS = {"route": 100, "symbol": 45, "queue": 55, "table": 55}
TERM_WEIGHT, ROUTE_WEIGHT = 18, 75
#: Names of questions that are broadcast; more meet the points' names by a shuffle.
MOST_NAMES = 500_000


def rerank(questions: DataFrame, points: DataFrame, most: int = 10, beside: dict[str, Column] | None = None) -> DataFrame:
    """(question_id, rank, file_id, score): points that share a name with a question, by weights of names, terms and intents.

    Candidates come from a join of equal names, so no pair without a common name is ever made. Questions of the same terms
    and intents are one, asked by the least of them. From the third chunk of a repository on each loses 30 more, 90 at most.
    beside: further columns by name, of a point's columns and the question's terms. What is made of points is never broadcast:
    their texts and names come from a table far smaller than they are, by whose size Spark would take them for few bytes.
    """
    beside = beside or {}
    low = F.lower("question")
    intents = {"on_tables": "database|table|query", "on_calls": "service|flow|call", "on_terms": "glossary|meaning|definition"}
    every = questions.select(F.col("question_id").alias("member"), F.array_sort(terms_of(F.col("question"))).alias("terms"), *(low.rlike(p).alias(k) for k, p in intents.items()))
    same = ["terms", *intents]
    asked = every.groupBy(*same).agg(F.min("member").alias("question_id"))
    named = asked.select("question_id", F.explode("terms").alias("name"))
    weight = F.coalesce(*(F.when(F.col("kind") == k, w) for k, w in NAME_WEIGHTS.items()))
    named = F.broadcast(named) if named.limit(MOST_NAMES + 1).count() <= MOST_NAMES else named.hint("merge")
    matched = named.join(named_points(points), "name").groupBy("question_id", "file_id").agg(F.sum(weight).alias("names"))
    texts = points.select("file_id", "repo", "path", "content", "routes", "symbols", "message_names", "queue_names", "db_tables", "evidence").hint("merge")
    both = matched.join(asked, "question_id").join(texts, "file_id")
    text = F.lower(F.concat_ws("\n", "repo", "path", "content", F.array_join("routes", "\n"), F.array_join("symbols", "\n"), F.array_join("queue_names", "\n"), F.array_join("db_tables", "\n")))
    found = F.filter("terms", lambda t: F.contains(text, t))
    said = F.aggregate(found, F.lit(0), lambda a, t: a + F.when(F.contains(t, F.lit("/")), ROUTE_WEIGHT).otherwise(TERM_WEIGHT))
    bonus = (
        F.when(F.col("on_tables") & (F.size("db_tables") > 0), 35).otherwise(0)
        + F.when(F.col("on_calls") & (F.size("routes") + F.size("message_names") + F.size("queue_names") > 0), 30).otherwise(0)
        + F.when(F.col("on_terms") & F.array_contains("evidence", "documentation"), 22).otherwise(0)
    )
    scored = both.select("question_id", "file_id", "repo", (F.col("names") + said + bonus).alias("score"), *(c.alias(k) for k, c in beside.items()))
    nth = F.row_number().over(Window.partitionBy("question_id", "repo").orderBy(F.desc("score"), "file_id"))
    fair = scored.withColumn("score", F.col("score") - F.when(nth >= 3, F.least(30 * (nth - 2), F.lit(90))).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "file_id"))
    best = fair.withColumn("rank", rank).filter(F.col("rank") <= most).select("question_id", "rank", "file_id", "score", *beside)
    members = every.join(asked, same).select("member", "question_id")
    return best.join(members, "question_id").select(F.col("member").alias("question_id"), "rank", "file_id", "score", *beside)


def shared_words(asked: DataFrame, held: DataFrame, question: str, terms: str, item: str, parts: str) -> DataFrame:
    """(question, terms, item, n): items whose distinct parts hold n >= 2 of a question's distinct terms.

    The sides meet on two common words at once, as one word may be in all of them; n words are met n * (n - 1) / 2 times.
    Questions of the same terms are one until the end.
    """
    pairs = lambda c: F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    same = asked.select(question, F.array_sort(terms).alias("_terms"), terms)
    known = same.select("_terms").distinct()
    words = known.select(F.explode("_terms").alias("_w")).distinct()
    some = held.select(item, F.explode(parts).alias("_w")).join(words, "_w", "left_semi").groupBy(item).agg(F.collect_list("_w").alias("_parts")).filter(F.size("_parts") >= 2)
    left = known.select("_terms", F.explode(pairs(F.col("_terms"))).alias("_p"))
    met = left.join(some.select(item, F.explode(pairs(F.col("_parts"))).alias("_p")), "_p").groupBy("_terms", item).agg(F.count("*").alias("_c"))
    n = F.round((1 + F.sqrt(1 + 8 * F.col("_c"))) / 2).cast("long")
    return met.select("_terms", item, n.alias("n")).join(same, "_terms").select(question, terms, item, "n")


def widened(first: DataFrame, touched: DataFrame) -> DataFrame:
    """(question_id, n_named, n_shared, n_new_tables): the files a question names, other files of their repositories that
    share a table with them, and the tables that only these touch.

    first: (question_id, file_id); touched: distinct (file_id, repo, tab), a file in one repository. Counted without a row
    for every question and file: files of a repository that hold the same shared tables are one class, questions that saw
    the same tables one set. A table of one file in its repository leads to no other file; one of a single file in all is
    counted by number, as it is never in two classes.
    """
    held = touched.groupBy("repo", "tab").agg(F.count("*").alias("here"))
    everywhere = touched.groupBy("tab").agg(F.count("*").alias("all"))
    t = touched.join(held, ["repo", "tab"]).join(everywhere, "tab")
    # a file's shared tables and how many tables are its own alone
    files = t.groupBy("file_id", "repo").agg(F.array_sort(F.collect_list(F.when(F.col("here") > 1, F.col("tab")))).alias("key"), F.count_if(F.col("all") == 1).alias("alone"))
    files = files.filter(F.size("key") > 0)
    classes = files.groupBy("repo", "key").agg(F.count("*").alias("files"), F.sum("alone").alias("alone"))
    other = t.filter("all > 1").join(files.select("file_id", "key"), "file_id").select("repo", "key", "tab").distinct()
    seen = first.join(t, "file_id").select("question_id", "repo", "tab", "here", "all").distinct()
    sets = seen.filter("here > 1").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("repo", "tab"))).alias("set"))
    met = sets.select("set").distinct().select("set", F.explode("set").alias("s")).select("set", "s.repo", "s.tab")
    reached = met.join(classes.select("repo", "key", F.explode("key").alias("tab")), ["repo", "tab"]).select("set", "repo", "key").distinct()
    sizes = reached.join(classes, ["repo", "key"]).groupBy("set").agg(F.sum("files").alias("files"), F.sum("alone").alias("alone"))
    tables = reached.join(other, ["repo", "key"]).select("set", "tab").distinct()
    counts = sizes.join(tables.groupBy("set").agg(F.count("*").alias("tables")), "set", "left")
    # less what the question named and saw itself
    own = first.join(files, "file_id").groupBy("question_id").agg(F.count("*").alias("own_files"), F.sum("alone").alias("own_alone"))
    known = seen.filter("all > 1").select("question_id", "tab").distinct().join(sets, "question_id").join(tables, ["set", "tab"], "left_semi").groupBy("question_id").agg(F.count("*").alias("own_tables"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    named = first.groupBy("question_id").agg(F.count("*").alias("n_named"))
    both = named.join(sets, "question_id", "left").join(counts, "set", "left").join(own, "question_id", "left").join(known, "question_id", "left")
    return both.select("question_id", "n_named", (zero("files") - zero("own_files")).alias("n_shared"), (zero("alone") - zero("own_alone") + zero("tables") - zero("own_tables")).alias("n_new_tables"))


def fallback_score(points: DataFrame) -> Column:
    """What a point's own evidence is worth when nothing better is found."""
    holds = lambda *cs: reduce(lambda a, b: a | b, (F.size(c) > 0 for c in cs))
    given = lambda cond, n, other=0: F.when(cond, n).otherwise(other)
    return (
        given(F.array_contains("evidence", "documentation"), -12)
        + given(holds("routes"), 28)
        + given(holds("symbols"), 18)
        + given(holds("message_names", "queue_names", "exchange_names"), 24)
        + given(holds("db_tables"), 12)
        + given(F.array_contains("evidence", "env_config"), 4)
        - given(F.array_contains("evidence", "test"), 10)
    )


def vocabulary(files: DataFrame, keys: list[str], content: str = "content", least: int = 3) -> DataFrame:
    """(keys, group_name, kind, position, term, value): constant objects, arrays of objects and PHP arrays with enough distinct terms."""
    # fixed values: shapes of dictionaries; the body is between the brackets
    shapes = (
        ("object", r"\bconst\s+([A-Z][A-Z0-9_]*)\s*=\s*\{([^{}]*)\}", r"""([A-Za-z_][A-Za-z0-9_]*)\s*:\s*["'`]?([^"'`,}]*)["'`]?"""),
        ("records", r"\bconst\s+([A-Z][A-Z0-9_]*)\s*=\s*\[((?:\s*\{[^{}]*\}\s*,?)+)\s*\]", r"""\{\s*name\s*:\s*["'`]([^"'`]+)["'`]\s*,\s*([^}]*)\}"""),
        ("php", r"\$([a-z_]+)\s*=\s*\[([^\[\]]*=>[^\[\]]*)\]", r"""["']([^"']+)["']\s*=>\s*["']?([^"',\]]*)["']?"""),
    )

    def groups(kind: str, outer: str, inner: str) -> Column:
        every = lambda g: F.regexp_extract_all(content, F.lit(outer), F.lit(g))
        terms = lambda body: F.arrays_zip(F.regexp_extract_all(body, F.lit(inner), F.lit(1)).alias("term"), F.regexp_extract_all(body, F.lit(inner), F.lit(2)).alias("value"))
        return F.transform(
            F.arrays_zip(every(1).alias("name"), every(2).alias("body")), lambda z: F.struct(z["name"].alias("name"), F.lit(kind).alias("kind"), terms(z["body"]).alias("terms"))
        )

    made = files.select(*keys, F.explode(F.concat(*(groups(*s) for s in shapes))).alias("g")).filter(F.size(F.array_distinct(F.transform("g.terms", lambda t: F.lower(t["term"])))) >= least)
    rows = made.select(*keys, F.col("g.name").alias("group_name"), F.col("g.kind").alias("kind"), F.posexplode("g.terms").alias("position", "t"))
    return rows.select(*keys, "group_name", "kind", "position", F.trim("t.term").alias("term"), F.trim("t.value").alias("value"))


def adf_text(document: Column, depth: int = 6) -> Column:
    """The text of a document tree in JSON: texts in order, a line end after each paragraph, heading and list item.

    Texts deeper than `depth` levels are left out; text that is no tree gives null.
    """
    node = "STRUCT<type: STRING, text: STRING>"
    for _ in range(depth):
        node = f"STRUCT<type: STRING, text: STRING, content: ARRAY<{node}>>"

    def said(x: Column, left: int) -> Column:
        own = F.coalesce(x["text"], F.lit(""))
        if not left:
            return own
        inner = F.array_join(F.transform(F.coalesce(x["content"], F.array()), lambda c: said(c, left - 1)), "")
        return F.concat(own, inner, F.when(x["type"].isin("paragraph", "heading", "listItem") & x["content"].isNotNull(), F.lit("\n")).otherwise(F.lit("")))

    return F.transform(F.array(F.from_json(document, node)), lambda x: said(x, depth))[0]


def note_state(log: DataFrame) -> DataFrame:
    """(note_id, title, status, updated): notes after a log of (note_id, seq, action, title, at); a deleted note is gone until created again."""
    last = Window.partitionBy("note_id").orderBy(F.desc("seq"))
    latest = log.withColumn("_n", F.row_number().over(last)).filter("_n = 1 AND action <> 'delete'")
    return latest.select("note_id", "title", F.when(F.col("action") == "create", "draft").otherwise("final").alias("status"), F.col("at").alias("updated"))
