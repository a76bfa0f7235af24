"""Comments, manifests, diagrams, dictionaries and windows of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import lines

#: Beginnings of a line comment by language (fixed values).
LINE_COMMENT = r"^\s*(//|#|--)"
CODE_LIKE = r"[;{}]\s*$|^\s*(const|let|var|return|if|for|import)[^A-Za-z]"


def comment_blocks(files: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of line comments without their markers, start_line and end_line; runs that are mostly code or hardly a word are dropped."""
    numbered = lines(files).filter(F.col("text").rlike(LINE_COMMENT))
    island = F.col("line") - F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    body = T.strip(F.regexp_replace("text", LINE_COMMENT, ""))
    runs = numbered.withColumn("_g", island).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct("line", body.alias("text")))).alias("x"))
    code = F.size(F.filter("x.text", lambda t: t.rlike(CODE_LIKE)))
    text = F.array_join("x.text", "\n")
    kept = runs.filter((code <= 0.6 * F.size("x")) & (F.length(text) >= 12))
    return kept.select(*keys, F.col("x")[0]["line"].alias("start_line"), F.element_at("x", -1)["line"].alias("end_line"), text.alias("content"))


def look_back(files: DataFrame, keys: list[str], use: str, assignment: str, rows: int = 5) -> DataFrame:
    """Uses of a variable with its last assignment in the lines before; both patterns have the name first, the assignment its value second."""
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(-rows, -1)
    given = F.when(F.col("text").rlike(assignment), F.struct(F.regexp_extract("text", assignment, 1).alias("name"), F.regexp_extract("text", assignment, 2).alias("value"), F.col("line").alias("at")))
    seen = lines(files).withColumn("_seen", F.collect_list(given).over(w)).withColumn("name", F.regexp_extract("text", use, 1)).filter(F.col("name") != "")
    hit = F.filter("_seen", lambda a: a["name"] == F.col("name"))
    last = F.get(hit, F.size(hit) - 1)
    return seen.select(*keys, "line", "name", last["value"].alias("value"), last["at"].alias("assigned_at"))


def manifest(rows: DataFrame, json: str = "json") -> DataFrame:
    """Dependencies and scripts of package manifests, sorted; a text that is no JSON object is one `parse_error` row."""
    parsed = F.from_json(json, "name string, version string, dependencies map<string,string>, scripts map<string,string>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in rows.columns if c != json]
    p = rows.select(*rest, parsed.alias("p"))
    entries = lambda kind: F.transform(F.map_entries(F.coalesce(F.col(f"p.{kind}"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("value")))
    bad = F.array(F.struct(F.lit("parse_error").alias("kind"), F.lit("").alias("name"), F.lit("").alias("value")))
    all_ = F.when(F.col("p._corrupt").isNotNull() | F.col("p").isNull(), bad).otherwise(F.array_sort(F.concat(entries("dependencies"), entries("scripts"))))
    return p.select(*rest, F.col("p.name").alias("package"), F.explode(all_).alias("e")).select(*rest, "package", "e.kind", "e.name", "e.value")


#: Kinds of diagram (fixed values).
DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie", "journey")


def mermaid(docs: DataFrame, content: str = "content") -> DataFrame:
    """Fenced diagrams of a known kind: pos, kind, number of arrows."""
    found = F.regexp_extract_all(content, F.lit(r"(?is)```mermaid\s*(.*?)```"), F.lit(1))
    rest = [c for c in docs.columns if c != content]
    kind = F.regexp_extract("block", r"^\s*([A-Za-z]+)", 1)
    return docs.select(*rest, F.posexplode(found).alias("pos", "block")).withColumn("kind", kind).filter(F.col("kind").isin(*DIAGRAMS)).withColumn("n_arrows", F.regexp_count("block", F.lit(r"-->|->>")).cast("long"))


def vocabulary(files: DataFrame, content: str = "content") -> DataFrame:
    """Terms of constant dictionaries `const NAME = {KEY: 'value', ...}` with at least two distinct keys: name, term, value."""
    rest = [c for c in files.columns if c != content]
    objects = F.regexp_extract_all(content, F.lit(r"const ([A-Z][A-Z_]+ = \{[^}]*\})"), F.lit(1))
    rows = files.select(*rest, F.explode(objects).alias("o")).select(
        *rest, F.regexp_extract("o", r"^([A-Z_]+)", 1).alias("name"), F.regexp_extract_all("o", F.lit(r"([A-Z_]+):\s*'[^']*'"), F.lit(1)).alias("terms"), F.regexp_extract_all("o", F.lit(r"[A-Z_]+:\s*'([^']*)'"), F.lit(1)).alias("values"),
    )
    kept = rows.filter(F.size(F.array_distinct("terms")) >= 2)
    return kept.select(*rest, "name", F.explode(F.arrays_zip("terms", "values")).alias("x")).select(*rest, "name", F.col("x.terms").alias("term"), F.col("x.values").alias("value"))


def method_windows(numbered: DataFrame, keys: list[str], declaration: str, most: int = 120) -> DataFrame:
    """Each declared method with its lines up to the next declaration, at most so many: name, start_line, end_line, content."""
    w = Window.partitionBy(*keys).orderBy("line")
    named = numbered.withColumn("name", F.nullif(F.regexp_extract("text", declaration, 1), F.lit("")))
    owner = F.last(F.when(F.col("name").isNotNull(), F.struct("name", F.col("line").alias("start"))), ignorenulls=True).over(w)
    owned = named.withColumn("m", owner).filter(F.col("m").isNotNull() & (F.col("line") < F.col("m.start") + most))
    packed = owned.groupBy(*keys, "m").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    return packed.select(*keys, "m.name", F.col("m.start").alias("start_line"), F.element_at("x", -1)["line"].alias("end_line"), F.array_join("x.text", "\n").alias("content"))


def plain(markdown: Column) -> Column:
    """Markdown without its marks."""
    out = F.regexp_replace(markdown, r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"(?m)^\s*[-*]\s+", "")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, "`([^`]*)`", "$1")
    return F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")


def json_in_text(text: Column, schema: str) -> Column:
    """The first object inside a text, parsed; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
