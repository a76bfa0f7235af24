"""Scans: repositories, Markdown, git logs, edges and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ignore import DEFAULTS, glob_regex, ignored

MAX_BYTES = 1_000_000

#: File names and extensions that are read, in lower case (fixed values).
NAMES = ("dockerfile", "jenkinsfile", "makefile", "gnumakefile", "go.mod", "composer.json", "phpunit.xml", "phpunit.xml.dist")
EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "json", "sql", "md", "yml", "yaml", "php", "phtml", "inc", "go", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "proto",
    "toml", "ini", "conf", "cfg", "properties", "xml", "gradle", "make", "mk", "sh", "bash", "zsh", "ps1",
)


def is_allowed(path: Column) -> Column:
    """By file name or extension, in any case; a name that only starts with a dot has none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"[^.].*?\.([^.]+)$", 1)
    return name.isin(*NAMES) | name.endswith(".env.example") | extension.isin(*EXTENSIONS)


def is_binary(content: Column) -> Column:
    """A NUL anywhere, or more than a twentieth control bytes among the first 8,000 bytes."""
    head = F.decode(F.substring(content, 1, 8000), "ISO-8859-1")
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return (F.position(F.lit(b"\x00"), content) > 0) | (control > 0.05 * F.length(head))


def globbed(path: Column, patterns: list[str]) -> Column:
    """Whether the whole path matches one of some globs; a leading slash and backslashes are taken for what they mean in paths."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(f"^(?:{glob_regex(p.replace(chr(92), '/').lstrip('/'))})$")
    return out


def repository(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, ignore_files: DataFrame | None = None) -> DataFrame:
    """(path, content) of the text files of a repository: included, not excluded, not ignored by default, by lines of `ignore` or by the
    ignore files (folder, content) of folders above them, of an allowed kind and bounded size, neither binary nor blank.

    Spark's readers don't list names that start with a dot, so ignore files come as a table and such files aren't read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    found = raw.filter(F.col("length") <= MAX_BYTES).select(F.lit("").alias("repo"), rel.alias("path"), "content")
    rules = spark.createDataFrame([], "folder string, content string") if ignore_files is None else ignore_files
    rules = rules.select(F.lit("").alias("repo"), "folder", "content")
    wanted = is_allowed(F.col("path")) & ~globbed(F.col("path"), exclude or [])
    if include:
        wanted = wanted & globbed(F.col("path"), include)
    gone = ignored(found.select("repo", "path"), rules, (*DEFAULTS, *(ignore or [])))
    kept = found.filter(wanted & ~is_binary(F.col("content"))).join(gone, ["repo", "path"], "left_anti")
    return kept.select("path", F.decode("content", "UTF-8").alias("content")).filter(T.strip(F.col("content")) != "")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all .md and .mdx files."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,mdx}")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def git_log(lines: DataFrame, repo: str = "repo") -> DataFrame:
    """Commits of `sha|author|date|message` lines, each followed by the names of its files; input (repo, pos, line)."""
    header = F.col("line").rlike(r"^[0-9a-f]{7,40}\|")
    w = Window.partitionBy(repo).orderBy("pos")
    grouped = lines.filter(T.strip(F.col("line")) != "").withColumn("_h", header).withColumn("_g", F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(w)).filter("_g > 0")
    commit = grouped.groupBy(repo, "_g").agg(
        F.max(F.when(F.col("_h"), F.col("line"))).alias("_l"), F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line")))).alias("_f")
    )
    parts = F.split("_l", r"\|", 4)
    return commit.select(
        repo, *(F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(("sha", "author", "date", "message"))), F.col("_f.line").alias("files")
    )


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Relationship edges from JSON lines."""
    return spark.read.schema(EDGE_SCHEMA).json(path)


EDGE_SCHEMA = (
    "id string, type string, repo string, branch string, path string, start_line int, end_line int, from_symbol string, to_route string, "
    "http_method string, handler string, rpc_func string, external_func string, receiver string, callee string, symbol string, tab string, evidence string"
)


def json_entries(spark: SparkSession, path: str, key: str = "entries") -> DataFrame:
    """The elements of an array inside whole-file JSON documents, as rows."""
    return spark.read.json(path, multiLine=True).select(F.explode(key).alias("e")).select("e.*")
