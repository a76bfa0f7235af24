"""Queries: chunks and the incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import index as I
from ..session import read, shared_folder
from ..sources.versions import ScopedTable, buckets, merged_by
from .fixtures import load, with_sql

KEYS = ["chunk_id"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "chunks").select("chunk_id", "content")


_BLOCKS = """b AS (SELECT chunk_id, i AS start_line, least(i + 3, len(l)) AS end_line, array_to_string(l[i:i + 3], chr(10)) AS content
 FROM (SELECT chunk_id, string_split(content, chr(10)) AS l FROM chunks), unnest(range(1, len(l) + 1, 4)) AS r(i))"""


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blocks(_docs(spark, sf_dir), 4)


def chunk_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_tiny(C.blocks(_docs(spark, sf_dir), 4), KEYS)


_MERGED = """m AS (SELECT chunk_id, min(start_line) AS start_line, max(end_line) AS end_line, string_agg(content, chr(10) ORDER BY start_line) AS content
 FROM (SELECT *, sum(CASE WHEN end_line - start_line + 1 < 5 AND length(content) < 100 THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY start_line) AS g FROM b)
 GROUP BY chunk_id, g)"""


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_overlap(C.blocks(_docs(spark, sf_dir), 4), KEYS)


_OVERLAP = """o AS (SELECT chunk_id, start_line - CASE WHEN p IS NULL THEN 0 ELSE least(len(p), 3) END AS start_line, end_line, p IS NOT NULL AS has_overlap,
 CASE WHEN p IS NULL THEN content ELSE array_to_string(p[greatest(len(p) - 2, 1):], chr(10)) || chr(10) || content END AS content
 FROM (SELECT *, string_split(lag(content) OVER (PARTITION BY chunk_id ORDER BY start_line), chr(10)) AS p FROM b))"""


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.blocks(_docs(spark, sf_dir).withColumnRenamed("chunk_id", "doc"), 4)
    return C.with_ids(made, "doc", "start_line", "end_line", "content").select("doc", "start_line", "chunk_id", "content_hash")


_IDS = """SELECT doc, start_line, content_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 (['8', '9', 'a', 'b'])[((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
 FROM (SELECT chunk_id AS doc, start_line, sha256('chunks-v1:' || chunk_id || ':' || start_line || ':' || end_line || ':' || content) AS h, h AS content_hash FROM b)"""


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a document: a line of one sentence begins one."""
    return C.at_boundaries(C.lines(_docs(spark, sf_dir)), KEYS, F.length("text") < 40)


def chunk_sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files").select("file_id", "content")
    return C.sql_statements(C.lines(files), ["file_id"])


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pack(_docs(spark, sf_dir), 1500)


_PACK = """RECURSIVE l AS (SELECT chunk_id, string_split(content, chr(10)) AS x FROM chunks),
 p AS (SELECT chunk_id, x, 1 AS k, 1 AS piece, length(x[1]) AS n FROM l
  UNION ALL SELECT chunk_id, x, k + 1, CASE WHEN n + 1 + length(x[k + 1]) <= 1500 THEN piece ELSE piece + 1 END,
   CASE WHEN n + 1 + length(x[k + 1]) <= 1500 THEN n + 1 + length(x[k + 1]) ELSE length(x[k + 1]) END FROM p WHERE k < len(x))
 SELECT chunk_id, piece, string_agg(x[k], chr(10) ORDER BY k) AS text FROM p GROUP BY chunk_id, piece"""


def chunk_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.declarations(load(spark, sf_dir, "files"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = C.lines(load(spark, sf_dir, "files").select("file_id", "content"))
    return pieces.filter(~C.is_noise(F.col("text"))).select("file_id", "line")


def content_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "files")
    c = F.col("content")
    return files.select(
        "file_id", T.normalize_path(F.col("path")).alias("path"), T.language_of(F.col("path")).alias("language"), T.slug(c).alias("slug"),
        F.sha2(T.normalize(c), 256).alias("hash"), T.uuid_of(F.sha2(c, 256)).alias("uuid"), F.length(T.fingerprint(c)).alias("n_fingerprint"),
    )


_NORMALIZE = """SELECT file_id, lower(path) AS path,
 CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.php' THEN 'php' WHEN path LIKE '%.sql' THEN 'sql' WHEN path LIKE '%.go' THEN 'go' ELSE 'markdown' END AS language,
 array_to_string(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '')[1:5], '-') AS slug,
 sha256(n) AS hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 (['8', '9', 'a', 'b'])[((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid,
 CASE WHEN length(n) > 360 THEN 361 ELSE length(n) END AS n_fingerprint
 FROM (SELECT *, lower(trim(regexp_replace(content, '[ \n\t]+', ' ', 'g'))) AS n, sha256(content) AS h FROM files)"""


def _generation(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Hashes of an index run over all documents; in the new run the French texts have changed."""
    docs = read(spark, sf_dir, "documents")
    change = F.when((F.col("lang") == "fr") & F.lit(new), "v2")
    return docs.select("doc_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text", change), 256).alias("hash"))


def incremental_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stale(_generation(spark, sf_dir, False), _generation(spark, sf_dir, True), "hash")


def incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fresh(_generation(spark, sf_dir, True), _generation(spark, sf_dir, False), "hash")


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the index after a run, by whether rows were kept or inserted."""
    old = _generation(spark, sf_dir, False).withColumn("origin", F.lit("kept"))
    new = _generation(spark, sf_dir, True).withColumn("origin", F.lit("inserted"))
    return I.upsert(old, new, "hash").groupBy("origin").agg(F.count("*").alias("n"))


def edge_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "edges").select(F.concat_ws(":", "repo", "tab").alias("key"), "id", "line", F.col("type"))
    return I.merge_last(edges.filter("line <= 30"), edges.filter("line > 20"), "key", "id").select("key", "id", "line")


def edge_replace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by repository after one repository's edges were replaced."""
    edges = load(spark, sf_dir, "edges")
    new = edges.filter("repo = 'repo-3' AND line = 10")
    return I.replace_scope(edges, new, F.col("repo") == "repo-3").groupBy("repo").agg(F.count("*").alias("n"))


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return I.drop_adjacent_repeats(events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "version")


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by repository and branch: files, characters, last line."""
    return load(spark, sf_dir, "chunks").groupBy("repo", "branch").agg(
        F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.sum(F.length("content")).alias("n_chars"), F.max("end_line").alias("last_line"),
        F.count_if(F.length("content") < 100).alias("n_short"),
    )


_RUNS = """WITH o AS (SELECT doc_id, sha256(doc_id || ':' || text) AS hash FROM documents),
 n AS (SELECT doc_id, sha256(doc_id || ':' || text || CASE WHEN lang = 'fr' THEN ':v2' ELSE '' END) AS hash FROM documents) """

def scope_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by repository and branch after one repository was loaded anew with fewer chunks, and two branches went."""
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "repo", "branch", "content")
    table = ScopedTable(spark, shared_folder(spark, "chunks"), "chunk_id bigint, repo string, branch string, content string", ("repo", "branch"))
    table.replace(chunks)
    again = chunks.filter("repo = 'src1' AND chunk_id % 2 = 0").withColumn("content", F.concat("content", F.lit("!")))
    table.replace(again, also=[{"repo": "src1", "branch": b} for b in ("en", "de", "fr", "es")])
    table.delete(lambda scope: scope[0] != "src1" and scope[1] == "de")
    return table.read().groupBy("repo", "branch").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind from batches of a stream, one of them repeated and one late."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", buckets(["user_id"]))
    table = ScopedTable(spark, shared_folder(spark, "state"), "user_id bigint, event_type string, event_id bigint, bucket int", ("bucket",))
    merge = merged_by(table, ["user_id", "event_type"], ["event_id"])
    for number, part in enumerate((1, 0, 2)):
        merge(events.filter(F.col("event_id") % 3 == part), number)
    merge(events.filter("event_id < 0").union(events.withColumn("event_id", F.col("event_id") + 1_000_000)), 1)  # batch 1 is there already
    return table.read().select("user_id", "event_type", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_blocks, chunk_merge_small, chunk_overlap, chunk_ids, chunk_sections, chunk_sql_statements, chunk_pack, chunk_declarations, noise_filter,
        content_normalize, incremental_stale, incremental_new, incremental_index, edge_merge_last_wins, edge_replace_scope, version_log, index_summary,
        scope_replaced, merged_state,
    )
}
ORACLE = {
    "scope_replaced": with_sql(
        """SELECT repo, branch, count(*) AS n, sum(length(content) + CASE WHEN repo = 'src1' THEN 1 ELSE 0 END)::BIGINT AS n_chars FROM chunks
        WHERE CASE WHEN repo = 'src1' THEN chunk_id % 2 = 0 ELSE branch IS DISTINCT FROM 'de' END GROUP BY ALL"""
    ),
    "merged_state": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
    "chunk_blocks": with_sql(f"WITH {_BLOCKS} SELECT * FROM b"),
    "chunk_merge_small": with_sql(f"WITH {_BLOCKS}, {_MERGED} SELECT * FROM m"),
    "chunk_overlap": with_sql(f"WITH {_BLOCKS}, {_OVERLAP} SELECT * FROM o"),
    "chunk_ids": with_sql(f"WITH {_BLOCKS} {_IDS}"),
    "chunk_sections": with_sql(
        """WITH l AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM chunks),
        g AS (SELECT *, sum(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY line) AS g FROM l)
        SELECT chunk_id, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM g GROUP BY chunk_id, g"""
    ),
    "chunk_sql_statements": with_sql(
        """WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files),
        e AS (SELECT *, coalesce(lag(CASE WHEN regexp_matches(text, ';[ ]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line), 0) AS e FROM l),
        g AS (SELECT *, sum(e) OVER (PARTITION BY file_id ORDER BY line) AS g FROM e)
        SELECT file_id, min(line) AS start_line, max(line) AS end_line, string_agg(text, chr(10) ORDER BY line) AS content FROM g GROUP BY file_id, g"""
    ),
    "chunk_pack": with_sql("WITH " + _PACK).replace("WITH chunks AS", "WITH RECURSIVE chunks AS").replace(", RECURSIVE l", ", l"),
    "noise_filter": with_sql(
        """WITH l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)
        SELECT file_id, line FROM (SELECT file_id, line, trim(x) AS x FROM l) WHERE NOT (regexp_matches(x, '^#[0-9a-fA-F]{3,8};?$') OR regexp_matches(x, '^[a-z-]+:[ ]*[^;]+;?$')
        OR regexp_matches(x, '^</?[a-zA-Z][^>]*>$') OR regexp_matches(x, '(?i)(auto-generated|do not edit)') OR length(replace(x, ' ', '')) < 5)"""
    ),
    "content_normalize": with_sql(_NORMALIZE),
    "incremental_stale": _RUNS + "SELECT * FROM o WHERE hash NOT IN (SELECT hash FROM n)",
    "incremental_new": _RUNS + "SELECT * FROM n WHERE hash NOT IN (SELECT hash FROM o)",
    "incremental_index": _RUNS + "SELECT CASE WHEN hash IN (SELECT hash FROM o) THEN 'kept' ELSE 'inserted' END AS origin, count(*) AS n FROM n GROUP BY 1",
    "edge_merge_last_wins": with_sql(
        """SELECT key, id, line FROM (SELECT repo || ':' || tab AS key, id, line, 0 AS g FROM edges WHERE line <= 30
        UNION ALL SELECT repo || ':' || tab, id, line, 1 FROM edges WHERE line > 20) QUALIFY row_number() OVER (PARTITION BY key ORDER BY g DESC, id DESC) = 1"""
    ),
    "edge_replace_scope": with_sql("SELECT repo, count(*) AS n FROM edges WHERE repo <> 'repo-3' OR line = 10 GROUP BY repo"),
    "version_log": """SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""",
    "index_summary": with_sql(
        """SELECT repo, branch, count(*) AS n, count(DISTINCT path) AS n_files, sum(length(content))::BIGINT AS n_chars, max(end_line) AS last_line,
        count(*) FILTER (WHERE length(content) < 100) AS n_short FROM chunks GROUP BY ALL"""
    ),
}
