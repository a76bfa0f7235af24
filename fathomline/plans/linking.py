"""Queries over the relationship graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import read
from .fixtures import load, with_sql


def _symbols(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return load(spark, sf_dir, "symbols").filter(F.col("type") == kind)


def cross_links_rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rpc_links(_symbols(spark, sf_dir, "CALLS_RPC_FUNC"), _symbols(spark, sf_dir, "DEFINES_SYMBOL"))


def cross_links_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_identifiers(load(spark, sf_dir, "edges"), F.col("tab"))


def links_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen identifiers with most links, by kind of link."""
    tables = cross_links_tables(spark, sf_dir).groupBy("identifier").agg((F.sum("n_links") / 2).cast("long").alias("n")).withColumn("kind", F.lit("table"))
    calls = cross_links_rpc(spark, sf_dir).groupBy(F.col("symbol").alias("identifier")).agg((F.sum("n_links") / 2).cast("long").alias("n")).withColumn("kind", F.lit("rpc"))
    return tables.unionByName(calls).orderBy(F.desc("n"), "kind", "identifier").limit(15)


def neighbor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "repo", "branch", "path", "start_line", "end_line")
    return G.overlapping(chunks, chunks.filter("chunk_id % 50 = 0"), 90, ["repo", "branch", "path"]).select("anchor_id", "chunk_id", "start_line")


def symbol_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within(_symbols(spark, sf_dir, "DEFINES_SYMBOL"), load(spark, sf_dir, "edges").select("path", "line", "tab"), ["path"], 20, 8).select("id", "symbol", "name", "first_line", "k")


def best_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: d.withColumn("path", F.concat_ws("/", "repo", F.concat(F.lit("d"), F.col("id") % 3), "path"))
    return G.best_definition(at(_symbols(spark, sf_dir, "CALLS_RPC_FUNC")), at(_symbols(spark, sf_dir, "DEFINES_SYMBOL")))


def graph_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _symbols(spark, sf_dir, "CALLS_RPC_FUNC").withColumn("entry", F.col("repo"))
    return G.trace(entries, _symbols(spark, sf_dir, "DEFINES_SYMBOL"), load(spark, sf_dir, "edges"))


#: Calls, handlers, remote calls, definitions, symbols, models and tables, one edge an order; keys that many share.
PATH_EDGES = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'CALLS_HTTP_ENDPOINT' WHEN 1 THEN 'HANDLES_HTTP_ENDPOINT' WHEN 2 THEN 'CALLS_RPC_FUNC' WHEN 3 THEN 'DEFINES_SYMBOL'
  WHEN 4 THEN 'CALLS_SYMBOL' WHEN 5 THEN 'DEFINES_MODEL' ELSE 'TOUCHES_TABLE' END AS type,
 CASE o_orderkey % 7 WHEN 1 THEN concat('route:', o_custkey % 97) WHEN 2 THEN concat('fn:', o_custkey % 41) WHEN 3 THEN concat('rpc:', o_custkey % 59) WHEN 4 THEN concat('fn:', o_custkey % 53)
  WHEN 5 THEN concat('sym:', o_custkey % 3) WHEN 6 THEN concat('model:', o_custkey % 71) END AS from_key,
 CASE o_orderkey % 7 WHEN 0 THEN concat('route:', o_custkey % 101) WHEN 1 THEN concat('fn:', o_custkey % 43) WHEN 2 THEN concat('rpc:', o_custkey % 61) WHEN 3 THEN concat('fn:', o_custkey % 47)
  WHEN 4 THEN concat('sym:', o_custkey % 5) WHEN 5 THEN concat('model:', o_custkey % 73) ELSE concat('table:', o_custkey) END AS to_key FROM orders"""
#: The edges followed from a call, and how many an entry keeps at each hop (fixed values).
HOPS = [("HANDLES_HTTP_ENDPOINT", 6), ("CALLS_RPC_FUNC", 12), ("DEFINES_SYMBOL", 12), ("CALLS_SYMBOL", 12), ("DEFINES_MODEL", 12), ("TOUCHES_TABLE", 16)]


def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hops from every call of an endpoint to the tables behind it."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    edges = spark.sql(PATH_EDGES.replace(" FROM orders", " FROM _orders"))
    found = G.paths(edges.filter("type = 'CALLS_HTTP_ENDPOINT'"), edges, HOPS)
    return found.select("entry", "hop", "edge", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of chunks or edges with the counts of both, zero where there are none."""
    chunks = load(spark, sf_dir, "chunks").groupBy(F.concat(F.lit("repo-"), F.regexp_extract("repo", "([0-9]+)", 1)).alias("repo")).agg(F.count("*").alias("n_chunks"))
    edges = load(spark, sf_dir, "edges").groupBy("repo").agg(F.count("*").alias("n_edges"), F.countDistinct("tab").alias("n_tables"))
    both = chunks.join(edges, "repo", "full_outer")
    return both.select("repo", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_chunks", "n_edges", "n_tables")))


def line_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks").select("repo", "path", "start_line", "content")
    return G.line_map(chunks, ["repo", "path"])


QUERIES = {f.__name__: f for f in (cross_links_rpc, cross_links_tables, links_histogram, neighbor_window, symbol_tables, best_definition, graph_trace, graph_paths, edge_counts, line_map)}

_RPC = """rpc AS (SELECT DISTINCT a.symbol, a.repo AS source_repo, b.repo AS target_repo FROM symbols a JOIN symbols b
 ON a.symbol = b.symbol AND a.repo <> b.repo WHERE a.type = 'CALLS_RPC_FUNC' AND b.type = 'DEFINES_SYMBOL')"""
_SHARED = """m AS (SELECT DISTINCT lower(tab) AS identifier, repo FROM edges),
 shared AS (SELECT identifier, repo, count(*) OVER (PARTITION BY identifier) - 1 AS n_links FROM m QUALIFY n_links > 0)"""
_AT = "repo || '/d' || id % 3 || '/' || path"


def _paths_sql() -> str:
    steps = ["h0 AS (SELECT id AS entry, 0 AS hop, id AS edge, to_key, 1 AS place, id::VARCHAR AS path FROM e WHERE type = 'CALLS_HTTP_ENDPOINT')"]
    for k, (kind, cap) in enumerate(HOPS, 1):
        before = " UNION ALL ".join(f"SELECT entry, edge FROM h{j}" for j in range(k))
        steps.append(
            f"""h{k} AS (SELECT entry, {k} AS hop, id AS edge, to_key, row_number() OVER (PARTITION BY entry ORDER BY id) AS place, path || '>' || id AS path
 FROM (SELECT entry, id, e.to_key, path FROM h{k - 1} f JOIN e ON e.type = '{kind}' AND e.from_key = f.to_key
  WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.entry = f.entry AND b.edge = e.id) QUALIFY row_number() OVER (PARTITION BY entry, id ORDER BY f.place) = 1)
 QUALIFY place <= {cap})"""
        )
    rows = " UNION ALL ".join(f"SELECT entry, hop, edge, path FROM h{k}" for k in range(len(HOPS) + 1))
    return f"WITH e AS MATERIALIZED ({PATH_EDGES}), {', '.join(steps)} {rows}"


ORACLE = {
    "graph_paths": _paths_sql(),
    "cross_links_rpc": with_sql(
        f"""WITH {_RPC}, e AS (SELECT symbol, source_repo AS repo, target_repo AS other FROM rpc UNION ALL SELECT symbol, target_repo, source_repo FROM rpc)
        SELECT symbol, repo, (count(*) FILTER (WHERE calls) > 0)::INT AS calls, (count(*) FILTER (WHERE NOT calls) > 0)::INT AS defines, n_links
        FROM (SELECT symbol, repo, count(*) AS n_links FROM e GROUP BY ALL) JOIN (SELECT symbol, repo, type = 'CALLS_RPC_FUNC' AS calls FROM symbols) USING (symbol, repo) GROUP BY symbol, repo, n_links"""
    ),
    "cross_links_tables": with_sql(f"WITH {_SHARED} SELECT * FROM shared"),
    "links_histogram": with_sql(
        f"""WITH {_RPC}, {_SHARED} SELECT * FROM (SELECT identifier, (sum(n_links) // 2)::BIGINT AS n, 'table' AS kind FROM shared GROUP BY identifier
        UNION ALL SELECT symbol, count(*), 'rpc' FROM rpc GROUP BY symbol) ORDER BY n DESC, kind, identifier LIMIT 15"""
    ),
    "neighbor_window": with_sql(
        """SELECT a.chunk_id AS anchor_id, c.chunk_id, c.start_line FROM chunks a JOIN chunks c USING (repo, branch, path)
        WHERE a.chunk_id % 50 = 0 AND c.end_line >= a.start_line - 90 AND c.start_line <= a.end_line + 90"""
    ),
    "symbol_tables": with_sql(
        """SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_line, name) AS k FROM (SELECT s.id, s.symbol, e.tab AS name, min(e.line) AS first_line
        FROM symbols s JOIN edges e ON s.path = e.path AND e.line BETWEEN s.line AND s.line + 20 WHERE s.type = 'DEFINES_SYMBOL' GROUP BY ALL) QUALIFY k <= 8"""
    ),
    "best_definition": with_sql(
        f"""WITH s AS (SELECT *, string_split({_AT}, '/') AS p FROM symbols),
        j AS (SELECT a.id, b.id AS definition_id, CASE WHEN a.p[1] <> b.p[1] THEN 0 WHEN a.p[2] <> b.p[2] THEN 1 WHEN a.p[3] <> b.p[3] THEN 2 ELSE 3 END AS score
        FROM s a JOIN s b USING (symbol) WHERE a.type = 'CALLS_RPC_FUNC' AND b.type = 'DEFINES_SYMBOL')
        SELECT id, definition_id, score FROM j WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, definition_id) = 1"""
    ),
    "graph_trace": with_sql(
        """WITH r AS (SELECT DISTINCT a.repo AS entry, b.repo AS target FROM symbols a JOIN symbols b USING (symbol) WHERE a.type = 'CALLS_RPC_FUNC' AND b.type = 'DEFINES_SYMBOL'),
        t AS (SELECT repo AS target, count(DISTINCT tab) AS n, min(tab) AS f FROM edges GROUP BY repo)
        SELECT entry, count(*) AS n_repos, sum(n)::BIGINT AS n_tables, min(f) AS first_table FROM r JOIN t USING (target) GROUP BY entry"""
    ),
    "edge_counts": with_sql(
        """WITH c AS (SELECT 'repo-' || regexp_extract(repo, '([0-9]+)', 1) AS repo, count(*) AS n FROM chunks GROUP BY 1),
        e AS (SELECT repo, count(*) AS n, count(DISTINCT tab) AS t FROM edges GROUP BY repo)
        SELECT coalesce(c.repo, e.repo) AS repo, coalesce(c.n, 0) AS n_chunks, coalesce(e.n, 0) AS n_edges, coalesce(t, 0) AS n_tables FROM c FULL JOIN e ON c.repo = e.repo"""
    ),
    "line_map": with_sql(
        """WITH l AS (SELECT repo, path, start_line, unnest(string_split(content, chr(10))) AS text, start_line + generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM chunks)
        SELECT repo, path, line, text FROM l QUALIFY row_number() OVER (PARTITION BY repo, path, line ORDER BY start_line, text) = 1"""
    ),
}
