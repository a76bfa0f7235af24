"""Inputs of the queries, derived from the given tables by SQL text that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read, spread

_Q = "chr(39)"
#: A source file of the repository of a part: routes, a handler, SQL, environment, queue, call, schedule and a rule.
CODE = f"""concat_ws(chr(10),
 concat('const ROUTE_', p_partkey, ' = ', {_Q}, '/api/part/', p_partkey, {_Q}, ';'),
 concat('app.get(', {_Q}, '/api/part/', p_partkey, {_Q}, ', handlePart', p_partkey, ');'),
 concat('async function handlePart', p_partkey, '(req) {{'),
 concat('  const rows = await db.query(', {_Q}, 'SELECT * FROM ', lower(replace(replace(p_brand, '#', '_'), ' ', '_')), '_items WHERE size = ', p_size, {_Q}, ');'),
 concat('  await db.query(', {_Q}, 'UPDATE part_', p_size, ' SET seen = 1', {_Q}, ');'),
 concat('  const limit = process.env.MAX_', p_size, ' || ', {_Q}, p_size, {_Q}, ';'),
 concat('  channel.sendToQueue(', {_Q}, 'queue.', p_size, '.jobs', {_Q}, ', rows);'),
 concat('  const more = await axios.get(', {_Q}, 'http://svc-', p_size, '/v1/items', {_Q}, ');'),
 concat('  return rpc.call(', {_Q}, 'getPart', p_size, {_Q}, ');'),
 '}}',
 concat('cron.schedule(', {_Q}, '*/', p_size, ' * * * *', {_Q}, ', handlePart', p_partkey, ');'),
 concat('// limit must not exceed ', p_size, ' items for ', p_type))"""

FILES = f"""SELECT p_partkey AS file_id, concat('repo-', p_size % 7) AS repo, concat('src/', lower(replace(p_brand, '#', '_')), '/part', p_partkey,
 CASE p_partkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.php' WHEN 2 THEN '.sql' WHEN 3 THEN '.md' ELSE '.go' END) AS path, {CODE} AS content FROM part"""

#: Documents as chunks with a place in a repository; text by lines.
CHUNKS = """SELECT doc_id AS chunk_id, source AS repo, lang AS branch, concat(source, '/', lang, '/', doc_id % 40, '.md') AS path, text AS content,
 doc_id % 100 * 10 + 1 AS start_line, doc_id % 100 * 10 + 12 AS end_line FROM documents"""

#: Relationship edges: a supplier (repository) touches a part (table) in an order (file) at a line.
EDGES = """SELECT concat(l_orderkey, ':', l_linenumber) AS id, 'TOUCHES_TABLE' AS type, concat('repo-', l_suppkey % 40) AS repo, concat('file-', l_orderkey) AS path,
 l_linenumber * 10 AS line, concat('table_', l_partkey % 300) AS tab FROM lineitem"""

#: Symbols: an order defines, a customer's later order calls.
SYMBOLS = """SELECT o_orderkey AS id, concat('repo-', o_orderkey % 40) AS repo, concat('file-', o_orderkey) AS path, o_orderkey % 4 * 10 AS line,
 concat('func_', o_custkey) AS symbol, CASE WHEN o_orderstatus = 'O' THEN 'CALLS_RPC_FUNC' ELSE 'DEFINES_SYMBOL' END AS type FROM orders"""

_SOURCES = {"files": (FILES, "part"), "chunks": (CHUNKS, "documents"), "edges": (EDGES, "lineitem"), "symbols": (SYMBOLS, "orders")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of files, chunks, edges and symbols."""
    sql, base = _SOURCES[name]
    rows = read(spark, sf_dir, base)
    (spread(rows) if name == "files" else rows).createOrReplaceTempView(f"_{base}")  # a part is a whole file
    return spark.sql(sql.replace(f" FROM {base}", f" FROM _{base}"))


def with_sql(query: str) -> str:
    """DuckDB SQL with the fixtures it names as common table expressions."""
    used = [f"{name} AS ({sql})" for name, (sql, _) in _SOURCES.items() if name in query]
    body = query.strip()
    if body.startswith("WITH "):
        return f"WITH {', '.join(used)}, {body[5:]}" if used else body
    return f"WITH {', '.join(used)} {body}" if used else body
