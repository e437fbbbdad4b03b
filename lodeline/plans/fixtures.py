"""Graphs and path tables as views over the test tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph, dealt

NODES = """
SELECT concat('r', r_regionkey) AS id, 'FILE' AS type, r_name AS name, concat('core/r', r_regionkey) AS path, r_name AS fqn FROM region
UNION ALL SELECT concat('n', n_nationkey), 'FILE', n_name, concat('core/r', n_regionkey, '/n', n_nationkey), n_name FROM nation
UNION ALL SELECT concat('s', s_suppkey), 'FILE', s_name, concat('core/r', n_regionkey, '/n', n_nationkey, '/s', s_suppkey), s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('c', c_custkey), 'CLASS', c_name, concat('core/r', n_regionkey, '/n', n_nationkey, '/c', c_custkey), c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('o', o_orderkey), 'FUNCTION', concat('order', o_orderkey), concat('core/r', n_regionkey, '/n', n_nationkey, '/o', o_orderkey), concat('order', o_orderkey)
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('p', p_partkey), 'INTERFACE', p_name, concat('lib/', p_brand, '/p', p_partkey), p_name FROM part
"""
EDGES = """
SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst, 'CONTAINS' AS type, CAST(1.0 AS DOUBLE) AS confidence, 'parsed' AS method FROM nation
UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), 'CONTAINS', CAST(1.0 AS DOUBLE), 'parsed' FROM customer
UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), 'CONTAINS', CAST(1.0 AS DOUBLE), 'parsed' FROM supplier
UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey), 'EXTENDS', CAST(1.0 AS DOUBLE), 'parsed' FROM orders
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'IMPORTS', CAST(1.0 AS DOUBLE), 'path' FROM supplier
UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), 'CALLS',
    CAST(CASE WHEN l_partkey % 3 = 0 THEN 0.5 WHEN l_partkey % 3 = 1 THEN 0.8 ELSE 1.0 END AS DOUBLE), CASE WHEN l_partkey % 3 = 0 THEN 'ambiguous_name' WHEN l_partkey % 3 = 1 THEN 'global_name' ELSE 'file_local_match' END
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) AS calls
"""
#: With three dead edges.
INJECTED = EDGES + """
UNION ALL SELECT 'missing1', 'n1', 'IMPORTS', CAST(1.0 AS DOUBLE), 'path' UNION ALL SELECT 'n1', 'missing2', 'IMPORTS', CAST(1.0 AS DOUBLE), 'path' UNION ALL SELECT 'missing3', 'missing4', 'CALLS', CAST(1.0 AS DOUBLE), 'path'
"""
#: A digraph with cycles over the parts, in blocks of 50, eight of which lead one into the next; and labels of some parts. It grows with the table.
_RING = "SELECT p_partkey AS k, p_partkey % 50 AS i, CAST(floor(p_partkey / 50) AS BIGINT) AS b FROM part"
RING = f"""
SELECT concat('p', k) AS src, concat('p', b * 50 + CAST(floor((3 * i + 1 + b % 7) / 2) AS BIGINT) % 50) AS dst FROM ({_RING}) AS x WHERE i % 5 <> 0
UNION SELECT concat('p', k), concat('p', k + 1) FROM ({_RING}) AS x WHERE (i % 4 = 1 AND i < 49) OR (i = 49 AND b % 8 <> 7)
"""
SEEDS = "SELECT concat('p', p_partkey) AS id, concat('R', CAST(floor(p_partkey / 60) AS BIGINT) % 5) AS label FROM part WHERE p_partkey % 60 = 0"
#: The same digraph with types by block, and its nodes with a path.
RING_TYPED = f"SELECT src, dst, CASE WHEN CAST(floor(CAST(substr(src, 2) AS BIGINT) / 50) AS BIGINT) % 2 = 0 THEN 'CALLS' ELSE 'IMPORTS' END AS type FROM ({RING}) AS r"
RING_FILES = "SELECT concat('p', p_partkey) AS id, 'FUNCTION' AS type, p_name AS name, concat('b', CAST(floor(p_partkey / 50) AS BIGINT), '/', p_partkey % 50) AS path, concat('p', p_partkey) AS fqn FROM part"
RING_NODES = "SELECT concat('p', p_partkey) AS id FROM part"
#: Paths of page URLs, without host and query.
PATHS = "SELECT DISTINCT path FROM (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') AS path FROM pages) AS p WHERE path <> ''"

#: Names as dependencies, requirement lines, references, rules of a vault and new ones, a row or more for each part; external symbols; includes.
REQUIREMENTS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat(replace(p_name, ' ', '-'), '==1.', p_partkey) WHEN 1 THEN concat('  ', replace(p_name, ' ', '_'), '[extra]>=2 # why')
    WHEN 2 THEN '# a comment' WHEN 3 THEN concat('-r other', p_partkey, '.txt') WHEN 4 THEN concat('https://x.org/', p_partkey, '.whl') WHEN 5 THEN '   ' WHEN 6 THEN concat(upper(replace(p_name, ' ', '.')), ' ; python_version < "4"')
    ELSE concat(replace(p_name, ' ', ''), ' @ https://x.org/y.whl') END AS line FROM part"""
PART_ENTITIES = "SELECT DISTINCT concat('lib.', replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_')) AS fqn FROM part"
PART_REFS = """SELECT DISTINCT module, symbol FROM (
    SELECT concat('lib.', replace(p_brand, '#', '')) AS module, replace(p_name, ' ', '_') AS symbol FROM part
    UNION ALL SELECT 'main', replace(p_name, ' ', '_') FROM part UNION ALL SELECT 'main', concat(replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_')) FROM part
    UNION ALL SELECT 'main', concat('missing', p_partkey % 100) FROM part) AS r"""
EXTERNALS = """SELECT concat('x', p_partkey) AS id, CASE WHEN p_partkey % 9 = 0 THEN 'FUNCTION' ELSE 'UNRESOLVED_EXTERNAL' END AS type,
    CASE WHEN p_partkey % 5 = 0 THEN 'len' WHEN p_partkey % 5 = 1 THEN 'Promise' ELSE p_name END AS name, '' AS path, p_name AS fqn FROM part"""
PART_VAULT = """SELECT concat('v', p_partkey) AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('n', p_partkey) END AS name, p_brand AS category, concat('use ', p_name, ' ', p_partkey) AS rule,
    CAST(0.5 + p_partkey % 5 / 10.0 AS DOUBLE) AS confidence, 'user' AS source, '2024-01-01' AS created_at FROM part WHERE p_partkey % 3 <> 0"""
PART_RULES = """SELECT concat('n', p_partkey) AS name, p_brand AS category, CASE WHEN p_partkey % 2 = 0 THEN concat('use ', p_name, ' ', p_partkey) ELSE concat('avoid ', p_name, ' ', p_partkey) END AS rule,
    CAST(0.7 AS DOUBLE) AS confidence, 'auto' AS source, '2024-02-01' AS created_at FROM part"""
INCLUDES = "SELECT concat('f', p_partkey) AS src, concat('f', p_partkey * 2) AS dst FROM part UNION ALL SELECT concat('f', p_partkey), concat('f', p_partkey * 2 + 1) FROM part WHERE p_partkey % 3 <> 0"

FILES = "SELECT * FROM (VALUES ('src/x.ts'), ('src/x.py'), ('src/u.py'), ('src/u/index.ts'), ('src/v/__init__.py')) AS t(path)"
IMPORTS = "SELECT * FROM (VALUES ('m.py', 'src/x'), ('m.py', 'src/u'), ('m.py', 'src/v'), ('m.py', 'nope'), ('m.py', 'src/x.py')) AS t(src, module)"
ENTITIES = "SELECT * FROM (VALUES ('m.a.Foo'), ('m.b.Foo'), ('m.b.Bar')) AS t(fqn)"
REFS = "SELECT * FROM (VALUES ('m.a', 'Foo'), ('m.c', 'Foo'), ('m.c', 'Bar'), ('m.c', 'b.Bar'), ('m.c', 'zzz')) AS t(module, symbol)"
VAULT = """SELECT * FROM (VALUES ('1', 'naming', 'style', 'use snake case', 0.8, 'user', '2024-01-01'), ('2', 'tests', 'quality', 'write tests', 0.9, 'user', '2024-01-01'),
    ('3', CAST(NULL AS {string}), 'style', 'no globals', 0.5, 'auto', '2024-01-01')) AS t(id, name, category, rule, confidence, source, created_at)"""
NEW_RULES = """SELECT * FROM (VALUES ('naming', 'style', 'use camel case', 0.7, 'auto', '2024-02-01'), ('tests', 'quality', 'write tests', 0.6, 'auto', '2024-02-01'),
    ('globals', 'style', 'no globals', 0.9, 'auto', '2024-02-01'), ('docs', 'quality', 'write docs', 0.7, 'auto', '2024-02-01')) AS t(name, category, rule, confidence, source, created_at)"""


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(text)


def graph(spark: SparkSession, sf_dir: str, injected: bool = False) -> Graph:
    """G1; injected: with dead edges."""
    views(spark, sf_dir, "region", "nation", "supplier", "customer", "orders", "part", "lineitem")
    size = sum(spark.table(t).count() for t in ("supplier", "customer", "orders", "part", "lineitem"))  # of the files' footers
    calls = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    dealt(calls, size, "l_orderkey", "l_partkey").createOrReplaceTempView("lineitem")  # DISTINCT then needs no shuffle of a fixed number of tasks
    return Graph(spark.sql(NODES), spark.sql(INJECTED if injected else EDGES), size)
