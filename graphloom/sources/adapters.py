"""The property graph that the test tables hold: nodes and edges with the five relations of the data model."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph_store import StoredGraph
from graphloom.session import files_version, kept_until_end, table

NODE_TABLES = (("region", "r_regionkey", "r_name", "r_regionkey"), ("nation", "n_nationkey", "n_name", "n_regionkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"), ("customer", "c_custkey", "c_name", "c_nationkey"), ("part", "p_partkey", "p_name", None), ("order", "o_orderkey", "o_orderpriority", None))
#: (relation, table, source kind, source key, target kind, target key)
EDGE_TABLES = (
    ("method", "nation", "nation", "n_nationkey", "region", "n_regionkey"),
    ("imports_from", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ("imports_from", "customer", "customer", "c_custkey", "nation", "c_nationkey"),
    ("contains", "orders", "customer", "o_custkey", "order", "o_orderkey"),
    ("calls", "lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
    ("imports", "lineitem", "order", "l_orderkey", "part", "l_partkey"),
)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, kind, source_file and community of every row of the entity tables."""
    out = None
    for kind, key, label, community in NODE_TABLES:
        t = table(spark, sf_dir, "orders" if kind == "order" else kind)
        group = F.col(community).cast("int") if community else F.lit(None).cast("int")
        rows = t.select(F.concat(F.lit(f"{kind}|"), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"), F.lit(f"{kind}.parquet").alias("source_file"), group.alias("community"))
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_edges(spark: SparkSession, sf_dir: str, relations=None) -> DataFrame:
    """source, target and relation, each once; only the tables of ``relations`` are read."""
    out = None
    for relation, name, a, a_key, b, b_key in EDGE_TABLES:
        if relations is not None and relation not in relations:
            continue
        end = lambda kind, key: F.concat(F.lit(f"{kind}|"), F.col(key).cast("string"))
        t = table(spark, sf_dir, name).select(a_key, b_key)
        rows = (t.distinct() if name == "lineitem" else t).select(end(a, a_key).alias("source"), end(b, b_key).alias("target"), F.lit(relation).alias("relation"))
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_graph(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """The whole graph in a store of this application, opened if the tables' files are those it was built from, else brought up to date."""
    store = StoredGraph(spark, kept_until_end(spark, "graph-" + hashlib.sha256(sf_dir.encode()).hexdigest()[:12]), int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = {name for _, name, *_ in EDGE_TABLES} | {"orders" if kind == "order" else kind for kind, *_ in NODE_TABLES}
    store.open_or_rebuild(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), files_version(spark, [f"{sf_dir}/{x}.parquet" for x in sorted(names)]))
    return store


def supplier_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A functional graph with cycles: supplier s calls supplier (7 s + 3) mod n."""
    t = table(spark, sf_dir, "supplier")
    n = t.agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").cast("string").alias("source"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).cast("string").alias("target"), F.lit("calls").alias("relation"))


def code_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A code graph with symbol keys that the tables hold: suppliers are classes, parts their members, customers functions in 40 files, some of tests.

    nodes, edges (legacy, between node ids), native (between keys), bindings, roles and index, with a few ambiguous, contradictory and wrongly
    bound nodes, constructors, explicit null roles, and calls in cycles.
    """
    text = lambda x: x.cast("string")
    s, p, c = F.col("s_suppkey"), F.col("p_partkey"), F.col("c_custkey")
    key = lambda path, kind, scope, name: F.concat(F.lit("ts|"), path, F.lit(f"|{kind}|"), scope, F.lit("|"), name, F.lit("|0"))
    s_path = lambda n: F.concat(F.lit("src/s"), text(n % 25), F.lit(".ts"))
    c_path = lambda n: F.when(n % 40 < 4, F.concat(F.lit("tests/c"), text(n % 40), F.lit(".test.ts"))).otherwise(F.concat(F.lit("src/c"), text(n % 40), F.lit(".ts")))
    s_key = lambda n: key(s_path(n), "class", F.lit("exported"), F.concat(F.lit("S"), text(n)))
    p_name = lambda n: F.concat(F.lit("S"), text(n % 50), F.when((n < 50) & (n % 7 == 0), ".constructor").otherwise(F.concat(F.lit(".m"), text(n))))
    p_key = lambda n: key(s_path(n % 50), "method", F.lit("member"), p_name(n))
    c_key = lambda n: key(c_path(n), "function", F.when(n % 2 == 0, "exported").otherwise("local"), F.concat(F.lit("f"), text(n)))
    none = F.lit(None).cast("string")

    def node(df, id_, kind, node_kind, path, own, meta=none):
        return df.select(id_.alias("id"), own.alias("label"), F.lit(kind).alias("kind"), F.lit(node_kind).alias("node_kind"), path.alias("source_file"), own.alias("symbol_key"), meta.alias("meta_key"))

    supplier, part, customer, lines = (table(spark, sf_dir, t) for t in ("supplier", "part", "customer", "lineitem"))
    nodes = node(supplier, F.concat(F.lit("sup"), text(s)), "class", "symbol", s_path(s), s_key(s), F.when(s % 11 == 0, "other").otherwise(s_key(s)))
    nodes = nodes.unionByName(node(part, F.concat(F.lit("part"), text(p)), "method", "member", s_path(p % 50), p_key(p)))
    nodes = nodes.unionByName(node(customer, F.concat(F.lit("cust"), text(c)), "function", "symbol", c_path(c), c_key(c))).unionByName(node(customer.where(c % 97 == 0), F.concat(F.lit("dup"), text(c)), "function", "symbol", c_path(c), c_key(c)))
    files = nodes.select("source_file").unionByName(spark.createDataFrame([("src/empty.ts",)], "source_file string")).distinct()
    nodes = nodes.unionByName(files.select(F.concat(F.lit("file|"), "source_file").alias("id"), F.col("source_file").alias("label"), none.alias("kind"), F.lit("file").alias("node_kind"), "source_file", none.alias("symbol_key"), none.alias("meta_key")))
    caller, callee, n = F.col("l_orderkey") % 150 + 1, F.col("l_partkey"), F.col("l_linenumber")
    cust_id, part_id = F.concat(F.lit("cust"), text(caller)), F.concat(F.lit("part"), text(callee))
    edge = lambda df, a, b, r: df.select(a.alias("source"), b.alias("target"), F.lit(r).alias("relation")).distinct()
    edges = edge(lines.where(n == 1), cust_id, part_id, "calls").unionByName(edge(lines.where((n == 3) & (callee % 5 == 0)), part_id, cust_id, "calls"))
    edges = edges.unionByName(edge(part, F.concat(F.lit("sup"), text(p % 50)), F.concat(F.lit("part"), text(p)), "method"))
    own_file = lambda path: F.concat(F.lit("file|"), path)
    native = edge(lines.where((n == 2) & (caller % 3 == 0)), c_key(caller), p_key(callee), "calls").unionByName(edge(lines.where(n == 4), own_file(c_path(caller)), own_file(s_path(callee % 50)), "imports"))
    native = native.unionByName(edge(supplier, own_file(s_path(s)), own_file(s_path((s % 25) * 3 + 1)), "imports"))
    bindings = supplier.select(own_file(c_path(s)).alias("source_id"), F.when(s % 13 != 0, s_key(s)).alias("target"))
    rank = lambda df, id_, role, layer: df.select(id_.alias("id"), role.alias("role"), layer.alias("layer"))
    roles = rank(supplier.where(s % 4 < 3), s_key(s), F.when(s % 4 == 0, "controller").when(s % 4 == 1, "service"), F.when(s % 4 == 0, "presentation").when(s % 4 == 1, "application"))
    roles = roles.unionByName(rank(part.where(p % 100 < 2), p_key(p), F.when(p % 100 == 0, "cli-command"), F.when(p % 100 == 0, "entrypoint"))).unionByName(rank(customer.where(c % 10 < 2), c_key(c), F.when(c % 10 == 0, "entrypoint").otherwise("controller"), F.when(c % 10 == 0, "entrypoint")))
    roles = roles.unionByName(spark.createDataFrame([("file|src/c5.ts", "cli", "entrypoint")], "id string, role string, layer string"))
    index = supplier.select(s_key(s).alias("symbol_key"), F.when(s % 7 == 0, "elsewhere").when(s % 2 == 0, F.concat(F.lit("sup"), text(s))).alias("graph_node_id"))
    return {"nodes": nodes, "edges": edges, "native": native, "bindings": bindings, "roles": roles, "index": index}


NODES_SQL = "\nUNION ALL ".join(
    f"SELECT '{kind}|' || {key} AS id, {label} AS label, '{kind}' AS kind, '{kind}.parquet' AS source_file, {f'CAST({community} AS INT)' if community else 'CAST(NULL AS INT)'} AS community FROM {'orders' if kind == 'order' else kind}" for kind, key, label, community in NODE_TABLES
)
EDGES_SQL = "\nUNION ALL ".join(f"SELECT DISTINCT '{a}|' || {ak} AS source, '{b}|' || {bk} AS target, '{r}' AS relation FROM {t}" for r, t, a, ak, b, bk in EDGE_TABLES)
GRAPH_SQL = f"nodes AS ({NODES_SQL}),\nedges AS ({EDGES_SQL})"
RING_SQL = "ring AS (SELECT CAST(s_suppkey AS VARCHAR) AS source, CAST((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS VARCHAR) AS target FROM supplier)"

_S_PATH = "'src/s' || ({n}) % 25 || '.ts'"
_C_PATH = "CASE WHEN ({n}) % 40 < 4 THEN 'tests/c' || ({n}) % 40 || '.test.ts' ELSE 'src/c' || ({n}) % 40 || '.ts' END"


def s_path_sql(n):
    return "(" + _S_PATH.format(n=n) + ")"


def c_path_sql(n):
    return "(" + _C_PATH.format(n=n) + ")"


def s_key_sql(n):
    return f"('ts|' || {s_path_sql(n)} || '|class|exported|S' || ({n}) || '|0')"


def p_key_sql(n):
    return f"('ts|' || {s_path_sql(f'({n}) % 50')} || '|method|member|S' || ({n}) % 50 || CASE WHEN ({n}) < 50 AND ({n}) % 7 = 0 THEN '.constructor' ELSE '.m' || ({n}) END || '|0')"


def c_key_sql(n):
    return f"('ts|' || {c_path_sql(n)} || '|function|' || CASE WHEN ({n}) % 2 = 0 THEN 'exported' ELSE 'local' END || '|f' || ({n}) || '|0')"


_L = "l_orderkey % 150 + 1"
#: The same code graph: symbols (canonical ones), walk (native override), imports, bindings, roles, keyed edges.
CODE_SQL = f"""groups AS (SELECT {s_key_sql('s_suppkey')} AS symbol_key, 'sup' || s_suppkey AS node_id, {s_path_sql('s_suppkey')} AS path, 'class' AS kind, 'exported' AS scope, 'S' || s_suppkey AS name, 'symbol' AS node_kind, CAST(NULL AS VARCHAR) AS container FROM supplier WHERE s_suppkey % 11 <> 0
UNION ALL SELECT {p_key_sql('p_partkey')}, 'part' || p_partkey, {s_path_sql('p_partkey % 50')}, 'method', 'member', string_split({p_key_sql('p_partkey')}, '|')[5], 'member', 'S' || p_partkey % 50 FROM part
UNION ALL SELECT {c_key_sql('c_custkey')}, 'cust' || c_custkey, {c_path_sql('c_custkey')}, 'function', CASE WHEN c_custkey % 2 = 0 THEN 'exported' ELSE 'local' END, 'f' || c_custkey, 'symbol', NULL FROM customer
UNION ALL SELECT {c_key_sql('c_custkey')}, 'dup' || c_custkey, {c_path_sql('c_custkey')}, 'function', CASE WHEN c_custkey % 2 = 0 THEN 'exported' ELSE 'local' END, 'f' || c_custkey, 'symbol', NULL FROM customer WHERE c_custkey % 97 = 0),
symbols AS (SELECT * FROM groups WHERE symbol_key IN (SELECT symbol_key FROM groups GROUP BY 1 HAVING count(*) = 1) AND NOT (kind = 'class' AND TRY_CAST(substr(name, 2) AS INT) % 7 = 0)),
native AS (SELECT DISTINCT {c_key_sql(_L)} AS source, {p_key_sql('l_partkey')} AS target FROM lineitem WHERE l_linenumber = 2 AND ({_L}) % 3 = 0),
mapped AS (SELECT a.node_id AS source, b.node_id AS target, contains(n.target, '.constructor|') AS made FROM native n JOIN symbols a ON a.symbol_key = n.source JOIN symbols b ON b.symbol_key = n.target),
legacy AS (SELECT DISTINCT 'cust' || ({_L}) AS source, 'part' || l_partkey AS target FROM lineitem WHERE l_linenumber = 1 UNION SELECT 'part' || l_partkey, 'cust' || ({_L}) FROM lineitem WHERE l_linenumber = 3 AND l_partkey % 5 = 0),
walk AS (SELECT DISTINCT * FROM (SELECT source, target, 'calls' AS relation FROM legacy WHERE source NOT IN (SELECT source FROM mapped) UNION ALL SELECT source, target, 'calls' FROM mapped WHERE NOT made UNION ALL SELECT 'sup' || p_partkey % 50, 'part' || p_partkey, 'method' FROM part)),
keyed AS (SELECT a.symbol_key AS source, b.symbol_key AS target, relation FROM walk w JOIN symbols a ON a.node_id = w.source JOIN symbols b ON b.node_id = w.target),
imports AS (SELECT DISTINCT {c_path_sql(_L)} AS source, {s_path_sql('l_partkey % 50')} AS target FROM lineitem WHERE l_linenumber = 4 UNION SELECT {s_path_sql('s_suppkey')}, {s_path_sql('(s_suppkey % 25) * 3 + 1')} FROM supplier),
bindings AS (SELECT DISTINCT {c_path_sql('s_suppkey')} AS path, {s_key_sql('s_suppkey')} AS symbol_key FROM supplier WHERE s_suppkey % 13 <> 0 AND {s_key_sql('s_suppkey')} IN (SELECT symbol_key FROM symbols)),
assigned AS (SELECT {s_key_sql('s_suppkey')} AS id, CASE s_suppkey % 4 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' END AS role, CASE s_suppkey % 4 WHEN 0 THEN 'presentation' WHEN 1 THEN 'application' END AS layer FROM supplier WHERE s_suppkey % 4 < 3
UNION ALL SELECT {p_key_sql('p_partkey')}, CASE WHEN p_partkey % 100 = 0 THEN 'cli-command' END, CASE WHEN p_partkey % 100 = 0 THEN 'entrypoint' END FROM part WHERE p_partkey % 100 < 2
UNION ALL SELECT {c_key_sql('c_custkey')}, CASE WHEN c_custkey % 10 = 0 THEN 'entrypoint' ELSE 'controller' END, CASE WHEN c_custkey % 10 = 0 THEN 'entrypoint' END FROM customer WHERE c_custkey % 10 < 2
UNION ALL SELECT 'file|src/c5.ts', 'cli', 'entrypoint'),
owners AS (SELECT m.symbol_key AS member, c.symbol_key AS owner FROM symbols m JOIN symbols c ON c.path = m.path AND c.name = m.container AND c.kind = 'class'),
effective AS (SELECT * FROM (SELECT * FROM assigned WHERE id IN (SELECT symbol_key FROM symbols) OR id LIKE 'file|%' UNION ALL SELECT o.member, a.role, a.layer FROM owners o JOIN assigned a ON a.id = o.owner WHERE o.member NOT IN (SELECT id FROM assigned)) WHERE role IS NOT NULL)"""
