"""Graph queries over the graph that the test tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import cards, graph, relations
from graphloom.plans.registering import Registry
from graphloom.session import Scratch, table
from graphloom.sources.adapters import GRAPH_SQL, RING_SQL, graph_edges, graph_nodes, stored_graph, supplier_ring

FOUND = Registry()
SEED, ORDER = "customer|1", "order|7"


def hops_sql(seeds: str, hops: int, direction: str = "out", where: str = "true", node_where: str = "true") -> str:
    """Breadth-first hops as one CTE a hop."""
    a, b = ("source", "target") if direction == "out" else ("target", "source")
    steps = [f"s0 AS (SELECT id, 0 AS hop FROM nodes WHERE id IN ({seeds}) AND {node_where})"]
    for k in range(1, hops + 1):
        steps.append(f"n{k} AS (SELECT DISTINCT e.{b} AS id, {k} AS hop FROM edges e JOIN s{k - 1} f ON e.{a} = f.id AND f.hop = {k - 1} JOIN nodes ON nodes.id = e.{b} WHERE {where} AND {node_where} AND e.{b} NOT IN (SELECT id FROM s{k - 1}))")
        steps.append(f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM n{k})")
    return f"WITH {GRAPH_SQL},\n" + ",\n".join(steps)


def plain(name: str, sql: str):
    return FOUND(name, f"WITH {GRAPH_SQL}\n{sql}")


@plain("node_by_id", f"SELECT id, label, kind FROM nodes WHERE id = '{SEED}'")
def node_by_id(spark, d):
    return graph.node_by_id(graph_nodes(spark, d), SEED).select("id", "label", "kind")


@plain("nodes_by_file", "SELECT id, label FROM nodes WHERE source_file = 'supplier.parquet'")
def nodes_by_file(spark, d):
    return graph.nodes_by_file(graph_nodes(spark, d), "supplier.parquet").select("id", "label")


@plain("edge_type_filter", "SELECT * FROM edges WHERE relation IN ('imports', 'imports_from')")
def edge_type_filter(spark, d):
    from graphloom.functions.keys import focus_relations

    return graph_edges(spark, d, focus_relations("dependencies"))


@plain("edge_scan", "SELECT * FROM edges WHERE relation = 'calls' AND target = 'supplier|3'")
def edge_scan(spark, d):
    return graph.edge_scan(graph_edges(spark, d), "calls", target="supplier|3")


@plain("incident_edges", f"SELECT * FROM edges WHERE source = '{SEED}' OR target = '{SEED}'")
def incident_edges(spark, d):
    return graph.incident_edges(graph_edges(spark, d), SEED)


def khop(k, direction="out", seeds=(SEED,), relations_=None, kinds=None):
    names = ", ".join(f"'{s}'" for s in seeds)
    where = f"e.relation IN ({', '.join(repr(r) for r in relations_)})" if relations_ else "true"
    node = f"nodes.kind IN ({', '.join(repr(r) for r in kinds)})" if kinds else "true"
    sql = hops_sql(names, k, direction, where, node) + f"\nSELECT id, hop FROM s{k}"

    def run(spark, d):
        g = stored_graph(spark, d)
        return graph.traverse(spark, g.read("nodes"), None, seeds, k, relations_, direction, kinds, walk=g.read(direction)).select("id", "hop")

    return sql, run


for _name, _args in {
    "khop_out_1": (1,), "khop_out_2": (2,), "khop_out_3": (3,), "khop_in_2": (2, "in", ("supplier|3",)), "khop_multi_seed": (2, "out", (SEED, "customer|2", "order|1", "missing|1")),
    "khop_relations": (3, "out", (SEED,), ("contains", "imports")), "khop_kind_filtered": (3, "out", (SEED,), None, ("customer", "order", "part")),
}.items():
    _sql, _f = khop(*_args)
    FOUND(_name, _sql)(_f)


@FOUND("khop_tree_edges", hops_sql(f"'{SEED}'", 2) + """
SELECT s2.id, s2.hop, arg_min(e.source, e.source || '~' || e.relation) AS source, min(e.source || '~' || e.relation) AS by_edge
FROM s2 JOIN edges e ON e.target = s2.id JOIN s2 p ON p.id = e.source AND p.hop = s2.hop - 1 GROUP BY s2.id, s2.hop""")
def khop_tree_edges(spark, d):
    g = stored_graph(spark, d)
    rows = graph.traverse(spark, g.read("nodes"), None, [SEED], 2, walk=g.read("out")).where("hop > 0")
    return rows.select("id", "hop", "source", F.concat_ws("~", "source", "relation").alias("by_edge"))


@plain("dual_source_edges", """, native AS (SELECT * FROM edges WHERE relation = 'calls' AND length(source) % 2 = 0 AND target LIKE '%1')
SELECT DISTINCT * FROM (SELECT * FROM edges WHERE relation <> 'calls' OR source NOT IN (SELECT source FROM native) UNION ALL SELECT * FROM native)""")
def dual_source_edges(spark, d):
    edges = graph_edges(spark, d)
    native = edges.where("relation = 'calls' and length(source) % 2 = 0 and target like '%1'")
    return graph.dual_source_edges(edges, native)


@FOUND("reachable_edges", hops_sql(f"'{SEED}'", 1) + "\nSELECT DISTINCT e.* FROM edges e JOIN s1 ON e.source = s1.id")
def reachable_edges(spark, d):
    return graph.reachable_edges(spark, graph_edges(spark, d), [SEED], 2)


@FOUND("impact_scope", hops_sql("'region|1'", 2, "in") + "\nSELECT id, hop FROM s2 WHERE hop > 0")
def impact_scope(spark, d):
    g = stored_graph(spark, d)
    return graph.impact_scope(spark, g.read("nodes"), None, ["region|1"], 2, walk=g.read("in"))


@plain("file_context", """, seeds AS (SELECT id FROM nodes WHERE source_file = 'region.parquet')
SELECT source, target, min(relation) AS relation FROM edges WHERE (source IN (SELECT id FROM seeds) AND target NOT IN (SELECT id FROM seeds)) OR (target IN (SELECT id FROM seeds) AND source NOT IN (SELECT id FROM seeds)) GROUP BY source, target""")
def file_context(spark, d):
    return graph.file_context(spark, graph_nodes(spark, d), graph_edges(spark, d), "region.parquet", 1)


def related(direction):
    a, b = ("source", "target") if direction == "out" else ("target", "source")
    sql = f"WITH {GRAPH_SQL}\nSELECT n.label, e.relation FROM edges e JOIN nodes n ON n.id = e.{b} WHERE e.{a} = 'part|5'"
    symbols = lambda spark, d: graph_nodes(spark, d).select(F.col("id").alias("node_id"), F.col("id").alias("symbol_key"), "label")
    return sql, lambda spark, d: graph.related_symbols(graph_edges(spark, d), symbols(spark, d), "part|5", direction).select("label", "relation")


for _direction in ("in", "out"):
    _sql, _f = related(_direction)
    FOUND(f"related_symbols_{_direction}", _sql)(_f)

CLOSED = """, walk AS (SELECT source, target FROM edges WHERE relation IN ('method', 'imports_from')),
c1 AS (SELECT DISTINCT source AS id, 1 AS distance FROM walk WHERE target = 'region|0'),
c2 AS (SELECT DISTINCT w.source AS id, 2 AS distance FROM walk w JOIN c1 ON w.target = c1.id)
"""


@plain("reverse_closure", CLOSED + "SELECT 'region|0' AS id, 0 AS distance UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2")
def reverse_closure(spark, d):
    return graph.reached(spark, graph_edges(spark, d, ("method", "imports_from")), ["region|0"], "in").select("id", "distance")


@plain("closure_paths", CLOSED + """SELECT c2.id, min('region|0>' || c1.id || '>' || c2.id) AS path FROM c2 JOIN walk w ON w.source = c2.id JOIN c1 ON c1.id = w.target GROUP BY c2.id""")
def closure_paths(spark, d):
    found = graph.reached(spark, graph_edges(spark, d, ("method", "imports_from")), ["region|0"], "in").where("distance = 2")
    found = graph.closure(spark, graph_edges(spark, d, ("method", "imports_from")), ["region|0"], "in", asked=found)
    return found.select("id", F.array_join("path", ">").alias("path"))


@plain("reach_counts", """, walk AS (SELECT DISTINCT target AS a, source AS b FROM edges WHERE relation IN ('method', 'imports_from', 'calls')), s AS (SELECT id FROM nodes WHERE kind IN ('region', 'nation', 'supplier')),
h1 AS (SELECT DISTINCT s.id AS seed, w.b AS id FROM s JOIN walk w ON w.a = s.id), h2 AS (SELECT DISTINCT h1.seed, w.b AS id FROM h1 JOIN walk w ON w.a = h1.id), h3 AS (SELECT DISTINCT h2.seed, w.b AS id FROM h2 JOIN walk w ON w.a = h2.id)
SELECT seed, count(*) AS n, sum(hop) AS hops FROM (SELECT seed, id, min(hop) AS hop FROM (SELECT id AS seed, id, 0 AS hop FROM s UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2 UNION ALL SELECT seed, id, 3 FROM h3) GROUP BY 1, 2) GROUP BY seed""")
def reach_counts(spark, d):
    """How much depends on each region, nation and supplier, for all of them in one loop."""
    g = stored_graph(spark, d)
    seeds = g.read("nodes").where("kind in ('region', 'nation', 'supplier')").select("id")
    walk = g.read("in").where("relation in ('method', 'imports_from', 'calls')")
    return graph.reach_of_many(spark, walk, seeds, 3).groupBy("seed").agg(F.count("*").alias("n"), F.sum("hop").alias("hops"))


def order_roles(spark, d):
    role = F.when(F.col("kind") == "part", F.when(F.length("id") % 2 == 0, "controller").otherwise("service")).when(F.col("kind") == "supplier", "repository")
    return graph_nodes(spark, d).select("id", role.alias("role"), F.when(F.col("kind") == "part", "presentation").alias("layer"))


@plain("stop_at_role", f"""SELECT e.target AS id, 'controller' AS role, 1 AS distance, '{ORDER}>' || e.target AS path FROM edges e WHERE e.source = '{ORDER}' AND e.relation = 'imports' AND length(e.target) % 2 = 0""")
def stop_at_role(spark, d):
    found = graph.walk_to_role(spark, graph_edges(spark, d, ("imports", "calls")), order_roles(spark, d), [ORDER], "controller")
    return found.select("id", "role", "distance", F.array_join("path", ">").alias("path"))


@plain("entrypoints_for", """SELECT DISTINCT source AS id, 'controller' AS role, 'presentation' AS layer, 1 AS distance FROM edges WHERE relation = 'calls' AND target = 'supplier|3' AND length(source) % 2 = 0""")
def entrypoints_for(spark, d):
    return graph.entrypoints(spark, graph_edges(spark, d, ("calls",)), order_roles(spark, d), ["supplier|3"]).select("id", "role", "layer", "distance")


def rank_sql(rounds: int) -> str:
    steps = ["v AS (SELECT DISTINCT source AS id FROM ring UNION SELECT DISTINCT target FROM ring)", "n AS (SELECT count(*) AS n FROM v)", "deg AS (SELECT source, count(*) AS d FROM (SELECT DISTINCT * FROM ring) GROUP BY source)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 / n.n + 0.85 * coalesce(sum(p.rank / deg.d), 0) + 0.85 / n.n * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT source FROM deg)) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT DISTINCT * FROM ring) e ON e.target = v.id LEFT JOIN deg ON deg.source = e.source LEFT JOIN r{k - 1} p ON p.id = e.source GROUP BY v.id, n.n)")
    return f"WITH {RING_SQL}, " + ",\n".join(steps) + f"\nSELECT id, round(rank, 9) AS rank FROM r{rounds}"


@FOUND("pagerank_fixed10", rank_sql(10))
def pagerank_fixed10(spark, d):
    ring = supplier_ring(spark, d)
    nodes = ring.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    ranks, _, _ = graph.pagerank(spark, nodes, ring, most=10, tolerance=1e-30)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@FOUND("ring_cycles", f"""WITH RECURSIVE {RING_SQL}, walk AS (SELECT source AS s0, target AS t0, 1 AS k FROM ring UNION ALL SELECT s0, r.target, k + 1 FROM walk JOIN ring r ON r.source = walk.t0 WHERE k < 400 AND walk.t0 <> walk.s0),
loops AS (SELECT DISTINCT s0 FROM walk WHERE t0 = s0),
inside AS (SELECT l.s0, w.t0 FROM loops l JOIN walk w ON w.s0 = l.s0)
SELECT source AS node, coalesce((SELECT min(t0) FROM inside WHERE s0 = source), source) AS component FROM ring""")
def ring_cycles(spark, d):
    return graph.components_by_cycle(spark, supplier_ring(spark, d))


@FOUND("call_levels", f"""WITH RECURSIVE {RING_SQL}, walk AS (SELECT source AS s0, target AS t0 FROM ring UNION SELECT s0, r.target FROM walk JOIN ring r ON r.source = walk.t0), loops AS (SELECT s0 FROM walk WHERE s0 = t0),
lv AS (SELECT s0 AS node, 0 AS level FROM loops UNION ALL SELECT r.source, lv.level + 1 FROM ring r JOIN lv ON r.target = lv.node WHERE r.source NOT IN (SELECT s0 FROM loops))
SELECT node, CASE WHEN node IN (SELECT s0 FROM loops) THEN (SELECT min(t0) FROM walk WHERE s0 = node) ELSE node END AS component, level FROM lv""")
def call_levels(spark, d):
    return graph.call_levels(spark, supplier_ring(spark, d))


@plain("impact_roles", """, hit AS (SELECT DISTINCT source AS id FROM edges WHERE relation = 'calls' AND target = 'supplier|3')
SELECT CASE WHEN length(id) % 2 = 0 THEN 'controller' ELSE 'service' END AS role, count(*) AS members, round(sum(length(id) / 10.0), 6) AS rank, 'presentation' AS layer FROM hit GROUP BY 1""")
def impact_roles(spark, d):
    hit = graph_edges(spark, d, ("calls",)).where("target = 'supplier|3'").select(F.col("source").alias("id"), (F.length("source") / 10.0).alias("rank"))
    return graph.impact_roles(hit, order_roles(spark, d)).withColumn("rank", F.round("rank", 6))


@plain("degree_stats", """, c AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'calls')
SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT target AS id, 1 AS i, 0 AS o FROM c UNION ALL SELECT source, 0, 1 FROM c) GROUP BY id""")
def degree_stats(spark, d):
    return graph.degrees(graph_edges(spark, d, ("calls",)))


FILES = """, f AS (SELECT n.source_file || CAST(coalesce(n.community, 0) AS VARCHAR) AS source, m.source_file || CAST(coalesce(m.community, 0) AS VARCHAR) AS target FROM edges e JOIN nodes n ON n.id = e.source JOIN nodes m ON m.id = e.target)
"""


def file_edges(spark, d):
    own = graph_nodes(spark, d).select("id", F.concat("source_file", F.coalesce("community", F.lit(0)).cast("string")).alias("file"))
    own = Scratch(spark, "files").write(own, "own")  # narrow, and of known size: broadcast where that is small, so that edges are not shuffled
    a, b = own.select(F.col("id").alias("source"), F.col("file").alias("a")), own.select(F.col("id").alias("target"), F.col("file").alias("b"))
    return graph_edges(spark, d).join(a, "source").join(b, "target").select(F.col("a").alias("source"), F.col("b").alias("target"))


@plain("module_minimap", FILES + """, i AS (SELECT target AS path, count(*) AS fan_in FROM f GROUP BY 1), o AS (SELECT source AS path, count(DISTINCT target) AS fan_out FROM f GROUP BY 1),
top AS (SELECT coalesce(i.path, o.path) AS path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM i FULL JOIN o ON i.path = o.path ORDER BY fan_in DESC, fan_out DESC, path LIMIT 14),
p AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, target) AS r FROM f GROUP BY source, target)
SELECT top.path, fan_in, fan_out, coalesce((SELECT string_agg(target, ',' ORDER BY r) FROM p WHERE p.source = top.path AND r <= 4), '') AS first_imports FROM top""")
def module_minimap(spark, d):
    return graph.minimap(file_edges(spark, d)).withColumn("first_imports", F.array_join("first_imports", ","))


@plain("file_facts", FILES + """, x AS (SELECT DISTINCT * FROM f)
SELECT coalesce(a.path, b.path) AS path, coalesce(imports, '') AS imports, coalesce(imported_by, '') AS imported_by, '' AS tests FROM (SELECT source AS path, string_agg(target, ',' ORDER BY target) AS imports FROM x GROUP BY 1) a FULL JOIN (SELECT target AS path, string_agg(source, ',' ORDER BY source) AS imported_by FROM x GROUP BY 1) b ON a.path = b.path""")
def file_facts(spark, d):
    rows = graph.file_facts(file_edges(spark, d))
    return rows.select("path", *[F.array_join(c, ",").alias(c) for c in ("imports", "imported_by", "tests")])


@plain("community_members_top50", """, deg AS (SELECT source AS id, count(*) AS degree FROM edges GROUP BY 1),
r AS (SELECT community, label, count(*) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS r FROM nodes LEFT JOIN deg USING (id) WHERE community IS NOT NULL)
SELECT community, size, string_agg(label, ',' ORDER BY r) AS members FROM r WHERE r <= 50 GROUP BY community, size""")
def community_members(spark, d):
    degree = graph_edges(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    return cards.communities(graph_nodes(spark, d).join(degree, "id", "left")).withColumn("members", F.array_join("members", ","))


@plain("grouped_edges", "SELECT source, relation, count(*) AS n, string_agg(target, ',' ORDER BY target) AS targets FROM edges WHERE relation IN ('contains', 'method') GROUP BY source, relation")
def grouped_edges(spark, d):
    return cards.grouped_edges(graph_edges(spark, d, ("contains", "method"))).withColumn("targets", F.array_join("targets", ","))


@FOUND("node_resolver_nearest", """WITH s AS (SELECT c_custkey AS id, c_nationkey AS path, c_mktsegment AS name, c_custkey % 1000 AS line FROM customer), n AS (SELECT 's' || s_suppkey AS node_id, s_nationkey AS path, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END AS name, s_suppkey * 7 % 1000 AS line FROM supplier),
m AS (SELECT s.id, s.path, n.node_id, abs(s.line - n.line) AS dist FROM s LEFT JOIN n ON s.path = n.path AND s.name = n.name), b AS (SELECT *, min(dist) OVER (PARTITION BY id) AS best FROM m),
g AS (SELECT id, path, count(DISTINCT node_id) AS k, min(node_id) AS node_id FROM b WHERE node_id IS NULL OR dist = best GROUP BY id, path)
SELECT id, CASE WHEN k = 1 AND path IN (SELECT path FROM n) THEN node_id END AS node_id, CASE WHEN path NOT IN (SELECT path FROM n) THEN 'no-file-node' WHEN k = 0 THEN 'no-label-match' WHEN k > 1 THEN 'ambiguous' END AS reason FROM g""")
def node_resolver_nearest(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    symbols = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("path"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 1000).alias("line"))
    k = F.col("s_suppkey") % 3
    nodes = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_nationkey").alias("path"), F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise("AUTOMOBILE").alias("name"), (F.col("s_suppkey") * 7 % 1000).alias("line"))
    return relations.resolved(symbols, nodes)


@FOUND("persist_relations", f"""WITH {GRAPH_SQL}, old AS (SELECT * FROM edges WHERE length(source) % 3 = 0)
SELECT e.relation, count(*) - count(o.source) AS inserted, count(o.source) AS duplicates FROM edges e LEFT JOIN old o ON o.source = e.source AND o.target = e.target AND o.relation = e.relation GROUP BY e.relation""")
def persist_relations(spark, d):
    edges = graph_edges(spark, d)
    return relations.persisted(edges.where("length(source) % 3 = 0"), edges)[1]
