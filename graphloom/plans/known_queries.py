"""Queries on the known graph over the code graph that the test tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph, known_graph as kg
from graphloom.plans.registering import Registry
from graphloom.session import files_version
from graphloom.sources.adapters import CODE_SQL, c_key_sql, code_graph, p_key_sql, s_key_sql

FOUND = Registry()
CALLER, CLASS, FILE = "f3", "S6", "src/s3.ts"
CALLER_KEY = "ts|tests/c3.test.ts|function|local|f3|0"
CLASS_KEY = "ts|src/s6.ts|class|exported|S6|0"


PREPARED: dict = {}


def known(spark, d):
    """The known graph of a folder's tables, prepared once an application for each state of their files: queries read its tables."""
    key = (spark.sparkContext.applicationId, d, files_version(spark, [f"{d}/{x}.parquet" for x in ("customer", "part", "supplier")]))
    if key not in PREPARED:
        PREPARED.clear()
        PREPARED[key] = kg.known_graph(spark, **code_graph(spark, d))
    return PREPARED[key]


def code(name: str, sql: str):
    return FOUND(name, f"WITH RECURSIVE {CODE_SQL}\n{sql}")


@code("canonical_symbols", "SELECT symbol_key, node_id, path, kind, scope, name, container FROM symbols")
def canonical_symbols(spark, d):
    return known(spark, d).symbols.select("symbol_key", "node_id", "path", "kind", "scope", "name", "container")


TARGETS = ("f2", "f97", "constructor", "src/c5.ts", "src/c5.ts#f45", "nothing at all", "src/nofile.ts", "file|src/empty.ts", CLASS, CLASS_KEY, "sup6", "tests\\c3.test.ts", "S6.m56", "m56")


def targets_sql():
    ambiguous = "(SELECT count(*) FROM groups g WHERE (name = '{n}' OR ends_with(name, '.{n}')) AND symbol_key IN (SELECT symbol_key FROM groups GROUP BY 1 HAVING count(*) > 1))"
    fits = "(SELECT {what} FROM symbols WHERE name = '{n}' OR ends_with(name, '.{n}'))"
    rows = []
    for t in TARGETS:
        if t in (CLASS_KEY, "sup6"):
            rows.append(f"SELECT '{t}' AS target, 'resolved' AS status, 'symbol' AS mode, '{CLASS_KEY}' AS found, 0 AS candidates")
        elif t == "src/c5.ts#f45":
            rows.append(f"SELECT '{t}', 'resolved', 'symbol', 'ts|src/c5.ts|function|local|f45|0', 0")
        elif "/" in t or "\\" in t:
            path = t.removeprefix("file|").replace("\\", "/")
            rows.append(f"SELECT '{t}', CASE WHEN n > 0 THEN 'resolved' ELSE 'missing' END, 'file', CASE WHEN n > 0 THEN '{path}' END, 0 FROM (SELECT count(*) + CAST('{path}' = 'src/empty.ts' AS INT) AS n FROM groups WHERE path = '{path}')")
        else:
            many, one, key = ambiguous.format(n=t), fits.format(n=t, what="count(*)"), fits.format(n=t, what="min(symbol_key)")
            rows.append(f"SELECT '{t}', CASE WHEN {many} > 0 OR {one} > 1 THEN 'ambiguous' WHEN {one} = 1 THEN 'resolved' ELSE 'missing' END, 'symbol', CASE WHEN {many} = 0 AND {one} = 1 THEN {key} END, CASE WHEN {many} > 0 THEN {many} WHEN {one} > 1 THEN {one} ELSE 0 END")
    return "SELECT NULL AS target, NULL AS status, NULL AS mode, NULL AS found, NULL AS candidates WHERE false\nUNION ALL " + "\nUNION ALL ".join(rows)


@code("target_resolution", targets_sql())
def target_resolution(spark, d):
    g = known(spark, d)
    rows = [(t, *kg.resolve(g, t)) for t in TARGETS]
    return spark.createDataFrame([(t, status, mode, found, len(c)) for t, status, mode, found, c in rows], "target string, status string, mode string, found string, candidates int")


@code("relations_ambiguous", "SELECT symbol_key, node_id FROM symbols WHERE ends_with(name, '.constructor')")
def relations_ambiguous(spark, d):
    return spark.createDataFrame(kg.resolve(known(spark, d), "constructor")[3], "symbol_key string, node_id string")


@code("relations_symbol_out", f"""SELECT source, target, relation, CAST(NULL AS VARCHAR) AS scope FROM keyed WHERE source = '{CALLER_KEY}' AND relation = 'calls'
UNION ALL SELECT '{CALLER_KEY}', symbol_key, 'imports', 'file' FROM bindings WHERE path = 'tests/c3.test.ts'""")
def relations_symbol_out(spark, d):
    return kg.relations(spark, known(spark, d), CALLER)


@code("relations_symbol_in", f"""SELECT source, target, relation, CAST(NULL AS VARCHAR) AS scope FROM keyed WHERE target = '{CLASS_KEY}' AND relation = 'calls'
UNION ALL SELECT s.symbol_key, '{CLASS_KEY}', 'imports', 'file' FROM bindings b JOIN symbols s ON s.path = b.path AND s.scope = 'exported' WHERE b.symbol_key = '{CLASS_KEY}'""")
def relations_symbol_in(spark, d):
    return kg.relations(spark, known(spark, d), CLASS, "inbound")


@code("relations_calls_depth2", f""", e1 AS (SELECT * FROM walk WHERE source = 'cust3' AND relation = 'calls'), e2 AS (SELECT * FROM e1 UNION SELECT w.* FROM walk w JOIN e1 ON w.source = e1.target WHERE w.relation = 'calls')
SELECT a.symbol_key AS source, b.symbol_key AS target FROM e2 JOIN symbols a ON a.node_id = e2.source JOIN symbols b ON b.node_id = e2.target""")
def relations_calls_depth2(spark, d):
    return kg.relations(spark, known(spark, d), CALLER, "out", ("calls",), 2).select("source", "target")


@code("relations_file_in", f"""SELECT k.source, k.target, k.relation, CAST(NULL AS VARCHAR) AS scope FROM keyed k JOIN symbols s ON s.symbol_key = k.target AND s.path = '{FILE}' WHERE k.relation IN ('calls', 'method')
UNION ALL SELECT 'file|' || source, 'file|' || target, 'imports', NULL FROM imports WHERE target = '{FILE}'""")
def relations_file_in(spark, d):
    return kg.relations(spark, known(spark, d), FILE, "in", ("calls", "method", "imports"))


@code("relations_file_out_depth2", f""", i1 AS (SELECT * FROM imports WHERE source = 'src/c9.ts'), i2 AS (SELECT * FROM i1 UNION SELECT i.* FROM imports i JOIN i1 ON i.source = i1.target)
SELECT 'file|' || source AS source, 'file|' || target AS target FROM i2""")
def relations_file_out_depth2(spark, d):
    return kg.relations(spark, known(spark, d), "src/c9.ts", "out", ("imports",), 2).select("source", "target")


@code("symbol_context", """, e AS (SELECT * FROM walk WHERE source = 'sup6'), n AS (SELECT DISTINCT target AS node_id FROM e)
SELECT n.node_id, s.symbol_key FROM n LEFT JOIN symbols s USING (node_id) WHERE n.node_id IN (SELECT 'part' || p_partkey FROM part)""")
def symbol_context(spark, d):
    return kg.symbol_context(spark, known(spark, d), CLASS_KEY)


@code("impact_scope_native", """, h1 AS (SELECT DISTINCT source AS node_id FROM walk WHERE target IN ('part56', 'part106')), h2 AS (SELECT DISTINCT source AS node_id FROM walk WHERE target IN (SELECT node_id FROM h1))
SELECT node_id, min(hop) AS hop FROM (SELECT node_id, 1 AS hop FROM h1 UNION ALL SELECT node_id, 2 FROM h2) WHERE node_id NOT IN ('part56', 'part106') GROUP BY node_id
HAVING regexp_matches(node_id, '^(part|cust)') OR node_id IN (SELECT 'sup' || s_suppkey FROM supplier)""")
def impact_scope_native(spark, d):
    keys = ["ts|src/s6.ts|method|member|S6.m56|0", "ts|src/s6.ts|method|member|S6.m106|0"]
    return kg.impact_scope(spark, known(spark, d), keys, "extended")


@code("symbol_facts", f""", f AS (SELECT '{CALLER_KEY}' AS id, 'callees' AS fact, target AS item FROM native WHERE source = '{CALLER_KEY}' AND NOT contains(target, '.constructor|')
UNION ALL SELECT '{CALLER_KEY}', 'imports', symbol_key FROM bindings WHERE path = 'tests/c3.test.ts'
UNION ALL SELECT '{CALLER_KEY}', 'imported_by', s.symbol_key FROM imports i JOIN symbols s ON s.path = i.source WHERE i.target = 'tests/c3.test.ts' AND s.scope = 'exported' AND s.node_kind = 'symbol'
UNION ALL SELECT '{CLASS_KEY}', 'imports', symbol_key FROM bindings WHERE path = 'src/s6.ts'
UNION ALL SELECT '{CLASS_KEY}', u.fact, s.symbol_key FROM imports i JOIN symbols s ON s.path = i.source, (SELECT unnest(['imported_by', 'tests']) AS fact) u WHERE i.target = 'src/s6.ts' AND s.scope = 'exported' AND s.node_kind = 'symbol' AND (u.fact = 'imported_by' OR s.path LIKE 'tests/%')
UNION ALL SELECT 'file|{FILE}', 'imports', target FROM imports WHERE source = '{FILE}'
UNION ALL SELECT 'file|{FILE}', u.fact, source FROM imports, (SELECT unnest(['imported_by', 'tests']) AS fact) u WHERE target = '{FILE}' AND (u.fact = 'imported_by' OR source LIKE 'tests/%'))
SELECT * FROM f""")
def symbol_facts(spark, d):
    g, out = known(spark, d), None
    for key in (CALLER_KEY, CLASS_KEY, f"file|{FILE}"):
        rows = kg.facts(spark, g, key).select(F.lit(key).alias("id"), "fact", "item")
        out = rows if out is None else out.unionByName(rows)
    return out


@code("symbol_fans", f"""SELECT CAST(0 AS BIGINT) + (SELECT count(*) FROM imports i JOIN symbols s ON s.path = i.source WHERE i.target = 'tests/c3.test.ts' AND s.scope = 'exported' AND s.node_kind = 'symbol') AS fan_in,
(SELECT count(*) FROM native WHERE source = '{CALLER_KEY}' AND NOT contains(target, '.constructor|')) + (SELECT count(*) FROM bindings WHERE path = 'tests/c3.test.ts') AS fan_out""")
def symbol_fans(spark, d):
    return kg.fans(kg.facts(spark, known(spark, d), CALLER_KEY))


@code("file_card", f"""SELECT 'exports' AS fact, symbol_key AS item FROM symbols WHERE path = '{FILE}' AND scope = 'exported' UNION ALL SELECT 'members', symbol_key FROM symbols WHERE path = '{FILE}' AND node_kind = 'member'
UNION ALL SELECT 'imports', target FROM imports WHERE source = '{FILE}' UNION ALL SELECT 'imported_by', source FROM imports WHERE target = '{FILE}'""")
def file_card(spark, d):
    return kg.file_card(known(spark, d), FILE)


@code("card_levels", f""", f AS (SELECT fact, string_agg(item, ', ' ORDER BY item) AS items FROM (SELECT 'exports' AS fact, symbol_key AS item FROM symbols WHERE path = '{FILE}' AND scope = 'exported' UNION ALL SELECT 'members', symbol_key FROM symbols WHERE path = '{FILE}' AND node_kind = 'member'
UNION ALL SELECT 'imports', target FROM imports WHERE source = '{FILE}' UNION ALL SELECT 'imported_by', source FROM imports WHERE target = '{FILE}') GROUP BY fact),
t AS (SELECT string_agg(fact || ': ' || items, chr(10) ORDER BY fact || ': ' || items) AS context FROM f), n AS (SELECT CAST(ceil(length('{FILE}' || chr(10) || 'A file') / 4) AS BIGINT) AS e, CAST(ceil(length(context) / 4) AS BIGINT) AS c FROM t)
SELECT 'compact' AS level, e AS tokens, '' AS omitted FROM n UNION ALL SELECT 'extended', CASE WHEN e + c <= 5000 THEN e + c ELSE e END, CASE WHEN e + c <= 5000 THEN '' ELSE 'context' END FROM n
UNION ALL SELECT 'deep', CASE WHEN e + c <= 10000 THEN e + c ELSE e END + CASE WHEN e + c + 2 <= 10000 THEN 2 ELSE 0 END, CASE WHEN e + c <= 10000 THEN CASE WHEN e + c + 2 <= 10000 THEN '' ELSE 'evidence' END ELSE 'context,evidence' END FROM n""")
def card_levels(spark, d):
    g, out = known(spark, d), None
    for level in kg.LEVELS:
        rows = kg.card(spark, g, FILE, level, "A file", ["because"]).select(F.lit(level).alias("level"), "tokens", F.array_join("omitted", ",").alias("omitted"))
        out = rows if out is None else out.unionByName(rows)
    return out


@code("effective_roles", "SELECT * FROM effective")
def effective_roles(spark, d):
    return kg.effective_roles(known(spark, d))


@code("stop_at_role_members", f""", hit AS (SELECT k.target AS id FROM keyed k JOIN effective e ON e.id = k.target WHERE k.source = '{CALLER_KEY}' AND k.relation = 'calls' AND e.role = 'controller')
SELECT DISTINCT CASE WHEN o.owner IN (SELECT id FROM effective WHERE role = 'controller') THEN o.owner ELSE hit.id END AS id, 'controller' AS role, 1 AS distance FROM hit LEFT JOIN owners o ON o.member = hit.id""")
def stop_at_role_members(spark, d):
    return kg.stop_at_role(spark, known(spark, d), CALLER, "controller", "out", ("calls",)).select("id", "role", "distance")


CLOSED = f""", seeds AS (SELECT '{CLASS_KEY}' AS id UNION ALL SELECT member FROM owners WHERE owner = '{CLASS_KEY}'), pairs AS ({{pairs}}),
up AS (SELECT id FROM seeds UNION SELECT p.source FROM pairs p JOIN up ON p.target = up.id)
"""


@code("entrypoints_container", CLOSED.format(pairs="SELECT source, target FROM keyed WHERE relation = 'calls'") + """SELECT e.id, role, layer, coalesce(role IN ('entrypoint', 'cli-command', 'mcp-tool') OR layer = 'entrypoint', false) AS entry FROM up JOIN effective e USING (id)
WHERE coalesce(role IN ('entrypoint', 'cli-command', 'mcp-tool') OR layer = 'entrypoint', false) OR role = 'controller'""")
def entrypoints_container(spark, d):
    return kg.entrypoints(spark, known(spark, d), CLASS).select("id", "role", "layer", "entry")


IMPACT = CLOSED.format(pairs="SELECT source, target FROM keyed WHERE relation = 'calls' UNION SELECT 'file|' || source, 'file|' || target FROM imports UNION SELECT s.symbol_key, b.symbol_key FROM bindings b JOIN symbols s ON s.path = b.path AND s.scope = 'exported'") + """, tests AS (SELECT s.symbol_key AS id FROM imports i JOIN symbols s ON s.path = i.source WHERE i.target = 'src/s6.ts' AND s.scope = 'exported' AND s.node_kind = 'symbol' AND s.path LIKE 'tests/%'),
found AS (SELECT id FROM up WHERE id NOT IN (SELECT id FROM seeds) UNION SELECT id FROM tests)
"""


@code("impact_records", IMPACT + "SELECT f.id AS symbol_key, f.id IN (SELECT id FROM tests) AS is_test, role, layer FROM found f LEFT JOIN effective e USING (id)")
def impact_records(spark, d):
    return kg.impact(spark, known(spark, d), CLASS, rounds=1)[0].select("symbol_key", "is_test", "role", "layer")


def ranked_sql(rounds: int) -> str:
    steps = [", v AS (SELECT symbol_key AS id FROM symbols UNION SELECT 'file|' || path FROM groups UNION SELECT 'file|' || source FROM imports UNION SELECT 'file|' || target FROM imports UNION SELECT 'file|' || CASE WHEN s_suppkey % 1 = 0 THEN " + "'src/s' || s_suppkey % 25 || '.ts' END FROM supplier UNION SELECT 'file|src/empty.ts')"]
    steps.append("e AS MATERIALIZED (SELECT DISTINCT source, target FROM keyed WHERE relation = 'calls' UNION SELECT 'file|' || source, 'file|' || target FROM imports)")
    steps += ["n AS (SELECT count(*) AS n FROM v)", "deg AS MATERIALIZED (SELECT source, count(*) AS d FROM e GROUP BY source)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for k in range(1, rounds + 1):
        steps.append(f"l{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS loose FROM r{k - 1} WHERE id NOT IN (SELECT source FROM deg)), g{k} AS MATERIALIZED (SELECT e.target AS id, sum(p.rank / deg.d) AS got FROM e JOIN deg ON deg.source = e.source JOIN r{k - 1} p ON p.id = e.source GROUP BY e.target)")
        steps.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 / n.n + 0.85 * coalesce(got, 0) + 0.85 / n.n * loose AS rank FROM v CROSS JOIN n CROSS JOIN l{k} LEFT JOIN g{k} ON g{k}.id = v.id)")
    return ",\n".join(steps)


@code("known_ranks_fixed10", ranked_sql(10) + "\nSELECT id, round(rank, 9) AS rank FROM r10")
def known_ranks_fixed10(spark, d):
    """Ranks of the whole known graph, which has dangling nodes, branches and cycles."""
    ranks, _, _ = graph.pagerank(spark, *kg.ranking_graph(known(spark, d)), most=10, tolerance=1e-30)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@code("impact_roles_fixed10", IMPACT + ranked_sql(10) + """
SELECT e.role, count(*) AS members, round(sum(r.rank), 7) AS rank, CASE WHEN count(DISTINCT e.layer) = 1 AND count(e.layer) = count(*) THEN min(e.layer) END AS layer FROM found f JOIN effective e USING (id) JOIN r10 r USING (id) GROUP BY e.role""")
def impact_roles_fixed10(spark, d):
    return kg.impact(spark, known(spark, d), CLASS, rounds=10)[1].withColumn("rank", F.round("rank", 7))


@FOUND("impact_analysis")
def impact_analysis(spark, d):
    """All records with ranks that have converged."""
    rows, _, _, _ = kg.impact(spark, known(spark, d), CLASS)
    return rows.select("symbol_key", "distance", "is_test", "role", "layer", F.round("rank", 9).alias("rank"))


@code("import_cycles", """, walks AS (SELECT source AS a, target AS b FROM imports UNION SELECT w.a, i.target FROM walks w JOIN imports i ON i.source = w.b), ends AS (SELECT source AS node FROM imports UNION SELECT target FROM imports)
SELECT node, least(node, coalesce((SELECT min(x.b) FROM walks x JOIN walks y ON y.a = x.b AND y.b = x.a WHERE x.a = node), node)) AS component FROM ends""")
def import_cycles(spark, d):
    """Cycles of the files' imports, which have branches and parts without a cycle."""
    return graph.components_by_cycle(spark, known(spark, d).imports)
