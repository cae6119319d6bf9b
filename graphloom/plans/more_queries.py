"""Queries of the operators on symbols, queues, ledgers, narratives, contexts and files over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keys as K
from graphloom.functions import text as T
from graphloom.operators import cards, delta, evaluation, ledger, memory, relations, search
from graphloom.plans.registering import Registry
from graphloom.plans.rule_queries import pick, pick_sql
from graphloom.session import Scratch, table
from graphloom.sources import files
from graphloom.streaming import capture

FOUND = Registry()


def text_of(c):
    return F.col(c).cast("string")


# ── functions ──────────────────────────────────────────────────────────────

CODE = ("import a", "  from b import c", "x = 1", "using System;", "namespace N", "return x", "require('z')")


@FOUND("context_lines", f"""WITH c AS (SELECT event_id, string_agg(l, chr(10) ORDER BY i) AS code FROM (SELECT event_id, i, ([{', '.join("'" + x.replace("'", "''") + "'" for x in CODE)}])[(event_id + i * 3) % 7 + 1] AS l FROM events, range(6) t(i)) GROUP BY event_id)
SELECT event_id, array_to_string(list_filter((string_split(code, chr(10)))[1:event_id % 6], lambda x: regexp_matches(x, '^\\s*(import|from|using|namespace|package|require)\\b')), chr(10)) AS lines FROM c""")
def context_lines(spark, d):
    k = F.col("event_id")
    code = F.concat_ws("\n", *[pick(CODE, k + i * 3) for i in range(6)])
    return table(spark, d, "events").select("event_id", code.alias("code")).select("event_id", F.array_join(T.context_lines("code", k % 6 + 1), "\n").alias("lines"))


@FOUND("key_parts_and_lines", """WITH r AS (SELECT o_orderkey AS k, (['L12-L20', 'L7', 'L9-L3', 'x', 'L1-22'])[o_orderkey % 5 + 1] AS span, (['.run()', 'Thing', '..x()', 'f'])[o_orderkey % 4 + 1] AS label, (['a/b.ts', '../x', 'C:\\x', '/abs', 'a|b', 'a\\b'])[o_orderkey % 6 + 1] AS path, (['extends Base<T>', 'implements db.Repo', 'models.Model', ' Plain '])[o_orderkey // 4 % 4 + 1] AS clause FROM orders)
SELECT k, CASE WHEN span = 'L12-L20' THEN '12:20' WHEN span = 'L7' THEN '7:7' WHEN span = 'L1-22' THEN '1:22' END AS lines, regexp_replace(regexp_replace(label, '^\\.+', ''), '\\(\\)$', '') AS label, CASE WHEN path IN ('a/b.ts', 'a\\b') THEN replace(path, '\\', '/') END AS path,
CASE clause WHEN 'extends Base<T>' THEN 'Base' WHEN 'implements db.Repo' THEN 'Repo' WHEN 'models.Model' THEN 'Model' ELSE 'Plain' END AS base, 'src/m' || k % 9 || '.ts,src/m' || k % 9 || '/index.ts' AS modules FROM r""")
def key_parts_and_lines(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(k.alias("k"), pick(("L12-L20", "L7", "L9-L3", "x", "L1-22"), k).alias("span"), pick((".run()", "Thing", "..x()", "f"), k).alias("label"), pick(("a/b.ts", "../x", "C:\\x", "/abs", "a|b", "a\\b"), k).alias("path"), pick(("extends Base<T>", "implements db.Repo", "models.Model", " Plain "), F.floor(k / 4).cast("long")).alias("clause"))
    span = K.line_range("span")
    base = F.concat(F.lit("src/m"), (F.col("k") % 9).cast("string"))
    some = F.filter(K.module_candidates(base), lambda x: x.endswith(".ts"))
    return r.select("k", F.concat_ws(":", span["start"], span["end"]).alias("lines"), K.label_name("label").alias("label"), K.strict_path("path").alias("path"), K.heritage_base("clause").alias("base"), F.array_join(some, ",").alias("modules")).withColumn("lines", F.when(F.col("lines") != "", F.col("lines")))


@FOUND("iso_times", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def iso_times(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "events").select("event_id", T.iso_time(said).cast("timestamp_ntz").alias("at"))


@FOUND("saved_payloads", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE '**What**: Doc ' || doc_id || chr(10) || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)) END AS content, CASE WHEN doc_id % 2 = 0 THEN 'bug-fix' ELSE 'learning' END AS category, 'p1,' || lang || ',' || source AS tags FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND lang <> source""")
def saved_payloads(spark, d):
    rows = table(spark, d, "documents").where("lang is not null and source is not null and lang <> source")
    title, kind = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("Doc "), text_of("doc_id"))), F.when(F.col("doc_id") % 2 == 0, "bugfix").otherwise("odd")
    x = T.saved_payload(title, F.col("text"), kind, F.concat(F.lit(" "), "lang", F.lit("//"), "source", F.lit("/"), "lang"), F.lit("p1"))
    return rows.select("doc_id", x["content"].alias("content"), x["category"].alias("category"), F.array_join(x["tags"], ",").alias("tags"))


@FOUND("unique_tags", "SELECT user_id, event_type || ',x' AS tags FROM events")
def unique_tags(spark, d):
    return table(spark, d, "events").select("user_id", F.array_join(T.unique_tags(F.array("event_type", F.lit(""), F.lit(None).cast("string"), "event_type", F.lit("x"))), ",").alias("tags"))


@FOUND("semantic_reports", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'does: it' ELSE 'sum ' || event_type END AS responsibility, event_type || '|b' AS inputs, CASE WHEN event_id % 3 = 0 THEN 'out' ELSE 'Not specified.' END AS output FROM events""")
def semantic_reports(spark, d):
    k = F.col("event_id")
    findings = F.array_compact(F.array(F.when(k % 2 == 0, " Responsibility : does: it"), F.concat(F.lit("INPUTS: "), "event_type", F.lit(" , b ,")), F.when(k % 3 == 0, "output: out"), F.lit("no colon")))
    x = T.semantic_report(F.concat(F.lit("sum "), "event_type"), findings)
    return table(spark, d, "events").select("event_id", x["responsibility"].alias("responsibility"), F.array_join(x["inputs"], "|").alias("inputs"), x["output"].alias("output"))


SENTENCE = (("First one. Second one.", "First one."), ("No end here\nsecond line", "No end here"), ("- **Responsibility:** Keeps the books. More.", "Keeps the books. More."), ("intro\nResponsibility: Does\nall of it.\n- next", "Does all of it."), ("responsibility:\n\nAfter a gap\n# head", "After a gap"), ("  ", None))


@FOUND("semantic_summaries", f"SELECT event_id, {pick_sql([b or '~' for _, b in SENTENCE], 'event_id').replace(chr(126), chr(126))} AS summary FROM events")
def semantic_summaries(spark, d):
    said = table(spark, d, "events").select("event_id", pick([a for a, _ in SENTENCE], F.col("event_id")).alias("t"))
    return said.select("event_id", F.coalesce(T.semantic_summary("t"), F.lit("~")).alias("summary"))


@FOUND("narrative_hashes", """SELECT p_partkey AS k, sha256('["' || p_name || '",' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '"sig"' END || ',{"a":"' || p_brand || '","b":"2"},[["x","1"],["y","' || p_size || '"]],"v1"]') AS h, '{"a":"' || p_brand || '","b":"2"}' AS role FROM part""")
def narrative_hashes(spark, d):
    role, callees = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("p_brand")), F.create_map(F.lit("y"), text_of("p_size"), F.lit("x"), F.lit("1"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", F.when(F.col("p_partkey") % 2 == 1, "sig").alias("sig"), role.alias("role"), callees.alias("callees"))
    return rows.select("k", ledger.narrative_hash("p_name", "sig", "role", "callees", F.lit("v1")).alias("h"), ledger.canonical_json("role").alias("role"))


@FOUND("callee_hash_maps", """WITH r AS (SELECT DISTINCT l_suppkey AS owner, l_shipmode_key AS symbol_key, h FROM (SELECT l_suppkey, 'k' || l_linenumber AS l_shipmode_key, CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN l_returnflag ELSE 'h' || l_linenumber END AS h FROM lineitem)), o AS (SELECT owner, symbol_key, min(h) AS h, min(h) <> max(h) AS bad FROM r GROUP BY 1, 2)
SELECT owner, bool_or(bad) AS conflict, string_agg(symbol_key || '=' || h, ',' ORDER BY symbol_key) AS callees FROM o GROUP BY owner""")
def callee_hash_maps(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.concat(F.lit("k"), n.cast("string")).alias("symbol_key"), F.when((n == 7) & (F.col("l_suppkey") % 5 == 0), F.col("l_returnflag")).otherwise(F.concat(F.lit("h"), n.cast("string"))).alias("hash"))
    found = ledger.callee_hashes(rows)
    return found.select("owner", "conflict", F.array_join(F.transform(F.map_entries("callees"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("callees"))


@FOUND("cosmetic_and_trivial", """SELECT o_orderkey AS k, (['function', 'file', 'class', 'other'])[o_orderkey % 4 + 1] AS looks, o_orderkey % 3 = 0 OR o_orderkey % 5 < 2 AS trivial FROM orders""")
def cosmetic_and_trivial(spark, d):
    k = F.col("o_orderkey")
    code = pick(("return x", "a\nb\nc", "if (x) y", "a\nb\nc\nd\ne", "x ? 1 : 2"), k)
    return table(spark, d, "orders").select(k.alias("k"), ledger.cosmetic_kind(pick(("run()", "a.ts", "Thing", "plain words"), k)).alias("looks"), ledger.trivial(F.when(k % 3 == 0, "getter").otherwise("function"), code).alias("trivial"))


# ── deltas, logs and upserts ───────────────────────────────────────────────

SYMBOLS = "sym AS (SELECT 'k' || c_custkey AS symbol_key, c_custkey AS c FROM customer)"


def log(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(text_of("o_orderkey").alias("id"), k.alias("seq"), F.when(F.col("o_orderstatus") == "F", "synced").otherwise("pending").alias("status"), F.when(k % 3 == 0, "delete").otherwise("upsert").alias("action"), F.lit(None).cast("string").alias("synced_at"), F.lit(None).cast("string").alias("owner"))


@FOUND("delete_operations", "SELECT 'k' || c_custkey AS symbol_key, 'delete' AS action FROM customer WHERE c_custkey % 4 IN (1, 2)")
def delete_operations(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("k"), text_of("c_custkey")).alias("symbol_key"), pick(("new", "stale", "removed", "unchanged"), F.col("c_custkey")).alias("change"))
    return delta.delete_operations(rows)


@FOUND("stale_dependents", "SELECT 'k' || c_custkey AS symbol_key FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def stale_dependents(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit("k"), text_of("c_custkey")).alias("symbol_key"), F.when(k % 3 != 0, F.create_map(F.lit("callee"), F.when(k % 5 == 0, "new").otherwise("old"))).otherwise(F.create_map(F.lit("other"), F.lit("old"))).alias("callee_hashes"))
    return delta.stale_dependents(rows, "callee", "new")


@FOUND("context_unions", "SELECT user_id, event_type || CASE WHEN event_type = 'view' THEN '' ELSE ',view' END || ',x' AS ids FROM events")
def context_unions(spark, d):
    return table(spark, d, "events").select("user_id", F.array_join(ledger.with_contexts(F.array("event_type"), F.array(F.lit("view"), F.lit("x"), F.col("event_type"))), ",").alias("ids"))


@FOUND("known_files", "SELECT DISTINCT path FROM (SELECT 'a/' || s_nationkey AS path FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'k/' || c_nationkey FROM customer UNION ALL SELECT 'a/' || n_nationkey FROM nation UNION ALL SELECT 'r/' || n_regionkey FROM nation)")
def known_files(spark, d):
    s, c, n = (table(spark, d, t) for t in ("supplier", "customer", "nation"))
    cat = lambda p, x: F.concat(F.lit(p), text_of(x))
    nodes = s.select(F.when(F.col("s_suppkey") % 2 == 0, "file").otherwise("symbol").alias("node_kind"), F.concat(F.lit("a\\"), text_of("s_nationkey")).alias("source_file"))
    return ledger.known_files(nodes, c.select(F.concat(F.lit("ts|k/"), text_of("c_nationkey"), F.lit("|function|exported|f|0")).alias("symbol_key")), n.select(cat("file|a/", "n_nationkey").alias("source"), cat("file|r/", "n_regionkey").alias("target")))


@FOUND("change_log", "SELECT o_orderstatus <> 'F' AND o_orderkey % 7 <> 0 AS open, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'upsert' END AS action, count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS marked FROM orders GROUP BY 1, 2")
def change_log(spark, d):
    rows = ledger.synced(log(spark, d), log(spark, d).where("seq % 7 = 0").select("id"), F.lit("now"))
    open_ = ledger.unsynced(rows).select("id", F.lit(True).alias("open"))
    return rows.join(open_, "id", "left").groupBy(F.coalesce("open", F.lit(False)).alias("open"), "action").agg(F.count("*").alias("n"), F.count_if(F.col("synced_at") == "now").alias("marked"))


@FOUND("pending_and_claimed", "SELECT 'pending' AS what, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'deletes', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0 UNION ALL SELECT 'claimed', min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F'")
def pending_and_claimed(spark, d):
    rows = log(spark, d)
    n = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    mine = ledger.claimed(rows, "me").where("status = 'in_progress' and owner = 'me'").agg(F.lit("claimed").alias("what"), F.max("seq").alias("n"))
    return n("pending", ledger.pending_entries(rows)).unionByName(n("deletes", ledger.pending_entries(rows, "delete"))).unionByName(mine)


@FOUND("queue_batch", "SELECT event_id FROM (SELECT event_id, CASE WHEN user_id % 5 = 4 THEN NULL ELSE user_id % 5 END AS f FROM events) ORDER BY f ASC NULLS LAST, event_id LIMIT 100")
def queue_batch(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 5 != 4, F.col("user_id") % 5).alias("file_ts"), F.col("event_id").alias("line"))
    return ledger.queue_batch(rows).select("event_id")


@FOUND("queue_counts", "SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS in_progress, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS error FROM events")
def queue_counts(spark, d):
    s = F.col("event_type")
    return ledger.queue_counts(table(spark, d, "events").select(F.when(s == "view", "pending").when(s == "click", "in_progress").when(s == "purchase", "done").otherwise(s).alias("status")))


@FOUND("errors_merged", """WITH e AS (SELECT trim(event_type || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END) AS message, user_id % 4 AS project_id, event_id, event_id % 10 > 6 AS new FROM events)
SELECT message, project_id, arg_min(event_id, CAST(new AS INT) * 1000000000 + event_id) AS created_at FROM e GROUP BY message, project_id""")
def errors_merged(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.concat("event_type", F.when(k % 2 == 0, " ").otherwise("")).alias("message"), F.lit(None).cast("string").alias("cause"), (F.col("user_id") % 4).alias("project_id"), k.alias("created_at"))
    return delta.errors_merged(rows.where(k % 10 <= 6), rows.where(k % 10 > 6)).select(F.trim("message").alias("message"), "project_id", "created_at")


@FOUND("move_project", "SELECT CASE WHEN user_id % 4 = 1 THEN 2 ELSE user_id % 4 END AS project_id, count(*) AS n FROM events GROUP BY 1")
def move_project(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("project_id"))
    return delta.move_project(rows, 1, 2).groupBy("project_id").agg(F.count("*").alias("n"))


@FOUND("keyed_upserts", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 THEN 'named' ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM nation UNION ALL SELECT 'new', 'fresh', 1")
def keyed_upserts(spark, d):
    k = F.col("n_nationkey")
    old = table(spark, d, "nation").select(k.cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(1).alias("version"))
    new = table(spark, d, "nation").where(k % 2 == 0).select(k.cast("string").alias("id"), F.when(k % 3 != 0, "named").alias("name")).unionByName(spark.createDataFrame([("new", "fresh")], "id string, name string"))
    return delta.merge(old, new, "id", version="version")


@FOUND("incremental_refresh", "SELECT 'k' || c_custkey AS symbol_key, a AS action FROM customer, (SELECT unnest(['upsert', 'delete']) AS a) WHERE (a = 'upsert' AND c_custkey % 7 = 0) OR (a = 'delete' AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0) OR (c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 = 0)")
def incremental_refresh(spark, d):
    k = F.col("c_custkey")
    base = table(spark, d, "customer").select(k, F.concat(F.lit("k"), text_of("c_custkey")).alias("symbol_key"), F.lit("h").alias("code_hash"), F.lit(None).cast("string").alias("narrative_hash"), F.lit(2).alias("hash_version"))
    work, now = base.where(k % 7 != 0), base.where((k % 7 == 0) | (k % 5 != 0)).withColumn("code_hash", F.when(k % 3 == 0, "g").otherwise("h"))
    snap = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.lit("a").alias("hash"))
    return ledger.refreshed(snap, snap.withColumn("hash", F.when(F.col("path") == "FRANCE", "b").otherwise("c")), work.drop("c_custkey"), now.drop("c_custkey"))


# ── relations, cards and evaluation ────────────────────────────────────────


def customer_symbols(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("c"), F.concat(F.lit("k"), k.cast("string")).alias("symbol_key"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node_id"), F.when(k % 3 == 0, "own").alias("summary"))


@FOUND("symbols_with_nodes", "SELECT 'k' || c_custkey AS symbol_key, CASE WHEN c_nationkey % 2 = 0 THEN n_name END AS node_label, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_nationkey % 4 = 0 THEN 'nodes' ELSE '' END AS summary FROM customer JOIN nation ON c_nationkey = n_nationkey")
def symbols_with_nodes(spark, d):
    n = F.col("n_nationkey")
    nodes = table(spark, d, "nation").where(n % 2 == 0).select(F.concat(F.lit("n"), n.cast("string")).alias("id"), F.col("n_name").alias("label"), F.when(n % 4 == 0, "nodes").alias("summary"))
    return relations.with_nodes(customer_symbols(spark, d), nodes).select("symbol_key", "node_label", "summary")


@FOUND("unique_keys", "SELECT 'n' || (c_custkey // 2) AS node_id, min('k' || c_custkey % 10) AS symbol_key FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey % 10) = 1")
def unique_keys(spark, d):
    k = F.col("c_custkey")
    return relations.unique_keys(table(spark, d, "customer").select(F.concat(F.lit("n"), F.floor(k / 2).cast("string")).alias("node_id"), F.concat(F.lit("k"), (k % 10).cast("string")).alias("symbol_key")))


@FOUND("resolved_modules", """WITH f AS (SELECT 'm' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' ELSE '.md' END AS path FROM customer WHERE c_custkey % 11 = 0), s AS (SELECT n_nationkey AS id, 'm' || n_nationkey AS base FROM nation), h AS (SELECT id, count(DISTINCT path) AS n, min(path) AS path FROM s JOIN f ON path IN (base || '.ts', base || '/index.js') GROUP BY id)
SELECT s.id, CASE WHEN n = 1 THEN path END AS target, CASE WHEN n IS NULL THEN 'not-found' WHEN n > 1 THEN 'ambiguous' END AS reason FROM s LEFT JOIN h USING (id)""")
def resolved_modules(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 11 = 0")
    inventory = c.select(F.concat(F.lit("m"), text_of("c_nationkey"), pick((".ts", "/index.js", ".md"), F.col("c_custkey"))).alias("path"))
    specs = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("m"), text_of("n_nationkey")).alias("base"))
    return relations.modules(specs, inventory)


@FOUND("restored_roles", "WITH n AS (SELECT c_nationkey AS path, c_custkey % 60 AS name, count(*) AS n, min(c_custkey) AS id FROM customer GROUP BY 1, 2) SELECT path, name, role, id FROM (SELECT s_nationkey AS path, s_suppkey % 60 AS name, 'r' || s_suppkey AS role FROM supplier) r JOIN n USING (path, name) WHERE n.n = 1")
def restored_roles(spark, d):
    roles = table(spark, d, "supplier").select(F.lit(0).alias("id"), F.col("s_nationkey").alias("path"), (F.col("s_suppkey") % 60).alias("name"), F.concat(F.lit("r"), text_of("s_suppkey")).alias("role"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("path"), (F.col("c_custkey") % 60).alias("name"))
    return relations.restored_roles(roles, nodes).select("path", "name", "role", "id")


@FOUND("binding_evidence", """WITH b AS (SELECT s_nationkey AS source_id, s_suppkey % 3 AS imported, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 't' || s_suppkey % 2 END AS target, CASE WHEN s_suppkey % 5 = 0 THEN 'no-file' END AS reason FROM supplier), g AS (SELECT source_id, imported, count(DISTINCT coalesce(target, '') || '/' || coalesce(reason, '')) AS n, min(target) AS t, min(reason) AS r FROM b GROUP BY 1, 2)
SELECT source_id, imported, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n > 1 THEN 'ambiguous-binding-evidence' ELSE r END AS reason FROM g""")
def binding_evidence(spark, d):
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id"), F.lit("f").alias("file_id"), (s % 3).alias("imported"), F.lit("x").alias("local"), F.lit(False).alias("type_only"), F.when(s % 5 != 0, F.concat(F.lit("t"), (s % 2).cast("string"))).alias("target"), F.when(s % 5 == 0, "no-file").alias("reason"))
    return relations.bindings(rows).select("source_id", "imported", "target", "reason")


@FOUND("import_bindings", """WITH x AS (SELECT p_size AS path, p_partkey % 40 AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT s_suppkey AS source, s_suppkey % 40 AS imported, CASE WHEN x.n = 1 AND s_suppkey % 7 <> 0 THEN k END AS target, CASE WHEN s_suppkey % 7 = 0 THEN 'unresolved-module' WHEN x.n IS NULL THEN 'no-exported-declaration' WHEN x.n > 1 THEN 'ambiguous-declaration' END AS reason FROM supplier LEFT JOIN x ON x.path = s_suppkey % 50 AND x.name = s_suppkey % 40 AND s_suppkey % 7 <> 0""")
def import_bindings(spark, d):
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    imports = table(spark, d, "supplier").select(s.alias("source"), F.when(s % 7 != 0, (s % 50).cast("int")).alias("target_path"), (s % 40).alias("imported"))
    made = table(spark, d, "part").select(F.col("p_size").alias("path"), (p % 40).alias("name"), p.alias("symbol_key"), F.when(p % 2 == 0, "exported").otherwise("local").alias("scope"))
    return ledger.import_bindings(imports, made)


@FOUND("exported_symbols", "SELECT 'src/' || s_nationkey || '.ts' AS path, 'ts|src/' || s_nationkey || '.ts|class|exported|S|0' AS symbol_key, 'class' AS kind FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey")
def exported_symbols(spark, d):
    s = F.col("s_suppkey")
    key = F.concat(F.lit("ts|src/"), text_of("s_nationkey"), F.lit(".ts|class|"), F.when(s % 2 == 0, "exported").otherwise("local"), F.lit("|S|0"))
    return ledger.exported_symbols(table(spark, d, "supplier").select(s.alias("id"), key.alias("symbol_key"), F.lit(None).cast("string").alias("kind"), F.lit("symbol").alias("node_kind")))


@FOUND("unresolved_and_report", "SELECT coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END, 'unknown') AS relation, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'null_rate', CAST(round(10000 * (1 - count(*) FILTER (l_linenumber < 3) / count(*))) AS BIGINT) FROM lineitem")
def unresolved_and_report(spark, d):
    rows = table(spark, d, "lineitem")
    n = relations.unresolved_counts(rows.select(F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("relation")))
    report = relations.resolver_report(rows.select("l_orderkey", F.when(F.col("l_linenumber") < 3, F.lit("x")).alias("node_id")))
    return n.unionByName(report.select(F.lit("null_rate").alias("relation"), F.round(F.col("null_rate") * 10_000).cast("long").alias("n")))


@FOUND("file_cards", """WITH s AS (SELECT 'src/' || c_nationkey AS path, 'k' || c_custkey % 400 AS symbol_key, CASE WHEN c_custkey % 3 = 0 THEN 'member' ELSE 'symbol' END AS kind, c_custkey % 2 = 0 AS exported FROM customer), o AS (SELECT * FROM s WHERE symbol_key IN (SELECT symbol_key FROM s GROUP BY 1 HAVING count(*) = 1))
SELECT path, coalesce(string_agg(DISTINCT symbol_key, ',' ORDER BY symbol_key) FILTER (kind = 'symbol' AND exported), '') AS exports, coalesce(string_agg(DISTINCT symbol_key, ',' ORDER BY symbol_key) FILTER (kind = 'member'), '') AS members FROM o GROUP BY path""")
def file_cards(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit("src/"), text_of("c_nationkey")).alias("path"), F.concat(F.lit("k"), (k % 400).cast("string")).alias("symbol_key"), F.when(k % 3 == 0, "member").otherwise("symbol").alias("node_kind"), F.when(k % 2 == 0, "exported").otherwise("local").alias("scope"))
    none = spark.createDataFrame([], "path string, imports array<string>, imported_by array<string>")
    return cards.file_cards(rows, none).select("path", F.array_join("exports", ",").alias("exports"), F.array_join("members", ",").alias("members"))


@FOUND("community_rollups", "SELECT n_regionkey AS community, string_agg('- ' || n_name || ': s' || n_nationkey, chr(10) ORDER BY n_name) AS rollup, count(*) AS narratives FROM nation GROUP BY 1")
def community_rollups(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("community"), F.col("n_name").alias("symbol_key"), F.concat(F.lit("s"), text_of("n_nationkey")).alias("summary"))
    return cards.rollup(rows, "community")


@FOUND("task_summary", "SELECT count(*) AS tasks, round(avg(CAST(event_type <> 'error' AS INT)), 9) AS success_rate, round(avg(user_id), 9) AS mean_file_reads, round(avg(CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 = 0 AS INT) END), 9) AS pass_rate FROM events")
def task_summary(spark, d):
    k = F.col("event_id")
    rows = evaluation.task_summary(table(spark, d, "events").select((F.col("event_type") != "error").alias("success"), F.col("user_id").alias("file_reads"), F.when(k % 2 == 0, k % 3 == 0).alias("judge_pass")))
    return rows.select("tasks", *[F.round(c, 9).alias(c) for c in ("success_rate", "mean_file_reads", "pass_rate")])


@FOUND("work_items", "SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'stale' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')")
def work_items(spark, d):
    return cards.work_items(table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "stale").otherwise("enriched").alias("status")))


@FOUND("enrichment_outcomes", "SELECT 'k' || c_custkey AS symbol_key, CASE WHEN c_custkey % 3 = 0 THEN 'enriched' WHEN c_custkey % 3 = 1 THEN 'error' ELSE 'pending' END AS status, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS attempts FROM customer")
def enrichment_outcomes(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.concat(F.lit("k"), k.cast("string")).alias("symbol_key"))
    work = rows.select("symbol_key", F.lit("pending").alias("status"), F.lit(None).cast("array<struct<mode:string,error:string>>").alias("attempts"))
    results = rows.where(k % 3 < 2).select("symbol_key", (k % 3 == 0).alias("ok"), F.when(k % 3 == 1, "bad").alias("error"), F.lit("m").alias("mode"))
    return cards.with_results(work, results).select("symbol_key", "status", F.coalesce(F.size("attempts"), F.lit(0)).alias("attempts")).withColumn("attempts", F.greatest("attempts", F.lit(0)))


LINES = "list_slice(string_split(text, chr(10)), doc_id % 3 + 1, doc_id % 3 + 2)"


@FOUND("source_freshness", f"""WITH r AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no-file' WHEN doc_id % 3 + 2 > n THEN 'out-of-range' END AS problem, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 + 2 <= n AND doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS fresh FROM r""")
def source_freshness(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    held = docs.where(k % 5 != 0).select("path", "content")
    want = F.sha2(T.line_slice("content", k % 3 + 1, k % 3 + 2), 256)
    symbols = docs.select(k.alias("symbol_key"), "path", (k % 3 + 1).alias("start"), (k % 3 + 2).alias("end"), F.when(k % 4 == 0, want).when(k % 2 == 0, "old").alias("expected"))
    return ledger.source_freshness(symbols, held).select(F.col("symbol_key").alias("doc_id"), "problem", "fresh")


@FOUND("semantic_jobs", f"SELECT doc_id, array_to_string({LINES}, chr(10)) AS code, CAST(ceil(length(array_to_string({LINES}, chr(10))) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0")
def semantic_jobs(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    work = docs.select(k.alias("symbol_key"), "path", F.when(k % 2 == 0, "pending").otherwise("enriched").alias("status"), (k % 3 + 1).alias("start"), (k % 3 + 2).alias("end"))
    return ledger.semantic_jobs(work, docs.select("path", "content")).withColumnRenamed("symbol_key", "doc_id")


@FOUND("everything_stale", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'stale' ELSE 'pending' END AS status, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS deletes FROM orders GROUP BY 1")
def everything_stale(spark, d):
    work = table(spark, d, "orders").select(text_of("o_orderkey").alias("symbol_key"), F.when(F.col("o_orderstatus") == "F", "enriched").otherwise("pending").alias("status"))
    rows, gone = ledger.all_stale(work)
    return rows.join(gone, "symbol_key", "left").groupBy("status").agg(F.count("*").alias("n"), F.count("action").alias("deletes"))


@FOUND("status_report", "SELECT 'worklist' AS section, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'queue', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'runs', CASE WHEN s_suppkey % 3 = 0 THEN 'finished' ELSE 'idle' END, count(*) FROM supplier GROUP BY 2")
def status_report(spark, d):
    runs = table(spark, d, "supplier").select((F.col("s_suppkey") % 3 == 0).alias("finished"), F.lit(False).alias("failed"), F.lit(None).cast("timestamp_ntz").alias("beat"))
    return ledger.status_report(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), table(spark, d, "events").select(F.col("event_type").alias("status")), capture.heartbeat(runs, "2024-01-30 12:00:00"))


@FOUND("retry_outcomes", "SELECT user_id AS symbol_key, coalesce(min(r) FILTER (ok), max(r)) AS rounds, CASE WHEN bool_or(ok) THEN 'enriched' ELSE 'error' END AS status FROM (SELECT user_id, event_id % 8 + 1 AS r, event_type = 'signup' AS ok FROM events) WHERE r <= 5 GROUP BY user_id")
def retry_outcomes(spark, d):
    return ledger.retry_outcomes(table(spark, d, "events").select(F.col("user_id").alias("symbol_key"), (F.col("event_id") % 8 + 1).alias("round"), (F.col("event_type") == "signup").alias("ok")))


@FOUND("migration_preview", "SELECT event_type AS type, count(*) AS total, count(*) FILTER (user_id % 4 = 0) AS deleted, count(*) FILTER (user_id % 4 <> 0) AS moved FROM events GROUP BY 1")
def migration_preview(spark, d):
    return ledger.migration_preview(table(spark, d, "events").select(F.col("event_type").alias("type"), F.when(F.col("user_id") % 4 == 0, F.col("ts")).alias("deleted_at")))


@FOUND("backfilled_nodes", """WITH n AS (SELECT c_custkey AS id, c_nationkey AS path, c_custkey % 50 AS name, CASE WHEN c_custkey % 6 = 0 THEN 'other' END AS k, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 50) AS n FROM customer), r AS (SELECT s_nationkey AS path, s_suppkey % 50 AS name, min(s_suppkey) AS s FROM supplier GROUP BY 1, 2)
SELECT id, CASE WHEN n = 1 AND s IS NOT NULL AND k IS NULL THEN 's' || s ELSE 'old' END AS summary, CASE WHEN n = 1 AND s IS NOT NULL AND k IS NULL THEN 'r' || s ELSE k END AS symbol_key FROM n LEFT JOIN r USING (path, name)""")
def backfilled_nodes(spark, d):
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("path"), (k % 50).alias("name"), F.lit("old").alias("summary"), F.when(k % 6 == 0, "other").alias("symbol_key"))
    one = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("path"), (F.col("s_suppkey") % 50).alias("name")).agg(F.min("s_suppkey").cast("string").alias("s"))
    return ledger.backfilled(nodes, one.select("path", "name", F.concat(F.lit("s"), "s").alias("summary"), F.concat(F.lit("r"), "s").alias("symbol_key"))).select("id", "summary", "symbol_key")


BACKFILL = """WITH k AS (SELECT c_custkey AS c, CASE c_custkey % 10 WHEN 0 THEN 'ts|src/a.ts|function|exported|f' || CASE WHEN c_custkey % 20 = 0 THEN '.' ELSE '/' END || c_custkey // 20 || '|0' WHEN 1 THEN 'bad|' || c_custkey WHEN 2 THEN 'ts|../x.ts|function|exported|f' || c_custkey || '|0' WHEN 3 THEN 'ts|src/.planning/x.ts|function|exported|f' || c_custkey || '|0' ELSE 'ts|src/a.ts|function|exported|g' || c_custkey || '|0' END AS symbol_key FROM customer),
t AS (SELECT *, 'key:symbol:' || regexp_replace(symbol_key, '[^a-zA-Z0-9_-]+', '_', 'g') AS tag, count(*) OVER (PARTITION BY regexp_replace(symbol_key, '[^a-zA-Z0-9_-]+', '_', 'g')) AS same FROM k),
m AS (SELECT symbol_key, c, CASE WHEN same > 1 THEN 'key-tag-collision' WHEN c % 10 = 1 THEN 'invalid-symbol-key' WHEN c % 10 = 2 THEN 'unsafe-path' WHEN c % 10 = 3 THEN 'ignored-path' END AS reason FROM t),
j AS (SELECT symbol_key, CASE WHEN c % 7 = 0 THEN NULL WHEN c % 10 = 9 THEN 'twice' || c // 20 ELSE 'm' || c END AS id, CASE WHEN c % 7 = 0 THEN 'invalid-memory-id' WHEN c % 7 = 1 THEN 'missing-exact-key-tag' WHEN c % 7 = 2 THEN 'project-tag-mismatch' WHEN c % 7 = 3 THEN 'conflicting-symbol-key' WHEN c % 7 = 4 THEN 'already-linked' END AS why FROM m WHERE reason IS NULL),
d AS (SELECT id FROM j WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
"""


def backfill(spark, d):
    c = F.col("c_custkey")
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    twenty = F.floor(c / 20)
    key = F.when(c % 10 == 0, said("ts|src/a.ts|function|exported|f", F.when(c % 20 == 0, ".").otherwise("/"), twenty, "|0")).when(c % 10 == 1, said("bad|", c)).when(c % 10 == 2, said("ts|../x.ts|function|exported|f", c, "|0")).when(c % 10 == 3, said("ts|src/.planning/x.ts|function|exported|f", c, "|0")).otherwise(said("ts|src/a.ts|function|exported|g", c, "|0"))
    rows = table(spark, d, "customer").select(c, key.alias("symbol_key"))
    tags = F.array_compact(F.array(K.key_tag("symbol_key"), F.when(c % 7 == 1, "key:symbol:other"), F.when(c % 7 == 2, "project:b").otherwise("project:a"), F.lit("x")))
    linked = F.when(c % 7 == 3, "another").when(c % 7 == 4, F.col("symbol_key"))
    id_ = F.when(c % 7 == 0, "").when(c % 10 == 9, said("twice", twenty)).otherwise(said("m", c))
    return delta.backfill_plan(rows, rows.select(id_.alias("id"), tags.alias("tags"), linked.alias("symbol_key")), "project:a")


@FOUND("backfill_mappings", BACKFILL + "SELECT id, symbol_key FROM j WHERE why IS NULL AND id NOT IN (SELECT id FROM d)")
def backfill_mappings(spark, d):
    return backfill(spark, d)[0]


@FOUND("backfill_skips", BACKFILL + "SELECT symbol_key, reason, CAST(NULL AS VARCHAR) AS id FROM m WHERE reason IS NOT NULL UNION ALL SELECT symbol_key, why, id FROM j WHERE why IS NOT NULL UNION ALL SELECT symbol_key, 'duplicate-memory-id', id FROM j WHERE id IN (SELECT id FROM d)")
def backfill_skips(spark, d):
    return backfill(spark, d)[1]


@FOUND("graph_delta_merge", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS label, 'node' AS part FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0 UNION ALL SELECT c_custkey, CAST(c_custkey % 10 AS VARCHAR), 'edge' FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 = 0")
def graph_delta_merge(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"))
    edge = lambda on: rows.where(on).select(text_of("id").alias("source"), (k % 10).cast("string").alias("target"), F.lit("calls").alias("relation"))
    rows = rows.withColumn("c_custkey", F.col("id"))
    nodes, edges = delta.graph_merged(rows.where("id % 5 <> 0").select("id", F.lit("old").alias("label")), rows.where("id % 3 = 0").select("id", F.lit("new").alias("label")), edge("id % 2 = 0"), edge("id % 7 = 0"))
    return nodes.withColumn("part", F.lit("node")).unionByName(edges.select(F.col("source").cast("long").alias("id"), F.col("target").alias("label"), F.lit("edge").alias("part")))


@FOUND("context_markdown", "SELECT n_nationkey AS k, '# ' || n_name || chr(10) || chr(10) || '## Region' || chr(10) || chr(10) || n_regionkey AS doc FROM nation")
def context_markdown(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ledger.context_markdown(F.col("n_name"), {"Region": text_of("n_regionkey"), "Empty": F.lit(" ")}).alias("doc"))


# ── memories, sessions and search ──────────────────────────────────────────


@FOUND("memory_filters", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND user_id % 3 <> 0 AND list_has_any(['u' || user_id % 4], ['u1', 'u2']) ORDER BY ts DESC, id LIMIT 50")
def memory_filters(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.array(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("tags"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 3 == 0, "archived").alias("status"))
    return memory.filtered(rows, "click", ["u1", "u2"], "2024-01-05", "2024-01-20", limit=50).select("id")


@FOUND("lifecycle_transitions", "WITH r AS (SELECT s_suppkey AS id, (['active', 'needs_review', 'archived'])[s_suppkey % 3 + 1] AS status, (['active', 'needs_review', 'archived'])[s_suppkey // 3 % 3 + 1] AS t FROM supplier), a AS (SELECT *, (status = 'active' AND t IN ('needs_review', 'archived')) OR (status = 'needs_review' AND t IN ('active', 'archived')) AS ok FROM r) SELECT id, CASE WHEN ok THEN t ELSE status END AS status, ok AS accepted FROM a")
def lifecycle_transitions(spark, d):
    states, s = ("active", "needs_review", "archived"), F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(s.alias("id"), pick(states, s).alias("status"))
    return memory.transition(rows, table(spark, d, "supplier").select(s.alias("id"), pick(states, F.floor(s / 3).cast("long")).alias("to")))


@FOUND("transition_log", "SELECT s_suppkey AS id, 'a' || s_suppkey % 3 AS from_state, 'a' || s_suppkey % 2 AS to_state FROM supplier WHERE s_suppkey % 3 <> s_suppkey % 2")
def transition_log(spark, d):
    s = F.col("s_suppkey")
    state = lambda m: table(spark, d, "supplier").select(s.alias("id"), F.concat(F.lit("a"), (s % m).cast("string")).alias("state"))
    return memory.transitions_log(state(3), state(2))


@FOUND("revive_gate", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 10 < 7 THEN 'defer' ELSE 'revive' END AS decision FROM events")
def revive_gate(spark, d):
    k = F.col("event_id")
    return memory.revive(table(spark, d, "events").select("event_id", F.when(k % 3 != 0, (k % 10) / 10).alias("confidence"))).select("event_id", "decision")


@FOUND("linked_memories", "SELECT c_nationkey AS symbol_key, c_custkey AS memory_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 DESC, c_custkey) <= 10 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def linked_memories(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("symbol_key"), (F.col("c_custkey") % 7).alias("updated_at"))
    return memory.linked_memories(table(spark, d, "nation").select(F.col("n_nationkey").alias("symbol_key")), rows).select("symbol_key", "memory_id")


@FOUND("recent_and_scoped", "SELECT 'recent' AS what, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 600 MINUTE UNION ALL SELECT 'scoped', count(*) FROM events WHERE user_id % 4 = 1 UNION ALL SELECT 'legacy', count(*) FROM events WHERE user_id % 4 IN (0, 1)")
def recent_and_scoped(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("project_id"))
    n = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    recent = memory.created_within(e.select(F.col("ts").alias("created_at")), 600, "2024-01-20 00:00:00").select(F.lit("recent").alias("what"), "n")
    return recent.unionByName(n("scoped", memory.scoped(rows, "p1"))).unionByName(n("legacy", memory.scoped(rows, "p1", True)))


@FOUND("session_ledger", "WITH l AS (SELECT conv_id AS session_id, turn // 2 AS tm, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 3 END AS o, text FROM conversations UNION ALL SELECT conv_id, turn // 2, 2, 'call ' || turn FROM conversations WHERE role = 'assistant') SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY tm, o, text) AS seq, (['prompt', 'response', 'tool_call', 'summary'])[o + 1] AS kind, sha256(text) AS h FROM l")
def session_ledger(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 2).alias("created_at"), "role", "text", "turn")
    calls = t.where("role = 'assistant'").withColumn("text", F.concat(F.lit("call "), text_of("turn")))
    rows = ledger.session_ledger(t.where("role = 'user'"), t.where("role = 'assistant'"), calls, t.where("role not in ('user', 'assistant')"))
    return rows.select("session_id", "seq", "kind", F.sha2("text", 256).alias("h"))


@FOUND("project_errors", "SELECT event_id AS id, n_name AS name FROM events JOIN nation ON n_nationkey = user_id % 40 WHERE event_type = 'error'")
def project_errors(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") % 40).cast("int").alias("project_id"))
    return ledger.project_errors(errors, table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))).select("id", "name")


@FOUND("embedded_memories", "SELECT event_id AS id, vec_id IS NOT NULL AS embedded FROM events LEFT JOIN embeddings ON vec_id = event_id WHERE event_type <> 'error'")
def embedded_memories(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", "active").otherwise("archived").alias("status"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ledger.with_embeddings(rows, vectors).select("id", F.col("embedding").isNotNull().alias("embedded"))


@FOUND("backend_drift", """WITH a AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 <> 0), m AS (SELECT count(*) AS overlap FROM a JOIN b USING (vec_id))
SELECT (SELECT count(*) FROM a) AS total_left, (SELECT count(*) FROM b) AS total_right, overlap, (SELECT count(*) FROM a) - overlap AS left_only, (SELECT count(*) FROM b) - overlap AS right_only, 1.0 AS avg_cosine FROM m""")
def backend_drift(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    a, b = rows.where("id % 3 <> 0"), rows.where("id % 5 <> 0")
    return ledger.backend_drift(a, b, ledger.paired_cosines(a, b)).withColumn("avg_cosine", F.round("avg_cosine", 6))


@FOUND("watchers_alive", "SELECT user_id, epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(max(ts))) <= 90 * 600 AND user_id % 2 = 0 AND user_id % 3 <> 0 AS alive FROM events GROUP BY user_id")
def watchers_alive(spark, d):
    u = F.col("user_id")
    beats = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("beat")).select("user_id", "beat", F.when(u % 2 == 0, "a\\b").otherwise("c").alias("root"), (u % 3 != 0).alias("pid_alive"))
    return ledger.alive(beats, F.lit("2024-01-30 12:00:00").cast("timestamp"), "a/b", 90 * 600).select("user_id", "alive")


@FOUND("pending_changes", "SELECT user_id AS key, max(event_id) AS last FROM events GROUP BY 1 HAVING max(event_id) % 2 = 0 OR user_id % 3 = 0")
def pending_changes(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("last"))
    done = last.where("last % 2 = 1 and key % 3 <> 0").unionByName(last.where("key % 3 = 0").withColumn("last", F.col("last") - 1))
    return capture.remaining(last, done)


@FOUND("cleaned_events", """SELECT event_id, '[REDACTED] ' || event_type AS content, '{"token":"***REDACTED***"}' AS args, event_type AS result FROM events""")
def cleaned_events(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("<private>x</private> "), "event_type").alias("content"), F.lit('{"token":1}').alias("argsSafe"), F.col("event_type").alias("resultSummary"))
    return capture.cleaned(rows).select("event_id", "content", F.col("argsSafe").alias("args"), F.col("resultSummary").alias("result"))


# ── files ──────────────────────────────────────────────────────────────────


@FOUND("json_artifacts", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def json_artifacts(spark, d):
    """Written as JSON lines, appended to and read again as a folder."""
    base = Scratch(spark, "json").base
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    files.write_json(rows.where("k % 2 = 0"), f"{base}/materialized")
    files.append_events(rows.where("k % 2 = 1"), f"{base}/materialized", 5)
    back = spark.read.schema("k int, name string").json(f"{base}/materialized")
    return back.unionByName(files.read_json(spark, f"{base}/nowhere", "k int, name string", back.limit(0)))


@FOUND("concatenated_json", """SELECT n, count(*) AS rows FROM (SELECT user_id, event_id, '{"k": ' || json_extract(props, '$.k') || '}' AS n FROM events) GROUP BY n""")
def concatenated_json(spark, d):
    said = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    texts = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.array_join(F.collect_list(said), "\n "), F.lit(" {bad")).alias("value"))
    return files.split_documents(texts).groupBy(F.col("document").alias("n")).agg(F.count("*").alias("rows"))


@FOUND("known_issues", "SELECT 'Issue ' || n_nationkey AS title, 'do ' || n_name AS fix, 'a,b' || n_regionkey AS tags FROM nation WHERE n_nationkey % 3 <> 0")
def known_issues(spark, d):
    k = F.col("n_nationkey")
    block = F.concat(F.lit("## Issue "), text_of("n_nationkey"), F.lit("\n- **Cause:** x\n"), F.when(k % 3 != 0, F.concat(F.lit("- **Fix:** do "), "n_name", F.lit("\n"))).otherwise(""), F.lit("- Tags: a, b"), text_of("n_regionkey"), F.lit("\n"))
    text = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("# Issues\n\n"), F.array_join(F.collect_list(block), "\n")).alias("value"))
    return files.known_issues(text).select("title", "fix", F.array_join("tags", ",").alias("tags"))


@FOUND("declared_symbols", """SELECT 'src/' || n_nationkey || ext AS path, kind, nm || n_nationkey AS name, line AS start_line FROM nation, (VALUES (0, '.py', 'class', 'A', 1), (0, '.py', 'function', 'run', 2), (1, '.ts', 'function', 'go', 2), (1, '.ts', 'class', 'B', 5), (2, '.go', 'function', 'Do', 1), (3, '.rs', 'type', 'T', 1)) v(m, ext, kind, nm, line) WHERE n_nationkey % 4 = m""")
def declared_symbols(spark, d):
    n = text_of("n_nationkey")
    code = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("class A"), n, F.lit(":\n    def run"), n, F.lit("(self):\n        pass")))
    code = code.when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("import x from './x'\nexport function go"), n, F.lit("() {\n  return 1\n}\nexport class B"), n, F.lit(" {\n}")))
    code = code.when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("func Do"), n, F.lit("() {}"))).otherwise(F.concat(F.lit("pub struct T"), n, F.lit(" {}")))
    rows = table(spark, d, "nation").select(F.concat(F.lit("src/"), n, pick((".py", ".ts", ".go", ".rs"), F.col("n_nationkey"))).alias("path"), code.alias("content"))
    return files.declared_symbols(rows).select("path", "kind", "name", "start_line")


@FOUND("rule_sentences", "SELECT 'Use ' || n_name || '.' AS rule FROM nation UNION ALL SELECT 'Avoid it.' FROM nation")
def rule_sentences(spark, d):
    return files.rule_sentences(table(spark, d, "nation").select(F.concat(F.lit("Some words. Use "), "n_name", F.lit(". Avoid it. Useful things too.")).alias("value")))


@FOUND("loaded_graph", "SELECT c_nationkey AS id, max(c_custkey) AS last, 'src/' || c_nationkey AS source_file, CASE WHEN c_nationkey % 2 = 0 THEN 'index' WHEN max(c_custkey) % 2 = 0 THEN 'node' ELSE '' END AS summary, count(DISTINCT c_mktsegment) AS edges FROM customer GROUP BY c_nationkey")
def loaded_graph(spark, d):
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), k.alias("seq"), k.alias("last"), F.concat(F.lit("src\\"), text_of("c_nationkey")).alias("source_file"), F.when(k % 2 == 0, "node").alias("summary"))
    index = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("graph_node_id"), F.lit("index").alias("summary"), F.lit("k").alias("symbol_key"))
    twice = table(spark, d, "customer").select(text_of("c_nationkey").alias("source"), text_of("c_mktsegment").alias("target"), F.lit("calls").alias("relation"))
    nodes, edges = ledger.loaded_graph(nodes, twice, index)
    out = edges.groupBy(F.col("source").cast("long").alias("id")).agg(F.count("*").alias("edges"))
    return nodes.join(out, "id", "left").select("id", "last", "source_file", "summary", "edges")


@FOUND("structure_facts", "WITH f AS (SELECT (['src/', 'tests/', '', 'lib/x/'])[p_partkey % 4 + 1] || 'f' || p_partkey || (['.ts', '.py', '', '.test.js'])[p_partkey // 4 % 4 + 1] AS path FROM part) SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS folder, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS extension, count(*) AS files, count(*) FILTER (regexp_matches(path, '(^|/)tests?/|\\.(test|spec)\\.[^/.]+$')) AS tests FROM f GROUP BY 1, 2")
def structure_facts(spark, d):
    p = F.col("p_partkey")
    path = F.concat(pick(("src/", "tests/", "", "lib/x/"), p), F.lit("f"), p.cast("string"), pick((".ts", ".py", "", ".test.js"), F.floor(p / 4).cast("long")))
    return files.structure_facts(table(spark, d, "part").select(path.alias("path")))


@FOUND("stack_facts", "SELECT 'p' || n_nationkey AS path, d AS dependency, v AS version, d = 'dev' AS dev FROM (SELECT n_nationkey, 'dep' || n_regionkey AS d, '^' || n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'dev', '1' FROM nation WHERE n_nationkey % 2 = 0)")
def stack_facts(spark, d):
    n = F.col("n_nationkey")
    content = F.concat(F.lit('{"name":"x","dependencies":{"dep'), text_of("n_regionkey"), F.lit('":"^'), text_of("n_nationkey"), F.lit('"}'), F.when(n % 2 == 0, ',"devDependencies":{"dev":"1"}').otherwise(""), F.lit("}"))
    return files.stack_facts(table(spark, d, "nation").select(F.concat(F.lit("p"), text_of("n_nationkey")).alias("path"), content.alias("content")))


@FOUND("forgotten_sessions", "SELECT conv_id AS session_id, count(*) AS left_turns, (SELECT count(*) FROM conversations c2 WHERE c2.conv_id = c.conv_id AND c2.turn % 2 = 0) AS left_vectors FROM conversations c WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def forgotten_sessions(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.concat_ws("/", "conv_id", "turn").alias("id"), "turn")
    rows = memory.forgotten(turns, turns.where("session_id % 3 = 0"))
    left, vectors = memory.purged(rows, turns.where("turn % 2 = 0").select("session_id", "id"))
    n = vectors.groupBy("session_id").agg(F.count("*").alias("left_vectors"))
    return left.groupBy("session_id").agg(F.count("*").alias("left_turns")).join(n, "session_id", "left").withColumn("left_vectors", F.coalesce("left_vectors", F.lit(0)))


@FOUND("topic_aliases", "WITH a AS (SELECT replace(replace(lower(n_name), ' ', '-'), '_', '-') AS slug, max_by('t' || n_regionkey, n_nationkey) AS topic FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1) SELECT n_name AS alias, replace(replace(lower(n_name), ' ', '-'), '_', '-') AS slug, coalesce(topic, replace(replace(lower(n_name), ' ', '-'), '_', '-')) AS topic FROM nation LEFT JOIN a ON slug = replace(replace(lower(n_name), ' ', '-'), '_', '-')")
def topic_aliases(spark, d):
    n = table(spark, d, "nation")
    given = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("alias"), F.concat(F.lit("t"), text_of("n_regionkey")).alias("topic"), F.col("n_nationkey").alias("seq"))
    return memory.resolved_topics(n.select(F.col("n_name").alias("alias")), given)


@FOUND("topic_suggestions", """WITH s AS (SELECT DISTINCT replace(lower(p_brand || ' ' || p_type), ' ', '-') AS slug FROM part), w AS (SELECT DISTINCT slug, unnest(string_split(slug, '-')) AS w FROM s), t AS (SELECT DISTINCT topic, unnest(string_split(topic, '-')) AS w FROM (SELECT DISTINCT replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_type), ' ', '-') AS topic FROM part)),
h AS (SELECT slug, topic, count(*) AS shared FROM w JOIN t USING (w) WHERE w <> '' GROUP BY 1, 2) SELECT slug, topic, shared, row_number() OVER (PARTITION BY slug ORDER BY shared DESC, topic) AS rank FROM h QUALIFY rank <= 3""")
def topic_suggestions(spark, d):
    slug = lambda *c: F.lower(F.replace(F.concat_ws("-", *c), F.lit(" "), F.lit("-")))
    p = table(spark, d, "part")
    return memory.suggested_topics(p.select(slug("p_brand", "p_type").alias("slug")).distinct(), p.select(slug("p_name", "p_type").alias("topic")).distinct())


@FOUND("maintenance_run", "WITH u AS (SELECT user_id AS id, date_diff('day', CAST(max(ts) AS DATE) - CAST(user_id AS INT) * 3, DATE '2024-02-15') AS days FROM events GROUP BY user_id), s AS (SELECT *, CASE WHEN days >= 455 THEN 'purge_candidate' WHEN days >= 365 THEN 'gist_only' WHEN days >= 180 THEN 'shadow' WHEN days >= 90 THEN 'dimmed' WHEN days >= 30 THEN 'cooling' ELSE 'active' END AS state FROM u) SELECT 'changed' AS what, count(*) AS n FROM s WHERE state <> CASE WHEN id % 2 = 0 THEN 'active' ELSE 'dimmed' END UNION ALL SELECT 'pruned', count(*) FROM s WHERE pow(0.5, greatest(days, 0) / 30.0) < 0.05 AND days > 90")
def maintenance_run(spark, d):
    used = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("used")).select("id", F.date_sub(F.col("used").cast("date"), (F.col("id") * 3).cast("int")).alias("last_used"))
    rows = used.select("id", "last_used", F.col("last_used").alias("updated_at"), F.lit(False).alias("evergreen"), F.array(F.lit("x")).alias("tags"), F.lit("learning").alias("category"), F.lit(1.0).alias("activation_score"), F.when(F.col("id") % 2 == 0, "active").otherwise("dimmed").alias("state"))
    _, changed, pruned = memory.maintained(rows, "2024-02-15 00:00:00")
    n = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return n("changed", changed).unionByName(n("pruned", pruned))


@FOUND("named_communities", "SELECT n_nationkey AS community, CASE WHEN n_nationkey % 3 = 0 THEN 'old' WHEN n_nationkey % 3 = 1 AND n_nationkey % 4 <> 0 THEN n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'kept' WHEN n_nationkey % 3 = 1 AND n_nationkey % 4 <> 0 THEN 'named' ELSE 'skipped' END AS outcome FROM nation")
def named_communities(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    return cards.named_communities(n.select(k.alias("community"), F.when(k % 3 == 0, "old").alias("name")), n.where(k % 3 < 2).select(k.alias("community"), F.when(k % 4 != 0, F.col("n_name")).otherwise(" ").alias("name")))


@FOUND("session_snapshot", "SELECT 'worklist' AS section, o_orderstatus AS name, CAST(count(*) AS VARCHAR) AS text FROM orders GROUP BY 2 UNION ALL (SELECT 'overview', r_name, 'about ' || r_regionkey FROM region ORDER BY r_name LIMIT 3)")
def session_snapshot(spark, d):
    report = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")).select(F.lit("worklist").alias("section"), "name", "n")
    docs = table(spark, d, "region").select(F.col("r_name").alias("kind"), F.concat(F.lit("about "), text_of("r_regionkey")).alias("text"))
    return cards.session_snapshot(report, docs, 3)


@FOUND("search_everywhere", """WITH h AS (SELECT 'docs' AS source, CAST(doc_id AS VARCHAR) AS id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'data') AS INT) AS score, doc_id AS o FROM documents UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'data') AS INT), item_id FROM benchmark),
t AS (SELECT * FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, o) <= 12), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS turn FROM t)
SELECT source, id, score, turn FROM r ORDER BY turn, score DESC, source, id LIMIT 12""")
def search_everywhere(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.search_everywhere({"docs": docs, "bench": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")}, "the data", 12)
