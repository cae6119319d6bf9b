"""Queries of narrative acceptance, cache decisions, results from outside and cards: each row has flags of its own, and the SQL is the rule over them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom.operators import narratives
from graphloom.plans.registering import Registry
from graphloom.session import table

FOUND = Registry()


def k():
    return F.col("c_custkey")


def on(p: int):
    """A flag of a customer, in Spark; ``c_custkey % p = 1`` in SQL. Flags of different primes are independent."""
    return k() % p == 1


KEY_SQL = "'ts|src/c' || c_custkey || '.ts|function|exported|f' || c_custkey || '|0'"


def key():
    return F.concat(F.lit("ts|src/c"), k().cast("string"), F.lit(".ts|function|exported|f"), k().cast("string"), F.lit("|0"))


def content(bad):
    """A narrative that mentions its own symbol; a bad one mentions another."""
    mention = F.when(bad, "nothing").otherwise(F.col("symbol_key"))
    return F.concat(F.lit('{"summary":"does '), k().cast("string"), F.lit('","behavior":[],"sideEffects":["x"],"errors":[],"contracts":[],"changeNotes":"","mentions":["'), mention, F.lit('"]}'))


def evidence(df, missing, invalid, other_key, other_hash):
    """Rows of the index or worklist: symbol_key, narrative_hash, prompt_version, callees, own_key."""
    hashed = F.when(missing, None).when(other_hash, "z").otherwise("h")
    return df.select("symbol_key", hashed.alias("narrative_hash"), F.when(invalid, "").otherwise("v2").alias("prompt_version"), F.create_map("symbol_key", F.lit("c")).alias("callees"), F.when(other_key, "x").otherwise(F.col("symbol_key")).alias("own_key"))


def artifacts(base):
    own = F.struct(F.when(on(67), "z").otherwise("h").alias("narrativeHash"), F.when(~on(29), "v2").alias("promptVersion"), F.create_map("symbol_key", F.lit("c")).alias("calleeSummaryHashes"), F.when(on(31), "x").otherwise(F.col("symbol_key")).alias("symbolKey"))
    whole = F.to_json(F.struct(F.when(~on(19), content(on(73))).alias("content"), F.when(~on(23), own).alias("narrativeEvidence")))
    return base.where(~on(11)).select("symbol_key", (~on(13)).alias("readable"), F.when(on(17), F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole).alias("payload"))


FLAG = "c_custkey % {} = 1"
ARTIFACT_SQL = " ".join(f"WHEN c_custkey % {p} = 1 THEN '{r}'" for p, r in ((11, "no-accepted-artifact"), (13, "unreadable-artifact"), (17, "corrupt-artifact"), (19, "missing-content"), (23, "missing-stored-hash"), (29, "invalid-evidence"), (31, "wrong-key")))


def prepared(spark, d):
    base = table(spark, d, "customer").select(k(), key().alias("symbol_key"))
    index = evidence(base.where(k() % 5 != 2), on(41), on(43), on(47), on(71))
    work = evidence(base, on(53), on(59), on(61), on(79))
    return base, artifacts(base), index, work.unionByName(evidence(base.where(on(37)), on(53), on(59), on(61), on(79)))


@FOUND("evidence_checks", f"""WITH r AS (SELECT {KEY_SQL} AS symbol_key, c_custkey, CASE {ARTIFACT_SQL} WHEN c_custkey % 37 = 1 THEN 'ambiguous-worklist-evidence' WHEN c_custkey % 5 = 2 OR c_custkey % 41 = 1 THEN 'missing-index-fingerprint' WHEN c_custkey % 43 = 1 THEN 'invalid-index-evidence' WHEN c_custkey % 47 = 1 THEN 'wrong-index-key'
WHEN c_custkey % 53 = 1 THEN 'missing-worklist-fingerprint' WHEN c_custkey % 59 = 1 THEN 'invalid-worklist-evidence' WHEN c_custkey % 61 = 1 THEN 'wrong-worklist-key' WHEN (c_custkey % 71 = 1) <> (c_custkey % 79 = 1) OR (c_custkey % 67 = 1) <> (c_custkey % 79 = 1) THEN 'fingerprint-mismatch' WHEN c_custkey % 73 = 1 THEN 'invalid-content' END AS reason FROM customer)
SELECT symbol_key, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN 'does ' || c_custkey END AS summary FROM r""")
def evidence_checks(spark, d):
    base, made, index, work = prepared(spark, d)
    return narratives.accepted_narratives(base, made, index, work, base)


@FOUND("cache_decisions", f"""WITH r AS (SELECT {KEY_SQL} AS symbol_key, CASE WHEN c_custkey % 7 = 1 THEN 'source-unavailable' WHEN c_custkey % 53 = 1 THEN 'missing-stored-hash' WHEN c_custkey % 59 = 1 THEN 'invalid-stored-evidence' WHEN c_custkey % 79 = 1 THEN 'worklist-fingerprint-mismatch'
WHEN c_custkey % 5 = 2 OR c_custkey % 41 = 1 THEN 'missing-stored-hash' WHEN c_custkey % 43 = 1 THEN 'invalid-stored-evidence' WHEN c_custkey % 71 = 1 THEN 'index-fingerprint-mismatch' {ARTIFACT_SQL} WHEN c_custkey % 67 = 1 THEN 'fingerprint-mismatch' WHEN c_custkey % 73 = 1 THEN 'invalid-content' END AS reason FROM customer)
SELECT symbol_key, reason IS NULL AS hit, reason FROM r""")
def cache_decisions(spark, d):
    base, made, index, _ = prepared(spark, d)
    none = F.lit(False)
    return narratives.cache_decisions(evidence(base, on(7), none, none, none), evidence(base, on(53), on(59), on(61), on(79)), index, made, base)


OUTSIDE = ((11, "not-found"), (13, "already-done"), (17, "unreadable-content"), (19, "empty-content"))


@FOUND("external_results", f"""WITH r AS (SELECT c_custkey AS entry_id, CASE {' '.join(f"WHEN c_custkey % {p} = 1 THEN '{x}'" for p, x in OUTSIDE)}
WHEN c_custkey % 3 <> 0 AND c_custkey % 23 = 1 THEN 'unsupported-prompt-version' WHEN c_custkey % 3 <> 0 AND c_custkey % 29 = 1 THEN 'schema-mismatch' WHEN c_custkey % 3 <> 0 AND c_custkey % 31 = 1 THEN 'invalid-json' WHEN c_custkey % 3 <> 0 AND c_custkey % 37 = 1 THEN 'invalid-narrative'
WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 41 = 1 THEN 'invalid-evidence' WHEN c_custkey % 43 = 1 THEN 'evidence-of-another-key' WHEN c_custkey % 3 = 0 OR c_custkey % 47 = 1 THEN 'evidence-of-another-version' WHEN c_custkey % 53 = 1 THEN 'source-unavailable' WHEN c_custkey % 59 = 1 THEN 'fingerprint-mismatch' WHEN c_custkey % 7 = 1 THEN 'superseded' ELSE 'applied' END ELSE 'applied' END AS outcome FROM customer)
SELECT entry_id, outcome, CASE WHEN outcome = 'applied' THEN 'done' WHEN outcome NOT IN ('not-found', 'already-done') THEN 'error' END AS entry_status, CASE WHEN outcome = 'applied' THEN 'enriched' WHEN outcome IN ('invalid-evidence', 'evidence-of-another-key', 'evidence-of-another-version', 'source-unavailable', 'fingerprint-mismatch') THEN 'stale' END AS symbol_status FROM r""")
def external_results(spark, d):
    base = table(spark, d, "customer").select(k(), k().alias("entry_id"), key().alias("symbol_key"))
    text = F.when(on(17), None).when(on(19), "  ").when(on(31), "{").otherwise(content(on(37)))
    given = base.select("entry_id", text.alias("content"))
    told = k() % 3 != 0
    queue = base.where(~on(11)).select(
        "entry_id", "symbol_key", F.when(on(13), "done").otherwise("queued").alias("status"), F.when(told, F.when(on(23), "v1").otherwise("v2")).alias("prompt_version"), F.when(told, F.when(on(29), "{}").otherwise("S")).alias("schema"),
        F.array("symbol_key").alias("known_keys"), (k() % 2 == 1).alias("has_evidence"), F.when(on(41), "").otherwise("h").alias("e_narrative_hash"), F.when(on(47), "v9").otherwise("v2").alias("e_prompt_version"), F.create_map("symbol_key", F.lit("c")).alias("e_callees"), F.when(on(43), "x").otherwise(F.col("symbol_key")).alias("e_own_key"),
    )
    work = base.select("symbol_key", F.when(on(7), "stale").otherwise("queued").alias("status"))
    now = base.where(~on(53)).select("symbol_key", F.when(on(59), "g").otherwise("h").alias("narrative_hash"))
    found = narratives.external_results(given, queue, work, now, "v2", "S")
    return found.select("entry_id", "outcome").join(narratives.after_external(found).select("entry_id", "entry_status", "symbol_status"), "entry_id")


def card_tables(spark, d):
    """Customers are symbols of their nation's community; some have two nodes, another file than their key's, a C# key, or no community."""
    own = F.when(on(17), F.concat(F.lit("csharp|src/c"), k().cast("string"), F.lit(".ts||C|class|C|()"))).otherwise(key())
    base = table(spark, d, "customer").select(k(), "c_nationkey", own.alias("symbol_key"), F.concat(F.lit("src\\c"), k().cast("string"), F.lit(".ts")).alias("source_file"))
    node = base.select(F.concat(F.lit("n"), k().cast("string")).alias("id"), "symbol_key", F.when(on(13), "src/else.ts").otherwise(F.col("source_file")).alias("source_file"), F.when(on(19), "doc").otherwise("symbol").alias("node_kind"), F.when(~on(23), F.col("c_nationkey")).alias("community"))
    twice = base.where(on(11)).select(F.concat(F.lit("m"), k().cast("string")).alias("id"), "symbol_key", "source_file", F.lit("symbol").alias("node_kind"), F.col("c_nationkey").alias("community"))
    return base, node.unionByName(twice)


CARD_SQL = f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 17 = 1 THEN 'csharp|src/c' || c_custkey || '.ts||C|class|C|()' ELSE {KEY_SQL} END AS key, 'src/c' || c_custkey || '.ts' AS path FROM customer),
n AS (SELECT g, k, key, CASE WHEN k % 13 = 1 THEN 'src/else.ts' ELSE path END AS at, CASE WHEN k % 19 = 1 THEN 'doc' ELSE 'symbol' END AS kind, CASE WHEN k % 23 <> 1 THEN g END AS c FROM c UNION ALL SELECT g, k, key, path, 'symbol', g FROM c WHERE k % 11 = 1),
"""
TOLD_SQL = """SELECT owner, CASE WHEN reason IS NULL THEN 'narrative' ELSE 'rejected' END AS part, key, coalesce(reason, 'does ' || k) AS text FROM told
UNION ALL SELECT owner, 'rejected', key, reason FROM bad UNION ALL SELECT owner, part, key, text FROM good"""


@FOUND("community_cards", CARD_SQL + """m AS (SELECT CAST(c.g AS VARCHAR) AS owner, c.k, c.key, c.path, (SELECT count(*) FROM n WHERE n.k = c.k AND n.at = c.path AND kind = 'symbol' AND n.c = c.g) AS hits, EXISTS (SELECT 1 FROM n WHERE n.k = c.k AND n.at = c.path) AS there FROM c),
good AS (SELECT owner, 'member' AS part, key, path AS text FROM m WHERE hits = 1),
bad AS (SELECT owner, key, 'ambiguous-symbol-key' AS reason FROM m WHERE hits > 1 UNION ALL SELECT owner, 'file|' || path, 'file-not-in-graph' FROM m WHERE NOT there),
told AS (SELECT owner, k, key, CASE WHEN hits <> 1 THEN 'symbol-not-in-community' WHEN k % 29 = 1 THEN 'invalid-narrative' END AS reason FROM m WHERE k % 2 = 0 OR k % 29 = 1)
""" + TOLD_SQL)
def community_cards(spark, d):
    base, nodes = card_tables(spark, d)
    told = base.where((k() % 2 == 0) | on(29)).select(F.col("c_nationkey").alias("community"), "symbol_key", content(on(29)).alias("content"))
    return narratives.community_cards(base.select(F.col("c_nationkey").alias("community"), F.col("source_file").alias("path")), nodes, told, base).withColumnRenamed("community", "owner")


@FOUND("feature_cards", CARD_SQL + """m AS (SELECT 'f' || g AS owner, k, key, path, (SELECT count(*) FROM n WHERE n.k = c.k AND n.at = c.path) AS hits FROM c),
good AS (SELECT owner, 'member' AS part, key, path AS text FROM m WHERE k % 3 <> 0 AND hits = 1 UNION ALL SELECT owner, 'file', 'file|' || path, path FROM m WHERE k % 3 = 0 AND hits > 0),
bad AS (SELECT owner, CASE WHEN k % 3 = 0 THEN 'file|' || path ELSE key END AS key, CASE WHEN k % 3 = 0 THEN 'file-not-in-graph' WHEN hits = 0 THEN 'symbol-not-in-graph' ELSE 'ambiguous-symbol-key' END AS reason FROM m WHERE hits = 0 OR k % 3 <> 0 AND hits > 1 UNION ALL SELECT owner, 'word ' || k, 'non-canonical-member-key' FROM m WHERE k % 5 = 0),
told AS (SELECT owner, k, key, CASE WHEN k % 3 = 0 OR hits <> 1 THEN 'symbol-not-in-feature' WHEN k % 29 = 1 THEN 'invalid-narrative' END AS reason FROM m WHERE k % 2 = 0 OR k % 29 = 1)
""" + TOLD_SQL)
def feature_cards(spark, d):
    base, nodes = card_tables(spark, d)
    feature = F.concat(F.lit("f"), F.col("c_nationkey").cast("string"))
    member = F.when(k() % 3 == 0, F.concat(F.lit("file|"), F.when(k() % 2 == 0, F.col("source_file")).otherwise(F.replace("source_file", F.lit("\\"), F.lit("/"))))).otherwise(F.col("symbol_key"))
    members = base.select(feature.alias("feature"), member.alias("member")).unionByName(base.where(k() % 5 == 0).select(feature.alias("feature"), F.concat(F.lit("word "), k().cast("string")).alias("member")))
    told = base.where((k() % 2 == 0) | on(29)).select(feature.alias("feature"), "symbol_key", content(on(29)).alias("content"))
    return narratives.feature_cards(members, nodes, told, base).withColumnRenamed("feature", "owner")


@FOUND("narrative_acceptance", CARD_SQL.rstrip(",\n") + """
SELECT g AS community, string_agg('- ' || key || ': does ' || k, chr(10) ORDER BY key) AS text, count(*) AS members, CAST(0 AS INTEGER) AS rejected FROM c WHERE (SELECT count(*) FROM n WHERE n.k = c.k AND n.at = c.path AND kind = 'symbol' AND n.c = c.g) = 1 GROUP BY g""")
def narrative_acceptance(spark, d):
    """Rollups of communities whose members all have an accepted narrative."""
    base, nodes = card_tables(spark, d)
    files = base.select(F.col("c_nationkey").alias("community"), F.col("source_file").alias("path"))
    members = narratives.community_cards(files, nodes, base.limit(0).select(F.col("c_nationkey").alias("community"), "symbol_key", F.lit("").alias("content")), base).where("part = 'member'")
    told = base.join(members.select(F.col("key").alias("symbol_key")), "symbol_key", "left_semi").select(F.col("c_nationkey").alias("community"), "symbol_key", content(F.lit(False)).alias("content"))
    shown = narratives.rolled_up(narratives.community_cards(files, nodes, told, base).where("part <> 'rejected'"), "community")
    return shown.select(F.col("community").cast("long").alias("community"), "text", "members", F.size("rejected").alias("rejected"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


N = narratives
PROMPT_SQL = " || chr(10) || ".join([
    "'Symbol: f' || c_custkey", "'Kind: function'", "'Language: ts'", "'Location: src/c' || c_custkey || '.ts:' || (c_custkey % 9 + 1) || '-' || (c_custkey % 9 + 3)", "'Prompt version: v2'",
    "CASE WHEN c_custkey % 5 = 0 THEN 'Role: (unclassified)' ELSE 'Role: service' || CASE WHEN c_custkey % 2 = 0 THEN ' (layer: core, confidence: 0.8)' ELSE ' (confidence: 0.8)' END END", "'Signature: ' || CASE WHEN c_custkey % 3 = 0 THEN 'f(x)' ELSE 'function f' || c_custkey || '() {' END", "''",
    quoted(N.HEAD_CALLEES), "CASE WHEN c_custkey % 4 = 0 THEN '(none)' ELSE '- ts|a|f|e|callee|0: does ' || c_custkey END", "''",
    quoted(N.HEAD_CALLERS), "CASE WHEN c_custkey % 8 = 0 THEN '(none)' ELSE (SELECT string_agg('- caller' || i || ' — role: ' || CASE WHEN i % 2 = 0 THEN 'unclassified' ELSE 'r' || i END, chr(10) ORDER BY i) FROM range(1, least(c_custkey % 8, 5) + 1) t(i)) END", "''",
    quoted(N.HEAD_FILE), "CASE WHEN c_custkey % 7 = 0 THEN '(not available)' ELSE c_mktsegment END", "''", quoted(N.HEAD_RULES), "'- Keep it'", "''", quoted(N.HEAD_IMPORTS), "'(none)'", "''",
    quoted(N.HEAD_CODE), "'function f' || c_custkey || '() {' || chr(10) || '}'", "''", quoted(N.HEAD_OUTPUT), quoted(json.dumps(N.SCHEMA, indent=2)), "''", quoted(N.HEAD_KEYS), f"'- ' || {KEY_SQL}", "''", quoted(N.IN_ENGLISH),
])


@FOUND("narrative_prompts", f"SELECT {KEY_SQL} AS symbol_key, {PROMPT_SQL} AS prompt FROM customer")
def narrative_prompts(spark, d):
    n = k()
    text = n.cast("string")
    callee = F.struct(F.when(n % 4 == 0, "no key").otherwise("ts|a|f|e|callee|0").alias("key"), F.concat(F.lit("does "), text, F.lit("\nand more")).alias("summary"))
    blank = F.array(F.struct(F.lit("ts|a|f|e|x|0").alias("key"), F.lit(" ").alias("name"), F.lit("r").alias("role")))
    named = F.transform(F.sequence(F.lit(1), F.greatest(n % 8, F.lit(1))), lambda i: F.struct(F.when(n % 8 == 0, "bad").otherwise("ts|a|f|e|c|0").alias("key"), F.concat(F.lit("caller"), i.cast("string")).alias("name"), F.when(i % 2 == 1, F.concat(F.lit("r"), i.cast("string"))).alias("role")))
    rows = table(spark, d, "customer").select(
        n, key().alias("symbol_key"), F.concat(F.lit("f"), text).alias("name"), F.lit("function").alias("kind"), F.lit("ts").alias("language"), F.concat(F.lit("src/c"), text, F.lit(".ts")).alias("path"), (n % 9 + 1).alias("start_line"), (n % 9 + 3).alias("end_line"),
        F.when(n % 3 == 0, " f(x) ").alias("signature"), F.when(n % 5 != 0, "service").alias("role"), F.when(n % 2 == 0, "core").alias("layer"), F.lit("0.8").alias("confidence"), F.concat(F.lit("function f"), text, F.lit("() {\n}")).alias("code"), F.lit(None).cast("string").alias("imports"),
        F.when(n % 7 != 0, F.col("c_mktsegment")).alias("file_summary"), F.array(callee).alias("callees"), F.concat(blank, named).alias("callers"), F.array(F.lit(" Keep it "), F.lit("  ")).alias("rules"), F.array(key()).alias("keys"),
    )
    return narratives.prompts(rows)
