"""Delta, change-log, search, memory and session queries over the test tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import delta, memory, search
from graphloom.plans.registering import Registry
from graphloom.operators.inverted_index import InvertedIndex
from graphloom.session import files_version, kept_until_end, table
from graphloom.sources import files
from graphloom.streaming import capture

FOUND = Registry()
AS_OF = "2024-02-15 00:00:00"
SNAPSHOTS = """WITH cur AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0),
prev AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 0)
"""


def snapshots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    previous = docs.where("doc_id % 10 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("hash")))
    return previous.select("path", "hash"), docs.where("doc_id % 11 <> 0").select("path", "hash")


@FOUND("file_delta", SNAPSHOTS + "SELECT coalesce(prev.path, cur.path) AS path, CASE WHEN prev.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'removed' WHEN prev.hash IS NOT DISTINCT FROM cur.hash THEN 'unchanged' ELSE 'modified' END AS change FROM prev FULL JOIN cur ON prev.path = cur.path")
def file_delta(spark, d):
    return delta.file_delta(*snapshots(spark, d))


@FOUND("changed_files", SNAPSHOTS + "SELECT coalesce(prev.path, cur.path) AS path FROM prev FULL JOIN cur ON prev.path = cur.path WHERE prev.hash IS DISTINCT FROM cur.hash OR prev.path IS NULL OR cur.path IS NULL")
def changed_files(spark, d):
    return delta.changed_files(*snapshots(spark, d))


def symbol_rows(df):
    return df.select(F.col("path").alias("symbol_key"), F.col("hash").alias("code_hash"), F.when(F.length("path") == 2, F.lit("n")).alias("narrative_hash"), F.when(F.col("path").endswith("5"), 1).otherwise(2).alias("hash_version"))


@FOUND("symbol_delta", SNAPSHOTS + "SELECT coalesce(prev.path, cur.path) AS symbol_key, CASE WHEN prev.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'removed' WHEN length(cur.path) = 2 OR prev.hash IS NOT DISTINCT FROM cur.hash THEN 'unchanged' ELSE 'stale' END AS change FROM prev FULL JOIN cur ON prev.path = cur.path")
def symbol_delta(spark, d):
    previous, current = snapshots(spark, d)
    return delta.symbol_delta(symbol_rows(previous), symbol_rows(current))


@FOUND("worklist_build", SNAPSHOTS + "SELECT cur.path AS symbol_key, CASE WHEN cur.hash = prev.hash AND CAST(cur.path AS BIGINT) % 2 = 0 THEN 'enriched' ELSE 'pending' END AS status FROM cur LEFT JOIN prev ON prev.path = cur.path")
def worklist_build(spark, d):
    previous, current = snapshots(spark, d)
    index = symbol_rows(previous).withColumn("status", F.when(F.col("symbol_key").cast("long") % 2 == 0, "enriched").otherwise("stale")).withColumn("memory_id", F.lit(None).cast("string"))
    return delta.worklist(symbol_rows(current).drop("hash_version"), index).select("symbol_key", "status")


@FOUND("removed_anti", SNAPSHOTS + "SELECT path FROM prev WHERE path NOT IN (SELECT path FROM cur)")
def removed_anti(spark, d):
    previous, current = snapshots(spark, d)
    return delta.removed(previous, current, "path").select("path")


@FOUND("manifest_last_wins", "SELECT user_id, max(event_id) AS event_id, min(event_id) AS first_seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def manifest_last_wins(spark, d):
    return delta.last_wins(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "first_seq", "event_type")


@FOUND("sync_dedupe_primary", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_primary FROM events")
def sync_dedupe_primary(spark, d):
    return delta.primary_ids(table(spark, d, "events"), "user_id", "event_id").select("event_id", "is_primary")


@FOUND("halt_after_failure", "SELECT event_id, CASE WHEN coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'halted' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS outcome FROM events")
def halt_after_failure(spark, d):
    return delta.halted(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "outcome")


@FOUND("checkpoint_batches", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 25 AS batch FROM events")
def checkpoint_batches(spark, d):
    return delta.batches(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], 25).select("event_id", "batch")


@FOUND("upsert_version", """WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, 1 AS version FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE upper(c_name) END AS name, -1.0 AS bal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, coalesce(o.bal, n.bal) AS bal, CASE WHEN o.k IS NULL THEN 1 WHEN n.k IS NULL THEN o.version ELSE o.version + 1 END AS version FROM o FULL JOIN n ON o.k = n.k""")
def upsert_version(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 != 0, F.upper("name")).alias("name"), F.lit(-1.0).alias("bal"))
    return delta.merge(c.where("k % 3 <> 0").withColumn("version", F.lit(1)), new, "k", keep=("bal",), version="version")


@FOUND("upsert_coalesce", """WITH o AS (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS name FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name FROM o FULL JOIN n ON o.k = n.k""")
def upsert_coalesce(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_brand")
    return delta.merge(p.where("k % 3 <> 0").select("k", "name"), p.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 != 0, F.col("p_brand")).alias("name")), "k")


QUESTION = "water data people model"
HITS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in QUESTION.split())


@FOUND("keyword_search_docs", f"SELECT doc_id, {HITS} AS score FROM documents WHERE {HITS} > 0")
def keyword_search_docs(spark, d):
    return search.keyword_search(table(spark, d, "documents"), QUESTION).select("doc_id", "score")


@FOUND("query_top3", f"SELECT doc_id, {HITS} AS score FROM documents WHERE {HITS} > 0 ORDER BY score DESC, doc_id LIMIT 3")
def query_top3(spark, d):
    return search.keyword_search(table(spark, d, "documents"), QUESTION, limit=3).select("doc_id", "score")


@FOUND("search_tokens", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2), ' ') AS tokens FROM benchmark")
def search_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.tokens("text"), " ").alias("tokens"))


WORDS = ("the", "of", "and")
COUNTS = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS t{k}" for k, w in enumerate(sorted(WORDS)))
IDF = [f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6)" for k in range(3)]
BM25 = " + ".join(f"{IDF[k]} * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * len / avg))" for k in range(3))
BM25_CTE = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(t) AS len, {COUNTS} FROM w),
s AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM c),
m AS (SELECT doc_id, {BM25} AS score FROM c, s WHERE t0 > 0 OR t1 > 0 OR t2 > 0)
"""


def bm25_rows(spark, d):
    return search.bm25(table(spark, d, "documents").where("text is not null"), " ".join(WORDS), every=False)


@FOUND("indexed_search", BM25_CTE + "SELECT doc_id, round(score, 6) AS score FROM m")
def indexed_search(spark, d):
    """The same scores from an inverted index, which is built once for each state of the table's files."""
    path = kept_until_end(spark, "index-" + hashlib.sha256(d.encode()).hexdigest()[:12])
    index = InvertedIndex(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    index.open_or_build(docs, files_version(spark, [f"{d}/documents.parquet"]))
    return index.search(" ".join(WORDS), every=False).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@FOUND("bm25_search", BM25_CTE + "SELECT doc_id, round(score, 6) AS score FROM m")
def bm25_search(spark, d):
    return bm25_rows(spark, d).withColumn("score", F.round("score", 6))


VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(64)]
COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VECTOR}::DOUBLE[])"


@FOUND("vector_topk", f"SELECT vec_id, round({COSINE}, 6) AS cosine FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return search.vector_search(table(spark, d, "embeddings"), VECTOR).withColumn("cosine", F.round("cosine", 6))


@FOUND("find_related", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 5 AND e.vec_id <> 5 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 10")
def find_related(spark, d):
    return search.find_related(table(spark, d, "embeddings"), 5).withColumn("cosine", F.round("cosine", 6))


@FOUND("hybrid_rrf", BM25_CTE + f""", a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM m QUALIFY r <= 30), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COSINE} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 30)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def hybrid_rrf(spark, d):
    words = bm25_rows(spark, d).select(F.col("doc_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(30)
    near = search.vector_search(table(spark, d, "embeddings"), VECTOR, limit=30).select(F.col("vec_id").alias("id"), F.col("cosine").alias("score"))
    return search.rrf([words, near], "id").withColumn("rrf", F.round("rrf", 9))


@FOUND("explain_scores", f"""WITH base AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(text, '') AS text, embedding FROM documents FULL JOIN embeddings ON doc_id = vec_id), w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS t FROM base), c AS (SELECT id, len(t) AS len, len(list_filter(t, lambda x: x = 'the')) AS t0 FROM w),
s AS (SELECT count(*) AS n, avg(len) AS avg, count(*) FILTER (t0 > 0) AS d0 FROM c), m AS (SELECT id, {IDF[0]} * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / avg)) AS score FROM c, s WHERE t0 > 0),
k AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM m QUALIFY r <= 30), v AS (SELECT id, {COSINE} AS cosine, row_number() OVER (ORDER BY {COSINE} DESC, id) AS r FROM base WHERE embedding IS NOT NULL QUALIFY r <= 30),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS rrf, pow(0.5, (26 + id % 50) / 30.0) AS decay FROM (SELECT id, r FROM k UNION ALL SELECT id, r FROM v) GROUP BY id)
SELECT f.id, round(k.score, 6) AS keyword_score, round(v.cosine, 6) AS semantic_cosine, round(rrf, 9) AS rrf, round(decay, 9) AS decay_factor, round(rrf * decay * (1 + f.id % 3 / 10), 9) AS final_score FROM f LEFT JOIN k USING (id) LEFT JOIN v USING (id) ORDER BY rrf * decay * (1 + f.id % 3 / 10) DESC, f.id LIMIT 10""")
def explain_scores(spark, d):
    docs, vectors = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = docs.join(vectors, "id", "full").select("id", F.coalesce("text", F.lit("")).alias("text"), "embedding", F.date_sub(F.lit("2024-01-20").cast("date"), (F.col("id") % 50).cast("int")).alias("updated_at"), (1 + F.col("id") % 3 / 10).alias("activation_score"))
    found = search.hybrid(rows, "the", VECTOR, as_of=AS_OF)
    return found.select("id", *[F.round(c, n).alias(c) for c, n in (("keyword_score", 6), ("semantic_cosine", 6), ("rrf", 9), ("decay_factor", 9), ("final_score", 9))])


@FOUND("greedy_vector_match", """WITH RECURSIVE l AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1),
p AS MATERIALIZED (SELECT l.k, l.vec_id AS a, r.vec_id AS b, list_cosine_similarity(l.v, r.v) AS c FROM l, r WHERE list_cosine_similarity(l.v, r.v) >= 0.3),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS a, NULL::BIGINT AS b, []::BIGINT[] AS used UNION ALL
SELECT n.k, n.a, n.b, CASE WHEN n.b IS NULL THEN n.used ELSE list_append(n.used, n.b) END FROM (SELECT g.k + 1 AS k, any_value(p.a) AS a, arg_max(p.b, (p.c, -p.b)) AS b, any_value(g.used) AS used FROM g LEFT JOIN p ON p.k = g.k + 1 AND NOT list_contains(g.used, p.b) WHERE g.k < (SELECT max(k) FROM l) GROUP BY g.k) n)
SELECT a, b FROM g WHERE b IS NOT NULL""")
def greedy_vector_match(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.greedy_match(spark, rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.3).select("a", "b")


TOPICS = ["water river", "model data"]
TOPIC_SQL = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in t.split()) + " AS score FROM documents" for t in TOPICS)


@FOUND("recall_topics", f"SELECT doc_id, topic, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM ({TOPIC_SQL}) WHERE score > 0 QUALIFY rank <= 5")
def recall_topics(spark, d):
    return search.recall(table(spark, d, "documents"), TOPICS, 5)


@FOUND("balanced_sources", "WITH t AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) SELECT doc_id, source, turn FROM t ORDER BY turn, n_chars DESC, source, doc_id LIMIT 20")
def balanced_sources(spark, d):
    return search.balanced(table(spark, d, "documents"), "source", "n_chars", "doc_id", 20).select("doc_id", "source", "turn")


@FOUND("list_recent", "SELECT event_id FROM events WHERE contains(event_type, 'click') ORDER BY ts DESC, event_id LIMIT 15")
def list_recent(spark, d):
    return search.recent_matches(table(spark, d, "events"), "click", "event_type", "ts", "event_id").select("event_id")


MEMORY = f"""WITH m AS (SELECT user_id AS id, max(ts) AS used, user_id % 10 = 0 AS evergreen FROM events GROUP BY user_id), a AS (SELECT *, date_diff('day', CAST(used AS DATE) - CAST(id AS INT) * 3, DATE '2024-02-15') AS days FROM m)
"""


def memories(spark, d):
    used = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("used"))
    return used.select("id", F.date_sub(F.col("used").cast("date"), (F.col("id") * 3).cast("int")).alias("last_used"), (F.col("id") % 10 == 0).alias("evergreen"))


@FOUND("decay_state", MEMORY + "SELECT id, days AS unused_days, CASE WHEN evergreen THEN 'active' WHEN days >= 455 THEN 'purge_candidate' WHEN days >= 365 THEN 'gist_only' WHEN days >= 180 THEN 'shadow' WHEN days >= 90 THEN 'dimmed' WHEN days >= 30 THEN 'cooling' ELSE 'active' END AS state FROM a")
def decay_state(spark, d):
    return memory.decay_state(memories(spark, d), AS_OF).select("id", F.col("unused_days").cast("long").alias("unused_days"), "state")


def tagged(spark, d):
    tags = F.when(F.col("evergreen"), F.array(F.lit("evergreen"))).when(F.col("id") % 4 == 0, F.array(F.lit("critical"))).otherwise(F.array(F.lit("x")))
    return memories(spark, d).select("id", "last_used", F.col("last_used").alias("updated_at"), tags.alias("tags"), F.when(F.col("id") % 3 == 0, "decision").otherwise("learning").alias("category"), F.lit(1.0).alias("activation_score"))


STRENGTH = "CASE WHEN evergreen THEN 1.0 ELSE pow(0.5, greatest(days, 0) / (30.0 * CASE WHEN id % 4 = 0 THEN 4.0 WHEN id % 3 = 0 THEN 2.0 ELSE 1.0 END)) END"


@FOUND("decay_scores", MEMORY + f"SELECT id, round({STRENGTH}, 8) AS strength FROM a")
def decay_scores(spark, d):
    return memory.strength(tagged(spark, d), AS_OF).select("id", F.round("strength", 8).alias("strength"))


@FOUND("prune_candidates", MEMORY + f"SELECT id FROM a WHERE {STRENGTH} < 0.05 AND days > 90 AND NOT evergreen")
def prune_candidates(spark, d):
    return memory.prune_candidates(tagged(spark, d), AS_OF).select("id")


@FOUND("promotion", """WITH e AS (SELECT user_id % 40 AS h, user_id % 40 % 7 + CAST(user_id % 80 = 7 AS INT) AS p, event_type = 'error' AS c, CAST(event_type = 'signup' AS INT) AS r FROM events), g AS (SELECT CAST(h AS VARCHAR) AS content_hash, count(DISTINCT p) AS projects, bool_or(c) AS critical, count(*) AS seen, sum(r) AS revivals FROM e GROUP BY h)
SELECT content_hash, CASE WHEN projects >= 2 THEN 'projects' WHEN critical AND seen >= 2 THEN 'critical' ELSE 'revivals' END AS reason FROM g WHERE projects >= 2 OR (critical AND seen >= 2) OR revivals >= 3""")
def promotion(spark, d):
    e = table(spark, d, "events")
    rows = e.select((F.col("user_id") % 40).cast("string").alias("content_hash"), (F.col("user_id") % 40 % 7 + (F.col("user_id") % 80 == 7).cast("int")).alias("project_id"), (F.col("event_type") == "error").alias("critical"), (F.col("event_type") == "signup").cast("int").alias("revivals"))
    return memory.promotions(rows)


@FOUND("memory_statistics", "SELECT event_type AS category, count(*) AS memories, min(ts) AS oldest, max(ts) AS newest, CAST(sum(user_id) AS BIGINT) AS accesses FROM events GROUP BY event_type")
def memory_statistics(spark, d):
    return memory.statistics(table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("ts").alias("created_at"), F.col("user_id").alias("access_count")))


@FOUND("session_list", "SELECT conv_id AS session_id, count(*) FILTER (role = 'user') AS prompts, max(turn) AS last_activity FROM conversations GROUP BY conv_id")
def session_list(spark, d):
    return memory.sessions(table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id"), time="turn")


@FOUND("session_get", "SELECT turn, role, text FROM conversations WHERE conv_id = 3")
def session_get(spark, d):
    return memory.session_view(table(spark, d, "conversations"), 3, "conv_id", "turn").select("turn", "role", "text")


@FOUND("topic_slugs", """WITH s AS (SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s FROM benchmark), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY item_id) AS n FROM s)
SELECT item_id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM n""")
def topic_slugs(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("title"))
    return memory.unique_slugs(rows, "title", "item_id").select("item_id", "slug")


@FOUND("quiet_partition", "SELECT user_id AS key, max(ts) AS last, epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(max(ts))) >= 86400 AS quiet FROM events GROUP BY user_id")
def quiet_partition(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts")
    return capture.partition_quiet(rows, "2024-01-30 12:00:00", 86400)


@FOUND("heartbeat_state", """SELECT user_id, CASE WHEN bool_or(event_type = 'signup' AND user_id % 9 = 0) THEN 'finished' WHEN user_id % 11 = 0 THEN 'failed' WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(max(ts))) <= 43200 THEN 'running' ELSE 'stalled' END AS state FROM events GROUP BY user_id""")
def heartbeat_state(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("beat"), F.max((F.col("event_type") == "signup") & (F.col("user_id") % 9 == 0)).alias("finished"))
    return capture.heartbeat(rows.withColumn("failed", F.col("user_id") % 11 == 0), "2024-01-30 12:00:00", 43200).select("user_id", "state")


@FOUND("session_gap_windows", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM s GROUP BY user_id, session""")
def session_gap_windows(spark, d):
    return capture.sessions_by_gap(table(spark, d, "events"), 6 * 3600, "user_id", "ts", "event_id")


@FOUND("page_link_edges", """SELECT url AS source, target, count(*) AS n FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages) GROUP BY url, target""")
def page_link_edges(spark, d):
    return files.links(table(spark, d, "pages"))


@FOUND("redact_private", "SELECT doc_id, sha256(regexp_replace('<private>' || lang || '</PRIVATE>' || text, '<private>.*?</private>', '[REDACTED]', 'gis')) AS h FROM documents")
def redact_private(spark, d):
    rows = table(spark, d, "documents").withColumn("x", F.concat(F.lit("<private>"), "lang", F.lit("</PRIVATE>"), "text"))
    return rows.select("doc_id", F.sha2(T.redact_private("x"), 256).alias("h"))


@FOUND("mask_args", """SELECT event_id, '{"monkey":1,"author":"a","apiToken":"***REDACTED***","deep":{"Password":"***REDACTED***","list":[{"my_secret":"***REDACTED***"},' || json_extract(props, '$.k') || ']},"api_keys":"***REDACTED***"}' AS masked FROM events""")
def mask_args(spark, d):
    text = F.concat(F.lit('{"monkey":1,"author":"a","apiToken":"t","deep":{"Password":{"x":1},"list":[{"my_secret":[2]},'), F.get_json_object("props", "$.k"), F.lit(']},"api_keys":3}'))
    return table(spark, d, "events").select("event_id", T.mask_args(text).alias("masked"))


@FOUND("summarize_200", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS s FROM documents")
def summarize_200(spark, d):
    return table(spark, d, "documents").select("doc_id", T.summarised("text").alias("s"))
