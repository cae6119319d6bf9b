"""Queues, session ledgers, narrative evidence and project contexts (A-2, A-16, A-19, A-23, E2, E8-E11, E15-E20, F15-F17, F39, F40, J11, J19, J20, P13, P23, P25, R16, S18, S25, T8, T10, U8, U9, U13, W7, W10, W11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import col, normal_path
from graphloom.functions.text import cosine, estimated_tokens, line_slice
from graphloom.operators import delta

# Words that branch, states of a queue, the files that project contexts follow, rounds of the retry loop.
BRANCH = r"\b(if|else|for|while|switch|case|catch|except|elif|match|when)\b|\?|&&|\|\|"
QUEUE_STATES = ("pending", "in_progress", "done", "error")
RETRY_ROUNDS = 5
TRIVIAL_LINES = 4


def queue_counts(rows: DataFrame) -> DataFrame:
    """A-2: total and one number for each state."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATES])


def pending_entries(rows: DataFrame, action: str | None = None) -> DataFrame:
    """P25: pending rows of a change log, of one action if given."""
    kept = rows.where("status = 'pending'")
    return kept if action is None else kept.where(F.col("action") == action)


def claimed(rows: DataFrame, owner: str) -> DataFrame:
    """The queue with its first pending row (by seq) in progress."""
    first = rows.where("status = 'pending'").agg(F.min("seq").alias("_first"))
    mine = (F.col("status") == "pending") & (F.col("seq") == F.col("_first"))
    rows = rows.crossJoin(F.broadcast(first))
    return rows.withColumns({"status": F.when(mine, "in_progress").otherwise(F.col("status")), "owner": F.when(mine, owner).otherwise(F.col("owner"))}).drop("_first")


def queue_batch(rows: DataFrame, size: int = 100) -> DataFrame:
    """The first rows across files, older files (file_ts, the live file's is null) first."""
    return rows.orderBy(F.col("file_ts").asc_nulls_last(), "line").limit(size)


def synced(rows: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The change log with the rows of ``ids`` (id) synced."""
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    rows = rows.join(done, "id", "left")
    return rows.withColumn("status", F.when(F.col("_done"), "synced").otherwise(F.col("status"))).withColumn("synced_at", F.when(F.col("_done"), at).otherwise(F.col("synced_at"))).drop("_done")


def unsynced(rows: DataFrame) -> DataFrame:
    """The log without its synced rows."""
    return rows.where("status <> 'synced'")


def with_contexts(held: Column, added: Column) -> Column:
    """U8: the ids of a context and new ones, each once, in order."""
    return F.array_union(F.coalesce(held, F.array().cast("array<string>")), F.coalesce(added, F.array().cast("array<string>")))


def known_files(nodes: DataFrame, keys: DataFrame, imports: DataFrame) -> DataFrame:
    """Paths of file nodes, symbol keys and both ends of file imports (``file|path``), each once."""
    of_keys = keys.select(F.try_element_at(F.split("symbol_key", r"\|"), F.lit(2)).alias("path"))
    ends = imports.select(F.explode(F.array("source", "target")).alias("end")).where(F.col("end").startswith("file|")).select(F.substring("end", 6, 1 << 30).alias("path"))
    return nodes.where("node_kind = 'file'").select(normal_path("source_file").alias("path")).unionByName(of_keys).unionByName(ends).where("path <> ''").distinct()


def exported_symbols(nodes: DataFrame) -> DataFrame:
    """Path, symbol_key and kind of the plain symbols whose key says exported; of nodes with one key the first by id."""
    parts = F.split("symbol_key", r"\|")
    rows = nodes.where((F.col("node_kind") == "symbol") & (F.size(parts) == 6) & (F.try_element_at(parts, F.lit(4)) == "exported") & ~F.exists(parts, lambda x: x == ""))
    return rows.groupBy("symbol_key").agg(F.min_by(F.coalesce("kind", F.try_element_at(parts, F.lit(3))), "id").alias("kind")).select(F.try_element_at(parts, F.lit(2)).alias("path"), "symbol_key", "kind")


def trivial(kind, code) -> Column:
    """A getter, or code of one to four lines without a branch; branches are told by words and operators, as no grammar is at hand."""
    n = F.size(F.split(F.trim(col(code)), "\n"))
    plain = (F.trim(col(code)) != "") & (n <= TRIVIAL_LINES) & ~col(code).rlike(BRANCH)
    return F.coalesce((col(kind) == "getter") | plain, F.lit(False))


def cosmetic_kind(label) -> Column:
    """The kind that a label looks like."""
    x = col(label)
    return F.when(x.rlike(r"\(\)$"), "function").when(x.rlike(r"\.[a-z0-9]{1,5}$"), "file").when(x.rlike(r"^[A-Z]"), "class").otherwise("other")


def canonical_json(pairs) -> Column:
    """F16: the JSON of a map of strings with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(pairs)))))


def callee_hashes(rows: DataFrame) -> DataFrame:
    """owner and a map of callee keys to hashes, keys in order; owners whose rows disagree on a hash are an ``conflict``."""
    one = rows.groupBy("owner", "symbol_key").agg(F.min("hash").alias("hash"), (F.min("hash") != F.max("hash")).alias("_bad"))
    entries = F.array_sort(F.collect_list(F.struct("symbol_key", "hash")))
    return one.groupBy("owner").agg(F.max("_bad").alias("conflict"), F.map_from_entries(entries).alias("callees"))


def narrative_hash(code, signature, role, callees, version) -> Column:
    """Sha-256 of the JSON list of code, signature, canonical role (map), callee pairs in order, and prompt version."""
    pairs = F.transform(F.array_sort(F.map_entries(col(callees))), lambda x: F.to_json(F.array(x["key"], x["value"])))
    text = lambda x: F.coalesce(F.substring(F.to_json(F.array(x)), 2, F.length(F.to_json(F.array(x))) - 2), F.lit("null"))
    whole = F.concat(F.lit("["), F.concat_ws(",", text(col(code)), F.when(col(signature).isNull(), "null").otherwise(text(col(signature))), F.coalesce(canonical_json(role), F.lit("null")), F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")), text(col(version))), F.lit("]"))
    return F.sha2(whole, 256)


def source_freshness(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbol_key, code and fresh (the slice's hash is the one expected; null without one) of symbols (path, start, end, expected).

    A range outside the file gives the problem ``out-of-range``, a missing file ``no-file``.
    """
    rows = symbols.join(files.select("path", "content"), "path", "left")
    size = F.size(F.split("content", "\n"))
    problem = F.when(F.col("content").isNull(), "no-file").when((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > size), "out-of-range")
    code = F.when(problem.isNull(), line_slice("content", F.col("start"), F.col("end")))
    return rows.select("symbol_key", code.alias("code"), F.when(F.col("expected").isNotNull() & problem.isNull(), F.sha2(code, 256) == F.col("expected")).alias("fresh"), problem.alias("problem"))


def semantic_jobs(worklist: DataFrame, files: DataFrame) -> DataFrame:
    """Pending symbols with the lines of their code and its tokens; symbols of missing files are left out."""
    rows = worklist.where("status = 'pending'").join(files.select("path", "content"), "path")
    code = line_slice("content", F.col("start"), F.col("end"))
    return rows.select("symbol_key", code.alias("code"), estimated_tokens(code).alias("tokens"))


def all_stale(worklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the worklist with enriched rows stale, delete operations for them)."""
    gone = worklist.where("status = 'enriched'").select("symbol_key", F.lit("delete").alias("action"))
    return worklist.withColumn("status", F.when(F.col("status") == "enriched", "stale").otherwise(F.col("status"))), gone


def status_report(worklist: DataFrame, queue: DataFrame, runs: DataFrame) -> DataFrame:
    """Section, name and number: the worklist and the queue by status, and runs by state (from ``capture.heartbeat``)."""
    part = lambda df, section, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    return part(worklist, "worklist", "status").unionByName(part(queue, "queue", "status")).unionByName(part(runs, "runs", "state"))


def refreshed(previous: DataFrame, current: DataFrame, worklist: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_key and action (upsert or delete) of an incremental refresh: nothing where no file changed, else the symbol delta as a log."""
    any_ = delta.changed_files(previous, current).limit(1).select(F.lit(True).alias("_any"))
    rows = delta.symbol_delta(worklist, symbols).where("change <> 'unchanged'").crossJoin(F.broadcast(any_))
    kinds = F.when(F.col("change") == "new", F.array(F.lit("upsert"))).when(F.col("change") == "removed", F.array(F.lit("delete"))).otherwise(F.array(F.lit("delete"), F.lit("upsert")))
    return rows.select("symbol_key", F.explode(kinds).alias("action"))


def with_embeddings(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Active memories with their embedding or null."""
    return memories.where("status = 'active'").join(embeddings, "id", "left")


def backend_drift(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """A-16: totals of two stores, how many rows match, those of one side only, and the mean cosine of the matches (a, b, cosine)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    m = matches.agg(F.count("*").alias("overlap"), F.coalesce(F.avg("cosine"), F.lit(0.0)).alias("avg_cosine"))
    rows = n(left, "total_left").crossJoin(n(right, "total_right")).crossJoin(m)
    return rows.select("total_left", "total_right", "overlap", (F.col("total_left") - F.col("overlap")).alias("left_only"), (F.col("total_right") - F.col("overlap")).alias("right_only"), "avg_cosine")


def paired_cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """A-16: id and cosine of rows (id, vector) that both stores have."""
    both = left.select("id", F.col("vector").alias("_a")).join(right.select("id", F.col("vector").alias("_b")), "id")
    return both.select("id", cosine("_a", "_b").alias("cosine"))


def retry_outcomes(attempts: DataFrame, most: int = RETRY_ROUNDS) -> DataFrame:
    """A-19: symbol_key, rounds and status: rounds up to the first success, at most ``most``."""
    tried = attempts.where(F.col("round") <= most)
    first = F.min(F.when(F.col("ok"), F.col("round")))
    return tried.groupBy("symbol_key").agg(F.coalesce(first, F.max("round")).alias("rounds"), F.when(first.isNotNull(), "enriched").otherwise("error").alias("status"))


def migration_preview(rows: DataFrame) -> DataFrame:
    """A-23: observations by type: total, deleted and those to be moved."""
    return rows.groupBy("type").agg(F.count("*").alias("total"), F.count("deleted_at").alias("deleted"), F.count_if(F.col("deleted_at").isNull()).alias("moved"))


def project_errors(errors: DataFrame, projects: DataFrame) -> DataFrame:
    """Errors with the name of their project."""
    return errors.join(projects.select("project_id", "name"), "project_id")


def error_search(errors: DataFrame, projects: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """The best errors for a question by BM25 over message and cause, with the project's name."""
    from graphloom.operators.search import bm25

    text = errors.withColumn("_text", F.concat_ws(" ", "message", "cause"))
    best = bm25(text, question, "_text", "id", every=False).orderBy(F.desc("score"), "id").limit(limit)
    return project_errors(errors, projects).join(F.broadcast(best), "id").select("id", "name", "message", "score")


def promoted_errors(errors: DataFrame, least: int = 2) -> DataFrame:
    """content_hash, message, projects, n and first_seen of the errors that at least ``least`` projects have recorded, by the hash of ``delta.errors_merged``."""
    key = F.sha2(F.concat_ws("\0", F.trim("message"), F.coalesce(F.trim("cause"), F.lit(""))), 256)
    rows = errors.select(key.alias("content_hash"), "message", "project_id", "created_at")
    found = rows.groupBy("content_hash").agg(F.min(F.trim("message")).alias("message"), F.count_distinct("project_id").alias("projects"), F.count("*").alias("n"), F.min("created_at").alias("first_seen"))
    return found.where(F.col("projects") >= least)


def session_ledger(prompts: DataFrame, responses: DataFrame, calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id, seq, kind, text of all four tables in order of created_at; of equal times prompts first, then responses, calls, summaries."""
    out = None
    for k, (kind, df) in enumerate((("prompt", prompts), ("response", responses), ("tool_call", calls), ("summary", summaries))):
        rows = df.select("session_id", "created_at", F.lit(k).alias("_o"), F.lit(kind).alias("kind"), "text")
        out = rows if out is None else out.unionByName(rows)
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "_o", "text"))
    return out.select("session_id", seq.alias("seq"), "kind", "text")


def alive(rows: DataFrame, now: Column, root: str, stale_s: int = 90) -> DataFrame:
    """Whether each watcher is alive: its last beat is no older than three intervals of 30 s, of the same root, and its process is there."""
    fresh = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(F.col("beat").cast("timestamp")) <= stale_s, F.lit(False))
    return rows.withColumn("alive", fresh & (normal_path("root") == root) & F.coalesce("pid_alive", F.lit(False)))


def import_bindings(imports: DataFrame, declarations: DataFrame) -> DataFrame:
    """Source, imported, target and reason: a binding (source, target_path, imported) stands for the one exported declaration (path, name, symbol_key) of that name."""
    hits = declarations.where("scope = 'exported'").groupBy(F.col("path").alias("target_path"), F.col("name").alias("imported")).agg(F.count_distinct("symbol_key").alias("_n"), F.min("symbol_key").alias("_key"))
    reason = F.when(F.col("target_path").isNull(), "unresolved-module").when(F.col("_n").isNull(), "no-exported-declaration").when(F.col("_n") > 1, "ambiguous-declaration")
    return imports.join(hits, ["target_path", "imported"], "left").select("source", "imported", F.when(reason.isNull(), F.col("_key")).alias("target"), reason.alias("reason"))


def backfilled(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes with the summary of the one result for their path and name; ambiguous nodes and nodes with another key stay as they are."""
    many = nodes.groupBy("path", "name").agg(F.count("*").alias("_n"))
    r = results.select("path", "name", F.col("summary").alias("_summary"), F.col("symbol_key").alias("_key"))
    rows = nodes.join(many, ["path", "name"]).join(r, ["path", "name"], "left")
    fits = (F.col("_n") == 1) & F.col("_key").isNotNull() & (F.col("symbol_key").isNull() | (F.col("symbol_key") == F.col("_key")))
    return rows.withColumn("summary", F.when(fits, F.col("_summary")).otherwise(F.col("summary"))).withColumn("symbol_key", F.when(fits, F.col("_key")).otherwise(F.col("symbol_key"))).drop("_n", "_summary", "_key")


def context_markdown(title, sections: dict[str, Column]) -> Column:
    """A title and the sections that have text."""
    part = lambda name, text: F.when(F.trim(text) != "", F.concat(F.lit(f"## {name}\n\n"), F.trim(text)))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), col(title)), *[part(k, v) for k, v in sections.items()])


def loaded_graph(nodes: DataFrame, edges: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): of rows of one id the last by seq wins, paths get slashes, a summary is the index's, else the node's, else empty."""
    last = nodes.groupBy("id").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").drop("seq")
    i = index.select(F.col("graph_node_id").alias("id"), F.col("summary").alias("_summary"), "symbol_key").groupBy("id").agg(F.min("_summary").alias("_summary"), F.min("symbol_key").alias("symbol_key"))
    rows = last.withColumn("source_file", normal_path("source_file")).join(i, "id", "left").withColumn("summary", F.coalesce("_summary", "summary", F.lit(""))).drop("_summary")
    return rows, edges.select("source", "target", "relation").dropDuplicates()
