"""Deltas, upserts and ordered change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import canonical_key, key_part, key_tag, normal_path


def file_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Path and change (added, removed, modified, unchanged) of two snapshots (path, hash)."""
    p, c = previous.select("path", F.col("hash").alias("_p"), F.lit(True).alias("_in_p")), current.select("path", F.col("hash").alias("_c"), F.lit(True).alias("_in_c"))
    change = F.when(F.col("_in_p").isNull(), "added").when(F.col("_in_c").isNull(), "removed").when(F.col("_p").eqNullSafe(F.col("_c")), "unchanged").otherwise("modified")
    return p.join(c, "path", "full").select("path", change.alias("change"))


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """U2."""
    return file_delta(previous, current).where("change <> 'unchanged'").select("path")


def symbol_delta(worklist: DataFrame, current: DataFrame) -> DataFrame:
    """symbol_key and change (new, stale, removed, unchanged) from rows (symbol_key, code_hash, narrative_hash, hash_version).

    A narrative hash on both sides decides before the code hash; another hash version is a silent new baseline.
    """
    w = worklist.select("symbol_key", F.struct("code_hash", "narrative_hash", "hash_version").alias("w"))
    c = current.select("symbol_key", F.struct("code_hash", "narrative_hash", "hash_version").alias("c"))
    both = F.col("w.narrative_hash").isNotNull() & F.col("c.narrative_hash").isNotNull()
    same = F.when(both, F.col("w.narrative_hash") == F.col("c.narrative_hash")).otherwise(F.col("w.code_hash").eqNullSafe(F.col("c.code_hash")))
    change = F.when(F.col("w").isNull(), "new").when(F.col("c").isNull(), "removed").when(~F.col("w.hash_version").eqNullSafe(F.col("c.hash_version")), "unchanged").when(same, "unchanged").otherwise("stale")
    return w.join(c, "symbol_key", "full").select("symbol_key", change.alias("change"))


def delete_operations(delta: DataFrame) -> DataFrame:
    """U4: a delete for each symbol that is stale or gone."""
    return delta.where(F.col("change").isin("stale", "removed")).select("symbol_key", F.lit("delete").alias("action"))


def worklist(symbols: DataFrame, index: DataFrame) -> DataFrame:
    """Status enriched if the index has the same hash and says so (or says nothing but has a memory), else pending."""
    i = index.select("symbol_key", F.col("code_hash").alias("_hash"), F.col("status").alias("_status"), F.col("memory_id").alias("_memory"))
    done = F.col("code_hash").eqNullSafe(F.col("_hash")) & ((F.col("_status") == "enriched") | F.col("_status").isNull() & F.col("_memory").isNotNull())
    return symbols.join(i, "symbol_key", "left").withColumn("status", F.when(F.coalesce(done, F.lit(False)), "enriched").otherwise("pending")).drop("_hash", "_status", "_memory")


def stale_dependents(entries: DataFrame, key: str, new_hash: str) -> DataFrame:
    """symbol_key of the entries whose stored hash (map callee_hashes) of a callee is another one."""
    stored = F.col("callee_hashes")[key]
    return entries.where(stored.isNotNull() & (stored != new_hash)).select("symbol_key")


def removed(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """J15."""
    return existing.join(current.select(key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, with first_seq, the place where the key came first; combined in the tasks before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    by = rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_x"), F.min(seq).alias("first_seq"))
    return by.select(*[F.col(key) if c == key else F.col(f"_x.{c}") for c in rows.columns], "first_seq")


def primary_ids(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """is_primary for the smallest id of each key."""
    return rows.withColumn("is_primary", F.row_number().over(Window.partitionBy(key).orderBy(id_)) == 1)


def halted(rows: DataFrame, key: str, seq: str, failed: Column) -> DataFrame:
    """Outcome of each row: halted after the first failure of its key (by seq; rows of that seq are not after it), else failed or done.

    The first failures are one row a key, counted in the tasks first, so that a key with very many rows is many tasks' work: it is no window of one task.
    """
    flag = F.coalesce(failed, F.lit(False))
    first = rows.where(flag).groupBy(F.col(key).alias("_key")).agg(F.min(seq).alias("_first"))
    met = rows.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn("outcome", F.when(F.col(seq) > F.col("_first"), "halted").when(flag, "failed").otherwise("done")).drop("_key", "_first")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with _n, their number from 0 in an order of the whole table: sorted by ranges, written, and counted on from the ranges before."""
    from graphloom.session import Scratch

    held = Scratch(rows.sparkSession, "numbered").write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "rows")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # one row a range
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_n", place + F.col("_before")).drop("_id", "_part", "_before")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Batch numbers of ``size`` rows each over the whole queue in its order."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def merge(old: DataFrame, new: DataFrame, key: str, keep=(), version: str | None = None) -> DataFrame:
    """Upsert by key; a null of ``new`` keeps the old value, ``keep`` columns never change, ``version`` counts updates.

    One full outer join and a CASE for each column; written to a new folder it stands in for MERGE on plain Parquet.
    """
    columns = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*columns).alias("o")), new.select(key, F.struct(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns]).alias("n"))
    out = []
    for c in columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == version:
            out.append(F.when(F.col("o").isNull(), F.coalesce(b, F.lit(1))).when(F.col("n").isNull(), a).otherwise(a + 1).alias(c))
        else:
            out.append((F.coalesce(a, b) if c in keep else F.coalesce(b, a)).alias(c))
    return o.join(n, key, "full").select(key, *out)


# Reasons for which an entry in memory may take back an enriched one on disk.
STALE_REASONS = ("narrative-hash-changed", "narrative-hash-missing", "callee-summary-changed", "queued-fingerprint-mismatch")


def merge_worklists(disk: DataFrame, memory: DataFrame, reasons: tuple[str, ...] = STALE_REASONS) -> DataFrame:
    """Rows by symbol_key with all their columns: an entry in memory takes the disk's columns where that is ``enriched`` and its own status isn't.

    Memory keeps its own where it is stale for one of ``reasons``. What only one side has keeps its values; of an entry on both sides
    columns that only the disk has are the disk's.
    """
    names = [*dict.fromkeys([*memory.columns, *disk.columns])]
    names.remove("symbol_key")
    d, m = disk.select("symbol_key", F.struct(*[c for c in disk.columns if c != "symbol_key"]).alias("d")), memory.select("symbol_key", F.struct(*[c for c in memory.columns if c != "symbol_key"]).alias("m"))
    told = (F.col("m.status") == "stale") & F.col("m.stale_reason").isin(*reasons)
    held = (F.col("d.status") == "enriched") & ~F.coalesce(F.col("m.status").isin("enriched", "already_enriched"), F.lit(False)) & ~F.coalesce(told, F.lit(False))
    keep = F.coalesce(F.col("m").isNull() | held, F.lit(False))
    both = d.join(m, "symbol_key", "full")

    def one(c):
        a, b = (F.col(f"{p}.{c}") if c in df.columns else None for p, df in (("d", disk), ("m", memory)))
        return (a if b is None else F.when(keep, F.col("d")[c] if a is not None else b).otherwise(b) if a is not None else F.when(F.col("m").isNotNull(), b)).alias(c)

    return both.select("symbol_key", *[one(c) for c in names])


def errors_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """U16: one row for each project and sha-256 of the trimmed message and cause; the first one stays."""
    key = F.sha2(F.concat_ws("\0", F.trim("message"), F.coalesce(F.trim("cause"), F.lit(""))), 256)
    rows = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1))).withColumn("content_hash", key)
    w = Window.partitionBy("content_hash", "project_id").orderBy("_age", "created_at")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_age")


def move_project(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of one project become another's; merging a project with itself is an error."""
    if old == new:
        raise ValueError("a project can't be merged with itself")
    return rows.withColumn("project_id", F.when(F.col("project_id") == old, new).otherwise(F.col("project_id")))


def graph_merged(nodes: DataFrame, new_nodes: DataFrame, edges: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id, the new ones win, of several new ones always the same; edges once."""
    both = nodes.withColumn("_new", F.lit(0)).unionByName(new_nodes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    kept = both.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_new"), F.xxhash64(*both.columns)))).where("_r = 1").drop("_r", "_new")
    return kept, edges.unionByName(new_edges).dropDuplicates(["source", "target", "relation"])


# Rows of a lookup from which it counts as cut off, and folders whose symbols are not linked.
LOOKUP_ROWS, UNLINKED_DIRS = 100, (".planning", ".worktrees")


def backfill_plan(keys: DataFrame, memories: DataFrame, project_tag: str) -> tuple[DataFrame, DataFrame]:
    """(mappings as id, symbol_key; skips as symbol_key, reason, id) of symbol keys to the memories (id, tags, symbol_key) that carry their tag.

    A key is skipped whole where another has its tag, where it is not canonical, its path is unsafe or ignored, or its lookup is cut off. A row is
    skipped without an id, with other key tags or another project, with another key, or where it is linked; an id that was met twice
    maps nothing.
    """
    steps = F.split(normal_path(key_part("symbol_key", 2)), "/")
    walk = F.aggregate(
        F.filter(steps, lambda x: ~x.isin("", ".")),
        F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok")),
        lambda acc, x: F.struct(
            F.when(x != "..", F.array_append(acc["path"], x)).otherwise(F.slice(acc["path"], F.lit(1), F.greatest(F.size(acc["path"]) - 1, F.lit(0)))).alias("path"),
            (acc["ok"] & ((x != "..") | (F.size(acc["path"]) > 0))).alias("ok"),
        ),
    )
    rows = keys.select("symbol_key").distinct().withColumn("tag", key_tag("symbol_key")).withColumn("_w", walk)
    rows = rows.join(rows.groupBy("tag").agg(F.count("*").alias("_same")), "tag")
    unsafe = normal_path(key_part("symbol_key", 2)).rlike("^/|^[A-Za-z]:") | ~F.col("_w.ok") | (F.size("_w.path") == 0)
    first = F.when(F.col("_same") > 1, "key-tag-collision").when(~canonical_key("symbol_key"), "invalid-symbol-key").when(unsafe, "unsafe-path").when(F.exists("_w.path", lambda x: x.isin(*UNLINKED_DIRS)), "ignored-path")
    rows = rows.select("symbol_key", "tag", first.alias("reason"))
    met = memories.select(F.col("id"), "tags", F.col("symbol_key").alias("_key"), F.explode(F.array_distinct(F.filter("tags", lambda x: x.startswith("key:symbol:")))).alias("tag"))
    asked = rows.where("reason is null").select("symbol_key", "tag").join(met, "tag")
    many = asked.groupBy("symbol_key").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= LOOKUP_ROWS)
    asked = asked.join(many.select("symbol_key"), "symbol_key", "left_anti")
    there = (F.col("id") != "") & F.col("id").isNotNull()
    projects = F.filter("tags", lambda x: x.startswith("project:"))
    why = (
        F.when(~F.coalesce(there, F.lit(False)), "invalid-memory-id")
        .when(F.size(F.filter("tags", lambda x: x.startswith("key:symbol:"))) != 1, "missing-exact-key-tag")
        .when((F.size(projects) != 1) | (F.try_element_at(projects, F.lit(1)) != project_tag), "project-tag-mismatch")
        .when(F.col("_key").isNotNull() & (F.col("_key") != F.col("symbol_key")), "conflicting-symbol-key")
        .when(F.col("_key") == F.col("symbol_key"), "already-linked")
    )
    judged = asked.select("symbol_key", F.when(there, F.col("id")).alias("id"), why.alias("reason"))
    twice = judged.where("id is not null").groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    none = F.lit(None).cast("string")
    skips = rows.where("reason is not null").select("symbol_key", "reason", none.alias("id")).unionByName(many.select("symbol_key", F.lit("lookup-truncated").alias("reason"), none.alias("id")))
    skips = skips.unionByName(judged.where("reason is not null").select("symbol_key", "reason", "id")).unionByName(judged.join(twice, "id", "left_semi").select("symbol_key", F.lit("duplicate-memory-id").alias("reason"), "id").distinct())
    return judged.where("reason is null").join(twice, "id", "left_anti").select("id", "symbol_key"), skips


def swap_write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a merged table beside ``path`` and put it in its place (MERGE on plain Parquet)."""
    jvm, fresh, old = spark._jvm, f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(fresh)
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(fresh), p(path))
    fs.delete(p(old), True)
