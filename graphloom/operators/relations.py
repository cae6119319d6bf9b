"""Resolving symbols, modules and bindings to graph nodes (J1, J2, J5, J6, J9, J10, G7, G20, G21, A-3, A-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import module_candidates


def with_nodes(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols with their node's label and the first summary there is."""
    n = nodes.select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.col("summary").alias("_summary"))
    return symbols.join(n, "node_id", "left").withColumn("summary", F.coalesce("summary", "_summary", F.lit(""))).drop("_summary")


def unique_keys(symbols: DataFrame) -> DataFrame:
    """node_id and symbol_key of nodes that exactly one key claims."""
    return symbols.groupBy("node_id").agg(F.count_distinct("symbol_key").alias("_n"), F.min("symbol_key").alias("symbol_key")).where("_n = 1").drop("_n")


def resolved(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Id, node_id and reason for symbols (id, path, name, line) against nodes (node_id, path, name, line).

    No node in the file: ``no-file-node``; none of that name: ``no-label-match``; several equally near: ``ambiguous``; else the
    one whose line is nearest.
    """
    key = ["path", "name"]
    files = nodes.select("path").distinct().withColumn("_file", F.lit(True))
    names = nodes.groupBy(*key).agg(F.max(F.col("node_id").isNull()).alias("_hole"))  # a node without an id counts as met at any line
    lines = nodes.where("line is not null and path is not null and name is not null").groupBy(*key, "line").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    # Nodes of one line are one row, and symbols of one place: the nearest lines are those before and after in the order of all, so no pairs are made.
    spots = symbols.select(*key, "line").distinct()
    both = spots.unionByName(lines.select(*key, "line", F.struct("line", "lo", "hi").alias("at")), allowMissingColumns=True)
    until = lambda order: Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("a", F.last("at", True).over(until(F.asc("line")))).withColumn("b", F.last("at", True).over(until(F.desc("line")))).where("at is null").drop("at")
    far = lambda x: F.abs(F.col("line") - F.col(f"{x}.line"))
    d = F.when(F.col("line").isNotNull(), F.least(far("a"), far("b")))
    pick = lambda f, end: f(*[F.when(far(x) == F.col("_d"), F.col(f"{x}.{end}")) for x in "ab"])
    spots = near.withColumn("_d", d).select(*key, "line", "_d", pick(F.least, "lo").alias("_lo"), pick(F.greatest, "hi").alias("_hi"))
    spots = spots.join(names, key, "left").join(files, "path", "left")
    s, t = symbols.alias("s"), spots.alias("t")
    same = F.lit(True)
    for c in (*key, "line"):
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    met = s.join(t, same).select("s.id", "s.path", "_d", "_lo", "_hi", "_hole", "_file")
    met = met.withColumn("_best", F.min("_d").over(Window.partitionBy("id"))).where("_hole is null or _hole or _d = _best")
    least = F.col("_d") == F.col("_best")
    found = met.groupBy("id", "path").agg(F.min(F.when(least, F.col("_lo"))).alias("_lo"), F.max(F.when(least, F.col("_hi"))).alias("_hi"), F.max("_file").alias("_file"))
    reason = F.when(F.col("_file").isNull(), "no-file-node").when(F.col("_lo").isNull(), "no-label-match").when(F.col("_lo") != F.col("_hi"), "ambiguous")
    return found.select("id", F.when(reason.isNull(), F.col("_lo")).alias("node_id"), reason.alias("reason"))


def resolver_report(rows: DataFrame) -> DataFrame:
    """A-4: total, resolved and null_rate (0 for no rows)."""
    total, ok = F.count("*"), F.count("node_id")
    return rows.agg(total.alias("total"), ok.alias("resolved"), F.when(total > 0, 1 - ok / total).otherwise(F.lit(0.0)).alias("null_rate"))


def modules(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """Id, target and reason of module paths (id, base) against the inventory (path): exactly one candidate must exist."""
    tried = specifiers.select("id", F.explode(module_candidates("base")).alias("path")).distinct()
    hits = tried.join(files.select("path").distinct(), "path").groupBy("id").agg(F.count("*").alias("_n"), F.min("path").alias("_path"))
    reason = F.when(F.col("_n").isNull(), "not-found").when(F.col("_n") > 1, "ambiguous")
    return specifiers.select("id").distinct().join(hits, "id", "left").select("id", F.when(reason.isNull(), F.col("_path")).alias("target"), reason.alias("reason"))


def persisted(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all edges, counts by relation of inserted and repeated ones)."""
    key = ["source", "target", "relation"]
    fresh = new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    seen = new.groupBy("relation").agg(F.count("*").alias("given")).join(fresh.groupBy("relation").agg(F.count("*").alias("inserted")), "relation", "left")
    counts = seen.select("relation", F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("given") - F.coalesce("inserted", F.lit(0))).alias("duplicates"))
    return existing.unionByName(fresh), counts


def bindings(rows: DataFrame) -> DataFrame:
    """One row a binding; more than one piece of evidence drops the target and says so."""
    key = ["source_id", "file_id", "imported", "local", "type_only"]
    by = rows.groupBy(*key).agg(F.count_distinct(F.coalesce("target", F.lit("")), F.coalesce("reason", F.lit(""))).alias("_n"), F.min("target").alias("_t"), F.min("reason").alias("_r"))
    return by.select(*key, F.when(F.col("_n") == 1, F.col("_t")).alias("target"), F.when(F.col("_n") > 1, "ambiguous-binding-evidence").otherwise(F.col("_r")).alias("reason"))


def unresolved_counts(rows: DataFrame) -> DataFrame:
    """A-3."""
    return rows.groupBy(F.coalesce("relation", F.lit("unknown")).alias("relation")).agg(F.count("*").alias("n"))


def restored_roles(roles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roles whose endpoint (path, name) is exactly one node after a rebuild, with that node's id."""
    one = nodes.groupBy("path", "name").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1").drop("_n")
    return roles.drop("id").join(one, ["path", "name"])
