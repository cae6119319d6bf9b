"""Cards, rollups, narratives and enrichment state (A-1, A-2, A-5-A-10, A-18, W6, W7, W12, P19, P24, J13, E1-E11, E14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import estimated_tokens


def status_counts(rows: DataFrame) -> DataFrame:
    """A-1: stale counts as pending, already enriched as enriched."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return rows.agg(F.count("*").alias("total"), n("pending", "stale").alias("pending"), n("enriched", "already_enriched").alias("enriched"), n("error").alias("errors"), n("subagent-queued").alias("queued"))


def work_items(rows: DataFrame, stale_only: bool = False) -> DataFrame:
    """Pending before stale, each in order of seq."""
    kept = rows.where(F.col("status").isin(*(["stale"] if stale_only else ["pending", "stale"])))
    return kept.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), "seq")


def communities(nodes: DataFrame, most: int = 50) -> DataFrame:
    """A-5, W6: community, size and the labels of its ``most`` nodes of the highest degree; ties by id. Tasks keep their own first ``most`` before the shuffle."""
    rows = nodes.where("community is not null")
    w = Window.partitionBy("community").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id")
    top = rows.select("community", "label", "id", "degree").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    lists = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]).alias("members"))
    return rows.groupBy("community").agg(F.count("*").alias("size")).join(lists, "community").select("community", "size", "members")


def grouped_edges(edges: DataFrame, most: int | None = None) -> DataFrame:
    """A-6: source, relation, number and targets in order; a list of at most ``most`` only where a renderer asks for that, the number counts all."""
    if most is None:
        return edges.groupBy("source", "relation").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("target")).alias("targets"))
    w = Window.partitionBy("source", "relation")
    rows = edges.withColumn("n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("target"))).where(F.col("_r") <= most)
    return rows.groupBy("source", "relation", "n").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def file_cards(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """A-7: path, exports, members, imports and imported_by; keys that more than one node has are left out."""
    one = symbols.withColumn("_n", F.count("*").over(Window.partitionBy("symbol_key"))).where("_n = 1")
    by = one.groupBy("path").agg(F.array_sort(F.collect_set(F.when((F.col("node_kind") == "symbol") & (F.col("scope") == "exported"), F.col("symbol_key")))).alias("exports"), F.array_sort(F.collect_set(F.when(F.col("node_kind") == "member", F.col("symbol_key")))).alias("members"))
    return by.join(facts, "path", "left")


def rollup(accepted: DataFrame, by: str = "path") -> DataFrame:
    """A-8-A-10: ``- key: summary`` lines of the accepted narratives of a file, community or feature, sorted by key."""
    line = F.concat(F.lit("- "), F.col("symbol_key"), F.lit(": "), F.col("summary"))
    return accepted.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_key", line.alias("line")))), lambda x: x["line"]), "\n").alias("rollup"), F.count("*").alias("narratives"))


def narrative_problems(rows: DataFrame, keys: DataFrame, words: int = 25) -> DataFrame:
    """symbol_key and the first problem of narratives (summary, behavior, mentions): no or long summary, empty items, unknown mentions."""
    told = rows.select("symbol_key", F.explode_outer("mentions").alias("mention")).join(keys.select(F.col("symbol_key").alias("mention"), F.lit(True).alias("_known")), "mention", "left")
    bad = told.groupBy("symbol_key").agg(F.count_if(F.col("mention").isNotNull() & F.col("_known").isNull()).alias("_bad"))
    size = F.size(F.filter(F.split(F.trim("summary"), r"\s+"), lambda x: x != ""))
    problem = F.when(F.coalesce(size, F.lit(0)) < 1, "no-summary").when(size > words, "long-summary").when(F.exists(F.coalesce("behavior", F.array().cast("array<string>")), lambda x: x.isNull() | (F.trim(x) == "")), "empty-item").when(F.col("_bad") > 0, "unknown-mention")
    return rows.join(bad, "symbol_key").select("symbol_key", problem.alias("problem"))


def within_budget(sections: DataFrame, most: int) -> DataFrame:
    """Leading sections (card, seq, text) of each card while their tokens sum to ``most`` at the most; the first always stays."""
    total = F.sum(estimated_tokens("text")).over(Window.partitionBy("card").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("seq").over(Window.partitionBy("card"))
    return sections.withColumn("tokens", total).withColumn("_first", first).where((F.col("tokens") <= most) | (F.col("seq") == F.col("_first"))).drop("_first")


def retry_candidates(failures: DataFrame) -> DataFrame:
    """A-18: per symbol all errors in order and the entry with most attempts; of equals the later one."""
    return failures.groupBy("symbol_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]).alias("errors"), F.max("attempts").alias("attempts"), F.max_by("entry", F.struct("attempts", "seq")).alias("entry"))


def with_results(worklist: DataFrame, results: DataFrame) -> DataFrame:
    """Worklist rows (symbol_key, status, attempts) updated by outcomes (symbol_key, ok, error, mode); a row a symbol."""
    r = results.select("symbol_key", "ok", F.struct("mode", "error").alias("_try"))
    rows = worklist.join(r, "symbol_key", "left")
    tried = F.when(F.col("ok").isNotNull(), F.array_append(F.coalesce("attempts", F.array().cast("array<struct<mode:string,error:string>>")), F.col("_try"))).otherwise(F.col("attempts"))
    return rows.select("symbol_key", F.when(F.col("ok"), "enriched").when(~F.col("ok"), "error").otherwise(F.col("status")).alias("status"), tried.alias("attempts"))


def named_communities(found: DataFrame, names: DataFrame) -> DataFrame:
    """Community, name and outcome: named where a name is given that is not empty, kept where the community has one already, else skipped."""
    rows = found.join(names.select("community", F.trim("name").alias("_new")), "community", "left")
    old = F.col("name").isNotNull() & (F.col("name") != "")
    new = F.coalesce(F.col("_new") != "", F.lit(False))
    return rows.select("community", F.when(old, F.col("name")).when(new, F.col("_new")).alias("name"), F.when(old, "kept").when(new, "named").otherwise("skipped").alias("outcome"))


def session_snapshot(report: DataFrame, overviews: DataFrame, most: int = 5) -> DataFrame:
    """Section, name and text: the numbers of a status report and the first ``most`` overview documents (kind, text), by kind."""
    docs = overviews.orderBy("kind").limit(most).select(F.lit("overview").alias("section"), F.col("kind").alias("name"), "text")
    return report.select("section", "name", F.col("n").cast("string").alias("text")).unionByName(docs)
