"""Queries of the keyed state over the test tables: a bounded queue run and a refresh by changed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.registering import Registry
from graphloom.session import Scratch, table
from graphloom.streaming.stateful import EnrichmentStore, Refresher

FOUND = Registry()


def buckets(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@FOUND("queue_run", """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'enriched' WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 3 THEN 'error' ELSE 'enriched' END AS status,
CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 4 = 3 THEN 3 ELSE o_orderkey % 4 + 1 END AS attempts,
CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'schema' WHEN o_orderkey % 4 = 3 THEN 'network' END AS error FROM orders""")
def queue_run(spark, d):
    """Every order is a symbol whose provider fails so many times, finally or in passing; four rounds of all that is due."""
    store = EnrichmentStore(spark, Scratch(spark, "queue-run").kept("store"), buckets(spark), most=3)
    store.create(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("symbol_key"), F.col("o_orderkey").alias("seq")))
    k = F.col("seq")
    provider = lambda items, _: items.select("symbol_key", (k % 4 <= F.col("attempts")).alias("ok"), F.when(k % 4 > F.col("attempts"), F.when(k % 7 == 0, "schema").otherwise("network")).alias("error"), F.lit("x").alias("mode"))
    store.run(provider, [f"2024-01-01 0{h}:00:00" for h in range(4)])
    return store.read().select("seq", "status", "attempts", "error")


@FOUND("refreshed_files", """SELECT p_partkey AS k, kind, CASE WHEN p_partkey % 3 = 0 AND kind = 'class' THEN 'stale'  ELSE 'pending' END AS status,
CASE WHEN p_partkey % 3 = 0 AND kind = 'class' THEN 3 ELSE 1 END AS logged FROM part, (VALUES ('class'), ('function')) v(kind) WHERE p_partkey % 7 <> 0""")
def refreshed_files(spark, d):
    """Two batches of a module for every part: the second changes a class in each third file and takes each seventh away."""
    k = F.col("p_partkey")
    name = k.cast("string")
    content = lambda x: F.concat(F.lit("class A"), name, F.lit(" {\n  // "), x, F.lit("\n}\nexport function run"), name, F.lit("() {\n}\n"))
    parts = table(spark, d, "part").select(k, F.concat(F.lit("src/m"), name, F.lit(".ts")).alias("path"))
    one = parts.select("path", k.alias("seq"), content(F.lit("first")).alias("content"))
    two = parts.where("p_partkey % 3 = 0 or p_partkey % 7 = 0 or p_partkey % 3 = 1").select("path", k.alias("seq"), F.when(k % 7 != 0, content(F.when(k % 3 == 0, "second").otherwise("first"))).alias("content"))
    r = Refresher(spark, Scratch(spark, "refreshed-files").kept("store"), buckets(spark))
    r.apply(one, "1")
    r.apply(two, "2")
    logged = r.log.read().groupBy("path", "symbol_key").agg(F.count("*").cast("int").alias("logged"))
    rows = r.worklist.read().join(logged, ["path", "symbol_key"])
    return rows.select(F.regexp_extract("path", r"m(\d+)\.ts$", 1).cast("long").alias("k"), F.split("symbol_key", r"\|")[2].alias("kind"), "status", "logged")
