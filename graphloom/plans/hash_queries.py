"""Queries of content hashes: SQL has no XXH64, so it can tell no more than their agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import hashes
from graphloom.plans.registering import Registry
from graphloom.session import table

FOUND = Registry()


@FOUND("content_hashes", "SELECT count(*) AS texts, count(DISTINCT coalesce(text, '')) AS hashes, 16 AS width FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, d):
    """Equal texts have equal hashes and different ones different."""
    rows = table(spark, d, "documents").where("text is not null").select(hashes.text_hash("text").alias("h"))
    return rows.agg(F.count("*").alias("texts"), F.count_distinct("h").alias("hashes"), F.max(F.length("h")).alias("width"))


@FOUND("canonical_roles", """SELECT c_custkey AS k, '{"evidence":[{"a":' || c_nationkey || ',"b":null}],"role":"' || lower(c_mktsegment) || '"}' AS canonical FROM customer""")
def canonical_roles(spark, d):
    text = F.concat(F.lit('{ "role" : "'), F.lower("c_mktsegment"), F.lit('", "evidence" : [ { "b" : null, "a" : '), F.col("c_nationkey").cast("string"), F.lit(".0 } ] }"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), hashes.canonical_json(text).alias("canonical"))


@FOUND("narrative_fingerprints", "SELECT c_nationkey AS owner, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY 1")
def narrative_fingerprints(spark, d):
    """One fingerprint for each nation and segment: neither the order of an object's keys nor that of the callees counts."""
    even = F.col("c_custkey") % 2 == 0
    role = F.when(even, F.concat(F.lit('{"role":"'), "c_mktsegment", F.lit('","layer":1}'))).otherwise(F.concat(F.lit('{"layer":1.0,"role":"'), "c_mktsegment", F.lit('"}')))
    callees = F.when(even, '{"b|k":"1","a|k":"2"}').otherwise('{"a|k":"2","b|k":"1"}')
    one = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), hashes.narrative_hash(F.col("c_nationkey").cast("string"), F.lit(None).cast("string"), role, callees, F.lit("v2")).alias("h"))
    return one.groupBy("owner").agg(F.count("*").alias("n"), F.count_distinct("h").alias("kinds"))
