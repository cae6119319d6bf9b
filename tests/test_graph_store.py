"""The bucketed store: partial rewrites, plans without moved edges, whole versions and conflicts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.graph_store import BucketTable, Conflict, StoredGraph


def files(path):
    return {x: os.path.getmtime(x) for x in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(spark, n, extra=0):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") * 2 + extra).alias("v"))


def test_rewrites_only_what_changes(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "key", 8)
    assert t.open_or_rebuild(rows(spark, 400), "a") == list(range(8)) and len(files(tmp_path)) == 8
    assert t.open_or_rebuild(rows(spark, 9), "a") == []  # the origin is said to be the same
    assert t.open_or_rebuild(rows(spark, 400).repartition(5), "b") == [] and len(files(tmp_path)) == 8
    one = spark.createDataFrame([("k7", -1)], "key string, v long")
    assert len(t.upsert(one)) == 1 and len(files(tmp_path)) == 9
    got = {r.key: r.v for r in t.read().collect()}
    assert got == {f"k{k}": 2 * k if k != 7 else -1 for k in range(400)}
    assert t.upsert(one) == [] and len(files(tmp_path)) == 9
    again = t.open_or_rebuild(rows(spark, 400), "c")
    assert len(again) == 1 and len(files(tmp_path)) == 10 and {r.key: r.v for r in t.read().collect()}["k7"] == 14
    t.upsert(rows(spark, 0), removed=spark.createDataFrame([("k1",), (None,)], "key string"))
    assert t.read().count() == 399
    before = t.whole()
    assert t.vacuum() == 3 and t.read().count() == 399 and t.whole() == before
    other = BucketTable(spark, str(tmp_path / "t"), "key", 8, schema_version=2)
    assert other.open_or_rebuild(rows(spark, 20), "c") and other.read().count() == 20
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path / "none"), "key").read()


def test_readers_see_whole_versions_and_writers_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    t = BucketTable(spark, path, "key", 4)
    t.open_or_rebuild(rows(spark, 50))
    base = t.whole()
    one = spark.createDataFrame([("k7", -1)], "key string, v long")
    t.upsert(one)
    with pytest.raises(Conflict):  # a second writer that began from the same version
        t.versions.add(base, {"entries": {}})
    with open(f"{path}/manifest/00000003.json", "w") as f:
        f.write('{"version": 3, "entr')  # a writer that died
    assert t.whole()["version"] == 2 and t.read().where("v = -1").count() == 1
    t.upsert(spark.createDataFrame([("k8", -2)], "key string, v long"))
    assert t.whole()["version"] == 4 and t.read().where("v < 0").count() == 2
    assert t.read(base).where("v < 0").count() == 0  # an older version stays whole until it is cleared


def test_empty_tables_and_null_keys(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "key", 4)
    assert t.open_or_rebuild(rows(spark, 0)) == [] and t.read().count() == 0
    t.upsert(spark.createDataFrame([(None, 1), ("a", None)], "key string, v long"))
    assert sorted(map(tuple, t.read().collect()), key=str) == [("a", None), (None, 1)]
    t.upsert(spark.createDataFrame([(None, 5)], "key string, v long"))
    assert {r.key: r.v for r in t.read().collect()} == {None: 5, "a": None}


def test_walks_move_no_edges(spark, tmp_path):
    edges = spark.range(2000).select((F.col("id") % 97).cast("string").alias("source"), (F.col("id") * 7 % 101).cast("string").alias("target"), F.when(F.col("id") % 3 == 0, "calls").otherwise("imports").alias("relation"))
    nodes = spark.range(101).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("kind"))
    g = StoredGraph(spark, str(tmp_path / "g"), 8)
    g.open_or_rebuild(nodes, edges)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = g.read("out").join(spark.createDataFrame([("3",)], "src string"), "src", "left_semi")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(src") == 1, plan  # the frontier's only
        assert "Bucketed: true" in plan and met.count() == edges.where("source = '3'").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for way in ("out", "in"):
        plain = graph.traverse(spark, nodes, edges, ["3"], 2, direction=way)
        stored = graph.traverse(spark, g.read("nodes"), None, ["3"], 2, direction=way, walk=g.read(way))
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, stored.collect()), key=str)


def test_merging_a_file_rewrites_its_buckets(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{k}", 1, f"f{k % 9}") for k in range(90)] + [("n5", 2, "moved")], "id string, seq int, file string")
    edges = spark.createDataFrame([(f"n{k}", f"n{(k * 7 + 1) % 90}", "calls") for k in range(90)], "source string, target string, relation string")
    g = StoredGraph(spark, str(tmp_path / "g"), 16)
    g.open_or_rebuild(nodes, edges, "1")
    assert g.read("nodes").where("id = 'n5'").first().file == "moved" and g.read("nodes").count() == 90
    assert not any(g.open_or_rebuild(nodes, edges, "1").values()) and not any(g.open_or_rebuild(nodes, edges, "2").values())
    done = g.merge(spark.createDataFrame([("n5", "again")], "id string, file string"), spark.createDataFrame([("n5", "n6", "calls"), ("n5", "n6", "calls")], "source string, target string, relation string"), edges.where("source = 'n8'"))
    assert {k: len(v) <= 2 for k, v in done.items()} == dict.fromkeys(("nodes", "out", "in"), True)
    assert {r.target for r in g.read("out").where("src = 'n5'").collect()} == {"n36", "n6"} and g.read("in").count() == g.read("out").count() == 90
