"""Scans of hot keys in many tasks, and the inverted index, against plain code."""

import math
import random

from pyspark.sql import functions as F

from graphloom.operators import delta
from graphloom.operators.inverted_index import InvertedIndex
from graphloom.operators.search import bm25
from graphloom.streaming.capture import sessions_by_gap


def test_sessions_of_a_hot_key(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for n in range(6000):
        at += rng.choice([1, 5, 60, 61, 0])
        rows.append(("hot" if n % 40 else rng.choice(["a", "b", None]), at, n))
    df = spark.createDataFrame(rows, "k string, s long, n long").select("k", F.timestamp_seconds("s").alias("ts"), "n").repartition(7)
    want, last = {}, {}
    for k, s, _ in rows:
        number = last.get(k, (None, 0))
        number = number[1] + (number[0] is None or s - number[0] > 60)
        last[k] = (s, number)
        x = want.setdefault((k, number), [s, s, 0])
        x[1], x[2] = s, x[2] + 1
    got = {(r.k, r.session): [int(r.start.timestamp()), int(r.end.timestamp()), r.events] for r in sessions_by_gap(df, 60, "k", "ts", "n").collect()}
    assert got == want
    assert sessions_by_gap(df.limit(0), 60, "k", "ts", "n").count() == 0


def test_halting_of_a_hot_key(spark):
    rows = [("hot" if n % 9 else None, n, n == 700 or n == 2000 or n == 81) for n in range(3000)] + [("calm", 1, False), ("calm", 2, None), ("tie", 5, True), ("tie", 5, False), ("tie", 6, False)]
    df = spark.createDataFrame(rows, "k string, seq int, bad boolean")
    got = sorted((str(r.k), r.seq, str(r.bad), r.outcome) for r in delta.halted(df, "k", "seq", F.col("bad")).collect())
    first = {}
    for k, seq, bad in rows:
        if bad:
            first[k] = min(first.get(k, seq), seq)
    assert got == sorted((str(k), s, str(b), "halted" if s > first.get(k, math.inf) else "failed" if b else "done") for k, s, b in rows)


def test_index_scores_as_a_scan_and_changes_in_place(spark, tmp_path):
    rng = random.Random(4)
    words = ["graph", "query", "Spark", "index", "node", "edge", "walk", "plan", "é", "x"]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.randrange(30))) if k % 11 else None for k in range(150)}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "doc int, text string")
    index = InvertedIndex(spark, str(tmp_path / "i"), 8)
    index.open_or_build(frame(texts), "1")

    def same(question):
        rows = frame({k: v or "" for k, v in texts.items()})
        for every in (True, False):
            want = {r.doc: round(r.score, 9) for r in bm25(rows, question, "text", "doc", every=every).collect()}
            assert {r.doc: round(r.score, 9) for r in index.search(question, every).collect()} == want
        best = [r.doc for r in index.search(question, False, 5).collect()]
        assert best == sorted(want, key=lambda d: (-want[d], d))[:5]

    same("spark graph")
    read = index.postings.read_keys(spark.createDataFrame([("spark",)], "token string")).inputFiles()
    assert len(read) == 1
    before = index.versions.last()
    index.open_or_build(frame({}), "1")
    assert index.versions.last() == before
    changed = {3: "walk walk rare", 149: "", 500: "graph plan"}
    done = index.upsert(frame(changed), spark.createDataFrame([(7,), (9999,)], "doc int"))
    texts |= changed
    del texts[7]
    same("graph walk")
    same("rare")
    assert len(done["docs"]) <= 5 and index.search("").count() == 0 and index.search("nothing here").count() == 0
