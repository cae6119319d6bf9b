"""Operator 7 against a plain version of its targets, and its edge cases."""

import re

from pyspark.sql import functions as F

from graphloom.llm.mixing import mix_sources


def targets(sizes):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in free}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= above
    return out


def check(rows, got):
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    want = targets(size)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1, (s, t, want[s])
    assert len(got) == rows


def test_mixing_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mix_sources(spark, docs).collect()
    check(docs.count(), got)
    by = {r.doc_id: r for r in docs.collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", by[r.doc_id].text or "")) and r.source == by[r.doc_id].source for r in got)
    again = mix_sources(spark, docs.repartition(7, "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_edge_cases(spark):
    rows = [(1, "a b c", "x", 1), (2, None, "x", 1), (3, "", None, 1), (4, "a " * 5000, None, 1), (5, "q", "y", 1), (1, "a b c", "x", 1), (None, "k k", "z", 1), (6, "a  b", "empty", 1), (7, " ", "blank", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumns({c: F.lit(1) for c in ("bucket", "at", "row", "taken", "target")})
    check(len(rows), mix_sources(spark, df).collect())
    assert mix_sources(spark, df.limit(0)).count() == 0
    nothing = mix_sources(spark, df.where("text is null")).collect()
    assert [(r.size, r.taken) for r in nothing] == [(0, 0)]
