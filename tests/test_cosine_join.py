"""The pruned cosine join against all pairs, and how much it leaves out."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators.cosine_join import cosine_pairs, regions


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, vector array<double>")


def plain(left, right, least):
    out = set()
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if a is None or b is None or len(a) != len(b) or not np.all(np.isfinite(a)) or not np.all(np.isfinite(b)):
                continue
            n = np.linalg.norm(a) * np.linalg.norm(b)
            if n > 0 and np.dot(a, b) / n >= least:
                out.add((i, j))
    return out


def test_finds_all_pairs(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    near = lambda n, s: [centres[k % 12] * rng.uniform(0.1, 9) + rng.normal(size=16) * s for k in range(n)]
    left, right = near(300, 0.3) + list(rng.normal(size=(60, 16))), near(300, 0.3) + list(rng.normal(size=(60, 16)))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, 2.0], [2.0, 4.1], [1e-100] * 16]
    left, right = left + odd + left[:3], right + odd + left[:3]
    for least in (0.95, 0.7, 0.0, -0.5):
        got = [(r.a, r.b) for r in cosine_pairs(frame(spark, left), frame(spark, right).repartition(3), least, block=64).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(left, right, least), least
    assert cosine_pairs(frame(spark, left), frame(spark, left).limit(0), 0.9).count() == 0 and cosine_pairs(frame(spark, left).limit(0), frame(spark, left), 0.9).count() == 0


def test_compares_a_small_part_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    rows = frame(spark, [centres[k % 40] + rng.normal(size=32) * 0.1 for k in range(2000)])
    a, b = regions(rows, rows, 0.9)
    key = ["dim", "pivot", "ring"]
    n = a.groupBy(*key).count().withColumnRenamed("count", "x").join(b.groupBy(*key).count().withColumnRenamed("count", "y"), key).agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    assert n < 0.1 * 2000 * 2000


def in_order(left, right, least):
    """The sequential rule on lists of (id, vector)."""
    free, out = dict(right), set()
    for a, v in sorted(left):
        best = max(((float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), -b) for b, w in free.items()), default=(-2, 0))
        if best[0] >= least:
            out.add((a, -best[1]))
            free.pop(-best[1])
    return out


def test_greedy_match_takes_few_rounds_where_many_rows_want_the_same(spark, monkeypatch):
    """Equal vectors and long chains of rows that wait for each other: a round a row before, a round a block now."""
    from graphloom.operators import search
    from graphloom.session import Scratch

    rng = np.random.default_rng(3)
    kinds = np.round(rng.normal(size=(6, 8)) * 4)  # whole numbers: sums are exact in any order
    left, right = ([(2 * k + side, kinds[k % 6] if k % 3 else np.round(rng.normal(size=8) * 4) + 0.5) for k in range(300)] for side in (0, 1))
    a, b = (spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "id long, vector array<double>") for rows in (left, right))
    written = []
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, f=Scratch.write: written.append(name) or f(self, df, name))
    want = in_order(left, right, 0.3)
    for block, most in ((4096, 8), (64, 20)):
        written.clear()
        assert {(r.a, r.b) for r in search.greedy_match(spark, a, b, 0.3, block).collect()} == want
        assert len(written) < most, written


def test_pairs_left_out_are_found_in_a_later_block(spark, monkeypatch):
    from graphloom.operators import search

    rows = [(k, [1.0, 2.0]) for k in range(400)] + [(900, [2.0, 4.0, 1.0]), (901, None), (902, [0.0, 0.0])]
    a, b = (spark.createDataFrame([(2 * k + s, v) for k, v in rows], "id long, vector array<double>") for s in (0, 1))
    got = {(r.a, r.b, r.cosine) for r in search.greedy_match(spark, a, b.coalesce(1), 0.5).collect()}
    assert {x[:2] for x in got} == {(2 * k, 2 * k + 1) for k in [*range(400), 900]}
    assert search.greedy_match(spark, a.limit(0), b).isEmpty() and search.greedy_match(spark, a, b.limit(0)).isEmpty()
