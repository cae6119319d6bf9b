"""Operator 9 against brute force, and its edge cases."""

import numpy as np
import pytest

from graphloom.llm.embedding_dedup import near_duplicates
from test_text_ops import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    ok = {i: np.array(v, float) for i, v, label in rows if v is not None and label is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    ids = sorted(ok)
    links = {i: 0 for i, *_ in rows}
    pairs = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if label[a] == label[b] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least:
                    pairs.append((a, b))
                    links[a] += 1
                    links[b] += 1
    return links, components(pairs, list(links))


def test_sorted_projections_of_embeddings(spark, sf_dir):
    """The table's own rows, and near copies of a tenth of them (its rows alone hold no links)."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rng = np.random.default_rng(5)
    rows = [tuple(r) for r in df.collect()]
    near = [(10_000_000 + i, (np.array(v) + 0.01 * np.linalg.norm(v) * rng.standard_normal(len(v)) / np.sqrt(len(v))).astype(np.float32).tolist(), label) for i, v, label in rows[::10]]
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows] + near
    links, up = brute(rows)
    got = {r.vec_id: r for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and sum(links.values()) >= 2 * len(near)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], up[i], up[i] == i) for i in links}


@pytest.mark.parametrize("partitions", [4, 64, 211])
def test_recall_in_a_dense_cloud_whatever_the_partitions(spark, partitions):
    """Small groups of near copies inside a cloud of one label whose vectors are all close together: 0.95 of the links, and the same ones."""
    rng = np.random.default_rng(8)
    centre, rows = rng.standard_normal(32), []
    for group in range(700):
        base = centre + 0.45 * rng.standard_normal(32)
        for _ in range(1 + group % 3):
            rows.append((len(rows), (base + 0.09 * rng.standard_normal(32)).astype(np.float32).tolist(), 1))
    links, _ = brute(rows)
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.vec_id: r.n_links for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", saved)
    assert sum(links.values()) > 500 and all(got[i] <= links[i] for i in links)
    assert sum(got.values()) >= 0.95 * sum(links.values())
    assert FOUND.setdefault("cloud", got) == got


FOUND: dict = {}


def test_sorted_projections_edge_cases(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(k, (base + 0.01 * rng.standard_normal(16)).tolist(), 1) for k in range(120)] + [(k, base.tolist(), 2) for k in range(200, 260)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, base.tolist(), None), (305, [], 1), (306, base[:8].tolist(), 1), (307, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as rep", "1 as n", "2 as component")
    links, up = brute(rows)
    got = {r.vec_id: r for r in near_duplicates(spark, df).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (links[i], up[i]) for i in links}
    assert near_duplicates(spark, df.limit(0)).count() == 0
