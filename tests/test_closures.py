"""Closures with parents, their paths by pointer jumping, and many seeds in one loop, against plain walks."""

import random

from pyspark.sql import functions as F

from graphloom.operators import graph, loops


def plain(edges, seeds, rounds=None):
    found, frontier, hop = {s: (0, [s]) for s in seeds}, sorted(seeds), 0
    while frontier and (rounds is None or hop < rounds):
        hop += 1
        new = {}
        for a in frontier:
            for x, y in edges:
                if x == a and y not in found:
                    new[y] = min(new.get(y, a), a)
        for y, a in new.items():
            found[y] = (hop, found[a][1] + [y])
        frontier = sorted(new)
    return found


def test_paths_and_many_seeds(spark, monkeypatch):
    monkeypatch.setattr(loops, "MOST_TABLES", 5)
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)} | {(f"c{k}", f"c{k + 1}") for k in range(25)})
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, relation string")
    seeds = ["n1", "n2", "c0", "nowhere"]
    got = {r.id: (r.distance, r.path) for r in graph.closure(spark, edges, seeds, "out").collect()}
    assert got == plain(pairs, seeds)
    found = graph.reached(spark, edges, seeds, "out")
    assert found.columns == ["id", "distance", "parent"]
    some = spark.createDataFrame([("c25",), ("c7",), ("never",)], "id string")
    assert {r.id: r.path for r in graph.with_paths(spark, found, some).collect()} == {k: got[k][1] for k in ("c25", "c7")}
    own = spark.createDataFrame([("c0", ["file", "c0"])], "id string, path array<string>")
    assert {r.id: r.path for r in graph.closure(spark, edges, own, "out", asked=some).collect()}["c7"] == ["file"] + [f"c{k}" for k in range(8)]
    many = [f"n{k}" for k in range(60)] + [f"c{k}" for k in range(26)]
    walk = graph.directed(edges, "out")
    reach = {}
    for r in graph.reach_of_many(spark, walk, spark.createDataFrame([(x,) for x in many], "id string"), 4).collect():
        reach.setdefault(r.seed, {})[r.id] = r.hop
    assert reach == {s: {k: v[0] for k, v in plain(pairs, [s], 4).items()} for s in many}
    assert graph.reach_of_many(spark, walk, spark.createDataFrame([], "id string")).count() == 0


def plain_components(edges):
    """Strongly connected components by reachability of all pairs."""
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_of_odd_graphs(spark):
    rng = random.Random(6)
    for n, m in ((20, 28), (25, 80)):
        edges, name = set(), lambda k: f"{k:03d}"
        for g in range(12):  # twelve graphs in one
            edges |= {(name(100 * g + rng.randrange(n)) if g < 10 else f"x{g}{rng.randrange(n)}", name(100 * g + rng.randrange(n)) if g < 10 else f"x{g}{rng.randrange(n)}") for _ in range(m)}
        # paths between nodes of different graphs, a loop on a path, a tail into a cycle, a path from a cycle to itself
        edges |= {("000", "p0"), ("p0", "p1"), ("p1", "p1"), ("p1", "p2"), ("p2", "105"), ("q0", "q1"), ("q1", "q2"), ("q2", "q3"), ("q3", "q2"), ("u0", "u1"), ("u1", "u0"), ("u1", "v0"), ("v0", "v1"), ("v1", "u0"), ("t0", "v0"), ("s0", "s0")}
        got = {r.node: r.component for r in graph.components_by_cycle(spark, spark.createDataFrame(sorted(edges), "source string, target string")).collect()}
        assert got == plain_components(edges)


def test_a_long_cycle_takes_as_many_rounds_as_its_length_has_bits(spark, monkeypatch):
    from graphloom.session import Scratch

    written = []
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, f=Scratch.write: written.append(name) or f(self, df, name))
    rows = [(f"{k}", f"{(k + 1) % 300}") for k in range(300)] + [(f"a{k}", f"a{k + 1}") for k in range(200)] + [("17", "a0")]
    got = {r.node: r.component for r in graph.components_by_cycle(spark, spark.createDataFrame(rows, "source string, target string")).collect()}
    assert len(got) == 501 and all(c == ("0" if n[0] != "a" else n) for n, c in got.items()) and len(written) < 60, written


def test_levels_over_a_long_cycle(spark, monkeypatch):
    from graphloom.session import Scratch

    written = []
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, f=Scratch.write: written.append(name) or f(self, df, name))
    rows = [(f"{k}", f"{(k + 1) % 100}") for k in range(100)] + [("a", "5"), ("b", "a"), ("b", "7"), ("9", "z")]
    got = {r.node: (r.component, r.level) for r in graph.call_levels(spark, spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got == {f"{k}": ("0", 1) for k in range(100)} | {"a": ("a", 2), "b": ("b", 3), "z": ("z", 0)} and len(written) < 80, written
