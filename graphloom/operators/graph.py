"""Graph operators over nodes (id, label, kind, source_file, community) and edges (source, target, relation): G1-G17, G23."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import RELATIONS, constructor_end, kinds_allowed, normal_path, test_file
from graphloom.operators.loops import frontier_loop
from graphloom.session import Scratch

# Roles that end an entry-point walk, and the layer that does so.
ENTRY_ROLES, ENTRY_LAYER = ("entrypoint", "cli-command", "mcp-tool", "controller"), "entrypoint"


def ids_frame(spark: SparkSession, ids) -> DataFrame:
    return ids if isinstance(ids, DataFrame) else spark.createDataFrame([(str(x),) for x in ids], "id string")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """src and dst in walking direction, with the edge's own source, target and relation."""
    if direction not in ("out", "in"):
        raise ValueError(f"unknown direction: {direction}")
    a, b = ("source", "target") if direction == "out" else ("target", "source")
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), "source", "target", "relation")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """S7."""
    return nodes.where(F.col("id") == node_id)


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    """Equality after slashes are made alike."""
    return nodes.where(normal_path("source_file") == path.replace("\\", "/"))


def edge_scan(edges: DataFrame, relation: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges that fit every value given."""
    for name, value in (("relation", relation), ("source", source), ("target", target)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    """P7."""
    return edges.where((F.col("source") == node_id) | (F.col("target") == node_id))


def traverse(spark: SparkSession, nodes: DataFrame, edges: DataFrame, seeds, hops: int | None, relations=RELATIONS, direction: str = "out", node_kinds=None, kind_column: str = "kind", walk: DataFrame | None = None) -> DataFrame:
    """G1/G2, id, hop and the discovering edge (source, target, relation; null for seeds) of every node within ``hops`` (None: all).

    Seeds count if known and allowed. A node is reached once, by its edge with the smallest (from, relation); nodes of kinds
    that are not allowed block the path, edges to unknown nodes are dropped, empty ``node_kinds`` reach nothing. ``walk`` stands for ``edges`` in walking
    direction, such as those of a stored graph: they are not moved, only the frontier is.
    """
    kinds = node_kinds if kind_column != "node_kind" else kinds_allowed(node_kinds)
    allowed = nodes if kinds is None else nodes.where(F.col(kind_column).isin(list(kinds)))
    allowed = allowed.select("id")
    walk = directed(edges, direction) if walk is None else walk
    walk = walk if relations is None else walk.where(F.col("relation").isin(list(relations)))
    scratch = Scratch(spark, "traverse")
    none = F.lit(None).cast("string")
    start = ids_frame(spark, seeds).distinct().join(allowed, "id", "left_semi").select("id", F.lit(0).alias("hop"), none.alias("source"), none.alias("target"), none.alias("relation"))

    def step(frontier, reached, hop):
        # Semi joins go down to the scans, below any distinct: with a frontier that is small, edges and nodes are read and not shuffled.
        met = walk.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
        found = met.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "relation", "source", "target")).alias("e"))
        found = scratch.write(found.join(reached.select("id"), "id", "left_anti"), f"met-{hop}")
        found = found.join(allowed.join(found.select("id"), "id", "left_semi"), "id", "left_semi")
        return found.select("id", F.lit(hop).alias("hop"), "e.source", "e.target", "e.relation")

    return frontier_loop(scratch, start, step, hops, "traverse")


def dual_source_edges(legacy: DataFrame, native: DataFrame) -> DataFrame:
    """Legacy edges, but for calls of sources that have any native call, with the native calls without constructors; each once.

    Without native calls it is the legacy edges. A source whose native calls all end in constructors loses its legacy calls too.
    """
    calls = native.where("relation = 'calls'")
    owners = calls.select("source").distinct().withColumn("_native", F.lit(True))
    old = legacy.join(owners, "source", "left").where((F.col("relation") != "calls") | F.col("_native").isNull()).select("source", "target", "relation")
    plain = calls.where(~constructor_end("source") & ~constructor_end("target")).select("source", "target", "relation")
    return old.unionByName(plain).distinct()


def reachable_edges(spark: SparkSession, edges: DataFrame, seeds, hops: int, direction: str = "out") -> DataFrame:
    """G3 with all edges: every matching edge between a node reached before the last hop and its neighbour, each once."""
    walk = directed(edges, direction)
    scratch = Scratch(spark, "reach")

    def step(frontier, reached, hop):
        new = walk.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        return new.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))

    found = frontier_loop(scratch, ids_frame(spark, seeds).distinct().withColumn("hop", F.lit(0)), step, hops, "reach")
    inner = found.where(F.col("hop") < hops).select(F.col("id").alias("src"))
    return walk.join(inner, "src", "left_semi").select("source", "target", "relation").distinct()


def file_context(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str, hops: int) -> DataFrame:
    """Discovering edges out of and into a file's nodes; of edges with equal ends the smallest relation stays."""
    seeds = nodes_by_file(nodes, path).select("id")
    both = traverse(spark, nodes, edges, seeds, hops).unionByName(traverse(spark, nodes, edges, seeds, hops, direction="in"))
    return both.where("source is not null").groupBy("source", "target").agg(F.min("relation").alias("relation"))


def impact_scope(spark: SparkSession, nodes: DataFrame, edges: DataFrame | None, seeds, hops: int, relations=RELATIONS, walk: DataFrame | None = None) -> DataFrame:
    """Id and hop of what reaches the seeds; the seeds are left out."""
    return traverse(spark, nodes, edges, seeds, hops, relations, "in", walk=walk).where("hop > 0").select("id", "hop")


def related_symbols(edges: DataFrame, symbols: DataFrame, key: str, direction: str) -> DataFrame:
    """Symbols (node_id, symbol_key, ...) at the other end of a symbol's edges, one row an edge."""
    own = F.broadcast(symbols.where(F.col("symbol_key") == key).select(F.col("node_id").alias("src")))
    met = directed(edges, direction).join(own, "src").select(F.col("dst").alias("node_id"), "relation")
    return met.join(symbols, "node_id")


def reached(spark: SparkSession, edges: DataFrame | None, seeds, direction: str = "in", stop: DataFrame | None = None, rounds: int | None = None, walk: DataFrame | None = None) -> DataFrame:
    """Id, distance and parent of all that can be reached in ``rounds`` (None: all); nodes of ``stop`` (id) are reached but not left.

    The parent of a node is the smallest key of the round before that has an edge to it, of a seed null: a row stays as narrow at any distance. ``walk`` stands
    for ``edges`` in walking direction. Seeds that are at a stop are left, but not those with a path of their own.
    """
    walk = (directed(edges, direction) if walk is None else walk).select("src", "dst")
    start = ids_frame(spark, seeds)
    own = "path" in start.columns
    start = start.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"))
    ends = None if stop is None else stop.select("id").distinct()

    def step(frontier, known, hop):
        live = frontier if ends is None or hop == 1 and not own else frontier.join(ends, "id", "left_anti")
        met = walk.join(live.select(F.col("id").alias("src")), "src", "left_semi")
        found = met.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        return found.join(known.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "parent")

    return frontier_loop(Scratch(spark, "closure"), start, step, rounds, "closure").withColumnRenamed("hop", "distance")


def with_paths(spark: SparkSession, found: DataFrame, asked: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """The rows of ``reached`` whose ids are ``asked`` for (id; all if None), with their path from the seed; seeds (id, path) may have one of their own.

    By pointer jumping: a round adds to each asked row the ancestors twice as far as those before, so a path of n steps takes log2(n) rounds, and
    only asked rows ever hold more than one id.
    """
    scratch = Scratch(spark, "paths")
    jump = scratch.write(found.where("parent is not null").select("id", F.col("parent").alias("to")), "jump-0")
    own = found if asked is None else found.join(asked.select("id").distinct(), "id", "left_semi")
    line, k = scratch.write(own.select(F.col("id").alias("of"), F.col("id").alias("at"), F.lit(0).alias("back")), "line-0"), 0
    while not jump.isEmpty():
        k += 1
        further = line.join(jump, line["at"] == jump["id"]).select("of", F.col("to").alias("at"), (F.col("back") + (1 << (k - 1))).alias("back"))
        line = scratch.write(line.unionByName(further), f"line-{k}")
        a, b = jump.alias("a"), jump.alias("b")
        jump = scratch.write(a.join(b, F.col("a.to") == F.col("b.id")).select("a.id", "b.to"), f"jump-{k}")
        scratch.drop(f"line-{k - 1}", f"jump-{k - 1}")
    steps = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "at"))), lambda x: x["at"])
    paths = line.groupBy(F.col("of").alias("id")).agg(steps.alias("path"))
    if seeds is not None and "path" in seeds.columns:
        first = seeds.groupBy(F.col("id").alias("_root")).agg(F.min("path").alias("_own"))
        paths = paths.join(first, F.col("path")[0] == F.col("_root"), "left").select("id", F.concat(F.coalesce("_own", F.slice("path", 1, 1)), F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).alias("path"))
    return own.join(paths, "id")


def closure(spark: SparkSession, edges: DataFrame, seeds, direction: str = "in", stop: DataFrame | None = None, rounds: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Id, distance and path (from the seed) of what ``reached`` finds, for the ids that are ``asked`` for, all if None. ``seeds`` may have a path of their own."""
    start = ids_frame(spark, seeds)
    found = reached(spark, edges, start, direction, stop, rounds)
    return with_paths(spark, found, asked, start).select("id", "distance", "path")


def reach_of_many(spark: SparkSession, walk: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """Seed, id and hop of all that each of many seeds (id) reaches along ``walk`` (src, dst), the seeds at hop 0, in one loop for all.

    A row of the frontier is a node with a bitmap of 64 seeds: a node that many seeds reach is read once for each 64 of them, and their
    bits are joined by or. A node's row of a round has the bits that are new to it.
    """
    scratch = Scratch(spark, "many")
    from graphloom.operators.delta import numbered

    named = scratch.write(numbered(seeds.select("id").distinct(), ["id"]).select("id", F.floor(F.col("_n") / 64).cast("int").alias("block"), (F.col("_n") % 64).cast("int").alias("bit")), "seeds")
    edges = walk.select("src", "dst")
    start = named.groupBy("block", "id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).select("id", F.lit(0).alias("hop"), "block", "bits")

    def step(frontier, known, hop):
        met = edges.join(frontier.select(F.col("id").alias("src"), "block", "bits"), "src").groupBy(F.col("dst").alias("id"), "block").agg(F.bit_or("bits").alias("got"))
        before = known.join(met.select("id", "block"), ["id", "block"], "left_semi").groupBy("id", "block").agg(F.bit_or("bits").alias("had"))
        new = met.join(before, ["id", "block"], "left").withColumn("bits", F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))))
        return new.where("bits <> 0").select("id", F.lit(hop).alias("hop"), "block", "bits")

    found = frontier_loop(scratch, start, step, hops, "many")
    each = found.select("id", "hop", "block", F.explode(F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(bits, b) & 1 = 1)")).alias("bit"))
    return each.join(named.withColumnRenamed("id", "seed"), ["block", "bit"]).select("seed", "id", "hop")


def walk_to_role(spark: SparkSession, edges: DataFrame, roles: DataFrame, seeds, role: str, direction: str = "out") -> DataFrame:
    """Key, role, distance and path of the nodes with a role where walks that stop at it arrive; a seed with the role is one, at 0."""
    at = roles.where(F.col("role") == role).select("id")
    return closure(spark, edges, seeds, direction, at, asked=at).select("id", F.lit(role).alias("role"), "distance", "path")


def known_role(roles: DataFrame, name: str, builtin) -> str:
    """A role name that a profile or an assignment has; else a TypeError."""
    if name in builtin or not roles.where(F.col("role") == name).isEmpty():
        return name
    raise TypeError(f"unknown role: {name}")


def entrypoints(spark: SparkSession, edges: DataFrame, roles: DataFrame, seeds) -> DataFrame:
    """Entry points from which calls reach the seeds: id, role, layer, distance and path, from the complete reverse closure."""
    calls = edges.where("relation = 'calls'")
    entries = roles.select("id", "role", "layer").where(F.col("role").isin(*ENTRY_ROLES) | (F.col("layer") == ENTRY_LAYER))
    return closure(spark, calls, seeds, "in", asked=entries).join(entries, "id").select("id", "role", "layer", "distance", "path")


def pagerank(spark: SparkSession, nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, most: int = 100) -> tuple[DataFrame, int, bool]:
    """(id and rank, rounds, converged). Pairs count once, loops stay, dangling mass is spread evenly; ranks sum to 1.

    It ends when no rank moves by more than ``tolerance``. Edges with weights are written once, in buckets by source, so that a round moves the
    ranks and the sums of what is sent, but no edges; one row (dangling mass and largest move) comes to the driver.
    """
    if not 0 <= damping < 1 or tolerance <= 0 or most < 0:
        raise ValueError("damping, tolerance or rounds out of range")
    scratch = Scratch(spark, "pagerank")
    ids = scratch.write(nodes.select("id").distinct(), "ids")
    pairs = edges.select("source", "target").distinct()
    degree = pairs.groupBy("source").agg(F.count("*").alias("out"))
    links = scratch.bucketed(pairs.join(degree, "source"), "links", "source")
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id")))
    if not ends.join(ids, "id", "left_anti").isEmpty():
        raise ValueError("an edge ends at an unknown node")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0)), 0, True
    base = ids.join(degree.withColumnRenamed("source", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved"))
    ranks, converged, rounds = scratch.write(base, "r0"), False, 0
    state = lambda df: df.agg(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.max("moved")).first()
    loose = state(ranks)[0] or 0.0
    while rounds < most and not converged:
        sent = links.join(ranks.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        value = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))
        rounds += 1
        ranks = scratch.write(ranks.join(sent, "id", "left").select("id", "dangling", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved")), f"r{rounds}")
        loose, moved = (x or 0.0 for x in state(ranks))
        converged = moved <= tolerance
        scratch.drop(f"r{rounds - 1}")
    return ranks.select("id", "rank"), rounds, converged


def impact_roles(found: DataFrame, roles: DataFrame) -> DataFrame:
    """A-11: members, summed rank and layer by role; the layer only if all members have the same one and none lacks it."""
    rows = found.dropDuplicates(["id"]).join(roles, "id").where("role is not null")
    one = (F.count_distinct("layer") == 1) & (F.count("layer") == F.count("*"))
    return rows.groupBy("role").agg(F.count("*").alias("members"), F.sum("rank").alias("rank"), F.when(one, F.min("layer")).alias("layer"))


def degrees(edges: DataFrame) -> DataFrame:
    """Id, fan_in and fan_out by distinct neighbours of calls without constructors."""
    calls = edges.where(F.col("relation") == "calls").where(~constructor_end("source") & ~constructor_end("target")).select("source", "target").distinct()
    ends = calls.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(calls.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def file_facts(file_edges: DataFrame) -> DataFrame:
    """Of (source, target) file imports: path, imports, imported_by and tests as sorted arrays."""
    pairs = file_edges.select("source", "target").distinct()
    out = pairs.groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("imports"))
    into = pairs.groupBy(F.col("target").alias("path")).agg(F.array_sort(F.collect_set("source")).alias("imported_by"))
    none = F.array().cast("array<string>")
    both = out.join(into, "path", "full").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))
    return both.withColumn("tests", F.filter("imported_by", test_file))


def forced_paths(scratch: Scratch, tag: str, only: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Where the paths of nodes with one way out lead, by pointer jumping: (node, to, low, over) at the end, the tables of all rounds, nodes of cycles with their component.

    ``only`` has (node, to) of these nodes. ``to`` is 2^k steps on in round k, or the first node with none or several ways out (``over``); ``low`` is the smallest
    node passed. Paths that never end run into cycles: then a round changes neither the smallest nodes nor the number of nodes that paths get to.
    """
    more = only.select(F.col("node").alias("to"), F.lit(True).alias("_more"))
    at = only.join(more, "to", "left").select("node", "to", F.col("node").alias("low"), F.col("_more").isNull().alias("over"), F.col("_more").isNotNull().alias("moved"))
    at = scratch.write(at, f"{tag}-0")
    rounds, ends = [at], None
    while True:
        n, moved, now = at.where("not over").agg(F.count("*"), F.count_if("moved"), F.count_distinct("to")).first()
        if not n:
            return at, rounds, None
        if not moved and now == ends:
            break
        ends, k = now, len(rounds)
        a, b = at.where("not over").alias("a"), at.alias("b")
        low = F.least("a.low", "b.low")
        on = a.join(b, F.col("a.to") == F.col("b.node")).select("a.node", "b.to", low.alias("low"), "b.over", (low < F.col("a.low")).alias("moved"))
        at = scratch.write(on.unionByName(at.where("over").withColumn("moved", F.lit(False))), f"{tag}-{k}")
        rounds.append(at)
    cycles = at.join(at.where("not over").select(F.col("to").alias("node")).distinct(), "node", "left_semi").where("not over")
    return at, rounds, scratch.write(cycles.select("node", F.col("low").alias("component")), f"{tag}-cycles")


def components_by_cycle(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Node and component (its smallest member) of the strongly connected components of (source, target) edges.

    Nodes without a way out, or in, are alone. Those with one are drawn together with the node where their path branches, forwards and backwards in turn, so a path or
    cycle of any length takes as many rounds as its length has bits. In what is left, a round spreads the smallest key forwards (the colour), then
    backwards within a colour from the node that gave it: what both reach is a component and leaves. Then nodes that were drawn together get
    the component of their branch if a path comes back to them from it.
    """
    scratch = Scratch(spark, "scc")
    live = scratch.write(edges.where("source <> target").select("source", "target").distinct(), "e0")
    nodes = scratch.write(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct(), "n0")
    alone = lambda df: df.select("node", F.col("node").alias("component"))
    found, drawn, turn, idle = [[]], [], 0, 0
    while not nodes.isEmpty():
        turn += 1
        if idle < 2:
            live = live.select(F.col("target").alias("source"), F.col("source").alias("target"))
            out = scratch.write(nodes.join(live.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("ways"), F.min("target").alias("to")), "node", "left"), f"out{turn}")
            every, few = out.agg(F.count("*"), F.count_if(F.expr("ways is null or ways = 1"))).first()
            if few * 100 < every:
                idle += 1
                continue
            idle = 0
            at, rounds, cycles = forced_paths(scratch, f"path{turn}", out.where("ways = 1").select("node", "to"))
            rest = out.where("ways > 1").select("node")
            held = scratch.write(at.where("over").select("node", "to").join(rest.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to"), f"held{turn}")
            gone = rest.unionByName(held.select("node"))
            if cycles is not None:
                found[-1].append(cycles)
                gone = gone.unionByName(cycles.select("node"))
            found[-1].append(scratch.write(alone(nodes.join(gone, "node", "left_anti")), f"alone{turn}"))
            own = live.join(rest.select(F.col("node").alias("source")), "source", "left_semi")
            into = scratch.write(own.join(held.select(F.col("node").alias("target"), "to"), "target"), f"into{turn}")
            drawn.append((held, rounds, into))
            found.append([])
            straight = own.join(rest.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")
            live = scratch.write(straight.unionByName(into.select("source", F.col("to").alias("target"))).where("source <> target").distinct(), f"e{turn}")
            nodes = scratch.write(rest, f"n{turn}")
            continue
        idle = 0
        colour, k, changed = scratch.write(nodes.select("node", F.col("node").alias("colour")), f"c{turn}-0"), 0, True
        while changed:
            k += 1
            sent = live.join(colour.select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("got"))
            new = colour.join(sent, "node", "left").select("node", F.least("colour", "got").alias("colour"), (F.col("got") < F.col("colour")).alias("moved"))
            after = scratch.write(new, f"c{turn}-{k}")
            changed = not after.where("moved").isEmpty()
            colour = after.select("node", "colour")
        same = live.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target").where("a = b").select("source", "target")
        same = scratch.write(same, f"same{turn}")
        start = colour.where("node = colour").select(F.col("node").alias("id"), F.lit(0).alias("hop"), "colour")

        def back(frontier, reached, hop, same=same):
            met = same.join(frontier.select(F.col("id").alias("target"), "colour"), "target").select(F.col("source").alias("id"), "colour").distinct()
            return met.join(reached.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "colour")

        done = frontier_loop(scratch, start, back, None, f"back{turn}").select(F.col("id").alias("node"), F.col("colour").alias("component"))
        found[-1].append(done)
        nodes = scratch.write(nodes.join(done, "node", "left_anti"), f"n{turn}")
        live = scratch.write(live.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi"), f"e{turn}")
    of = alone(nodes)
    for level in range(len(found) - 1, -1, -1):
        if level < len(drawn) and not drawn[level][2].isEmpty():
            held, rounds, into = drawn[level]
            a, b = of.select(F.col("node").alias("source"), F.col("component").alias("a")), of.select(F.col("node").alias("to"), F.col("component").alias("b"))
            back_ = scratch.write(into.join(a, "source").join(b, "to").where("a = b").select(F.col("target").alias("node")).distinct(), f"back{level}-0")
            for k, jump in enumerate(rounds):
                back_ = scratch.write(back_.unionByName(jump.where("not over").join(back_, "node", "left_semi").select(F.col("to").alias("node"))).distinct(), f"back{level}-{k + 1}")
            mine = held.join(back_, "node", "left_semi").join(b, "to").select("node", F.col("b").alias("component"))
            of = of.unionByName(mine).unionByName(alone(held.join(back_, "node", "left_anti")))
        elif level < len(drawn):
            of = of.unionByName(alone(drawn[level][0]))
        for x in found[level]:
            of = of.unionByName(x)
        of = scratch.write(of, f"of{level}")
    least = of.groupBy("component").agg(F.min("node").alias("least"))
    return of.join(least, "component").select("node", F.col("least").alias("component"))


def call_levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Node, component and level: callees before callers, each level after all that it calls has ended."""
    scratch = Scratch(spark, "levels")
    of = scratch.write(components_by_cycle(spark, edges), "scc")
    a, b = of.select(F.col("node").alias("source"), F.col("component").alias("a")), of.select(F.col("node").alias("target"), F.col("component").alias("b"))
    dag = scratch.write(edges.select("source", "target").join(a, "source").join(b, "target").where("a <> b").select("a", "b").distinct(), "dag")
    level = scratch.write(of.select(F.col("component").alias("c"), F.lit(0).alias("level")).distinct(), "l0")
    frontier, hop = level, 0
    while not frontier.isEmpty():
        hop += 1
        moved = dag.join(frontier.select(F.col("c").alias("b")), "b").select(F.col("a").alias("c")).distinct()
        frontier = scratch.write(moved, f"f{hop}")
        level = scratch.write(level.join(frontier.withColumn("_up", F.lit(hop)), "c", "left").select("c", F.coalesce("_up", "level").alias("level")), f"l{hop}")
        scratch.drop(f"l{hop - 1}")
    return of.join(level.withColumnRenamed("c", "component"), "component").select("node", "component", "level")


def minimap(file_edges: DataFrame, modules: int = 14, imports: int = 4) -> DataFrame:
    """The ``modules`` files that most import edges lead to: path, fan_in (edges), fan_out (distinct files) and their first imports.

    The edges are read once: the number of each pair is written, and all three come from that.
    """
    counted = Scratch(file_edges.sparkSession, "minimap").write(file_edges.groupBy("source", "target").agg(F.count("*").alias("n")), "pairs")
    into = counted.groupBy(F.col("target").alias("path")).agg(F.sum("n").alias("fan_in"))
    out = counted.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("fan_out"))
    both = into.join(out, "path", "full").select("path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    top = both.orderBy(F.desc("fan_in"), F.desc("fan_out"), "path").limit(modules)
    pairs = counted.withColumnRenamed("source", "path").join(F.broadcast(top.select("path")), "path")
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "target"))).where(F.col("_r") <= imports)
    lists = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "target"))), lambda x: x["target"]).alias("first_imports"))
    return top.join(lists, "path", "left").withColumn("first_imports", F.coalesce("first_imports", F.array().cast("array<string>")))


def visible(nodes: DataFrame, communities=None, active_only: bool = False, search: str | None = None) -> DataFrame:
    """Nodes of the enabled communities, active ones if asked for, whose label holds a text."""
    keep: Column = F.lit(True)
    if communities is not None:
        keep &= F.col("community").isin(list(communities))
    if active_only:
        keep &= F.col("active")
    if search:
        keep &= F.lower("label").contains(search.lower())
    return nodes.where(keep)
