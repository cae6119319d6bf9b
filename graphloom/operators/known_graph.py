"""Queries on the known graph: canonical symbols, targets, typed relations, facts, cards, role walks, entry points, impact (G4, G6-G8, G10, G11, G13, J6, P8-P10, A-7, A-9, A-10)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import DEPTHS, RELATIONS, canonical_key, constructor_end, normal_path, test_file
from graphloom.functions.text import estimated_tokens
from graphloom.operators import graph, roles as role_rules
from graphloom.session import Scratch

# Languages whose native calls count, kinds that own members, entry roles, presets of depth, sections of cards.
NATIVE_LANGUAGES = ("js", "ts", "tsx")
CONTAINER_KINDS = ("class", "interface", "enum", "struct", "trait", "object", "protocol", "record")
ENTRY_ROLES, CONTROLLER, ENTRY_LAYER = ("entrypoint", "cli-command", "mcp-tool"), "controller", "entrypoint"
PRESETS = ("compact", "extended", "deep")
LEVELS = {"compact": (2000, ("essentials",)), "extended": (5000, ("essentials", "context")), "deep": (10_000, ("essentials", "context", "evidence"))}
BARE_FILES = ("Dockerfile", "Makefile", "README.md", "README.txt", "package.json", "tsconfig.json", "jsconfig.json", ".gitignore", ".npmrc", ".env")
BARE_FILE = re.compile("(?:" + "|".join(map(re.escape, BARE_FILES)) + r"|\.env\.[A-Za-z0-9_-]+)", re.I)


def file_key(path) -> Column:
    return F.concat(F.lit("file|"), path)


@dataclass
class KnownGraph:
    """The tables that queries read.

    ``symbols``: symbol_key, node_id, path, kind, scope, name, node_kind, container (or null) of the canonical symbols; ``nodes``: id and what else
    nodes have; ``calls`` and ``legacy``: edges (source, target, relation) between node ids, calls with the native override; ``native``: calls between
    symbol keys without constructors; ``imports``: source and target path of file imports; ``bindings``: path and target symbol_key; ``roles``: id (a
    symbol or file key), role, layer as assigned; ``groups``: every canonical key with its nodes, ambiguous ones too.
    """

    symbols: DataFrame
    nodes: DataFrame
    walk: DataFrame
    native: DataFrame
    imports: DataFrame
    bindings: DataFrame
    roles: DataFrame
    groups: DataFrame
    files: DataFrame


def canonical_groups(nodes: DataFrame) -> DataFrame:
    """symbol_key, node_id, kind, node_kind of the nodes whose identities (symbol_key, meta_key, and the id where it has a ``|``) agree on a
    canonical key, and whose source file and kind, where there, are the key's. A C# key's container is a part of its name here."""
    own = F.filter(F.array("symbol_key", "meta_key", F.when(F.col("id").contains("|"), F.col("id"))), lambda x: x.isNotNull())
    rows = nodes.select(F.col("id").alias("node_id"), "kind", "node_kind", "source_file", own.alias("_own")).where(F.size(F.array_distinct("_own")) == 1)
    rows = rows.withColumn("symbol_key", F.element_at("_own", 1)).withColumn("_p", F.split("symbol_key", r"\|"))
    part = lambda k: F.try_element_at(F.col("_p"), F.lit(k))
    sharp, holder = F.size("_p") == 7, part(4)
    member = sharp & ~holder.isin("", "none")
    kind, scope = F.when(sharp, part(5)).otherwise(part(3)), F.when(member, "member").when(sharp, "exported").otherwise(part(4))
    name = F.when(member, F.concat_ws(".", holder, part(6))).when(sharp, part(6)).otherwise(part(5))
    good = canonical_key("symbol_key") & (F.col("source_file").isNull() | (normal_path("source_file") == normal_path(part(2)))) & (F.col("kind").isNull() | (F.col("kind") == kind))
    return rows.where(good).select("symbol_key", "node_id", part(2).alias("path"), kind.alias("kind"), scope.alias("scope"), name.alias("name"), "node_kind")


def canonical_symbols(groups: DataFrame, index: DataFrame) -> DataFrame:
    """The keys that exactly one node has, but those that the index gives to another node; with the container that a member's name proves."""
    one = groups.groupBy("symbol_key").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("node_id", "path", "kind", "scope", "name", "node_kind")]).where("_n = 1").drop("_n")
    bound = index.where("graph_node_id is not null").select("symbol_key", F.col("graph_node_id").alias("_bound"))
    kept = one.join(bound, "symbol_key", "left").where("_bound is null or _bound = node_id").drop("_bound")
    dotted = (F.col("scope") == "member") & F.col("name").rlike(r"^.+\.")
    return kept.withColumn("container", F.when(dotted, F.regexp_replace("name", r"\.[^.]*$", "")))


def known_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, native: DataFrame, bindings: DataFrame, roles: DataFrame, index: DataFrame) -> KnownGraph:
    """The known graph of nodes (id, label, kind, node_kind, source_file, symbol_key, meta_key), edges between their ids, native edges between keys
    (``file|path`` for files), bindings (source_id, target), roles (id, role, layer) and index (symbol_key, graph_node_id). Small derived tables are
    written once."""
    scratch = Scratch(spark, "known")
    groups = scratch.write(canonical_groups(nodes), "groups")
    symbols = scratch.write(canonical_symbols(groups, index), "symbols")
    at = symbols.select("symbol_key", "node_id", F.split("symbol_key", r"\|")[0].isin(*NATIVE_LANGUAGES).alias("_native"))
    calls = native.where("relation = 'calls'")
    a, b = at.where("_native").select(F.col("symbol_key").alias("source"), F.col("node_id").alias("_a")), at.where("_native").select(F.col("symbol_key").alias("target"), F.col("node_id").alias("_b"))
    mapped = calls.join(a, "source").join(b, "target").select(F.col("_a"), F.col("_b"), (constructor_end("source") | constructor_end("target")).alias("_new"))
    mapped = scratch.write(mapped.distinct(), "native-calls")
    owners = mapped.select(F.col("_a").alias("source")).distinct()
    plain = edges.where("relation <> 'calls'").select("source", "target", "relation").unionByName(edges.where("relation = 'calls'").join(owners, "source", "left_anti").select("source", "target", "relation"))
    walk = plain.unionByName(mapped.where("not _new").select(F.col("_a").alias("source"), F.col("_b").alias("target"), F.lit("calls").alias("relation"))).distinct()
    walk = scratch.write(walk, "walk")
    path = lambda c: F.substring(c, 6, 1 << 30)
    files = native.where("relation = 'imports' and source like 'file|%' and target like 'file|%'").select(path("source").alias("source"), path("target").alias("target")).distinct()
    files = scratch.write(files, "imports")
    bound = bindings.where("source_id like 'file|%' and target is not null").select(path("source_id").alias("path"), F.col("target").alias("symbol_key")).distinct()
    bound = scratch.write(bound.join(symbols.select("symbol_key"), "symbol_key", "left_semi"), "bindings")
    known = nodes.where("node_kind = 'file' and source_file is not null").select(normal_path("source_file").alias("path")).unionByName(nodes.where("source_file is not null").select(normal_path("source_file").alias("path"))).unionByName(files.select(F.col("source").alias("path"))).unionByName(files.select(F.col("target").alias("path"))).distinct()
    direct = calls.where(~constructor_end("source") & ~constructor_end("target")).select("source", "target").distinct()
    return KnownGraph(symbols, nodes, walk, direct, files, bound, roles, groups, scratch.write(known, "files"))


# ── targets ────────────────────────────────────────────────────────────────


def looks_like_path(target: str) -> bool:
    """A drive, a share, a relative step, a bare file name, or slashes with a file's name at the end or without white space."""
    last = re.split(r"[\\/]", target)[-1]
    fileish = bool(BARE_FILE.fullmatch(last) or re.search(r"\.[a-zA-Z0-9]{2,6}$", last))
    return bool(re.match(r"[A-Za-z]:[\\/]|[\\/]{2}|\.{1,2}[\\/]|\.{1,2}$", target) or re.search(r"[\\/]", target) and (not re.search(r"\s", target) or fileish) or BARE_FILE.fullmatch(target))


def named(name: str) -> Column:
    return (F.col("name") == name) | F.col("name").endswith(f".{name}")


def resolve(g: KnownGraph, target: str) -> tuple[str, str, str | None, list[tuple[str, str]]]:
    """(status, mode, key or path, candidates as (symbol_key, node_id)): status resolved, ambiguous or missing; mode symbol or file.

    A symbol is told by its key, its node's id, ``path#name`` or its name or last part of it; a name of which a key has several nodes is ambiguous. Each
    lookup is a filter of the symbols; only the candidates come to the driver.
    """
    if not isinstance(target, str) or not target.strip():
        raise TypeError("target must be a text that is not empty")
    own = g.symbols.where((F.col("symbol_key") == target) | (F.col("node_id") == target)).select("symbol_key").limit(2).collect()
    if len(own) == 1:
        return "resolved", "symbol", own[0].symbol_key, []
    path, _, name = target.rpartition("#") if "#" in target else ("", "", target)
    fits = named(name) if name else F.lit(False)
    if path:
        fits &= F.col("path") == path.replace("\\", "/")
    match = (F.col("symbol_key") == target) | (F.col("node_id") == target) | fits
    several = g.groups.where(match).join(g.groups.groupBy("symbol_key").agg(F.count("*").alias("_n")), "symbol_key")
    rows = sorted((r.symbol_key, r.node_id, r._n) for r in several.select("symbol_key", "node_id", "_n").collect())
    if any(n > 1 for *_, n in rows):
        return "ambiguous", "symbol", None, [(k, i) for k, i, n in rows if n > 1]
    file = target[5:] if target.startswith("file|") else target
    if target.startswith("file|") or "|" not in target and "#" not in target and (looks_like_path(target) or not g.symbols.where(F.col("path") == target.replace("\\", "/")).isEmpty()):
        file = re.sub(r"^(\./)+", "", file.replace("\\", "/"))
        return ("missing", "file", None, []) if g.files.where(F.col("path") == file).isEmpty() else ("resolved", "file", file, [])
    found = sorted((r.symbol_key, r.node_id) for r in g.symbols.where(fits).select("symbol_key", "node_id").collect())
    if len(found) == 1:
        return "resolved", "symbol", found[0][0], []
    return ("ambiguous", "symbol", None, found) if found else ("missing", "symbol", None, [])


def resolved(g: KnownGraph, target: str) -> tuple[str, str]:
    """(mode, key or path) of a target that is one symbol or file; else a LookupError that says why."""
    status, mode, found, candidates = resolve(g, target)
    if status != "resolved":
        raise LookupError(f"{status} target: {target!r}, {len(candidates)} candidates")
    return mode, found


# ── edges between keys ─────────────────────────────────────────────────────


def keyed(g: KnownGraph, edges: DataFrame) -> DataFrame:
    """Edges between node ids as edges between symbol keys; those with an end that is no canonical symbol are left out."""
    a, b = g.symbols.select(F.col("node_id").alias("source"), F.col("symbol_key").alias("_a")), g.symbols.select(F.col("node_id").alias("target"), F.col("symbol_key").alias("_b"))
    return edges.join(a, "source").join(b, "target").select(F.col("_a").alias("source"), F.col("_b").alias("target"), "relation").distinct()


def import_lift(g: KnownGraph, incoming: bool) -> DataFrame:
    """source and target symbol of the imports that bindings prove: from a file's symbols, seen from outside its exported ones, to what the file binds."""
    own = g.symbols.where("scope = 'exported'") if incoming else g.symbols
    return own.select("path", F.col("symbol_key").alias("source")).join(g.bindings.withColumnRenamed("symbol_key", "target"), "path").select("source", "target").distinct()


def checked(direction: str, relations, depth: int) -> bool:
    if direction not in ("in", "out", "inbound", "outbound"):
        raise TypeError("direction must be in, out, inbound or outbound")
    if isinstance(depth, bool) or not isinstance(depth, int) or not 1 <= depth <= 3:
        raise TypeError("depth must be 1, 2 or 3")
    if any(r not in RELATIONS for r in relations):
        raise TypeError("unsupported relation")
    return direction in ("in", "inbound")


def hop_edges(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int, incoming: bool) -> DataFrame:
    """Edges (source, target) of up to ``depth`` hops from ``seeds`` (id)."""
    return graph.reachable_edges(spark, edges.withColumn("relation", F.lit("imports")), seeds, depth, "in" if incoming else "out").select("source", "target")


def relations(spark: SparkSession, g: KnownGraph, target: str, direction: str = "out", relations=("calls", "imports"), depth: int = 1) -> DataFrame:
    """Source, target, relation and scope of a symbol's or file's typed relations of up to ``depth`` hops.

    Calls are native where their source has native calls. A symbol's imports are also those that bindings prove (scope ``file``); a file's
    imports are those between files, its other relations those of its symbols.
    """
    incoming = checked(direction, relations, depth)
    mode, found = resolved(g, target)
    plain = [r for r in relations if mode == "symbol" or r != "imports"]
    own = g.symbols.where(F.col("symbol_key") == found) if mode == "symbol" else g.symbols.where(F.col("path") == found)
    out = g.symbols.select(F.col("symbol_key").alias("source"), F.col("symbol_key").alias("target"), F.lit("").alias("relation"), F.lit(None).cast("string").alias("scope")).limit(0)
    if plain:
        walked = graph.reachable_edges(spark, g.walk.where(F.col("relation").isin(*plain)), own.select(F.col("node_id").alias("id")), depth, "in" if incoming else "out")
        out = out.unionByName(keyed(g, walked).withColumn("scope", F.lit(None).cast("string")))
    if "imports" in relations and mode == "symbol":
        lifted = hop_edges(spark, import_lift(g, incoming), own.select(F.col("symbol_key").alias("id")), depth, incoming)
        out = out.join(lifted, ["source", "target"], "left_anti").unionByName(out.join(lifted, ["source", "target"], "left_semi").where("relation <> 'imports'")).unionByName(lifted.select("source", "target", F.lit("imports").alias("relation"), F.lit("file").alias("scope")))
    if "imports" in relations and mode == "file":
        between = hop_edges(spark, g.imports, graph.ids_frame(spark, [found]), depth, incoming)
        out = out.unionByName(between.select(file_key("source").alias("source"), file_key("target").alias("target"), F.lit("imports").alias("relation"), F.lit(None).cast("string").alias("scope")))
    return out


def symbol_context(spark: SparkSession, g: KnownGraph, key: str, depth: str = "compact", relations=RELATIONS) -> DataFrame:
    """Neighbours of a symbol over outbound relations: node_id and symbol_key (null for nodes that are no canonical symbols); unknown keys give nothing."""
    seeds = g.symbols.where(F.col("symbol_key") == key).select(F.col("node_id").alias("id"))
    walked = graph.reachable_edges(spark, g.walk.where(F.col("relation").isin(*relations)), seeds, DEPTHS[depth][0], "out")
    near = walked.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().join(seeds.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    return near.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(g.symbols.select("node_id", "symbol_key"), "node_id", "left")


def impact_scope(spark: SparkSession, g: KnownGraph, keys, depth: str = "compact", relations=RELATIONS) -> DataFrame:
    """node_id and hop of what reaches the symbols, with the native override; the symbols themselves are left out."""
    seeds = g.symbols.where(F.col("symbol_key").isin(list(keys))).select(F.col("node_id").alias("id"))
    found = graph.reached(spark, g.walk.where(F.col("relation").isin(*relations)), seeds, "in", rounds=DEPTHS[depth][0])
    return found.where("distance > 0").join(g.nodes.select("id"), "id", "left_semi").select(F.col("id").alias("node_id"), F.col("distance").alias("hop"))


# ── facts and cards ────────────────────────────────────────────────────────


def facts(spark: SparkSession, g: KnownGraph, target: str, depth: int = 1) -> DataFrame:
    """Fact (callers, callees, imports, imported_by, tests) and item, a symbol key or for files a path.

    Callers and callees come from native calls up to ``depth`` hops. A symbol's imports are its file's proven bindings; importing files count by
    their exported symbols, those in test files are tests.
    """
    if isinstance(depth, bool) or not isinstance(depth, int) or depth < 1:
        raise TypeError("depth must be a positive number")
    mode, found = ("file", target[5:]) if target.startswith("file|") else ("symbol", target)
    path = found if mode == "file" else found.split("|")[1]
    into = g.imports.where(F.col("target") == path).select(F.col("source").alias("path"))
    if mode == "file":
        rows = g.imports.where(F.col("source") == path).select(F.lit("imports").alias("fact"), F.col("target").alias("item"))
        rows = rows.unionByName(into.select(F.lit("imported_by").alias("fact"), F.col("path").alias("item")))
        return rows.unionByName(into.where(test_file("path")).select(F.lit("tests").alias("fact"), F.col("path").alias("item")))
    calls = g.native.withColumn("relation", F.lit("calls"))
    rows = None
    for fact, direction in (("callers", "in"), ("callees", "out")):
        part = graph.reached(spark, calls, [found], direction, rounds=depth).where("distance > 0").select(F.lit(fact).alias("fact"), F.col("id").alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(g.bindings.where(F.col("path") == path).select(F.lit("imports").alias("fact"), F.col("symbol_key").alias("item")))
    exported = g.symbols.where("scope = 'exported' and node_kind = 'symbol'").join(into, "path").select("path", F.col("symbol_key").alias("item"))
    rows = rows.unionByName(exported.select(F.lit("imported_by").alias("fact"), "item"))
    return rows.unionByName(exported.where(test_file("path")).select(F.lit("tests").alias("fact"), "item"))


def fans(rows: DataFrame) -> DataFrame:
    """fan_in (callers and importers) and fan_out (callees and imports) of ``facts``."""
    return rows.agg(F.count_if(F.col("fact").isin("callers", "imported_by")).alias("fan_in"), F.count_if(F.col("fact").isin("callees", "imports")).alias("fan_out"))


def file_card(g: KnownGraph, path: str) -> DataFrame:
    """A-7: fact (exports, members, imports, imported_by) and item of a file; keys that several nodes have are left out."""
    own = g.symbols.where((F.col("path") == path) & F.col("node_kind").isin("symbol", "member"))
    rows = own.where("scope = 'exported'").select(F.lit("exports").alias("fact"), F.col("symbol_key").alias("item")).unionByName(own.where("node_kind = 'member'").select(F.lit("members").alias("fact"), F.col("symbol_key").alias("item")))
    rows = rows.unionByName(g.imports.where(F.col("source") == path).select(F.lit("imports").alias("fact"), F.col("target").alias("item")))
    return rows.unionByName(g.imports.where(F.col("target") == path).select(F.lit("imported_by").alias("fact"), F.col("source").alias("item")))


def card(spark: SparkSession, g: KnownGraph, target: str, level: str | None = None, summary: str = "", evidence=()) -> DataFrame:
    """One row: target, sections (a map of names to texts), tokens and the sections that were left out for the level's limit of tokens.

    Essentials always stay; evidence goes first, then context.
    """
    if level is not None and level not in LEVELS:
        raise TypeError(f"unknown level: {level}")
    mode, found = resolved(g, target)
    own = facts(spark, g, found) if mode == "symbol" else file_card(g, found)
    lines = own.groupBy("fact").agg(F.array_join(F.array_sort(F.collect_set("item")), ", ").alias("items"))
    one = lines.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "fact", "items"))), "\n").alias("context"), F.count("*").alias("_n"))
    sections = {"essentials": F.concat_ws("\n", F.lit(found), F.lit(summary)), "context": F.col("context"), "evidence": F.lit("\n".join(evidence))}
    limit, names = LEVELS[level or "deep"]
    total, texts, cut = F.lit(0).cast("long"), [], []
    for name in names:  # a section stays if it and all before it fit
        total = total + estimated_tokens(sections[name])
        keep = F.lit(True) if name == "essentials" or level is None else total <= limit
        texts.append(F.when(keep, F.struct(F.lit(name).alias("key"), sections[name].alias("value"))))
        cut.append(F.when(~keep, F.lit(name)))
    kept = F.array_compact(F.array(*texts))
    tokens = F.aggregate(kept, F.lit(0).cast("long"), lambda n, x: n + estimated_tokens(x["value"]))
    return one.select(F.lit(found).alias("target"), F.map_from_entries(kept).alias("sections"), tokens.alias("tokens"), F.array_compact(F.array(*cut)).alias("omitted"))


# ── roles ──────────────────────────────────────────────────────────────────


def owners(g: KnownGraph) -> DataFrame:
    """member and owner: the one container of its file that a member's name proves."""
    members = g.symbols.where("container is not null").select(F.col("symbol_key").alias("id"), "path", F.col("container").alias("container_name"))
    heads = g.symbols.where((F.col("scope") != "member") & F.col("kind").isin(*CONTAINER_KINDS)).select(F.col("symbol_key").alias("id"), "path", "name")
    return role_rules.ownership(members, heads).select("member", F.col("container").alias("owner"))


def effective_roles(g: KnownGraph) -> DataFrame:
    """id, role and layer: assigned ones (of symbols and files), else for members the owner's; an assigned null is no role."""
    known = g.symbols.select(F.col("symbol_key").alias("id"))
    own = g.roles.select("id", "role", F.when(F.col("layer") != "", F.col("layer")).alias("layer"))
    mine = own.join(known, "id", "left_semi").unionByName(own.where("id like 'file|%'"))
    bare = g.symbols.where(F.col("node_kind").isin("symbol", "member")).select(F.col("symbol_key").alias("member")).join(own.select(F.col("id").alias("member")), "member", "left_anti")
    inherited = owners(g).join(bare, "member").join(own.withColumnRenamed("id", "owner"), "owner").select(F.col("member").alias("id"), "role", "layer")
    return mine.unionByName(inherited).where("role is not null and role <> ''")


def seeds_of(g: KnownGraph, mode: str, found: str) -> DataFrame:
    """id and path: the start itself and, for a file or a container, its symbols or members below it."""
    start = found if mode == "symbol" else f"file|{found}"
    if mode == "file":
        inner = g.symbols.where(F.col("path") == found).select(F.col("symbol_key").alias("id"))
    else:
        inner = owners(g).where(F.col("owner") == found).select(F.col("member").alias("id"))
    one = g.symbols.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    return one.unionByName(inner.where(F.col("id") != start).select("id", F.array(F.lit(start), F.col("id")).alias("path")))


def stop_at_role(spark: SparkSession, g: KnownGraph, target: str, role: str, direction: str = "out", relations=("calls", "imports"), depth: int = 1) -> DataFrame:
    """Id, role, distance and path of the nodes with a role where walks of up to ``depth`` hops from a target end.

    A container or file begins at its members too, at distance 0. Nodes with the role are not left. Unless the target is a member, a match is
    given as its owner where that has the role too and is not the target. Names that neither a packaged profile nor an assignment has are an error.
    """
    incoming = checked(direction, relations, depth)
    vocabulary = {r for name in ("generic", *role_rules.OVERRIDES) for r in role_rules.load_profile(name)["layers"]}
    graph.known_role(g.roles, role, vocabulary)
    mode, found = resolved(g, target)
    at = effective_roles(g).where(F.col("role") == role).select("id", "role")
    at = Scratch(spark, "stop").write(at, "at")
    start = seeds_of(g, mode, found)
    if not at.where(F.col("id") == (found if mode == "symbol" else f"file|{found}")).isEmpty():
        start = start.where(F.size("path") == 1)
        walked = start.withColumn("distance", F.lit(0))
    else:
        plain = [r for r in relations if mode == "symbol" or r != "imports"]
        edges = keyed(g, g.walk.where(F.col("relation").isin(*plain))) if plain else None
        if "imports" in relations:
            lift = import_lift(g, incoming) if mode == "symbol" else g.imports.select(file_key("source").alias("source"), file_key("target").alias("target"))
            lift = lift.withColumn("relation", F.lit("imports"))
            edges = lift if edges is None else edges.unionByName(lift).distinct()
        walked = graph.closure(spark, edges, start, "in" if incoming else "out", at, depth, asked=at)
    hits = walked.join(at, "id")
    member = mode == "symbol" and found.split("|")[3] == "member"
    if not member:
        own = owners(g).join(at.select(F.col("id").alias("owner")), "owner", "left_semi").where(F.col("owner") != found).select(F.col("member").alias("id"), "owner")
        hits = hits.join(own, "id", "left").withColumn("path", F.when(F.col("owner").isNull(), F.col("path")).otherwise(F.concat("path", F.array("owner")))).withColumn("id", F.coalesce("owner", "id"))
    first = hits.groupBy("id", "role").agg(F.min(F.struct("distance", "path")).alias("x"))
    return first.select("id", "role", "x.distance", "x.path")


def entrypoints(spark: SparkSession, g: KnownGraph, target: str) -> DataFrame:
    """Id, role, layer, entry, distance and path of the entry points and controllers from which calls reach a target, from the complete reverse closure."""
    mode, found = resolved(g, target)
    calls = keyed(g, g.walk.where("relation = 'calls'"))
    entry = F.coalesce(F.col("role").isin(*ENTRY_ROLES) | (F.col("layer") == ENTRY_LAYER), F.lit(False))
    entries = Scratch(spark, "entries").write(effective_roles(g).withColumn("entry", entry).where(F.col("entry") | (F.col("role") == CONTROLLER)), "at")
    return graph.closure(spark, calls, seeds_of(g, mode, found), "in", asked=entries).join(entries, "id").select("id", "role", "layer", "entry", "distance", "path")


# ── impact ─────────────────────────────────────────────────────────────────


def ranking_graph(g: KnownGraph) -> tuple[DataFrame, DataFrame]:
    """(ids of all canonical symbols and known files, distinct pairs of calls and of file imports)."""
    ids = g.symbols.select(F.col("symbol_key").alias("id")).unionByName(g.symbols.select(file_key("path").alias("id"))).unionByName(g.files.select(file_key("path").alias("id"))).distinct()
    pairs = keyed(g, g.walk.where("relation = 'calls'")).select("source", "target").unionByName(g.imports.select(file_key("source").alias("source"), file_key("target").alias("target"))).distinct()
    return ids, pairs


def impact(spark: SparkSession, g: KnownGraph, target: str, rounds: int = 100) -> tuple[DataFrame, DataFrame, int, bool]:
    """G11, A-11: (records, roles, rounds, converged).

    Records have symbol_key, distance, path, is_test, role, layer and rank: all that reaches the target or its members by calls, file imports or proven
    bindings, and the tests among its importers (distance null where nothing else leads there). Ranks are those of the whole
    known graph, without the bindings, whatever the target. Roles sum the ranks of each role's records; the layer only if all have the same one.
    """
    scratch = Scratch(spark, "impact")
    mode, found = resolved(g, target)
    ids, pairs = ranking_graph(g)
    pairs = scratch.write(pairs, "pairs")
    ranks, took, converged = graph.pagerank(spark, ids, pairs, most=rounds)
    walk = pairs.unionByName(import_lift(g, True)).withColumn("relation", F.lit("calls"))
    reached = graph.closure(spark, walk, seeds_of(g, mode, found), "in").where("distance > 0").select(F.col("id").alias("symbol_key"), "distance", "path")
    tests = facts(spark, g, found if mode == "symbol" else f"file|{found}").where("fact = 'tests'").select((F.col("item") if mode == "symbol" else file_key("item")).alias("symbol_key"), F.lit(True).alias("is_test")).distinct()
    rows = reached.join(tests, "symbol_key", "full").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
    rows = rows.join(effective_roles(g).withColumnRenamed("id", "symbol_key"), "symbol_key", "left").join(ranks.withColumnRenamed("id", "symbol_key"), "symbol_key", "left")
    rows = scratch.write(rows, "records")
    return rows, graph.impact_roles(rows.select(F.col("symbol_key").alias("id"), "rank"), effective_roles(g)), took, converged
