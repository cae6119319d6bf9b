"""Role classification by weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import heritage_base, normal_path
from graphloom.functions.text import round4

# The eight signals, strongest first, and the packaged profiles: layers of roles, weights of signals and rules by signal.
SIGNALS = ("annotation", "heritage", "container", "suffix", "decorator", "directory", "topology", "side_effect")
GENERIC = {
    "layers": {
        "entrypoint": "entrypoint", "cli": "entrypoint", "cli-command": "entrypoint", "mcp-tool": "entrypoint", "controller": "presentation", "view": "presentation", "component": "presentation", "decorator": "presentation", "service": "application", "dto": "application",
        "repository": "data", "store": "data", "model": "domain", "interface": "domain", "client": "infrastructure", "adapter": "infrastructure", "config": "infrastructure", "extractor": "infrastructure", "util": "cross-cutting", "test": "test",
    },
    "weights": {"annotation": 0.9, "heritage": 0.85, "container": 0.75, "suffix": 0.6, "decorator": 0.6, "directory": 0.5, "topology": 0.35, "side_effect": 0.3},
    "decorators": ("Controller", "Service", "Injectable", "Component", "Module", "Entity", "Api", "RestController", "ApiController", "Middleware"),
    "suffix": {"Controller": "controller", "Service": "service", "Repository": "repository", "Store": "store", "Client": "client", "Adapter": "adapter", "Dto": "dto", "View": "view", "Model": "model", "Config": "config"},
    "directory": {
        "controllers": "controller", "services": "service", "repositories": "repository", "repos": "repository", "models": "model", "interfaces": "interface", "views": "view", "utils": "util", "helpers": "util", "cli": "cli", "commands": "cli-command",
        "mcp": "mcp-tool", "components": "component", "adapters": "adapter", "config": "config", "tests": "test", "test": "test", "__tests__": "test",
    },
    "annotation": {"Controller": "controller", "RestController": "controller", "ApiController": "controller", "Injectable": "service", "Service": "service", "Entity": "model", "Component": "component"},
    "heritage": {"ControllerBase": "controller", "RepositoryBase": "repository", "ServiceBase": "service"},
    "thresholds": {"fan_out": 8, "fan_in": 8, "low_fan_in": 2},
    "topology": {"high_out_low_in": "controller", "high_in": "util"},
    "side_effect": {"db-client": "repository", "http": "adapter", "fetch": "adapter", "fs-write": "cli", "child-process": "cli", "process.argv": "cli"},
}
OVERRIDES = {
    "node-cli": {"directory": {"cli": "cli-command", "bin": "cli-command", "commands": "cli-command", "mcp": "mcp-tool", "extractors": "extractor", "extractor": "extractor", "graph-store": "store", "store": "store", "stores": "store"}, "side_effect": {"process.argv": "cli-command", "child-process": "cli-command", "fs-write": "cli-command"}},
    "express": {"directory": {"routes": "controller", "middleware": "adapter"}, "side_effect": {"express-router": "controller"}},
    "nest": {"annotation": {"Module": "config", "Resolver": "controller"}, "suffix": {"Module": "config", "Resolver": "controller"}},
    "spring": {"annotation": {"Repository": "repository", "Configuration": "config", "ControllerAdvice": "controller"}},
    "aspnet": {"heritage": {"DbContext": "store", "BackgroundService": "service"}, "annotation": {"ApiController": "controller"}},
    "django": {"heritage": {"View": "view", "Form": "dto", "Model": "model"}, "directory": {"templates": "view", "migrations": "config"}},
}
#: Rule tables of a profile whose keys are compared without regard to case.
TABLES, FOLDED = ("suffix", "directory", "annotation", "heritage", "side_effect"), ("suffix", "directory", "heritage")
PRIORITY = {name: k for k, name in enumerate(SIGNALS)}


def merged_profiles(base: dict, override: dict) -> dict:
    """Layers, weights and thresholds by name, rules by key; the override wins. Lists of decorators and topology rules are replaced."""
    out = {t: dict(base[t]) | dict(override.get(t, {})) for t in ("layers", "weights", "thresholds")}
    out |= {t: override.get(t, base[t]) for t in ("decorators", "topology")}
    for t in TABLES:
        fold = str.lower if t in FOLDED else str
        rules = {fold(k): (k, role) for k, role in base[t].items()} | {fold(k): (k, role) for k, role in override.get(t, {}).items()}
        out[t] = dict(rules.values())
    return out


def load_profile(name: str = "generic") -> dict:
    """A packaged profile by its name; an unknown name is an error."""
    if name != "generic" and name not in OVERRIDES:
        raise TypeError(f"unknown role profile: {name}")
    return checked_profile(merged_profiles(GENERIC, OVERRIDES.get(name, {})))


def checked_profile(profile: dict) -> dict:
    """Weights are numbers from 0 to 1 for every signal, and every role of a rule has a layer; else a TypeError."""
    for name in SIGNALS:
        w = profile["weights"].get(name)
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not 0 <= w <= 1:
            raise TypeError(f"weight of {name} must be a number from 0 to 1: {w!r}")
    for t in (*TABLES, "topology"):
        for role in profile[t].values():
            if role not in profile["layers"]:
                raise TypeError(f"{t} gives an undeclared role: {role!r}")
    return profile


def lookup(rules: dict, value: Column, fold: bool = False) -> Column:
    """The role that a table of rules gives a value, or null."""
    if not rules:
        return F.lit(None).cast("string")
    pairs = {(k.lower() if fold else k): role for k, role in rules.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.lower(value) if fold else value)


def stereotype(name: Column, rules: dict, exact: bool = False) -> Column:
    """The role of the longest suffix of a name; the name must be longer than the suffix unless ``exact``."""
    low, out = F.lower(name), None
    for suffix, role in sorted(rules.items(), key=lambda r: (-len(r[0]), r[0])):
        hit = low.endswith(suffix.lower()) & ((F.length(low) >= len(suffix)) if exact else (F.length(low) > len(suffix)))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return F.lit(None).cast("string") if out is None else out


def first_role(values: Column, role) -> Column:
    """The first role that the values of an array give."""
    return F.try_element_at(F.array_compact(F.transform(values, role)), F.lit(1))


def signals(symbols: DataFrame, profile: dict | None = None) -> DataFrame:
    """Id, signal, role and weight of all signals but the container's; each gives a symbol one role at most.

    ``symbols`` has id, name and path, and may have kind, scope, annotations, heritage and side_effects (arrays; the first that fits counts),
    fan_in and fan_out. The longest suffix and the deepest folder win. Suffixes say nothing of interfaces and types, nor below a
    folder of tests. Rules are small literals: matching is an expression in the scan, without a join.
    """
    p = checked_profile(profile or load_profile())
    have, found = set(symbols.columns), []
    if "annotations" in have:
        found.append(("annotation", first_role(F.col("annotations"), lambda x: lookup(p["annotation"], F.regexp_replace(x, "^@", "")))))
    if "heritage" in have:
        base = lambda x: F.trim(heritage_base(x))
        found.append(("heritage", first_role(F.col("heritage"), lambda x: F.coalesce(lookup(p["heritage"], base(x), True), stereotype(base(x), p["suffix"], True)))))
    steps = F.filter(F.split(F.lower(normal_path("path")), "/"), lambda x: x != "")
    tests = [t.lower() for t, role in p["directory"].items() if role == "test"]
    plain = ~F.exists(steps, lambda x: x.isin(*tests)) if tests else F.lit(True)
    if "kind" in have:
        plain &= ~F.coalesce(F.col("kind").isin("interface", "type"), F.lit(False))
    found.append(("suffix", F.when(plain, stereotype(F.col("name"), p["suffix"]))))
    if {"kind", "scope"} <= have:
        found.append(("decorator", F.when((F.col("kind") == "function") & (F.col("scope") == "local") & F.col("name").isin(*p["decorators"]), "decorator")))
    found.append(("directory", F.try_element_at(F.array_compact(F.transform(steps, lambda x: lookup(p["directory"], x, True))), F.lit(-1))))
    if {"fan_in", "fan_out"} <= have:
        t = p["thresholds"]
        busy = (F.col("fan_out") >= t["fan_out"]) & (F.col("fan_in") <= t["low_fan_in"])
        found.append(("topology", F.when(F.col("fan_in").isNull() | F.col("fan_out").isNull(), None).when(busy, p["topology"].get("high_out_low_in")).when(F.col("fan_in") >= t["fan_in"], p["topology"].get("high_in"))))
    if "side_effects" in have:
        found.append(("side_effect", first_role(F.col("side_effects"), lambda x: lookup(p["side_effect"], x))))
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), r.cast("string").alias("role"), F.lit(float(p["weights"][s])).alias("weight")) for s, r in found])
    return symbols.select("id", F.explode(rows).alias("x")).select("id", "x.*").where("role is not null")


def scored(rows: DataFrame, layers: dict | None = None) -> DataFrame:
    """The best role of each id: confidence 1 - product(1 - weight) to four places; ties go to the strongest signal, then the name."""
    priority = F.element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("signal"))
    miss = F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(1.0), lambda acc, w: acc * (1 - w))
    evidence = F.transform(F.array_sort(F.collect_set(F.struct(priority.alias("p"), "signal"))), lambda x: x["signal"])
    by = rows.groupBy("id", "role").agg(round4(1 - miss).alias("confidence"), F.min(priority).alias("_p"), evidence.alias("evidence"))
    best = by.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "_p", "role"))).where("_r = 1")
    return best.select("id", "role", lookup(layers or GENERIC["layers"], F.col("role")).alias("layer"), "confidence", "evidence")


def classified(symbols: DataFrame, profile: dict | None = None) -> DataFrame:
    """Roles of symbols, members with their container's role as a signal; without any signal role null and confidence 0.

    ``symbols`` has ``container`` (the id of the one class of its file that it is a member of, or null) besides what ``signals``
    reads. A member whose own annotation outweighs the inherited role is scored by the signals of the annotation's role alone.
    """
    p = checked_profile(profile or load_profile())
    own = signals(symbols, p)
    base = scored(own, p["layers"])
    weight = float(p["weights"]["container"])
    inherited = symbols.where("container is not null").select("id", "container").join(base.select(F.col("id").alias("container"), "role"), "container").select("id", F.lit("container").alias("signal"), "role", F.lit(weight).alias("weight"))
    w = Window.partitionBy("id")
    both = own.unionByName(inherited).withColumn("_c", F.max(F.col("signal") == "container").over(w)).withColumn("_a", F.max(F.when((F.col("signal") == "annotation") & (F.col("weight") > weight), F.col("role"))).over(w))
    found = scored(both.where("not _c or _a is null or role = _a").drop("_c", "_a"), p["layers"])
    return symbols.select("id").join(found, "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def classified_files(files: DataFrame, profile: dict | None = None) -> DataFrame:
    """Roles of files (path, and what ``signals`` may read) by folder and by the name without its extension."""
    name = F.regexp_replace(F.element_at(F.split(normal_path("path"), "/"), -1), r"\.[^.]+$", "")
    rows = files.withColumn("id", F.col("path")).withColumn("name", name).withColumn("container", F.lit(None).cast("string"))
    return classified(rows, profile).withColumnRenamed("id", "path")


def ownership(members: DataFrame, containers: DataFrame) -> DataFrame:
    """Member and container where exactly one container has the member's path and container name."""
    one = containers.groupBy("path", "name").agg(F.count("*").alias("_n"), F.min("id").alias("container")).where("_n = 1").drop("_n")
    return members.select(F.col("id").alias("member"), "path", F.col("container_name").alias("name")).join(one, ["path", "name"]).select("member", "container")


def inherited_roles(nodes: DataFrame, roles: DataFrame, owners: DataFrame) -> DataFrame:
    """An own row counts, even with a null role; only without one the container's role does."""
    own = roles.select("id", F.col("role").alias("_own"), F.lit(True).alias("_has"))
    theirs = owners.select(F.col("member").alias("id"), "container").join(roles.select(F.col("id").alias("container"), F.col("role").alias("_theirs")), "container", "left").drop("container")
    return nodes.join(own, "id", "left").join(theirs, "id", "left").select("id", F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_theirs")).alias("role"))
