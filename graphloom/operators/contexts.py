"""Documents of project context: the nine base documents, entry points, and the refresh of what changed files invalidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import invalidated_kinds
from graphloom.operators import delta

# Title, tags, source files (None: those given; ``{declared}``: the folder of declared documents), mode and confidence of the documents by kind;
# texts where nothing is known.
DOCUMENTS = {
    "stack-runtime": ("Project stack and runtime", ("stack",), ("package.json", "tsconfig.json"), "detected", "high"),
    "dependencies-summary": ("Dependency summary", ("dependencies",), ("package.json",), "detected", "high"),
    "integrations-summary": ("Integration summary", ("integrations",), ("src",), "detected", "medium"),
    "architecture-current": ("Current architecture", ("architecture", "current-state"), None, "detected", "medium"),
    "architecture-target": ("Target architecture", ("architecture", "target-state"), ("{declared}/architecture-target.json",), "declared", "high"),
    "structure-summary": ("Project structure summary", ("structure",), None, "detected", "high"),
    "technical-rules": ("Technical rules", ("rules",), ("README.md",), "merged", "medium"),
    "project-requirements": ("Project requirements", ("requirements",), ("{declared}/project-requirements.json",), "declared", "high"),
    "known-issues-and-fixes": ("Known issues and fixes", ("issues",), ("{declared}/known-issues-and-fixes.json",), "declared", "high"),
}
NO_VALUES, NO_TARGET, NO_REQUIREMENTS, NO_ISSUES = "Not detected", "No target architecture declared.", "- No declared requirements.", "- No known issues recorded."
ENTRY_POINT = r"(?:^|/)(?:main|app)\.[cm]?[jt]sx?$"
TRACKED = ("package.json", "README.md", "AGENTS.md")

FACTS = """project string, languages array<string>, runtimes array<string>, frameworks array<string>, package_managers array<string>, critical array<string>, testing array<string>, services array<string>, pattern string, entry_points array<string>,
graph_refs array<string>, target string, root_directories array<string>, key_subtrees array<string>, entry_files array<string>, declared_rules array<string>, found_rules array<string>, requirements array<string>, issues array<struct<symptom:string,workaround:string>>"""


def values(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


def joined(name: str, none: str | None = None) -> Column:
    text = F.array_join(values(name), ", ")
    return text if none is None else F.when(F.size(values(name)) > 0, text).otherwise(none)


def listed(*pairs: tuple[str, str]) -> Column:
    """One line for each label: its values, or that there are none."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), joined(name, NO_VALUES)) for label, name in pairs])


def bullets(items: Column, none: str = "") -> Column:
    text = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(text == "", none).otherwise(text)


def base_documents(facts: DataFrame, declared: str = ".planning/project-context/declared") -> DataFrame:
    """Project, kind, title, summary, body, tags, source_files, mode, confidence and content_hash of the nine documents of each project (FACTS).

    ``declared`` is where the project keeps its declared documents. The hash is sha-256 of the JSON of all that the document holds, so it changes with its content only. Null lists are empty ones.
    """
    words = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rules = F.concat(values("declared_rules"), values("found_rules"))
    target = F.when(F.coalesce("target", F.lit("")) != "", F.col("target")).otherwise(NO_TARGET)
    issues = F.coalesce("issues", F.array().cast("array<struct<symptom:string,workaround:string>>"))
    told = F.transform(issues, lambda x: F.concat(F.lit("Symptom: "), x["symptom"], F.lit("; Workaround: "), x["workaround"]))
    texts = {
        "stack-runtime": (words("Languages: ", joined("languages"), ". Frameworks: ", joined("frameworks"), "."), listed(("Languages", "languages"), ("Runtimes", "runtimes"), ("Frameworks", "frameworks"), ("Package managers", "package_managers"))),
        "dependencies-summary": (words("Critical dependencies: ", joined("critical", "none"), "."), listed(("Critical", "critical"), ("Testing", "testing"))),
        "integrations-summary": (words("Detected services: ", joined("services", "none"), "."), listed(("Services", "services"))),
        "architecture-current": (words("Pattern: ", F.col("pattern"), ". Entry points: ", joined("entry_points", "none"), "."), words("- Pattern: ", F.col("pattern"), "\n", listed(("Entry points", "entry_points")))),
        "architecture-target": (target, target),
        "structure-summary": (words("Root directories: ", joined("root_directories", "none"), "."), listed(("Root directories", "root_directories"), ("Key subtrees", "key_subtrees"), ("Entry points", "entry_files"))),
        "technical-rules": (F.array_join(F.slice(rules, 1, 2), " "), bullets(rules)),
        "project-requirements": (F.array_join(F.slice(values("requirements"), 1, 2), " "), bullets(values("requirements"), NO_REQUIREMENTS)),
        "known-issues-and-fixes": (words(F.size(issues).cast("string"), " known issues recorded."), bullets(told, NO_ISSUES)),
    }
    given = {"architecture-current": values("entry_points"), "structure-summary": values("entry_files")}
    empty, out = F.array().cast("array<string>"), []
    for kind, (title, tags, files, mode, confidence) in DOCUMENTS.items():
        summary, body = texts[kind]
        own = [
            F.lit(title).alias("title"), summary.alias("summary"), body.alias("body"), F.concat(F.array(F.lit("project-context"), F.concat(F.lit("project:"), F.col("project"))), F.array(*map(F.lit, tags))).alias("tags"),
            (given[kind] if files is None else F.array(*[F.lit(x.format(declared=declared)) for x in files])).alias("sourceFiles"), (values("graph_refs") if kind == "architecture-current" else empty).alias("graphRefs"), F.lit(mode).alias("sourceMode"), F.lit(confidence).alias("confidence"),
            empty.alias("detectedSources"), empty.alias("declaredSources"),
        ]
        out.append(F.struct(F.lit(kind).alias("kind"), F.struct(*own).alias("d")))
    rows = facts.select("project", F.explode(F.array(*out)).alias("x")).select("project", "x.kind", "x.d")
    return rows.select("project", "kind", "d.title", "d.summary", "d.body", "d.tags", F.col("d.sourceFiles").alias("source_files"), F.col("d.sourceMode").alias("mode"), "d.confidence", F.sha2(F.to_json("d"), 256).alias("content_hash"))


def architecture(nodes: DataFrame) -> DataFrame:
    """Label, entry (whether it names an entry point) and ref of each node (id, label)."""
    label = F.coalesce("label", "id", F.lit(""))
    return nodes.select(label.alias("label"), label.rlike(ENTRY_POINT).alias("entry"), F.concat(F.lit("node:"), label).alias("ref"))


def context_refresh(previous: DataFrame, current: DataFrame, held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Project, kind, rewrite and logged, for every document of ``fresh`` (project, kind, content_hash).

    A document is written where a tracked file (project, path, hash) that its kind follows was added, changed or removed, and where ``held`` (project, kind,
    content_hash) has none of its kind; the log gets an entry where that changes its content.
    """
    keyed = lambda df: df.where(F.col("path").isin(*TRACKED)).select(F.concat_ws("\0", "project", "path").alias("path"), "hash")
    moved = delta.changed_files(keyed(previous), keyed(current)).select(F.substring_index("path", "\0", 1).alias("project"), F.explode(invalidated_kinds(F.substring_index("path", "\0", -1))).alias("kind")).distinct().withColumn("_hit", F.lit(True))
    rows = fresh.select(F.col("project").cast("string").alias("project"), "kind", "content_hash").join(moved, ["project", "kind"], "left").join(held.select(F.col("project").cast("string").alias("project"), "kind", F.col("content_hash").alias("_old")), ["project", "kind"], "left")
    rewrite = F.col("_old").isNull() | F.coalesce("_hit", F.lit(False))
    return rows.select("project", "kind", rewrite.alias("rewrite"), (rewrite & ~F.col("content_hash").eqNullSafe(F.col("_old"))).alias("logged"))
