"""Narratives and what proves them: validation, acceptance, cache decisions, results from outside, community and feature cards (P19, J13, J16, E9-E11, A-8-A-10)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import canonical_key, normal_path

# The fields of a narrative and the words of its summary.
LISTS = ("behavior", "sideEffects", "errors", "contracts", "mentions")
TEXTS = ("summary", "changeNotes")
MOST_WORDS = 25


def inner(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind_of(v: Column) -> Column:
    """The type of a JSON value, such as STRING or ARRAY<STRING>; null where there is none."""
    return F.schema_of_variant(v)


def is_text(v: Column, path: str, empty: bool = False) -> Column:
    own = F.coalesce(kind_of(inner(v, path)) == "STRING", F.lit(False))
    return own if empty else own & F.coalesce(F.try_variant_get(v, f"$.{path}", "string") != "", F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column, path: str) -> Column:
    """Whether a field is an array of strings; an empty one is."""
    kind, items = kind_of(inner(v, path)), F.try_variant_get(v, f"$.{path}", "array<string>")
    return F.coalesce((kind == "ARRAY<STRING>") & ~F.exists(items, lambda x: x.isNull()) | kind.startswith("ARRAY") & (F.size(items) == 0), F.lit(False))


def well_formed(content: Column) -> Column:
    """P19 without the mentions: a JSON object with exactly the fields of a narrative, of their types, and a short summary."""
    v = F.try_parse_json(content)
    names = F.json_object_keys(F.to_json(v))
    whole = is_object(v) & F.coalesce((F.size(names) == len(LISTS + TEXTS)) & (F.size(F.array_except(names, F.array(*map(F.lit, LISTS + TEXTS)))) == 0), F.lit(False))
    for name in TEXTS:
        whole &= is_text(v, name, empty=True)
    for name in LISTS:
        whole &= is_list(v, name)
    words = F.filter(F.split(F.trim(summary_of(content)), r"\s+"), lambda x: x != "")
    return whole & F.coalesce(F.size(words) <= MOST_WORDS, F.lit(False))


def mentions_of(content: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), "$.mentions", "array<string>"), F.array().cast("array<string>"))


def summary_of(content: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(content), "$.summary", "string")


def validated(rows: DataFrame, known: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """``rows`` with ``valid``: whether their content is a narrative that mentions keys of ``known`` (symbol_key) only. ``key`` tells rows apart."""
    mentions = rows.where(F.col(content).isNotNull()).select(*key, F.explode(mentions_of(F.col(content))).alias("_mention"))
    wrong = mentions.join(known.select(F.col("symbol_key").alias("_mention")).distinct(), "_mention", "left_anti").select(*key).distinct().withColumn("_wrong", F.lit(True))
    return rows.join(wrong, key, "left").withColumn("valid", F.coalesce(well_formed(F.col(content)) & F.col("_wrong").isNull(), F.lit(False))).drop("_wrong")


def sound(prefix: str) -> Column:
    """Whether evidence columns (narrative_hash, prompt_version, callees, own_key) are whole: texts that are not empty, and hashes by canonical keys."""
    c = lambda name: F.col(f"{prefix}{name}")
    callees = F.forall(F.map_entries(c("callees")), lambda x: canonical_key(x["key"]) & F.coalesce(x["value"] != "", F.lit(False)))
    return F.coalesce((c("narrative_hash") != "") & (c("prompt_version") != "") & callees & (c("own_key").isNull() | (c("own_key") != "")), F.lit(False))


def same_map(a: Column, b: Column) -> Column:
    order = lambda m: F.array_sort(F.map_entries(m))
    return order(a).eqNullSafe(order(b))


def same_evidence(p: str, q: str) -> Column:
    return F.col(f"{p}narrative_hash").eqNullSafe(F.col(f"{q}narrative_hash")) & F.col(f"{p}prompt_version").eqNullSafe(F.col(f"{q}prompt_version")) & same_map(F.col(f"{p}callees"), F.col(f"{q}callees"))


def side(df: DataFrame, prefix: str) -> DataFrame:
    """Evidence columns under a prefix; of several rows of a key the first by all columns, and their number."""
    columns = ("narrative_hash", "prompt_version", "callees", "own_key")
    order = F.struct("narrative_hash", "prompt_version", F.map_entries("callees"), "own_key")
    one = df.groupBy("symbol_key").agg(F.min_by(F.struct(*columns), order).alias("x"), F.count("*").alias(f"{prefix}rows"))
    return one.select("symbol_key", f"{prefix}rows", *[F.col(f"x.{c}").alias(f"{prefix}{c}") for c in columns])


def read_artifacts(artifacts: DataFrame, known: DataFrame) -> DataFrame:
    """Artifacts (symbol_key, readable, payload) with the first reason against each, their evidence (a_ columns), content, valid and summary."""
    v = F.try_parse_json("payload")
    e = inner(v, "narrativeEvidence")
    callees = F.try_variant_get(e, "$.calleeSummaryHashes", "map<string,variant>")
    hashes = F.coalesce(is_object(inner(e, "calleeSummaryHashes")) & F.forall(F.map_entries(callees), lambda x: canonical_key(x["key"]) & F.coalesce((kind_of(x["value"]) == "STRING") & (F.try_variant_get(x["value"], "$", "string") != ""), F.lit(False))), F.lit(False))
    own_sound = inner(e, "symbolKey").isNull() | is_text(e, "symbolKey")
    reason = (
        F.when(~F.coalesce("readable", F.lit(False)), "unreadable-artifact").when(~is_object(v), "corrupt-artifact").when(~is_text(v, "content"), "missing-content").when(e.isNull(), "missing-stored-hash")
        .when(~(is_object(e) & is_text(e, "narrativeHash") & is_text(e, "promptVersion") & hashes & own_sound), "invalid-evidence")
        .when(~F.try_variant_get(e, "$.symbolKey", "string").eqNullSafe(F.col("symbol_key")), "wrong-key")
    )
    text = lambda path: F.try_variant_get(e, f"$.{path}", "string")
    rows = artifacts.select(
        "symbol_key", reason.alias("a_reason"), text("narrativeHash").alias("a_narrative_hash"), text("promptVersion").alias("a_prompt_version"),
        F.try_variant_get(e, "$.calleeSummaryHashes", "map<string,string>").alias("a_callees"), F.when(reason.isNull(), F.try_variant_get(v, "$.content", "string")).alias("content"),
    )
    return validated(rows, known, ["symbol_key"]).withColumn("summary", summary_of(F.col("content"))).withColumn("a_in", F.lit(True))


def accepted_narratives(candidates: DataFrame, artifacts: DataFrame, index: DataFrame, worklist: DataFrame, known: DataFrame) -> DataFrame:
    """symbol_key, accepted, the first reason against, and the summary of what is accepted, for every key of ``candidates``.

    ``index`` and ``worklist`` have symbol_key and evidence (narrative_hash, prompt_version, callees: a map, own_key; a null hash is none). The
    artifact is checked first, then that the worklist has one row, the index, the worklist, and that all three agree; content comes last.
    """
    a = read_artifacts(artifacts, known)
    rows = candidates.select("symbol_key").distinct().join(a, "symbol_key", "left").join(side(index, "i_"), "symbol_key", "left").join(side(worklist, "w_"), "symbol_key", "left")
    own = lambda p: F.col(f"{p}own_key")
    reason = (
        F.when(F.col("a_in").isNull(), "no-accepted-artifact").when(F.col("a_reason").isNotNull(), F.col("a_reason")).when(F.col("w_rows") > 1, "ambiguous-worklist-evidence")
        .when(F.col("i_narrative_hash").isNull(), "missing-index-fingerprint").when(~sound("i_"), "invalid-index-evidence").when(own("i_").isNotNull() & (own("i_") != F.col("symbol_key")), "wrong-index-key")
        .when(F.col("w_narrative_hash").isNull(), "missing-worklist-fingerprint").when(~sound("w_"), "invalid-worklist-evidence").when(~own("w_").eqNullSafe(F.col("symbol_key")), "wrong-worklist-key")
        .when(~same_evidence("i_", "w_") | ~same_evidence("a_", "w_"), "fingerprint-mismatch").when(~F.col("valid"), "invalid-content")
    )
    return rows.select("symbol_key", reason.isNull().alias("accepted"), reason.alias("reason"), F.when(reason.isNull(), F.col("summary")).alias("summary"))


def cache_decisions(current: DataFrame, worklist: DataFrame, index: DataFrame, artifacts: DataFrame, known: DataFrame) -> DataFrame:
    """symbol_key, hit and the first reason for a miss, for symbols with the evidence of their present source (``current``; a null hash: no source).

    A hit needs the worklist's, the index's and the artifact's fingerprints, all equal to the present one, and a valid narrative.
    """
    a = read_artifacts(artifacts, known)
    rows = side(current, "c_").join(side(worklist, "w_"), "symbol_key", "left").join(side(index, "i_"), "symbol_key", "left").join(a, "symbol_key", "left")
    reason = F.when(F.col("c_narrative_hash").isNull(), "source-unavailable")
    for p, name in (("w_", "worklist"), ("i_", "index")):
        reason = reason.when(F.col(f"{p}narrative_hash").isNull(), "missing-stored-hash").when(~sound(p), "invalid-stored-evidence").when(~same_evidence(p, "c_"), f"{name}-fingerprint-mismatch")
    reason = (
        reason.when(F.col("a_in").isNull(), "no-accepted-artifact").when(F.col("a_reason").isNotNull(), F.col("a_reason")).when(F.col("a_prompt_version") != F.col("c_prompt_version"), "prompt-version-mismatch")
        .when(F.col("a_narrative_hash") != F.col("c_narrative_hash"), "fingerprint-mismatch").when(~same_map(F.col("a_callees"), F.col("c_callees")), "callee-summaries-mismatch").when(~F.col("valid"), "invalid-content")
    )
    return rows.select("symbol_key", reason.isNull().alias("hit"), reason.alias("reason"))


def external_results(results: DataFrame, queue: DataFrame, worklist: DataFrame, current: DataFrame, version: str, schema: str) -> DataFrame:
    """entry_id, symbol_key and outcome of contents given from outside (``results``: entry_id, content; null: it can't be read).

    ``queue`` has entry_id, symbol_key, status, prompt_version, schema (JSON), known_keys (array) and, under e_, the evidence that was queued, with
    ``has_evidence``; ``worklist`` symbol_key and status; ``current`` symbol_key and the present narrative_hash (null: no source). The entry comes first, and one that is done is
    skipped whatever is given for it; then the content, for entries of the structured kind version, schema, JSON and narrative, then the queued
    evidence, then whether the symbol was marked stale since. Entries without a structured kind or evidence skip those checks.
    """
    rows = results.join(queue, "entry_id", "left").join(worklist.groupBy("symbol_key").agg(F.max(F.col("status") == "stale").alias("_stale")), "symbol_key", "left")
    rows = rows.join(current.select("symbol_key", F.col("narrative_hash").alias("_now"), F.lit(True).alias("_source")), "symbol_key", "left")
    text = F.trim("content")
    structured = F.col("schema").isNotNull() | F.col("prompt_version").isNotNull()
    proven = F.coalesce("has_evidence", F.lit(False))
    unknown = F.size(F.array_except(mentions_of(text), F.coalesce("known_keys", F.array().cast("array<string>")))) > 0
    outcome = (
        F.when(F.col("status").isNull(), "not-found").when(F.col("status") == "done", "already-done").when(F.col("content").isNull(), "unreadable-content").when(text == "", "empty-content")
        .when(structured & ~F.col("prompt_version").eqNullSafe(F.lit(version)), "unsupported-prompt-version").when(structured & ~F.col("schema").eqNullSafe(F.lit(schema)), "schema-mismatch")
        .when(structured & F.try_parse_json(text).isNull(), "invalid-json").when(structured & (~well_formed(text) | unknown), "invalid-narrative")
        .when(proven & ~sound("e_"), "invalid-evidence").when(proven & ~F.col("e_own_key").eqNullSafe(F.col("symbol_key")), "evidence-of-another-key").when(proven & ~F.col("e_prompt_version").eqNullSafe(F.col("prompt_version")), "evidence-of-another-version")
        .when(proven & (F.col("_source").isNull() | F.col("_now").isNull()), "source-unavailable").when(proven & (F.col("_now") != F.col("e_narrative_hash")), "fingerprint-mismatch").when(proven & F.coalesce("_stale", F.lit(False)), "superseded")
    )
    return rows.select("entry_id", "symbol_key", F.coalesce(outcome, F.lit("applied")).alias("outcome"))


# The version, schema and texts of the prompt, and the callers it names.
PROMPT_VERSION, MOST_CALLERS = "v2", 5
FIELDS = ("summary", "behavior", "sideEffects", "errors", "contracts", "changeNotes", "mentions")
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": list(FIELDS),
    "properties": {"summary": {"type": "string", "pattern": r"^\s*(?:\S+(?:\s+\S+){0,24})?\s*$"}, "changeNotes": {"type": "string"}} | {x: {"type": "array", "items": {"type": "string"}} for x in LISTS},
}
HEAD_CALLEES = "Callee one-line summaries (canonical symbol keys):"
HEAD_CALLERS = "Top callers (at most 5; caller-supplied deterministic order, not ranked by semantic importance):"
HEAD_FILE, HEAD_RULES, HEAD_IMPORTS, HEAD_CODE = "File card summary:", "Relevant project rules:", "Context (imports):", "Code:"
HEAD_OUTPUT = "Output contract: reply with a single JSON object that matches this schema exactly (no prose outside JSON):"
HEAD_KEYS = 'Mentionable symbol keys (every "mentions" entry must be one of these canonical keys):'
IN_ENGLISH = "Write all descriptive explanation fields in English, regardless of source comments or conversation language. Preserve code, identifiers, paths, tags and structured keys exactly."


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def filled(x: Column) -> Column:
    """A trimmed text; null for one without more than white space."""
    return F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.trim(x))


def prompts(rows: DataFrame) -> DataFrame:
    """symbol_key and prompt of symbols (symbol_key, name, kind, language, path, start_line, end_line, signature, role, layer, confidence: a text, code, imports,
    file_summary, and in the order to be shown callees: key and summary, callers: key, name and role, rules, keys that may be mentioned).

    Entries without a canonical key, or without what is to be said of them, are left out; of callers the first five usable ones are named. Null texts and lists
    are absent ones.
    """
    c = F.col
    lines = lambda items, none: F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(none)
    some = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    callees = F.filter(some("callees", "array<struct<key:string,summary:string>>"), lambda x: canonical_key(x["key"]) & filled(x["summary"]).isNotNull())
    callers = F.filter(some("callers", "array<struct<key:string,name:string,role:string>>"), lambda x: canonical_key(x["key"]) & filled(x["name"]).isNotNull())
    rules = F.filter(some("rules", "array<string>"), lambda x: filled(x).isNotNull())
    evidence = F.concat_ws(", ", F.concat(F.lit("layer: "), F.when(filled(c("layer")).isNotNull(), c("layer"))), F.concat(F.lit("confidence: "), c("confidence")))
    role = F.when(filled(c("role")).isNull(), "Role: (unclassified)").otherwise(F.concat(F.lit("Role: "), filled(c("role")), F.when(evidence != "", F.concat(F.lit(" ("), evidence, F.lit(")"))).otherwise("")))
    code = F.coalesce("code", F.lit(""))
    signature = F.coalesce(filled(c("signature")), F.when(first_line(code) != "", first_line(code)), F.lit("(not available)"))
    say = lambda label, x: F.concat(F.lit(f"{label}: "), x)
    parts = [
        say("Symbol", c("name")), say("Kind", c("kind")), say("Language", c("language")), F.concat(F.lit("Location: "), c("path"), F.lit(":"), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string")),
        F.lit(f"Prompt version: {PROMPT_VERSION}"), role, say("Signature", signature), F.lit(""),
        F.lit(HEAD_CALLEES), lines(F.transform(callees, lambda x: F.concat(F.lit("- "), x["key"], F.lit(": "), first_line(x["summary"]))), "(none)"), F.lit(""),
        F.lit(HEAD_CALLERS), lines(F.transform(F.slice(callers, 1, MOST_CALLERS), lambda x: F.concat(F.lit("- "), F.trim(x["name"]), F.lit(" — role: "), F.coalesce(filled(x["role"]), F.lit("unclassified")))), "(none)"), F.lit(""),
        F.lit(HEAD_FILE), F.coalesce(filled(c("file_summary")), F.lit("(not available)")), F.lit(""), F.lit(HEAD_RULES), lines(F.transform(rules, lambda x: F.concat(F.lit("- "), F.trim(x))), "(none declared)"), F.lit(""),
        F.lit(HEAD_IMPORTS), F.when(F.coalesce("imports", F.lit("")) != "", c("imports")).otherwise("(none)"), F.lit(""), F.lit(HEAD_CODE), code, F.lit(""), F.lit(HEAD_OUTPUT), F.lit(json.dumps(SCHEMA, indent=2)), F.lit(""),
        F.lit(HEAD_KEYS), lines(F.transform(F.array_distinct(some("keys", "array<string>")), lambda x: F.concat(F.lit("- "), x)), "(none)"), F.lit(""), F.lit(IN_ENGLISH),
    ]
    return rows.select("symbol_key", F.concat_ws("\n", *parts).alias("prompt"))


#: Outcomes that leave the queue's entry as it is, and those after which the symbol is stale.
UNTOUCHED, STALE_AFTER = ("not-found", "already-done"), ("invalid-evidence", "evidence-of-another-key", "evidence-of-another-version", "source-unavailable", "fingerprint-mismatch")


def after_external(outcomes: DataFrame) -> DataFrame:
    """entry_id, entry_status and symbol_status that outcomes lead to; null where nothing changes."""
    o = F.col("outcome")
    return outcomes.select("entry_id", "symbol_key", F.when(o == "applied", "done").when(~o.isin(*UNTOUCHED), "error").alias("entry_status"), F.when(o == "applied", "enriched").when(o.isin(*STALE_AFTER), "stale").alias("symbol_status"))


# ── cards ──────────────────────────────────────────────────────────────────


def _card(owner: str, members: DataFrame, rejected: DataFrame, narratives: DataFrame, known: DataFrame, outside: str) -> DataFrame:
    """Card rows (owner, part, key, text): members (symbols and files) and rejections as given, and the narratives of members, or why not."""
    own = members.where("part = 'member'").select(owner, F.col("key").alias("symbol_key"), F.lit(True).alias("_own"))
    told = validated(narratives, known, [owner, "symbol_key"]).join(own, [owner, "symbol_key"], "left")
    reason = F.when(~canonical_key("symbol_key"), "non-canonical-symbol-key").when(F.col("_own").isNull(), outside).when(~F.col("valid"), "invalid-narrative")
    told = told.select(owner, F.when(reason.isNull(), "narrative").otherwise("rejected").alias("part"), F.col("symbol_key").alias("key"), F.coalesce(reason, summary_of(F.col("content"))).alias("text"))
    return members.select(owner, "part", "key", "text").unionByName(rejected.select(owner, F.lit("rejected").alias("part"), "key", F.col("reason").alias("text"))).unionByName(told)


def graph_keys(nodes: DataFrame) -> DataFrame:
    """node, key and path of the nodes (id, symbol_key, source_file, node_kind, community) that carry a key; the id stands for a missing one."""
    return nodes.select(F.col("id").alias("node"), F.coalesce("symbol_key", "id").alias("key"), normal_path("source_file").alias("path"), "node_kind", F.col("community").cast("string").alias("community"))


def community_cards(files: DataFrame, nodes: DataFrame, narratives: DataFrame, known: DataFrame) -> DataFrame:
    """A-9: card rows (community, part, key, text) of communities, from the ``files`` (community, path) that are to be looked through.

    A member is a symbol of such a file whose canonical key names the file, assigned to the community; its text is the path. Several nodes of one key are
    rejected as one, files without nodes too. ``narratives`` has community, symbol_key and content.
    """
    asked = files.select(F.col("community").cast("string").alias("community"), normal_path("path").alias("path")).distinct()
    keys = graph_keys(nodes)
    gone = asked.join(keys.select("path").distinct(), "path", "left_anti").select("community", F.concat(F.lit("file|"), F.col("path")).alias("key"), F.lit("file-not-in-graph").alias("reason"))
    fits = F.col("node_kind").isin("symbol", "member") & canonical_key("key") & (normal_path(F.try_element_at(F.split("key", r"\|"), F.lit(2))) == F.col("path"))
    groups = asked.join(keys.where(fits), ["community", "path"]).groupBy("community", "key").agg(F.count("*").alias("n"), F.min("path").alias("text"))
    many = groups.where("n > 1").select("community", "key", F.lit("ambiguous-symbol-key").alias("reason"))
    return _card("community", groups.where("n = 1").withColumn("part", F.lit("member")), gone.unionByName(many), narratives.withColumn("community", F.col("community").cast("string")), known, "symbol-not-in-community")


def feature_cards(members: DataFrame, nodes: DataFrame, narratives: DataFrame, known: DataFrame) -> DataFrame:
    """A-10: card rows (feature, part, key, text) of declared features: members (feature, member: a symbol key or ``file|path``) that the graph proves.

    Two spellings of a file are one member. ``narratives`` has feature, symbol_key and content.
    """
    keys = graph_keys(nodes)
    is_file = F.col("member").startswith("file|")
    files = members.where(is_file).select("feature", normal_path(F.substring("member", 6, 1 << 30)).alias("path")).distinct()
    there = files.join(keys.select("path").distinct().withColumn("_in", F.lit(True)), "path", "left").withColumn("key", F.concat(F.lit("file|"), F.col("path")))
    symbols = members.where(~is_file).select("feature", F.col("member").alias("key"), normal_path(F.try_element_at(F.split("member", r"\|"), F.lit(2))).alias("path")).distinct()
    n = keys.groupBy("key", "path").agg(F.count("*").alias("n"))
    found = symbols.join(n, ["key", "path"], "left")
    reason = F.when(~canonical_key("key"), "non-canonical-member-key").when(F.col("n").isNull(), "symbol-not-in-graph").when(F.col("n") > 1, "ambiguous-symbol-key")
    found = found.withColumn("reason", reason)
    good = found.where("reason is null").select("feature", F.lit("member").alias("part"), "key", F.col("path").alias("text")).unionByName(there.where("_in").select("feature", F.lit("file").alias("part"), "key", F.col("path").alias("text")))
    bad = found.where("reason is not null").select("feature", "key", "reason").unionByName(there.where("_in is null").select("feature", "key", F.lit("file-not-in-graph").alias("reason")))
    return _card("feature", good, bad, narratives, known, "symbol-not-in-feature")


def rolled_up(cards: DataFrame, owner: str) -> DataFrame:
    """A-8-A-10: owner, text (``- key: summary`` lines of the narratives by key), members and rejected (sorted ``key: reason``)."""
    line = lambda mark: F.concat(F.lit(mark), F.col("key"), F.lit(": "), F.col("text"))
    sorted_of = lambda part, mark: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("key", "text", line(mark).alias("line"))))), lambda x: x["line"])
    return cards.groupBy(owner).agg(F.array_join(sorted_of("narrative", "- "), "\n").alias("text"), F.count_if(F.col("part").isin("member", "file")).alias("members"), sorted_of("rejected", "").alias("rejected"))
