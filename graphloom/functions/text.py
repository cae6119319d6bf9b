"""Text functions as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.keys import basename, col, normal_path

# Words of sensitive keys, categories by type, error classes in order, half-life factors by tag, files that invalidate contexts.
SENSITIVE = ("authorization", "api_key", "apikey", "password", "secret", "token")
CATEGORIES = {"bugfix": "bug-fix", "decision": "architecture", "architecture": "architecture", "discovery": "learning", "pattern": "learning", "config": "tool-usage", "preference": "personal"}
ERRORS = (
    ("auth", ("401", "unauthorized", "forbidden")),
    ("rate-limit", ("429", "rate limit")),
    ("provider", ("500", "502", "503", "504", "404", "provider unavailable", "model missing")),
    ("network", ("econnrefused", "enotfound", "econnreset", "socket", "network")),
    ("timeout", ("timeout",)),
    ("config", ("config",)),
    ("provider", ("provider",)),
)
EVERGREEN, SLOW, SLOWER = ("evergreen", "non-forgettable"), ("important", "critical"), ("architecture", "decision")
PACKAGE_FILES = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "tsconfig.json", "global.json")
PACKAGE_CONTEXTS = ("stack-runtime", "dependencies-summary", "integrations-summary")
DECLARED_FOLDER = r"^\.planning/[^/]+/project-context/declared/"
DECLARED_CONTEXTS = ("technical-rules", "project-requirements", "known-issues-and-fixes", "architecture-target")
INSTRUCTION_FILES = ("AGENTS.md", "CLAUDE.md", "GEMINI.md", ".cursorrules", ".windsurfrules")
INSTRUCTION_CONTEXTS = ("technical-rules", "project-requirements")


def tokens(text) -> Column:
    """lower-case ASCII words of two characters or more, repeats kept."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def match_count(text, words: list[str]) -> Column:
    """how many of the words occur in the text, each occurrence in ``words`` for itself."""
    hay = F.lower(col(text))
    return sum((hay.contains(w).cast("int") for w in words), F.lit(0))


def estimated_tokens(text) -> Column:
    """F7."""
    return F.ceil(F.length(col(text)) / 4)


def tokens_saved(source, answer) -> Column:
    """F8."""
    return F.greatest(F.lit(0), estimated_tokens(source) - estimated_tokens(answer))


def line_slice(text, start, end) -> Column:
    """lines from 1, end included."""
    return F.array_join(F.slice(F.split(col(text), "\n"), F.greatest(col(start), F.lit(1)), F.greatest(col(end) - F.greatest(col(start), F.lit(1)) + 1, F.lit(0))), "\n")


def context_lines(text, before) -> Column:
    """import, using and namespace lines above a line."""
    return F.filter(F.slice(F.split(col(text), "\n"), F.lit(1), F.greatest(col(before) - 1, F.lit(0))), lambda x: x.rlike(r"^\s*(import|from|using|namespace|package|require)\b"))


def report_fields(text) -> Column:
    """``key: value`` lines as a map with lower-case keys; the first of a key stays."""
    rows = F.filter(F.split(col(text), "\n"), lambda x: x.rlike(r"^\s*[A-Za-z][\w ]*:"))
    pairs = F.transform(rows, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(first)


def redact_private(text) -> Column:
    """F18."""
    return F.regexp_replace(col(text), r"(?is)<private>.*?</private>", "[REDACTED]")


@F.pandas_udf(StringType())
def _masked(texts):
    def mask(x, depth):
        if depth > 5:
            return x
        if isinstance(x, dict):
            return {k: "***REDACTED***" if any(w in k.lower() for w in SENSITIVE) else mask(v, depth + 1) for k, v in x.items()}
        return [mask(v, depth + 1) for v in x] if isinstance(x, list) else x

    def one(text):
        try:
            return json.dumps(mask(json.loads(text), 0), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return text

    return texts.map(one)


def mask_args(text) -> Column:
    """values under sensitive keys down to depth five; a text that is no JSON stays.

    JSON of unknown depth needs Python; rows without a sensitive word never reach it.
    """
    may = F.lower(col(text)).rlike("|".join(SENSITIVE))
    return F.when(may, _masked(col(text))).otherwise(col(text))


def summarised(text, most: int = 200) -> Column:
    """F20."""
    return F.when(F.length(col(text)) > most, F.concat(F.substring(col(text), 1, most), F.lit("..."))).otherwise(col(text))


def cosine(a, b) -> Column:
    """0 where a norm is 0; null for null or unequal lengths."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def round4(x) -> Column:
    """half up."""
    return F.floor(col(x) * 10_000 + 0.5) / 10_000


def fresh(heartbeat, now, stale_s: int = 300) -> Column:
    """the limit counts as fresh."""
    return F.coalesce(F.unix_timestamp(col(now)) - F.unix_timestamp(col(heartbeat)) <= stale_s, F.lit(False))


def iso_time(text) -> Column:
    """F25."""
    return F.try_to_timestamp(col(text))


def category(kind) -> Column:
    """F26."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p]), col(kind)), F.lit("learning"))


def saved_payload(title, content, kind, topic, project) -> Column:
    """content (with the title above it), category and tags (the project and the parts of the topic, each once) of a memory to be saved."""
    clean = lambda x: F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^\s+|\s+$", "")
    head, body = clean(title), clean(content)
    parts = F.transform(F.split(F.coalesce(col(topic), F.lit("")), "/"), lambda x: F.trim(x))
    tags = unique_tags(F.concat(F.array(col(project)), parts))
    return F.struct(F.when(head != "", F.concat(F.lit("**What**: "), head, F.lit("\n\n"), body)).otherwise(body).alias("content"), category(kind).alias("category"), tags.alias("tags"))


def semantic_report(summary, findings) -> Column:
    """responsibility (else the summary), inputs, output, dependencies, role and summary of an array of ``key: value`` findings; the last of a key counts."""
    rows = F.filter(F.coalesce(col(findings), F.array().cast("array<string>")), lambda x: F.contains(x, F.lit(":")) & ~x.startswith(":"))
    pairs = F.transform(rows, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    get = lambda name: F.try_element_at(F.transform(F.filter(pairs, lambda x: x["k"] == name), lambda x: x["v"]), F.lit(-1))
    items = lambda name: F.filter(F.transform(F.split(F.coalesce(get(name), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    said = F.trim(F.coalesce(col(summary), F.lit("")))
    known = lambda name, other: F.when(get(name) != "", get(name)).otherwise(other)
    return F.struct(known("responsibility", said).alias("responsibility"), items("inputs").alias("inputs"), known("output", F.lit("Not specified.")).alias("output"), items("dependencies").alias("dependencies"), known("role", F.lit("Not specified.")).alias("role"), said.alias("summary"))


def semantic_summary(text, most: int = 200) -> Column:
    """what a line ``Responsibility:`` says with the lines that go on from it, up to a sentence's end, an empty line, a list or a heading; else the
    first sentence, or the first line; cut. Null for a text without anything."""
    clean = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", "")
    said = F.regexp_extract(clean, r"(?im)^[ \t]*(?:[-*]\s+)?(?:\*{1,2}|_{1,2})?responsibility(?::(?:\*{1,2}|_{1,2})?|(?:\*{1,2}|_{1,2})?:)[ \t]*\n?\s*((?:[^\n]*[^\n\s][^\n]*)(?:\n(?![ \t]*(?:#{1,6}\s|[-*]\s|$))[^\n]+)*)", 1)
    lines = F.transform(F.split(said, "\n"), lambda x: F.trim(x))
    ends = F.transform(lines, lambda x: x.rlike(r"[.!?]$"))
    last = F.coalesce(F.nullif(F.array_position(ends, True), F.lit(0)), F.size(lines)).cast("int")
    whole = F.array_join(F.slice(lines, F.lit(1), F.greatest(last, F.lit(1))), " ")
    first = F.trim(F.regexp_extract(clean, r"^([^\n]+?[.!?])(?:\s|$)", 1))
    found = F.when(F.trim(said) != "", whole).when(first != "", first).otherwise(F.trim(F.substring_index(clean, "\n", 1)))
    return F.when(clean != "", F.substring(found, 1, most))


def unique_tags(tags) -> Column:
    """F32: in order, without repeats, nulls and empty ones."""
    return F.array_distinct(F.filter(col(tags), lambda x: x.isNotNull() & (x != "")))


def decay_factor(age_days, half_life) -> Column:
    """F35."""
    return F.when(col(half_life) <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), F.greatest(col(age_days), F.lit(0.0)) / col(half_life)))


def half_life_factor(tags, kind) -> Column:
    """null is for ever."""
    has = lambda words: F.arrays_overlap(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(*[F.lit(w) for w in words]))
    return F.when(has(EVERGREEN), F.lit(None)).when(has(SLOW), F.lit(4.0)).when(col(kind).isin(*SLOWER), F.lit(2.0)).otherwise(F.lit(1.0))


def topic_slug(text) -> Column:
    """the ``-2`` for repeats is ``operators.memory.unique_slugs``."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


def routed(n_tokens, span, total_lines, token_limit: int = 4000, coverage: float = 0.6) -> Column:
    """P20: by coverage first, then by tokens, both limits included."""
    return F.when((col(total_lines) > 0) & (col(span) / col(total_lines) >= coverage), "subagent").when(col(n_tokens) >= token_limit, "subagent").otherwise("local")


def error_class(message) -> Column:
    """The first class a word of which occurs."""
    out, m = None, F.lower(F.coalesce(col(message), F.lit("")))
    for name, words in ERRORS:
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(m, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("runtime")


def invalidated_kinds(path) -> Column:
    """Kinds of project context that a changed file invalidates: package files, declared documents, and instructions for agents."""
    p = F.regexp_replace(normal_path(path), r"^(\./)+", "")
    packages, instructions = p.isin(*PACKAGE_FILES) | p.endswith(".csproj"), (p == "README.md") | basename(p).isin(*INSTRUCTION_FILES)
    found = [F.when(packages, F.lit(k)) for k in PACKAGE_CONTEXTS]
    found += [F.when(p.rlike(DECLARED_FOLDER + k), F.lit(k)) for k in DECLARED_CONTEXTS]
    return F.array_distinct(F.array_compact(F.array(*found, *[F.when(instructions, F.lit(k)) for k in INSTRUCTION_CONTEXTS])))


def prompt_cut(text, most: int = 80) -> Column:
    """Of more than ``most`` lines the first 60 % and the last 40 % of that number."""
    lines = F.split(col(text), "\n")
    head, tail = int(most * 0.6), most - int(most * 0.6)
    return F.when(F.size(lines) > most, F.array_join(F.concat(F.slice(lines, 1, head), F.slice(lines, -tail, tail)), "\n")).otherwise(col(text))
