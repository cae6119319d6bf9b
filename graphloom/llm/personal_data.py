"""Operator 13: personal data by patterns, and by contexts that are bootstrapped from what the patterns find."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_batches, texts, tuned
from graphloom.session import Scratch

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits with the three parts that may follow it: each run is read once.
ADDRESS = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

# What else may identify somebody where its context says so: numbers in groups, IPv6 addresses, and addresses with a spelt "at".
NUMBER = re.compile(r"[0-9](?:[-. ()/:]{0,2}[0-9])*+")
COLONS = re.compile(r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{3,}")
SPELT_AT = re.compile(r"[\[({] ?at ?[\])}]", re.I)
SPELT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]++)++", re.I)
#: A word or a sign of the context, and the characters beside a mention in which its context is looked for.
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]")
NEAR = 64

#: Rounds of scoring; distinct identifiers of a kind that a pattern needs; the confidence from which it discovers others; what an identifier
#: without a score counts against a pattern.
ROUNDS, LEAST_SUPPORT, CONFIDENT, UNKNOWN = 4, 5, 0.8, 0.25


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def reach_left(text: str, at: int, least: int) -> int:
    """Where the run of LOCAL characters that ends before ``at`` begins."""
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and without overlap in each kind; time is linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = reach_left(text, at, done)
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in ADDRESS.finditer(text):
        if m[1] and all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def other_mentions(text: str, base: list[tuple[int, int, int]]):
    """(start, end, kinds) of what looks like an identifier outside the base spans; without kinds it can't be one of them, such as a year."""
    taken = []
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    found = []
    for m in SPELT_AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = reach_left(text, end, 0)
        if start < end and (d := SPELT_DOMAIN.match(text, m.end())):
            found.append((start, d.end(), (0,)))
    for m in COLONS.finditer(text) if "::" in text or text.count(":") > 6 else ():
        parts = m[0].split(":")
        if (len(parts) == 8 or "::" in m[0] and 3 <= len(parts) <= 8) and any(parts) and all(len(x) <= 4 for x in parts):
            found.append((*m.span(), (1,)))
    for m in NUMBER.finditer(text):
        n = sum("0" <= c <= "9" for c in m[0])
        opened = ")" in m[0] and text[m.start() - 1 : m.start()] == "("
        found.append((m.start() - opened, m.end(), tuple(k for k, low, high in ((2, 12, 19), (3, 7, 15)) if low <= n <= high)))
    found.sort(key=lambda x: (x[0], -x[1]))
    last, at = 0, 0
    for start, end, kinds in found:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and not (at < len(taken) and taken[at][0] < end):
            yield start, end, kinds
            last = end


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a mention: its two and three tokens before it, and the nearest words on both sides."""
    low = max(0, start - NEAR)
    before = [(m.start(), m[0].lower()) for m in TOKEN.finditer(text, low, start)]
    if before and low and before[0][0] == low:
        before = before[1:]  # may be a part of a word
    left = [x for _, x in before]
    m = TOKEN.search(text, end, end + NEAR)
    right = m[0].lower() if m and (m.end() < end + NEAR or m.end() == len(text)) else ""
    out = []
    if len(left) >= 2:
        out.append(" ".join(left[-2:]) + " _")
    if len(left) >= 3:
        out.append(" ".join(left[-3:]) + " _")
    if left and right and len(left[-1]) > 2:
        out.append(f"{left[-1]} _ {right}")
    return out


def mentions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (of its text), base spans, identifiers in their contexts, and other numbers' contexts with counts.

    The last are summed in each batch and stand in its first row: they only weaken patterns.
    """
    tuned(spark)
    span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    base_type = pa.list_(pa.struct(span))
    found_type = pa.list_(pa.struct([("kinds", pa.list_(pa.int32())), ("known", pa.bool_()), ("value", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))]))
    other_type = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))

    def run(batch):
        base, found, others = [], [], Counter()
        for text in texts(batch):
            own = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for a, b, k in own])
            here = []
            for a, b, kinds, known in [(a, b, (k,), True) for a, b, k in own] + [(*x, False) for x in other_mentions(text, own)]:
                near = contexts(text, a, b)
                if not kinds:
                    others.update(near)
                elif near:
                    value = text[a:b].lower() if kinds[0] < 2 else NO_DIGIT.sub("", text[a:b])
                    here.append({"kinds": list(kinds), "known": known, "value": value, "start": a, "end": b, "patterns": near})
            found.append(here)
        rest = [[{"pattern": p, "n": n} for p, n in others.items()]] + [[]] * (len(base) - 1)
        return pa.table({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "base": pa.array(base, base_type), "found": pa.array(found, found_type), "others": pa.array(rest[: len(base)], other_type)})

    schema = "doc_id long, key long, base array<struct<kind:int,start:long,end:long>>, found array<struct<kinds:array<int>,known:boolean,value:string,start:long,end:long,patterns:array<string>>>, others array<struct<pattern:string,n:long>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"), run, schema)


def pattern_graph(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, patterns): edges (pattern, kind, value, known), and how many others each pattern has against it for a kind (neg).

    Only patterns that can discover something are left: LEAST_SUPPORT distinct identifiers that may be of the kind, one of them unknown. An
    edge counts a value once, however many copies of a document repeat it.
    """
    each = seen.select(F.explode("found").alias("m")).select("m.kinds", "m.known", "m.value", F.explode("m.patterns").alias("pattern"))
    edges = each.select("pattern", "value", "known", F.explode("kinds").alias("kind")).groupBy("pattern", "kind", "value").agg(F.max("known").alias("known"))
    # A value that is known for one kind is no candidate for another.
    kinds = edges.groupBy("pattern", "value").agg(F.max("known").alias("any"), F.collect_set(F.struct("kind", "known")).alias("of"))
    edges = kinds.select("pattern", "value", F.explode(F.filter("of", lambda x: x["known"] | ~F.col("any"))).alias("x")).select("pattern", "value", "x.kind", "x.known")
    values = kinds.groupBy("pattern").agg(F.count("*").alias("n_values"))
    numbers = seen.select(F.explode("others").alias("o")).groupBy("o.pattern").agg(F.sum("o.n").alias("n_numbers"))
    able = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("open")).where(f"n >= {LEAST_SUPPORT} and open > 0")
    patterns = able.join(values, "pattern").join(numbers, "pattern", "left").select("pattern", "kind", (F.col("n_values") - F.col("n") + F.coalesce("n_numbers", F.lit(0))).alias("neg"))
    return edges.join(patterns.select("pattern", "kind"), ["pattern", "kind"]), patterns


def score_patterns(scratch: Scratch, edges: DataFrame, patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are confident after some rounds of scoring patterns and instances in turn.

    A seed's score is 1. A pattern's confidence for a kind is the sum of its instances' scores, against itself, what else stands in its place, and the
    instances without a score (at UNKNOWN each); it counts where the scores of its instances come to LEAST_SUPPORT. An instance's score is
    one less the product of its confident patterns' doubts, so a later round also trusts patterns of what was discovered before.
    """
    scored = edges.withColumn("score", F.col("known").cast("double"))
    for k in range(rounds):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum(1 - F.col("score")).alias("open"))
        weighed = sums.join(patterns, ["pattern", "kind"]).withColumn("confidence", F.col("s") / (F.col("s") + F.col("neg") + UNKNOWN * F.col("open")))
        sure = scratch.write(weighed.where(f"s >= {LEAST_SUPPORT} and confidence >= {CONFIDENT}").select("pattern", "kind", "confidence"), f"sure-{k}")
        if k < rounds - 1:
            doubt = edges.where("not known").join(sure, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("found"))
            scored = edges.join(doubt, ["kind", "value"], "left").withColumn("score", F.when(F.col("known"), 1.0).otherwise(F.coalesce("found", F.lit(0.0)))).drop("found")
            scored = scratch.write(scored, f"scored-{k}")
    return sure


def personal_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) of every row of ``docs`` (doc_id, text).

    A null or empty text has no spans. Repeated rows each give a row, other columns are ignored, an empty table gives an empty result, and texts
    are read whole. ``spans`` holds the base spans and the identifiers that confident patterns discover: numbers, IPv6 addresses and
    spelt-out mail addresses in places where such identifiers stand. Texts are read once; contexts and scores are joins and sums of small tables.
    """
    scratch = Scratch(spark, "personal")
    seen = scratch.write(mentions(spark, docs), "seen")
    edges, patterns = pattern_graph(seen)
    edges, patterns = scratch.write(edges, "edges"), scratch.write(patterns, "patterns")
    sure = score_patterns(scratch, edges, patterns)
    each = seen.select("doc_id", "key", F.explode("found").alias("m")).where("not m.known").select("doc_id", "key", "m.start", "m.end", "m.kinds", F.explode("m.patterns").alias("pattern"))
    hits = each.join(sure, "pattern").where("array_contains(kinds, kind)")
    best = hits.groupBy("doc_id", "key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
    new = best.groupBy("doc_id", "key").agg(F.collect_list(F.struct((-F.col("best.k")).alias("kind"), "start", "end")).alias("new"))
    new = scratch.write(new, "new").select(F.col("doc_id").alias("new_id"), F.col("key").alias("new_key"), "new")
    both = seen.select("doc_id", "key", "base").join(new, F.expr("doc_id <=> new_id and key = new_key"), "left")
    in_order = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return both.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.when(F.col("new").isNull(), F.col("base")).otherwise(F.concat("base", "new"))).alias("spans"))


def personal_digest(found: DataFrame) -> DataFrame:
    """The digest columns of op13 from ``personal_spans``."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def mask(text: str, spans, mark: str = "[{}]") -> str:
    """A text with each of its spans (kind, start, end) replaced by a mark of its kind; overlapping spans become one mark, of the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], mark.format(kind)]
        done = max(done, b)
    return "".join(out) + text[done:]
