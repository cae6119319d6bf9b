"""Operator 4: Lempel-Ziv phrase fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import slices, tuned
from graphloom.llm.hashing import mix, multilinear

#: Components of a signature and hex digits of each.
COMPONENTS, DIGITS = 64, 4
MULTIPLIERS = mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) | np.uint64(1)
SHIFTS = mix(np.arange(1001, 1001 + COMPONENTS, dtype=np.uint64))
#: Ranges of doc_id, at least; a task sorts and parses the rows of some of them.
RANGES = 64


def parse(text: str, phrases: set[str], ends: list[int], word: str = "", at: int = 0) -> str:
    """LZ78: cut ``text`` into the shortest phrases not seen before; returns the unfinished last one."""
    add, end = phrases.add, ends.append
    for at, c in enumerate(text, at + 1):  # noqa: B020
        word += c
        if word not in phrases:
            add(word)
            end(at)
            word = ""
    return word


def signature(text: str, ends: list[int]) -> np.ndarray:
    """Minimum hashes of the set of phrases of a text that ``ends`` cuts; all ones for an empty text."""
    if not text:
        return np.full(COMPONENTS, (1 << 4 * DIGITS) - 1, np.uint64)
    cuts = np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = multilinear(codes, np.concatenate([[0], cuts[:-1]]), cuts)
    least = np.full(COMPONENTS, np.uint64(2**64 - 1))
    for at in range(0, hashes.size, 4096):
        part = hashes[at : at + 4096, None] * MULTIPLIERS + SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least) >> np.uint64(64 - 4 * DIGITS)


def as_text(sig: np.ndarray) -> str:
    return "".join(f"{int(x):0{DIGITS}x}" for x in sig)


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    ends: list[int] = []
    parse(text, set(), ends)
    return as_text(signature(text, ends))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components: an estimate of the Jaccard similarity of the two sets of phrases."""
    return float((a == b).mean())


def with_edited(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """(signature, signature of the edited text, the edited text); the part that both share is parsed once."""
    half = len(text) // 2
    kept = text[: len(text) - half]
    edited = kept + following[:half]
    phrases, ends = set(), []
    word = parse(kept, phrases, ends)
    phrases2, ends2 = phrases.copy(), ends.copy()
    parse(text[len(kept) :], phrases, ends, word, len(kept))
    parse(edited[len(kept) :], phrases2, ends2, word, len(kept))
    return signature(text, ends), signature(edited, ends2), edited


def fingerprints(spark: SparkSession, docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and how alike they are.

    The text's last half (rounded down, in code points) is replaced by as many first code points of the next row by
    (doc_id, text), or all that it has; the row after the last is the first. Rows are dealt by ranges of doc_id cut
    at ids that occur, so a range's first row is known, and goes to the range before it too: each text moves once,
    and no task holds more than a batch of texts at a time.

    A null text is empty; the fingerprint of an empty text has all bits set, and two empty texts are alike (1.0).
    Equal texts have equal fingerprints. Repeated rows each give a row and follow each other; a null doc_id sorts first;
    other columns are ignored; an empty table gives an empty result. Texts are parsed whole.
    """
    tuned(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    ids = rows.where(F.col("doc_id").isNotNull())
    steps = [k / ranges for k in range(1, ranges)]
    got = ids.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", F.lit(steps), 10 * ranges).alias("cuts"), F.count("*").alias("n")).first()
    nulls = rows.where(F.col("doc_id").isNull()).limit(1).count()
    cuts = sorted({*(got.cuts or [])} - {got.low}) if got.n else []
    cut_list = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.coalesce(F.size(F.filter(cut_list, lambda c: c <= F.col("doc_id"))), F.lit(0))
    last = len(cuts)
    first_of_all = F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(got.low).cast("long"))
    homes = F.array_compact(
        F.array(
            F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest")),
            F.when(F.array_contains(cut_list, F.col("doc_id")), F.struct((F.col("_part") - 1).alias("part"), F.lit(1).alias("guest"))),
            F.when(first_of_all, F.struct(F.lit(last).alias("part"), F.lit(2).alias("guest"))),
        )
    )
    dealt = rows.withColumn("_part", part).withColumn("_home", F.explode(homes)).select("_home.*", "doc_id", "text")
    dealt = dealt.repartition(max(2, ranges // 4), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        waits_text = None  # (part, doc_id, text): a row whose next row is awaited
        waits_sig = None  # (doc_id, n_chars, sha, signature, edited signature): waits for the next row's signature
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

        for whole in batches:
            for batch in slices(whole):
                done = []

                def emit(row, sig, done=done):
                    doc, n, sha, own, edited = row
                    done.append((doc, n, sha, as_text(own), as_text(edited), likeness(own, edited), likeness(own, sig)))

                for p, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                    if waits_text is not None and waits_text[0] == p:
                        sig, sig2, edited = with_edited(waits_text[2], text)
                        if waits_sig:
                            emit(waits_sig, sig)
                        waits_sig = (waits_text[1], len(waits_text[2]), hashlib.sha256(edited.encode()).hexdigest(), sig, sig2)
                        if guest:
                            ends: list[int] = []
                            parse(text, set(), ends)
                            emit(waits_sig, signature(text, ends))
                            waits_sig = None
                    waits_text = None if guest else (p, doc, text)
                if done:
                    cols = dict(zip(names, zip(*done)))
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) if k < 2 else pa.array(v) for k, (n, v) in enumerate(cols.items())})

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
