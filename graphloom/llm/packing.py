"""Operator 5: best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_batches, texts, tuned
from graphloom.llm.pretokens import packed, tokenizer_path, worker_pretokens
from graphloom.session import Scratch

#: A length is ranked in parts, so that one very common length is the work of many tasks: so many at least, of so many pieces at most on average.
SALTS, PART = 64, 1_000_000
SALT_BITS = 24


def cut_pieces(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only one longer than ``size`` is cut; the first piece takes the rest."""
    first = total % size or size
    return [(0, first)] + [(at, size) for at in range(first, total, size)]


def token_pieces(spark: SparkSession, docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row's token ids."""
    tuned(spark)
    tail = packed([end_id])

    def run(batch):
        cache, out = worker_pretokens(path, "packed"), []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), cache.of_texts(texts(batch))):
            ids += tail
            out += [(doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut_pieces(len(ids) // 4, size))]
        cols = list(zip(*out)) or [()] * 5
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()), "ids_crc32": pa.array(cols[4], pa.int64())})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that use up ``counts`` (length -> pieces).

    Pieces of one length are interchangeable, so the plan is made on the histogram of lengths, which has at most
    ``size`` entries however many documents there are. A bin opens with the longest piece left and is filled
    greedily with the longest that fits; then its smallest piece gives way to two unpacked pieces that fill the
    expanded gap more tightly, if there are such. The same bin is repeated for as long as its pieces last.
    """
    left = dict(counts)
    plan: list[tuple[list[int], int]] = []
    have = np.zeros(size + 1, np.int64)
    for n, c in left.items():
        have[n] = c
    top = size
    while True:
        while top > 0 and have[top] == 0:
            top -= 1
        if top == 0:
            return plan
        bin_, gap = [top], size - top
        have[top] -= 1
        while gap > 0 and (fit := np.flatnonzero(have[1 : gap + 1])).size:
            n = int(fit[-1]) + 1
            bin_.append(n)
            have[n] -= 1
            gap -= n
        if gap > 0 and len(bin_) > 1:
            smallest = bin_[-1]
            pair = tightest_pair(have, smallest + gap, smallest)
            if pair:
                have[smallest] += 1
                bin_[-1:] = pair
                for n in pair:
                    have[n] -= 1
        uses: dict[int, int] = {}
        for n in bin_:
            uses[n] = uses.get(n, 0) + 1
        times = 1 + min(int(have[n]) // u for n, u in uses.items())
        for n, u in uses.items():
            have[n] -= u * (times - 1)
        plan.append((bin_, times))


def tightest_pair(have: np.ndarray, gap: int, over: int) -> list[int] | None:
    """Two pieces whose sum is the largest that is at most ``gap`` and above ``over``; the longer one first."""
    there = np.flatnonzero(have[: gap + 1])
    if not there.size:
        return None
    mate_at = np.searchsorted(there, gap - there, side="right") - 1  # the longest mate of each piece
    best, best_sum = None, over
    for i, j in zip(range(there.size), mate_at):
        a = int(there[i])
        while j >= 0:
            b = int(there[j])
            if b > a:
                b = a  # each pair once, as (longer, shorter)
                j = i
            if a == b and have[a] < 2:
                j -= 1
                if j < 0:
                    break
                b = int(there[j])
            if a + b > best_sum:
                best, best_sum = [a, b], a + b
            break
    return best


def pack(spark: SparkSession, pieces: DataFrame, size: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``size``) with sequence_id and offset.

    The histogram of lengths (at most ``size`` rows) goes to the driver, and the plan made of it, with at most a few
    thousand bins, back to the tasks. Each piece is ranked within its length; the ranks are taken by the plan's bins
    in order. A length is ranked in parts whose number grows with that of the pieces, so a length that a third of all pieces have is not one task's work.
    """
    scratch = scratch or Scratch(spark, "packing")
    key = [c for c in ("doc_id", "piece") if c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(1 << SALT_BITS)).cast("int"))
    held = scratch.write(salted, "pieces")
    salts = max(SALTS, min(1 << SALT_BITS, held.count() // PART))
    held = held.withColumn("_salt", F.pmod("_salt", F.lit(salts)))
    counts = held.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    by_salt = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = best_two_fit(histogram, size)
    lookup = spark.sparkContext.broadcast(plan_table(plan))
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*key)) - 1)
    ranked = ranked.join(by_salt.select("length", "_salt", "_before"), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    names = [c for c in ranked.columns if c != "_rank"]
    fields = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", sequence_id long, offset long"

    def place(batches):
        keys, first, uses, base, offsets_at, offsets, span = lookup.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            slot = rank - first[at]
            sequence, offset = base[at] + slot // uses[at], offsets[offsets_at[at] + slot % uses[at]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def plan_table(plan: list[tuple[list[int], int]]):
    """Arrays by (length, first rank): which bin takes the ranks from there on, and the places of that length in it."""
    span = 1 << 44  # more than there are pieces of one length
    taken: dict[int, int] = {}
    rows, offsets, sequence = [], [], 0
    for lengths, times in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            places.setdefault(n, []).append(at)
            at += n
        for n, own in places.items():
            rows.append((n * span + taken.get(n, 0), taken.get(n, 0), len(own), sequence, len(offsets)))
            offsets += own
            taken[n] = taken.get(n, 0) + len(own) * times
        sequence += times
    rows.sort()
    cols = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
    return (*cols, np.array(offsets, np.int64), span)


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of ``docs``.

    A document's ids are those of its whole text without special tokens, then ``end_id``; a null or empty text is
    ``end_id`` alone. Only a document of more than ``size`` ids is cut: its first piece takes what is left over, so that all
    other pieces fill a sequence each. Repeated rows are packed each for itself; other columns are ignored; an empty
    table gives an empty result. Sequences are numbered from 0, and places in them are gapless from 0.
    """
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(spark, docs, path or tokenizer_path(), size, end_id)
    return pack(spark, pieces, size, scratch).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
