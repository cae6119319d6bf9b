"""Operator 11: collocations from word-id suffix arrays of shards, counted by LCP intervals and merged by key."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_groups, text_bytes, tuned
from graphloom.llm.hashing import LOWER, mix
from graphloom.llm.id_filter import maybe_token
from graphloom.session import Scratch

#: Bytes that end a piece, and those that separate words within one.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
#: Bytes of text of a shard: one suffix array. A longer text is cut at ends of pieces.
SHARD = 1 << 24
_BASE = np.uint64(0x9E6C63D0876A9A47)


class Shard:
    """The words of some texts of one language: distinct ``words`` (Arrow), the ``ids`` of all words in order, and the ``piece`` of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = LOWER[raw]
        inside = ~(PIECE | SPACE)[raw]
        ends = PIECE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]  # a text's first word is none of the text before
        starts = np.flatnonzero(first)
        texts = np.searchsorted(offsets[1:], starts, side="right")
        self.piece = np.cumsum(ends, dtype=np.int32)[starts] + texts
        lengths = np.add.reduceat(inside, starts, dtype=np.int64) if starts.size else np.zeros(0, np.int64)
        at = np.zeros(starts.size + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        body = pa.Array.from_buffers(pa.large_binary(), starts.size, [None, pa.py_buffer(at), pa.py_buffer(raw[inside])])
        coded = body.dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def word_keys(self, lang: str) -> np.ndarray:
        """A 64-bit hash of each distinct word and the language."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        at = np.frombuffer(self.words.buffers()[1], np.int64, len(self.words) + 1, self.words.offset * 8)
        raw = np.frombuffer(self.words.buffers()[2], np.uint8)[at[0] : at[-1]]
        lengths, begins = np.diff(at), at[:-1] - at[0]
        place = (np.arange(raw.size) - np.repeat(begins, lengths)).astype(np.uint64)
        seed = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(raw.astype(np.uint64) + place * _BASE), begins)
            return mix(sums + mix(lengths.astype(np.uint64)) + seed)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _BASE + mix(b))


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the first ``depth`` words of their suffixes (or more), by prefix doubling; a suffix ends with its piece.

    ``left`` is how many words a suffix has. Ranks of the first h words of all suffixes give those of the first 2h: a suffix's pair of
    ranks is its own and that of the suffix h words on, zero where its piece has ended.
    """
    rank, h = ids + 1, 1
    while True:
        if h >= depth:
            return np.argsort(rank, kind="stable")
        after = np.zeros(rank.size, np.int64)
        after[:-h] = rank[h:]
        after[left <= h] = 0
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        h *= 2
        if h >= depth:
            return np.argsort(pair, kind="stable")
        rank = np.unique(pair, return_inverse=True)[1] + 1


def shared_words(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """LCP of each suffix with the one before it in the order, up to ``depth``; the first has none."""
    lcp = np.zeros(order.size, np.int64)
    alike = np.ones(max(order.size - 1, 0), bool)
    for k in range(depth):
        a, b = order[:-1], order[1:]
        alike &= (left[a] > k) & (left[b] > k)
        alike &= ids[np.minimum(a + k, ids.size - 1)] == ids[np.minimum(b + k, ids.size - 1)]
        lcp[1:] += alike
    return lcp


def interval_counts(ids: np.ndarray, piece: np.ndarray, depth: int):
    """(n, first positions, counts) of the distinct n-grams of 1 to ``depth`` words within pieces.

    An n-gram is an interval of the suffix array whose neighbours share n words or more; the interval's length is its count.
    """
    if not ids.size:
        return
    new = np.flatnonzero(np.diff(piece, append=piece[-1] + 1)) + 1  # ends of pieces
    left = new[np.searchsorted(new, np.arange(ids.size), side="right")] - np.arange(ids.size)
    order = suffix_array(ids, left, depth)
    lcp = shared_words(ids, left, order, depth)
    for n in range(1, depth + 1):
        starts = np.flatnonzero(lcp < n)
        counts = np.diff(starts, append=ids.size)
        whole = left[order[starts]] >= n
        yield n, order[starts][whole], counts[whole]


def shards(batches, rows: int = 512):
    """(lang, raw bytes, offsets) of the texts of a task, about SHARD bytes of one language at once; longer texts in parts of whole pieces."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def done(lang):
        parts = held.pop(lang)
        del size[lang]
        return lang, np.concatenate(parts), np.concatenate([[0], np.cumsum([x.size for x in parts])])

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            raw, offsets = text_bytes(part)
            for k, lang in enumerate(part.column("lang").to_pylist()):
                text = raw[offsets[k] : offsets[k + 1]]
                while text.size:
                    cut = text.size
                    if cut > SHARD and (over := np.flatnonzero(PIECE[text[SHARD:]])).size:
                        cut = SHARD + int(over[0]) + 1
                    held.setdefault(lang, []).append(text[:cut].copy())
                    size[lang] = size.get(lang, 0) + cut
                    text = text[cut:]
                    if size[lang] >= SHARD:
                        yield done(lang)
        if sum(size.values()) >= 4 * SHARD:  # very many languages
            for lang in list(held):
                yield done(lang)
    for lang in list(held):
        yield done(lang)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")


#: Bytes of text for each bucket of keys, the fewest and the most buckets; bits of a key that are kept besides its bucket.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS, LOW_BITS = 1 << 21, 256, 1 << 16, 40


def bucket_bits(docs: DataFrame) -> int:
    """Bits of the bucket number: buckets hold the keys of about BUCKET bytes of text each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return (min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET)) - 1).bit_length()


def packed(keys: np.ndarray, counts: np.ndarray, bits: int, least: int):
    """(bucket, six bytes a key: its low bits and its count, which is held down to ``least``) of sorted keys."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    low = ((keys << np.uint64(bits)) >> np.uint64(64 - LOW_BITS)) << np.uint64(8) | np.minimum(counts, least).astype(np.uint64)
    raw = low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    for bucket in np.flatnonzero(np.diff(edges)):
        yield int(bucket), raw[6 * edges[bucket] : 6 * edges[bucket + 1]]


def merged(bucket: int, parts: list[bytes], bits: int, least: int) -> np.ndarray:
    """The keys of a bucket whose counts come to ``least``, as they are after ``packed`` has cut them."""
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    both = np.zeros((len(raw), 8), np.uint8)
    both[:, :6] = raw
    both = np.sort(both.view(np.uint64).ravel())
    low = both >> np.uint64(8)
    starts = np.flatnonzero(np.diff(low, prepend=low[0] + np.uint64(1)))
    enough = low[starts][np.add.reduceat((both & np.uint64(255)).astype(np.int64), starts) >= least]
    return np.uint64(bucket << (64 - bits)) | enough << np.uint64(64 - LOW_BITS - bits)


def cut_key(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys as ``merged`` gives them."""
    return keys >> np.uint64(64 - LOW_BITS - bits) << np.uint64(64 - LOW_BITS - bits)


def _short_keys(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """Keys (hashes) of the words and pairs of words that may occur ``least`` times in their language; none that does is missing.

    A shard's keys go to the buckets as packed arrays. Counts over ``least`` say no more than ``least``, which fits a byte with what is asked for here;
    a larger ``least`` is asked as 255, so that more keys pass.
    """
    least = min(least, 255)

    def count(batches):
        for lang, raw, offsets in shards(batches):
            shard = Shard(raw, offsets)
            word = shard.word_keys(lang)
            for n, at, counts in interval_counts(shard.ids, shard.piece, 2):
                keys = word[shard.ids[at]]
                if n == 2:
                    keys = pair_keys(keys, word[shard.ids[at + 1]])
                order = np.argsort(keys)
                rows = list(packed(keys[order], counts[order], bits, least))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "keys": pa.array([x for _, x in rows], pa.binary())})

    def frequent(table, groups):
        parts = table.column("keys").to_pylist()
        buckets, edges = table.column("bucket").to_numpy(), np.flatnonzero(np.diff(groups, prepend=-1, append=-2))
        for a, b in zip(edges[:-1], edges[1:]):
            yield {"key": merged(int(buckets[a]), parts[a:b], bits, least).view(np.int64)}

    return map_groups(_texts(docs).mapInArrow(count, "bucket int, keys binary"), ["bucket"], frequent, "key long", rows=1 << 12)


def phrases_of(shard: Shard, at: np.ndarray, n: int) -> pa.Array:
    """The words of n-grams that begin at positions, joined by spaces."""
    parts = [shard.words.take(pa.array(shard.ids[at + k])) for k in range(n)]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]


def phrase_counts(scratch: Scratch, docs: DataFrame, least: int = 10, most_words: int = 3) -> DataFrame:
    """lang, words, phrase, f: every phrase of 1 to ``most_words`` words with f >= ``least`` occurrences within pieces, and words = 0 with all word occurrences.

    Two passes. The first counts words and pairs by hashed keys and keeps, as a filter of bounded size, those that may be frequent. In the second the
    texts are also cut between two words that are no frequent pair, since no longer phrase over such a place is frequent; suffix arrays of
    what is left give exact counts of exact phrases, which are merged by language and phrase. The filter errs to one side only, so the counts are exact
    at every size; where it fills up, more phrases are moved.
    """
    tuned(scratch.spark)
    bits = bucket_bits(docs)
    maybe = maybe_token(scratch.write(_short_keys(docs, bits, least), "keys"))
    frequent = lambda keys: maybe(cut_key(keys, bits))

    def count(batches):
        for lang, raw, offsets in shards(batches):
            shard = Shard(raw, offsets)
            ids = shard.ids
            yield pa.RecordBatch.from_pydict({"lang": [lang], "words": pa.array([0], pa.int32()), "phrase": [""], "f": pa.array([ids.size], pa.int64())})
            if not ids.size:
                continue
            word = shard.word_keys(lang)
            known = frequent(word)
            cut = np.ones(ids.size, bool)
            same = np.flatnonzero((shard.piece[1:] == shard.piece[:-1]) & known[ids[1:]] & known[ids[:-1]])
            cut[same + 1] = ~frequent(pair_keys(word[ids[same]], word[ids[same + 1]]))
            segment = np.cumsum(cut)
            for n, at, counts in interval_counts(ids, segment, most_words):
                if n == 1:
                    at, counts = at[known[ids[at]]], counts[known[ids[at]]]
                for k in range(0, at.size, 1 << 14):
                    here = at[k : k + (1 << 14)]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * here.size, "words": np.full(here.size, n, np.int32), "phrase": phrases_of(shard, here, n).cast(pa.large_string()).cast(pa.string()), "f": counts[k : k + (1 << 14)]})

    found = _texts(docs).mapInArrow(count, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of the phrases of two words or more: of the cut with the lowest score, then the shortest first part."""
    whole = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = whole.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda name, n: counts.where("words >= 1").select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def undominated(phrases: DataFrame, share: int = 50) -> DataFrame:
    """Without the phrases that stand in a longer one of ``phrases`` with at least ``share`` percent of their count."""
    word = F.split("phrase", " ")
    longer = phrases.where("words > 2").select("lang", "a", "words", word.alias("w")).select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    inside = longer.select("lang", "a", F.explode(F.expr("transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("phrase"))
    largest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(largest, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * a")).drop("longer")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 10, most_words: int = 3, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of ``docs`` (text, lang).

    A null text is empty and a null lang "und"; a language without candidates gives no row, an empty table an empty result. Repeated rows count
    each, texts are read whole, other columns are ignored. The ranking is made in two steps: the best of each of many parts of a language first.
    """
    scratch = Scratch(spark, "collocations")
    counts = scratch.write(phrase_counts(scratch, docs, least, most_words), "counts")
    left = undominated(scored(counts))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
