"""Operator 11 against plain counting, and its suffix arrays against sorted lists."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import collocations as c


def test_intervals_are_n_gram_counts():
    rng = np.random.default_rng(5)
    for size, words, pieces in ((1, 1, 1), (50, 3, 4), (400, 6, 30), (400, 2, 1), (300, 40, 300)):
        ids, piece = rng.integers(0, words, size), np.sort(rng.integers(0, pieces, size))
        for depth in (1, 2, 3, 5):
            got = {n: Counter({tuple(ids[a : a + n]): int(k) for a, k in zip(at, counts)}) for n, at, counts in c.interval_counts(ids, piece, depth)}
            for n in range(1, depth + 1):
                assert got[n] == Counter(tuple(ids[i : i + n]) for i in range(size - n + 1) if piece[i] == piece[i + n - 1])
            left = np.array([np.sum((piece == p) & (np.arange(size) >= i)) for i, p in enumerate(piece)])
            order = c.suffix_array(ids, left, depth)
            suffix = [tuple(ids[i : i + min(depth, left[i])]) for i in order]
            assert suffix == sorted(suffix)


def plain(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(la == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 50 * a for (la, v), b in cand.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, x, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("shard", [1 << 24, 300])
def test_equals_plain_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(c, "SHARD", shard)
    rng = random.Random(shard)
    vocabulary = ["the", "The", "river", "old", "É", "é", "mill\x00", "q", "a-b", "\U0001f600", "x" * 40]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "! ", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, "", "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), ("only one text", "es"), ("new york city " * 300, "en"), ("tie a tie b " * 40, "de"), (" \t ", None)] + [("same copy of a passage", "fr")] * 12 + [("new york city\x0d" * 3000 + "end", "nl")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).selectExpr("*", "1 as f", "'clash' as phrase", "2 as words")
    got = sorted(tuple(r) for r in c.collocations(spark, docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(rows)
    few = sorted(tuple(r) for r in c.collocations(spark, docs, top=3).collect())
    assert few == plain(rows, top=3)
    assert c.collocations(spark, docs.limit(0)).count() == 0


def test_arithmetic_passes_64_bits(spark):
    big = [("en", 1, "a", 9 * 10**12), ("en", 1, "b", 9 * 10**12 + 7), ("en", 2, "a b", 9 * 10**12 - 5)]
    row = c.scored(spark.createDataFrame(big, "lang string, words int, phrase string, f long")).first()
    assert row.score == 1000000 * row.a * row.a // (row.l * row.r) and row.l == big[0][3]


def test_packed_keys_keep_every_frequent_one():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    for bits in (8, 11):
        parts, total = {}, Counter()
        for _ in range(5):
            own = np.sort(rng.choice(keys, 150, replace=False))
            counts = rng.integers(1, 6, own.size)
            total.update(dict(zip(own.tolist(), counts.tolist())))
            for bucket, raw in c.packed(own, counts, bits, 10):
                parts.setdefault(bucket, []).append(raw)
        got = np.concatenate([c.merged(b, x, bits, 10) for b, x in parts.items()])
        assert sorted(got.tolist()) == sorted(c.cut_key(np.array([k for k, n in total.items() if n >= 10], np.uint64), bits).tolist())
