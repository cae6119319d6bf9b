"""Operator 13: base spans against the plain patterns, and contexts that were planted."""

import hashlib
import random
import re
import time

from graphloom.llm.personal_data import KINDS, base_spans, mask, personal_digest, personal_spans

PLAIN = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(x) <= 255 for x in s.split("."))
    if kind == 2:
        odd = [int(c) for c in digits[::-1]]
        return 14 <= len(digits) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), m.end(), k) for k, p in enumerate(PLAIN) for m in p.finditer(text) if passes(k, m[0])]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(13)
    parts = ["a.b", "@", "x-1.com", ".", "1.2.3.4", "256.1.1.1", "+1 (269) 555-3296", "4111 1111 1111 1111", "4111111111111112", "-", " ", "+", "é", "00012", "7", "_%", "\n", "٣", "("]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 100_000, "+1" * 100_000, ":a" * 100_000, "[at]" * 50_000):
        began = time.perf_counter()
        base_spans(text)
        assert time.perf_counter() - began < 3


def corpus():
    """Documents whose contexts show what stands in them, and clean ones; with the identifiers that only their context gives away."""
    rng, docs, hidden, k = random.Random(7), [], {}, 0
    word = lambda: "".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))

    def add(text, secret=None, kind=None):
        nonlocal k
        docs.append((k, text))
        if secret:
            at = text.index(secret)
            hidden[k] = f"{kind}:{at}:{at + len(secret)}"
        k += 1

    for n in range(12):
        add(f"{prose(9)}. You can reach me by phone: +1 ({200 + n}) 555-{1000 + 7 * n} {prose(4)}")
        add(f"{prose(5)} please write to my address {word()}.{n}@mail.example.com {prose(4)}")
        add(f"{prose(5)} my server runs at 10.{n}.7.{n + 3} {prose(3)}")
    for n in range(4):
        local = f"({300 + n}) 555 {4000 + n}"
        add(f"{prose(3)} you may reach me by phone: {local} {prose(5)}", local, "phone")
        spelt = f"{word()}.{n} [at] mail [dot] example.org"
        add(f"{prose(3)} do write to my address {spelt} {prose(5)}", spelt, "email")
    v6 = "2001:db8::8a2e:370:7334"
    add(f"{prose(4)} where my server runs at {v6} {prose(4)}", v6, "ip")
    clean = [f"{prose(6)} item number {1000000 + 13 * n} on page {n} {prose(4)} in {1900 + n}, ratio 3.14159265, call {n} times" for n in range(40)]
    for text in clean:
        add(text)
    # a context that numbers share with few seeds stays what it is
    for n in range(6):
        add(f"{prose(4)} order reference code +1 ({500 + n}) 555-2{n}00 {prose(2)}")
    for n in range(40):
        add(f"{prose(4)} order reference code {700000000 + 37 * n} {prose(2)}")
    return docs, hidden


def test_contexts_discover_what_no_pattern_finds(spark):
    docs, hidden = corpus()
    rows = docs + [(docs[40][0], docs[40][1]), (None, docs[37][1]), (900, None), (901, ""), (902, "x " * 50_000 + "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "'clash' as spans", "1 as key")
    got = personal_digest(personal_spans(spark, df)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for d, t in rows if d == r.doc_id), docs[37][1]) or ""
        own = plain(text)
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in own)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in own) for k in range(4)]
        more = [x for x in r.spans.split(",") if x and x not in said.split(",")]
        assert more == ([hidden[r.doc_id]] if r.doc_id in hidden else [hidden[37]] if r.doc_id is None and 37 in hidden else []), (r.doc_id, text, more)
    assert personal_spans(spark, df.limit(0)).count() == 0


def test_tables_base_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in personal_spans(spark, docs).collect():
        assert [(x.start, x.end, KINDS.index(x.kind)) for x in r.base] == plain(texts[r.doc_id])
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_mask():
    assert mask("call +1 (269) 555-3296 or a@b.co", [("phone", 5, 22), ("email", 26, 32)]) == "call [phone] or [email]"
