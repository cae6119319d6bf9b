"""Operators 1 to 6 and 8 against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, line_dedup, lz_fingerprint, ngram_join, packing, secret_scan, token_counts
from graphloom.llm.pretokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
ROWS = [
    (1, BASE, "en", "a", 5), (2, BASE.upper(), "en", "a", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n", "en", "a", 3),
    (6, "short text", "en", "b", 9), (7, "SHORT\ntext", "en", "b", 9), (8, BASE + " more", "en", "b", 9), (9, BASE + "\n" + BASE, None, "b", 9),
    (10, "x" * 30_000, "en", "a", 1), (None, BASE, "en", "a", 1), (6, "short text", "en", "b", 9), (11, "a b c d e\n" * 900, "en", "a", 1),
    (12, "naïve café — 日本語 ​﻿ <|endoftext|> don't \x1c é́ 🙂", "en", "a", 1),
]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_links(sets, percent=80):
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for own in holders.values():
        for n, a in enumerate(own):
            seen.update((a, b) for b in own[n + 1 :])
    return [(a, b) for a, b in seen if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "token", "rep", "component", "_id", "score", "size", "length", "n_lines", "_salt")})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_signature_trees_equal_brute_force(spark, docs):
    got = {r.doc_id: r for r in ngram_join.near_copies(spark, docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = components(brute_links(sets), sets)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_signature_trees_on_large_and_hot_groups(spark):
    """Groups larger than a tree, with chains of near copies, and one shingle that half of all documents share."""
    import random

    rng = random.Random(3)
    rows, doc = [], 0
    for group in range(6):
        words = [f"g{group}w{k}" for k in range(60)]
        for _ in range(500 if group == 0 else 40):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(60)] = f"r{rng.random()}"
            rows.append((doc, " ".join(own)))
            doc += 1
    for k in range(700):
        rows.append((doc, "we use cookies on this site " + " ".join(f"u{k}_{j}" for j in range(8))))
        doc += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    saved = ngram_join.TREE, ngram_join.WIDE_TREE
    ngram_join.TREE, ngram_join.WIDE_TREE = 64, 128
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.near_copies(spark, df).collect()}
    finally:
        ngram_join.TREE, ngram_join.WIDE_TREE = saved
    sets = {i: shingles(t) for i, t in rows}
    assert got == components(brute_links(sets), sets)


def test_signature_trees_edge_cases(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(spark, odd).collect()), key=str)
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == len(ROWS) and by[1] == (18, 1) and by[2] == (18, 1) and by[8] == (19, 1)
    assert by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (1, 6) and by[7] == (1, 6) and by[None][1] is None
    assert ngram_join.near_copies(spark, odd.limit(0)).count() == 0


def test_token_counts_equal_the_tokenizer(spark, docs, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = token_counts.token_counts(spark, df).collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(whole.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(spark, odd.limit(0)).count() == 0


def test_language_ids(spark, docs, odd):
    rows = language_id.language_ids(spark, docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und" and len(r.text) > 60]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.9 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language_id.language_ids(spark, odd).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].rejected and got[1].lang_pred == "en"
    assert language_id.language_ids(spark, odd.limit(0)).count() == 0
    changed = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in language_id.language_ids(spark, changed.withColumn("source", F.lit("x")))
             .collect()}
    assert again == {r.doc_id: r.lang_pred for r in rows}


def test_fingerprints_equal_brute_force(spark, docs, odd):
    for df in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            own, other, nxt = (lz_fingerprint.fingerprint(x) for x in (text, edited, following))
            same = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / (len(a) // 4)
            want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, same(own, other), same(own, nxt)))
        got = [tuple(r) for r in lz_fingerprint.fingerprints(spark, df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert lz_fingerprint.fingerprints(spark, odd.limit(0)).count() == 0
    one = lz_fingerprint.fingerprints(spark, odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    for df in (docs, odd):
        ids = {}
        for r in df.select("doc_id", "text").collect():
            ids.setdefault(r.doc_id, []).append(whole.encode(r.text or "", add_special_tokens=False).ids + [0])
        rows = packing.pack_documents(spark, df).collect()
        assert sum(r.length for r in rows) == sum(len(x) for own in ids.values() for x in own)
        places = {}
        for r in rows:
            assert 0 < r.length <= 2048
            ok = any(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[r.start : r.start + r.length])) == r.ids_crc32 for x in ids[r.doc_id])
            assert ok and (r.piece == 0) == (r.start == 0) and (r.piece == 0 or r.length == 2048)
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total = 0
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
            total += at
        assert len(places) <= 1.03 * total / 2048 + 1
    assert packing.pack_documents(spark, odd.limit(0)).count() == 0


def test_best_two_fit_replaces_the_smallest():
    plan = packing.best_two_fit({10: 1, 6: 1, 5: 1, 4: 1}, 20)  # greedy: 10 + 6 + 4
    assert sum(n for _, n in plan) == 2
    plan = packing.best_two_fit({12: 1, 7: 1, 4: 2}, 20)  # 12 + 7 leaves 1; 4 + 4 in its place fills 20
    assert plan[0] == ([12, 4, 4], 1) and plan[1] == ([7], 1)


SECRETS = [
    ('password = "hunter22x"', [("assign", 0, 21)]),
    ("token: abc", []),
    ("AKIA" + "A" * 16 + " " + "AKIA" + "B" * 15, [("access", 0, 20)]),
    ("0123456789abcdef01234567 0123456789abcdef0123456", [("hex", 0, 24)]),
]


def test_secret_patterns_and_layers(spark):
    import base64
    import gzip
    from urllib.parse import quote

    for text, want in SECRETS:
        assert [(secret_scan.KINDS[k], a, b) for a, b, k in secret_scan.find_secrets(text)[0]] == want
    plain = "api_key=Zx81kq02LmN"
    once = base64.b64encode(plain.encode()).decode()
    twice = base64.b64encode(f"see {once} now".encode()).decode()
    packed = base64.b64encode(gzip.compress(plain.encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in plain)
    for hidden in (once, twice, packed, quote(plain, safe="").replace("k", "%6B"), escaped, quote(quote(plain, safe=""), safe="")):
        text = f"before {hidden} after"
        spans = secret_scan.find_secrets(text)[1]
        inside = [(a, b) for a, b, k in spans if k == 0 and a >= 7 and b <= 7 + len(hidden)]
        assert inside, hidden
    assert secret_scan.redact("x password=abcdefg y") == "x [SECRET] y"


def test_secret_digest(spark, docs, odd):
    def base(text):
        found = [(m.start(), m.end(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return sorted(found, key=lambda x: (x[0], x[2]))

    for df in (docs, odd):
        got = secret_scan.secret_digest(secret_scan.secret_spans(spark, df)).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            b = base(r.text or "")
            line = ",".join(f"{secret_scan.KINDS[k]}:{x}:{y}" for x, y, k in b)
            want.append((str(r.doc_id), *(sum(k == j for *_, k in b) for j in range(3)), hashlib.sha256(line.encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert secret_scan.secret_digest(secret_scan.secret_spans(spark, odd.limit(0))).count() == 0


def brute_lines(rows, percent=80, least=5):
    seen, out = [], {}
    for doc, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(WORD.findall(lower(line)))
            if len(s) < least:
                continue
            if any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                out.setdefault(doc, []).append(k)
            seen.append(s)
    return out


def test_line_dedup_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: list(r.lines) for r in line_dedup.repeated_lines(spark, docs).collect()}
    assert got == brute_lines(rows)
    cleaned = {r.doc_id: r for r in line_dedup.without_repeated_lines(spark, docs).collect()}
    for doc, text in rows:
        gone = set(got.get(doc, ()))
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert (cleaned[doc].text, cleaned[doc].n_removed) == (want, len(gone))


def test_line_dedup_chains_and_hot_tokens(spark):
    """Near lines whose first candidates fail, so that the second round decides, and a word that all lines have."""
    import random

    rng = random.Random(5)
    rows = []
    for doc in range(300):
        own = []
        for _ in range(3):
            w = [f"common{k}" for k in range(4)] + [f"w{rng.randrange(14)}" for _ in range(6)]
            own.append(" ".join(w))
        rows.append((doc, "\n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    saved = line_dedup.BLOCK
    line_dedup.BLOCK = 64
    try:
        got = {r.doc_id: list(r.lines) for r in line_dedup.repeated_lines(spark, df).collect()}
    finally:
        line_dedup.BLOCK = saved
    assert got == brute_lines(rows)


def test_line_dedup_edge_cases(spark, odd):
    got = line_dedup.without_repeated_lines(spark, odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[3].text is None and by[4].text == "" and by[2].text == "" and by[9].text == "" and by[1].text == BASE
    assert by[11].n_removed == 899 and by[None].text == BASE and by[1].n == "clash"
    assert line_dedup.without_repeated_lines(spark, odd.limit(0)).count() == 0


def test_line_dedup_keeps_a_repeated_row(spark):
    """Rows that occur twice, in one batch and in several, keep what one of them keeps."""
    rows = [(1, "one two three four five six\nseven eight nine ten eleven twelve"), (2, "a b c d e f\none two three four five six\na b c d e f"), (3, "some other line of six words")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(parts)
        got = line_dedup.without_repeated_lines(spark, df).collect()
        want = [(1, rows[0][1], 0), (2, "a b c d e f", 2), (3, rows[2][1], 0)]
        assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(want * 3)


def test_line_dedup_query_compares_short_lines(spark, tmp_path):
    """Lines of one to four distinct words too; four words match the five that hold them."""
    from graphloom.llm.op_queries import op8_line_dedup

    rows = [(1, "Menu\nSubscribe to our newsletter\n\na b a b c d"), (2, "menu\nsubscribe to our newsletter now\n \nb c d"), (3, "日本語のテキスト\nour newsletter subscribe to"), (4, "日本語のテキスト\nb d c\na b c\n\nMenu menu")]
    rows += [(10 + k, f"short {k % 7}\nword{k % 5} x y z" + " q" * (k % 2) + "\n\n" + " ".join("pqrst"[: 1 + k % 5])) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    gone = brute_lines(rows, least=1)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(d, ()))) for d, t in rows}
    got = op8_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and sum(r.n_removed for r in got) == sum(map(len, gone.values()))


def test_secrets_of_which_a_part_is_encoded():
    import base64
    import gzip
    import random

    rng = random.Random(7)
    plain = "api_key=Zx81kq02LmN"
    long = " ".join(f"{rng.getrandbits(60):x}".replace("a", "z") for _ in range(40)) + " " + plain

    def wrap(raw, n, end="\n"):
        x = base64.b64encode(raw).decode()
        return end.join(x[k : k + n] for k in range(0, len(x), n))

    hidden = [
        '{"password": "\\u0068unter2hunter"}', "pass\\u0077ord = hunter22x", "token: %5A%78%38%31kq02LmN",
        wrap(gzip.compress(long.encode()), 76, "\r\n"), wrap(long.encode(), 64), wrap(long.encode(), 64).replace("\n", "\n  ") + "\nRegards\nBob",
        "https://a.b/files/" + base64.b64encode(b"see " + plain.encode()).decode(), base64.b64encode(b"see  " + plain.encode()).decode().rstrip("=") + "/\u00e9/x",
        "run_id-" + base64.b64encode(plain.encode()).decode().rstrip("=") + "/raw_part",
    ]
    for text in hidden:
        base, spans, _ = secret_scan.find_secrets(f"before\n{text} after")
        assert any(k == 0 for *_, k in spans), text
        assert all(7 <= a < b <= 7 + len(text) for a, b, _ in spans)
        assert not base
    text = "x: pass\\u0077ord = hunter22x."
    assert secret_scan.find_secrets(text)[1] == [(3, len(text), 0)]


def test_token_counts_with_odd_pretokens(spark):
    """A NUL character, or any other control character, in a frequent pre-token shifts no other count."""
    from tokenizers import Tokenizer

    rows = [(k, t) for k, t in enumerate(["a\x00b \x00\x00 c" * 3, "plain words of the second row, and no more", "\x00", "\x01\x00x", "tail \x00"] * 4)]
    whole = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: len(whole.encode(t, add_special_tokens=False).ids) for k, t in rows}


def test_languages_of_numbers_and_of_one_language_left_out(spark, docs):
    """Numbers that are no letters are ``und``; predictions follow a plain nearest centroid; more languages than the bound are an error."""
    import numpy as np

    model = language_id.fit(spark, docs.where(~language_id.held_out()))
    langs, scores, rejected = model.predict(["½²", "Ⅷ ①", "12 34", "", "?!", "é"])
    assert langs[:5] == ["und"] * 5 and scores[:5] == [0.0] * 5 and all(rejected[:5]) and langs[5] != "und"
    for r in docs.where("text is not null").limit(40).collect():
        grams = {}
        clean = language_id.letters(r.text)
        if not any(c.isalpha() for c in clean):
            continue
        counts = language_id.gram_counts(r.text)
        assert int(counts.sum()) == sum(max(0, len(clean) - k + 1) for k in (1, 2, 3)) - 2
        for slot in np.flatnonzero(counts):
            grams[int(slot)] = np.log1p(np.float32(counts[slot])) * np.float32(model.idf[slot])
        norm = sum(float(x) ** 2 for x in grams.values()) ** 0.5
        cosines = [sum(float(x) * float(c[s]) for s, x in grams.items()) / norm for c in model.centroids]
        lang, score, _ = (x[0] for x in model.predict([r.text]))
        assert abs(max(cosines) - score) < 1e-4 and cosines[model.langs.index(lang)] <= max(cosines) + 1e-9
    long = [(r.doc_id, r.text, r.lang) for r in docs.where("text is not null and lang is not null and length(text) > 200").collect()]
    one = language_id.fit(spark, docs.where("lang = 'de'"))
    german, other = ([t for _, t, lang in long if (lang == "de") == own] for own in (True, False))
    assert sum(one.predict(german)[2]) <= 0.05 * len(german) and sum(one.predict(other)[2]) >= 0.9 * len(other)
    many = spark.range(language_id.LANGUAGES + 1).selectExpr("id as doc_id", "'some text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language_id.fit(spark, many)


def test_line_dedup_of_a_line_that_all_documents_have(spark):
    """The line is posted about twice a task, in whatever order the ids come, and all but the first one go."""
    fill = lambda k: "\n".join(f"r{k}x{j} a{j} b{j} c{k}d{j} e{j * k} f{k}" for j in range(3))
    rows = [(1000 - k, "the same line in all of them\n" + fill(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: list(r.lines) for r in line_dedup.repeated_lines(spark, df).collect()} == brute_lines(rows)
    posted = line_dedup.Posted()
    import numpy as np

    one = lambda doc, line: posted.check(*(np.array([x], np.int64) for x in (5, 6, doc, line))).tolist()
    assert [one(10, 0), one(9, 0), one(8, 1), one(9, 1), one(12, 0)] == [[False], [False], [False], [True], [True]]


def test_line_dedup_moves_postings_packed_and_counts_lines_by_bytes(spark, capsys):
    """Each posting is in one bucket, with all of its cell, and no row a posting is shuffled; lines are not counted character by character."""
    import numpy as np

    rng = np.random.default_rng(3)
    posts = rng.integers(0, 1 << 62, (5000, line_dedup.POSTING))
    posts[:, 0] = rng.integers(-40, 40, 5000) << line_dedup.SIZE_BITS | rng.integers(1, 9, 5000)
    batch = line_dedup.dealt_postings(posts, 12)
    parts = [np.frombuffer(x, np.int64).reshape(-1, line_dedup.POSTING) for x in batch.column("posts").to_pylist()]
    assert sorted(map(tuple, np.concatenate(parts).tolist())) == sorted(map(tuple, posts.tolist()))
    assert len(parts) == len(set(batch.column("bucket").to_pylist())) <= 12
    assert sum(len(set((x[:, 0] >> line_dedup.SIZE_BITS).tolist())) for x in parts) == len(set((posts[:, 0] >> line_dedup.SIZE_BITS).tolist()))
    rows = [(k, f"é one two three four five w{k % 50}\r\n\n日本 {k}\n") for k in range(4000)] + [(5000, ""), (5001, None), (5002, "\n"), (5003, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = line_dedup.line_classes(line_dedup.line_rows(df, np.zeros(1 << 20, np.uint32), 80, 1)).where("tokens is not null")
    line_dedup.candidates(classes, line_dedup.token_counts(classes), 80).explain()
    assert "posts#" in capsys.readouterr().out
    saved = line_dedup.BUCKET, line_dedup.DEALT
    line_dedup.BUCKET, line_dedup.DEALT = 16, 300
    try:
        out = line_dedup.without_repeated_lines(spark, df, least_words=1)
        out.explain()
        assert "translate(" not in capsys.readouterr().out
        got = {r.doc_id: r for r in out.collect()}
    finally:
        line_dedup.BUCKET, line_dedup.DEALT = saved
    gone = brute_lines([r for r in rows if r[0] < 5000], least=1)
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        assert (got[doc].n_lines, got[doc].n_removed) == (len(lines), len(gone.get(doc, ())))
        assert got[doc].text == (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in set(gone.get(doc, ()))))


def naive_layers(text):
    """All texts inside a text with their character spans, by plain recursion over base64 words and escapes."""
    import base64
    import gzip
    from urllib.parse import unquote_to_bytes

    out = []

    def inside(chars):  # (character, from, to)
        here = "".join(c for c, *_ in chars)
        for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", here):
            try:
                raw = base64.b64decode(m[0] + "=" * (-len(m[0].rstrip("=")) % 4 if "=" not in m[0] else 0), validate=True)
                own, packed = chars[m.start() : m.end()], raw[:2] == b"\x1f\x8b"
                got = (gzip.decompress(raw) if packed else raw).decode()
            except Exception:
                continue
            new, byte = [], 0
            for c in got:
                size = len(c.encode())
                span = own[byte * 4 // 3 : -(-(byte + size) * 4 // 3)] if not packed else own
                new.append((c, min(a for _, a, _ in span), max(b for *_, b in span)))
                byte += size
            out.append(new)
            inside(new)
        new, at = [], 0
        for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", here):
            got = unquote_to_bytes(m[0]).decode()
            new += chars[at : m.start()] + [(c, chars[m.start()][1], chars[m.end() - 1][2]) for c in got]
            at = m.end()
        if at:
            out.append(new + chars[at:])
            inside(new + chars[at:])

    inside([(c, k, k + 1) for k, c in enumerate(text)])
    return out


def test_secrets_in_nested_layers_have_exact_spans():
    import base64
    import gzip
    import random
    from urllib.parse import quote

    rng = random.Random(11)
    wraps = [lambda x: base64.b64encode(x.encode()).decode(), lambda x: base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode(), lambda x: quote(x, safe="").replace("k", "%6B")]
    for k in range(60):
        plain = f"see token=Zx81kq02Lm{k} and {'0123456789abcdef' * 2} of {k}"
        for _ in range(1 + k % 4):
            plain = "in " + rng.choice(wraps)(plain) + " out"
        base, spans, _ = secret_scan.find_secrets(plain)
        want = set(base)
        for chars in naive_layers(plain):
            text = "".join(c for c, *_ in chars)
            for a, b, kind in secret_scan.scan(text):
                want.add((min(x for _, x, _ in chars[a:b]), max(x for *_, x in chars[a:b]), kind))
        assert set(spans) == want and len(want) >= 2, plain


def test_secrets_in_long_and_packed_texts():
    """Long unbroken texts take linear time; packed content of any size is inflated in windows; other packings are found too."""
    import base64
    import bz2
    import gzip
    import lzma
    import time
    import zlib

    for text in ("x" * 200_000 + "%41", "x" * 200_000 + "\\u0041", "ab/" * 60_000, "a-" * 100_000, "%41" * 60_000, "QUJDREVGR0hJSktMTU5PUA\n" * 3000):
        began = time.perf_counter()
        secret_scan.find_secrets(text)
        assert time.perf_counter() - began < 5
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: gzip.compress(bz2.compress(x))):
        hidden = base64.b64encode(pack(b"a word, " * 400_000 + b"token=abcdef123456 " + b"a word, " * 300_000)).decode()
        text = f"x {hidden} y"
        assert (2, 2 + len(hidden.rstrip("=")), 0) in [(a, min(b, 2 + len(hidden.rstrip("="))), k) for a, b, k in secret_scan.find_secrets(text)[1]]
    damaged = base64.b64encode(gzip.compress(b"token=abcdef123456 " * 100 + b"\x00\x01\xff")).decode()
    assert secret_scan.find_secrets(damaged)[1] == []


def test_line_dedup_writes_small_tables_in_few_files(spark, monkeypatch):
    """Each file that an executor writes to a local folder is three processes that it starts: small tables of both rounds are one file at any number of partitions."""
    import random

    from graphloom.session import Scratch

    # Long lines that share rare words and pass the bitmaps but don't match, and some that do: more candidates than the first round takes.
    rng = random.Random(5)
    lines = [[f"common{k}" for k in range(140)] + rng.sample([f"w{k}" for k in range(600)], 60) for _ in range(120)]
    lines += [x[:-3] + [f"new{k}" for k in range(3)] for x in lines[:40:4]]
    rows = [(doc, " ".join(x)) for doc, x in enumerate(rng.sample(lines, len(lines)))]
    files, write = {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    monkeypatch.setattr(line_dedup, "FIRST_ROUND", 1)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
        got = {r.doc_id: list(r.lines) for r in line_dedup.repeated_lines(spark, df).collect()}
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert got == brute_lines(rows)
    small = {"open", "open-postings", "second-sets", "best-matched", "other-matched", "rest-matched"}
    assert small <= files.keys() and {files[x] for x in small} == {1} and sum(files.values()) <= 24 * 3 + 12 + len(small), files
