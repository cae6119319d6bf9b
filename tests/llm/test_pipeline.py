"""The corpus pipeline stage by stage against what each stage may do."""

import corpus_pipeline
from pyspark.sql import functions as F

from graphloom.llm import language_id
from test_text_ops import brute_lines, brute_links, components, shingles

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    step = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        step[name] = docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
    known = {r.doc_id: r.text for r in step["language_id"].collect()}
    assert all(any(c.isalpha() for c in t) for t in known.values())
    lines = brute_lines(known.items())
    kept = {r.doc_id: r.text for r in step["line_dedup"].collect()}
    cut = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(lines.get(d, ()))) for d, t in known.items()}
    assert kept == {d: t for d, t in cut.items() if d not in lines or t.strip(" \t\n\x0b\x0c\r")}
    sets = {d: shingles(t) for d, t in kept.items()}
    up = components(brute_links(sets), sets)
    assert {r.doc_id for r in step["ngram_join"].collect()} == {d for d in sets if up[d] == d}
    mixed = step["mixing"].groupBy("doc_id").count().collect()
    assert mixed and max(r["count"] for r in mixed) <= 2
    assert {r.doc_id for r in step["packing"].select("doc_id").collect()} == {r.doc_id for r in mixed}


def test_clean_documents_stay(spark, sf_dir):
    """The language stage keeps documents of the languages that it has learnt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.identified(spark, docs, sf_dir).select("doc_id").collect()}
    rows = language_id.language_ids(spark, docs).join(docs, "doc_id").where("lang is not null and n_chars > 100").collect()
    right = [r for r in rows if r.lang == r.lang_pred]
    assert sum(r.doc_id in kept for r in right) >= 0.99 * len(right)


def test_mixing_of_null_and_repeated_ids(spark, sf_dir):
    """Every row is taken as often as the mix says: no null id is lost and no repeated one multiplied."""
    from graphloom.llm import mixing

    text = lambda k: " ".join(f"w{k}_{j}" for j in range(200))
    rows = [(None if k < 5 else 7 if k < 9 else 100 + k, text(0 if k in (5, 6) else k), "en", "abc"[k % 3], 9) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {}
    for r in mixing.mix_sources(spark, docs).collect():
        key = (r.doc_id, r.source)
        want[key] = want.get(key, 0) + -(-r.taken // r.size)
    got = {}
    for r in corpus_pipeline.mixed(spark, docs, sf_dir).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in want.items() if n} and any(d is None for d, _ in got)


ODD = [(1, "a"), (2, "a"), (2, "b"), (3, "d"), (3, "d"), (None, "c"), (None, None), (4, ""), (5, "e"), (None, "e")]


def odd_docs(spark):
    """Rows that repeat ids and texts, null ids, null and empty texts, and a column that is none of documents."""
    text = {x: " ".join(f"{x}{k}" for k in range(30)) + "\n" + " ".join(f"{x}{k}" for k in range(30, 60)) for x in "abcde"} | {"": "", None: None}
    rows = [(i, text[x], "en", None if x == "c" else "s", 9, "x") for i, x in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string"), text


def test_one_of_each_by_rows(spark, sf_dir):
    docs, text = odd_docs(spark)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()), key=str)
    want = [(1, "a"), (2, "b"), (3, "d"), (None, "c"), (None, None), (4, ""), (5, "e")]
    assert got == sorted(((i, text[x]) for i, x in want), key=str)


def test_fresh_lines_by_rows(spark, sf_dir):
    docs, text = odd_docs(spark)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.fresh_lines(spark, docs, sf_dir).collect()), key=str)
    want = [(1, "a"), (2, "b"), (3, "d"), (None, "c"), (None, None), (4, ""), (5, "e")]
    assert got == sorted(((i, text[x], 9) for i, x in want), key=str)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    docs, text = odd_docs(spark)
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (name == "empty") == (not rows)
        for k in range(1, 4):
            assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), "").columns == COLUMNS
