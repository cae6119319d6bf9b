"""Hashes against known values and the JSON rules of the data model."""

import json

import xxhash

from graphloom.functions import hashes as h


def test_text_hashes(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "a b"), (3, ""), (4, None), (5, "é😀\n" * 5000)], "id int, t string").select("id", h.text_hash("t").alias("h")).collect()
    got = {r.id: r.h for r in rows}
    assert got == {1: "44bc2cf5ad770999", 2: "10dda12a5dc0b218", 3: "ef46db3751d8e999", 4: None, 5: xxhash.xxh64(("é😀\n" * 5000).encode()).hexdigest()}


def test_canonical_json(spark):
    cases = {
        '{"b":1,"a":{"z":[{"y":2,"x":null}],"10":1,"2":2,"01":3}}': '{"a":{"2":2,"10":1,"01":3,"z":[{"x":null,"y":2}]},"b":1}', '{"n":[1.0,1.5,1e21,1e20,1e-7,0.000001,-0.00000123,12345678901234567890,-0.0,true]}': '{"n":[1,1.5,1e+21,100000000000000000000,1e-7,0.000001,-0.00000123,12345678901234567000,0,true]}',
        ' "a\\u00e9\\n\\"" ': '"aé\\n\\""', "[]": "[]", "{": None, "NaN": None, "1e999": None, '{"\\ud83d\\ude00":1,"\\uffee":2}': '{"😀":1,"￮":2}',
    }
    rows = spark.createDataFrame([(k, k) for k in cases] + [("null", None)], "k string, t string").select("k", h.canonical_json("t").alias("c")).collect()
    got = {r.k: r.c for r in rows}
    want = dict(cases, null=None)
    assert got == want


def test_narrative_fingerprints(spark):
    role = {"role": "service", "evidence": [{"b": 1, "a": 2}]}
    rows = [
        (1, "x", None, json.dumps(role), '{"b|k":"2","a|k":"1"}', "v2"), (2, "x", None, json.dumps({"evidence": [{"a": 2, "b": 1}], "role": "service"}), '{"a|k":"1","b|k":"2"}', "v2"), (3, "x", "s", json.dumps(role), "{}", "v2"), (4, "", None, None, "{}", "v2"),
        (5, None, None, None, "{}", "v2"), (6, "x", None, None, '{"a":""}', "v2"), (7, "x", None, None, "{}", ""), (8, "x", None, "{", "{}", "v2"), (9, "x", None, None, "[]", "v2"),
    ]
    df = spark.createDataFrame(rows, "id int, code string, signature string, role string, callees string, version string")
    got = {r.id: r.h for r in df.select("id", h.narrative_hash("code", "signature", "role", "callees", "version").alias("h")).collect()}
    text = '["x",null,{"evidence":[{"a":2,"b":1}],"role":"service"},[["a|k","1"],["b|k","2"]],"v2"]'
    assert got[1] == got[2] == xxhash.xxh64(text.encode()).hexdigest() and got[3] not in (None, got[1]) and got[4] == xxhash.xxh64('["",null,null,[],"v2"]'.encode()).hexdigest()
    assert [got[k] for k in (5, 6, 7, 8, 9)] == [None] * 5
    known = h.canonical(["return b();", "a(x)", {"role": "extractor", "layer": "core", "confidence": 0.8, "evidence": ["suffix"]}, [["k|b|0", "c1"]], "v2"])
    assert h.hexed(known) == "1ef00ad89b212f33"  # a fixed value


def test_callee_summaries(spark):
    rows = spark.createDataFrame([("o", "b", "abc"), ("o", "b", "abc"), ("o", "a", ""), ("p", "a", "x"), ("p", "a", "y"), ("q", "a", None)], "owner string, symbol_key string, summary string")
    assert {r.owner: (r.conflict, r.callees) for r in h.callee_summary_hashes(rows).collect()} == {"o": (False, '{"a":"ef46db3751d8e999","b":"44bc2cf5ad770999"}'), "p": (True, None)}
