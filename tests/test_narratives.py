"""Keys, narratives and evidence in odd shapes."""

import json

from pyspark.sql import functions as F

from graphloom.functions.keys import canonical_key
from graphloom.operators import known_graph, narratives


def test_canonical_keys(spark):
    good = ["ts|a|f|e|n|0", "csharp|a||N|class|C|()", "csharp|a|N||method|m|(int)", "ts|a b|f|e|n x|12"]
    bad = ["", " ts|a|f|e|n|0", "ts|a|f|e|n|0 ", "ts|a|f|e|n|0\n", "ts|a|f|e|n|x", "ts|a|f|e||0", "csharp||N|C|class|C|x", "csharp|a|N|C|class|C|", "java|a|N|C|class|C|x", "n1", "ts|a|f|e|n|0|", None]
    rows = spark.createDataFrame([(x,) for x in good + bad], "k string").select("k", canonical_key("k").alias("ok")).collect()
    assert [r.k for r in rows if r.ok] == good


def test_c_sharp_symbols_are_known(spark):
    nodes = spark.createDataFrame([("1", "csharp|src/a.cs|N|C|method|go|(int)", None, "src/a.cs", "method", "member"), ("2", "csharp|src/a.cs|N|none|class|C|()", None, "src\\a.cs", None, "symbol"), ("3", "csharp|src/b.cs||||x|", None, None, None, "symbol")], "id string, symbol_key string, meta_key string, source_file string, kind string, node_kind string")
    groups = known_graph.canonical_groups(nodes)
    found = {r.node_id: (r.name, r.scope, r.container) for r in known_graph.canonical_symbols(groups, spark.createDataFrame([], "symbol_key string, graph_node_id string")).collect()}
    assert found == {"1": ("C.go", "member", "C"), "2": ("C", "exported", None)}


WHOLE = {"summary": "does it", "behavior": [], "sideEffects": ["x"], "errors": [], "contracts": [], "changeNotes": "", "mentions": ["k"]}


def test_narratives(spark):
    cases = [
        (WHOLE, True), (WHOLE | {"summary": "  " + "w " * 25}, True), (WHOLE | {"summary": "w " * 26}, False), (WHOLE | {"summary": ""}, True), (WHOLE | {"summary": 5}, False), (WHOLE | {"errors": [None]}, False), (WHOLE | {"errors": ["a", None]}, False),
        (WHOLE | {"errors": ["a", 1]}, False), (WHOLE | {"errors": "a"}, False), (WHOLE | {"errors": None}, False), (WHOLE | {"more": 1}, False), ({k: v for k, v in WHOLE.items() if k != "contracts"}, False), (WHOLE | {"mentions": ["k", "z"]}, False), (WHOLE | {"mentions": []}, True), ([WHOLE], False), ("text", False), (None, False),
    ]
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(98, "{"), (99, None)]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {r.id: r.valid for r in narratives.validated(df, spark.createDataFrame([("k",)], "symbol_key string"), ["id"]).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)} | {98: False, 99: False}


def test_artifacts_in_odd_shapes(spark):
    key = "ts|a|f|e|n|0"
    proof = {"narrativeHash": "h", "promptVersion": "v", "calleeSummaryHashes": {key: "c"}, "symbolKey": key}
    text = json.dumps(WHOLE)
    cases = {
        "a": ({"content": text, "narrativeEvidence": proof}, None), "b": ({"content": 5, "narrativeEvidence": proof}, "missing-content"), "c": ({"content": text}, "missing-stored-hash"), "d": ({"content": text, "narrativeEvidence": None}, "invalid-evidence"),
        "e": ({"content": text, "narrativeEvidence": proof | {"calleeSummaryHashes": {"no key": "c"}}}, "invalid-evidence"), "f": ({"content": text, "narrativeEvidence": proof | {"calleeSummaryHashes": []}}, "invalid-evidence"), "g": ({"content": text, "narrativeEvidence": proof | {"symbolKey": 7}}, "invalid-evidence"),
        "h": ({"content": text, "narrativeEvidence": {k: v for k, v in proof.items() if k != "symbolKey"}}, "wrong-key"), "i": ([1], "corrupt-artifact"), "j": (None, "corrupt-artifact"), "k": ({"content": text, "narrativeEvidence": proof | {"calleeSummaryHashes": {key: ""}}}, "invalid-evidence"), "l": ({"content": text, "narrativeEvidence": proof | {"calleeSummaryHashes": {}}}, None),
    }
    for name, (payload, want) in cases.items():
        rows = spark.createDataFrame([(key, True, json.dumps(payload))], "symbol_key string, readable boolean, payload string")
        assert narratives.read_artifacts(rows, spark.createDataFrame([("k",)], "symbol_key string")).first().a_reason == want, name
    none = spark.createDataFrame([], "symbol_key string, readable boolean, payload string")
    side = spark.createDataFrame([], "symbol_key string, narrative_hash string, prompt_version string, callees map<string,string>, own_key string")
    asked = spark.createDataFrame([("x",), ("x",), (None,)], "symbol_key string")
    assert {(r.symbol_key, r.reason) for r in narratives.accepted_narratives(asked, none, side, side, asked).collect()} == {("x", "no-accepted-artifact"), (None, "no-accepted-artifact")}
