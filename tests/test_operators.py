"""Graph shapes, streams, roles, relations and files on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import keys as K
from graphloom.functions import text as T
from graphloom.operators import cards, delta, evaluation, graph, relations, roles, search
from graphloom.sources import files
from graphloom.streaming import capture

EDGES = "source string, target string, relation string"


def edges(spark, *pairs):
    return spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else "calls") for p in pairs], EDGES)


def nodes(spark, *ids):
    return spark.createDataFrame([(i, i, "x", f"src/{i}.ts", None) for i in ids], "id string, label string, kind string, source_file string, community int")


def test_traverse_shapes(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "zz"), ("c", "d", "imports"))
    n = nodes(spark, "a", "b", "c", "d")
    got = {r.id: (r.hop, r.source) for r in graph.traverse(spark, n, e, ["a", "no"], None).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "c")}
    assert {r.id for r in graph.traverse(spark, n, e, ["a"], 5, ("calls",)).collect()} == {"a", "b", "c"}
    assert graph.traverse(spark, n, e, ["a"], 2, node_kinds=[]).count() == 0
    with pytest.raises(TypeError):
        K.kinds_allowed(["planet"])


def test_pagerank_known_values(spark):
    ranks, _, done = graph.pagerank(spark, nodes(spark, "a", "b"), edges(spark, ("a", "b"), ("a", "b")))
    got = {r.id: r["rank"] for r in ranks.collect()}
    assert done and abs(sum(got.values()) - 1) < 1e-9 and abs(got["a"] - 0.350877193) < 1e-6
    assert graph.pagerank(spark, nodes(spark, "a").limit(0), edges(spark, ("a", "b")).limit(0))[1:] == (0, True)
    _, rounds, done = graph.pagerank(spark, nodes(spark, "a", "b"), edges(spark, ("a", "b")), most=2)
    assert rounds == 2 and not done
    with pytest.raises(ValueError):
        graph.pagerank(spark, nodes(spark, "a"), edges(spark, ("a", "b")))


def test_components_and_levels(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("f", "f"), ("g", "e"), ("a", "b"))
    got = {r.node: (r.component, r.level) for r in graph.call_levels(spark, e).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("c", 1), "e": ("e", 0), "f": ("f", 0), "g": ("g", 1)}


def test_role_walks(spark):
    e = edges(spark, ("main", "ctl"), ("ctl", "svc"), ("svc", "repo"), ("svc", "util"), ("repo", "repo2"))
    r = spark.createDataFrame([("main", "entrypoint", "entrypoint"), ("ctl", "controller", "presentation"), ("repo", "repository", "data"), ("repo2", "repository", "data")], "id string, role string, layer string")
    got = [(x.id, x.distance, list(x.path)) for x in graph.walk_to_role(spark, e, r, ["ctl"], "repository").collect()]
    assert got == [("repo", 2, ["ctl", "svc", "repo"])]
    got = {x.id: x.distance for x in graph.entrypoints(spark, e, r, ["util"]).collect()}
    assert got == {"ctl": 2, "main": 3}
    with pytest.raises(TypeError):
        graph.known_role(r, "king", ("controller",))


def test_roles(spark):
    schema = "id string, name string, path string, kind string, scope string, annotations array<string>, heritage array<string>, side_effects array<string>, fan_in int, fan_out int, container string"
    rows = [
        ("c", "UserController", "src/controllers/user.ts", "class", "exported", None, None, None, 1, 1, None), ("m", "getUser", "src/controllers/user.ts", "method", "member", None, None, None, 1, 1, "c"),
        ("x", "thing", "lib/x.ts", "function", "exported", None, None, None, 1, 1, None), ("a", "run", "src/utils/a.ts", "method", "member", ["@Nope", "@Injectable"], None, None, 1, 1, "c"),
        ("s", "Service", "lib/s.ts", "function", "local", None, None, None, 1, 1, None), ("i", "UserService", "lib/i.ts", "interface", "exported", None, None, None, 1, 1, None),
        ("t", "UserService", "tests/u.ts", "class", "exported", None, None, None, 1, 1, None), ("h", "Users", "lib/h.py", "class", "exported", None, ["object", "implements db.UserRepository<User>"], None, 1, 1, None),
        ("g", "go", "lib/g.ts", "function", "exported", None, None, ["odd", "fetch"], 2, 9, None), ("u", "pad", "lib/u.ts", "function", "exported", None, None, None, 9, 9, None), ("d", "x", "cli/services/x.ts", "function", "exported", None, None, None, 1, 1, None),
    ]
    got = {r.id: (r.role, r.layer, r.confidence) for r in roles.classified(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "c": ("controller", "presentation", 0.8), "m": ("controller", "presentation", 0.875), "x": (None, None, 0.0), "a": ("service", "application", 0.9), "s": ("decorator", "presentation", 0.6), "i": (None, None, 0.0),
        "t": ("test", "test", 0.5), "h": ("repository", "data", 0.85), "g": ("controller", "presentation", 0.35), "u": ("util", "cross-cutting", 0.35), "d": ("service", "application", 0.5),
    }
    files_ = spark.createDataFrame([("src/UserService.ts",), ("bin/x.js",)], "path string")
    assert {r.path: r.role for r in roles.classified_files(files_, roles.load_profile("node-cli")).collect()} == {"src/UserService.ts": "service", "bin/x.js": "cli-command"}
    assert roles.load_profile("nest")["suffix"]["Module"] == "config" and roles.load_profile("django")["heritage"]["View"] == "view"
    for bad in ({"weights": {"suffix": 2}}, {"suffix": {"King": "king"}}, {"weights": {"topology": None}}):
        with pytest.raises(TypeError):
            roles.checked_profile(roles.merged_profiles(roles.GENERIC, bad))
    with pytest.raises(TypeError):
        roles.load_profile("planet")


def test_error_classes_and_kinds(spark):
    """The order of rules: what comes first wins."""
    said = {"HTTP 503 timeout": "provider", "forbidden": "auth", "socket closed": "network", "Invalid API key": "runtime", "Timed out": "runtime", "429 network": "rate-limit", "provider config": "config", "provider": "provider"}
    df = spark.createDataFrame(list(said.items()), "m string, want string").withColumn("got", T.error_class("m"))
    assert df.where("got <> want").isEmpty()
    kinds = {"app.json": "data", "Makefile": "config", "tsconfig.json": "config", "src/a.ts": "file", "x": "data", "README.md": "doc", ".env": "config"}
    df = spark.createDataFrame(list(kinds.items()), "label string, want string").withColumn("got", K.node_kind("label"))
    assert df.where("got <> want").isEmpty()


def test_relations(spark):
    f = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/c.ts",), ("src/c.js",)], "path string")
    s = spark.createDataFrame([(1, "src/a"), (2, "src/b"), (3, "src/c"), (4, "src/no")], "id int, base string")
    got = {r.id: (r.target, r.reason) for r in relations.modules(s, f).collect()}
    assert got == {1: ("src/a.ts", None), 2: ("src/b/index.ts", None), 3: (None, "ambiguous"), 4: (None, "not-found")}
    b = spark.createDataFrame([("s", "f", "X", "x", False, "t", None), ("s", "f", "X", "x", False, "u", None), ("s", "f", "Y", "y", False, "t", None)], "source_id string, file_id string, imported string, local string, type_only boolean, target string, reason string")
    assert {r.imported: (r.target, r.reason) for r in relations.bindings(b).collect()} == {"X": (None, "ambiguous-binding-evidence"), "Y": ("t", None)}


def test_greedy_match_is_sequential(spark):
    import random

    rng = random.Random(2)
    left, right = ([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(30)] for _ in range(2))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    free, want = set(range(30)), []
    for k, v in left:
        best = max(((cos(v, right[j][1]), -j) for j in free), default=(0, 0))
        if best[0] >= 0.3:
            want.append((k, -best[1]))
            free.discard(-best[1])
    a, b = (spark.createDataFrame(x, "id int, vector array<double>") for x in (left, right))
    assert sorted((r.a, r.b) for r in search.greedy_match(spark, a, b, 0.3).collect()) == sorted(want)


def test_metrics_and_narratives(spark):
    rows = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, ["a", "b"], ["b", "c"])], "id int, expected array<string>, observed array<string>")
    assert {r.id: (r.precision, r.recall) for r in evaluation.precision_recall(rows).collect()} == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.5, 0.5)}
    n = spark.createDataFrame([("a", "does it", ["x"], ["b"]), ("b", "w " * 30, [], []), ("c", "ok", [" "], []), ("d", "ok", [], ["zz"])], "symbol_key string, summary string, behavior array<string>, mentions array<string>")
    got = {r.symbol_key: r.problem for r in cards.narrative_problems(n, n.select("symbol_key")).collect()}
    assert got == {"a": None, "b": "long-summary", "c": "empty-item", "d": "unknown-mention"}


def test_text_functions(spark):
    row = spark.createDataFrame([('{"a":{"apiToken":"x","b":[{"password":1}]},"n":2}', "a <Private>b\nc</private> d", "L12-L20", "../x", "Fix: it\nfix: no\nTags: a, b")], "j string, p string, r string, s string, f string")
    got = row.select(T.mask_args("j").alias("j"), T.redact_private("p").alias("p"), K.line_range("r").alias("r"), K.strict_path("s").alias("s"), T.report_fields("f").alias("f")).first()
    assert json.loads(got.j) == {"a": {"apiToken": "***REDACTED***", "b": [{"password": "***REDACTED***"}]}, "n": 2}
    assert got.p == "a [REDACTED] d" and (got.r.start, got.r.end) == (12, 20) and got.s is None and got.f == {"fix": "it", "tags": "a, b"}


def test_capture_stream_equals_batch(spark, tmp_path):
    lines = [{"type": "prompt", "ts": 1000 * k, "sessionId": "s", "content": f"<private>x</private>{k}"} for k in range(5)] + [{"type": "odd", "ts": 1}]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    query = capture.drain(capture.stream_queue(spark, str(tmp_path / "q")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).where("type = 'prompt'").collect())
    assert got == [f"[REDACTED]{k}" for k in range(5)]
    assert capture.cleaned(capture.read_queue(spark, str(tmp_path / "q"))).where("type = 'prompt'").count() == 5
    pending = spark.createDataFrame([("a", 1), ("b", 2)], "key string, last int")
    assert [r.key for r in capture.remaining(pending, spark.createDataFrame([("a", 1), ("b", 1)], "key string, last int")).collect()] == ["b"]


def test_files(spark, tmp_path):
    src = tmp_path / "src" / "my proj+(x)" / "src"
    src.mkdir(parents=True)
    (src / "a.py").write_text("class A:\n    def run(self):\n        pass\n")
    (src / "b.ts").write_text("import {A} from '../lib/a'\nexport function go() {\n  if (x) { y }\n}\n")
    (src.parent / "node_modules").mkdir()
    (src.parent / "node_modules" / "c.ts").write_text("export function no() {}\n")
    tree = files.source_tree(spark, str(src.parent))
    symbols = files.declared_symbols(tree)
    assert {(r.path, r.name) for r in symbols.collect()} == {("src/a.py", "A"), ("src/a.py", "run"), ("src/b.ts", "go")}
    parts = spark.createDataFrame([('{"a": 1}\n{"b": 2} {bad',)], "value string")
    assert [r.document for r in files.split_documents(parts).collect()] == ['{"a": 1}', '{"b": 2}']


def test_merge_and_swap(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, version int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    delta.swap_write(spark, delta.merge(old, new, "id", version="version"), str(tmp_path / "t"))
    delta.swap_write(spark, spark.read.parquet(str(tmp_path / "t")).where(F.lit(True)), str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 1)]


def plain_summary(text):
    """What F11 says, by a walk over the lines."""
    import re

    clean = (text or "").strip()
    if not clean:
        return None
    lines = re.split(r"\r?\n", clean)
    for i, line in enumerate(lines):
        m = re.match(r"(?:[-*]\s+)?(?:\*{1,2}|_{1,2})?Responsibility(?::(?:\*{1,2}|_{1,2})?|(?:\*{1,2}|_{1,2})?:|:)\s*(.*)$", line.strip(), re.I)
        if m:
            parts = [m[1].strip()] if m[1].strip() else []
            for following in lines[i + 1 :]:
                x = following.strip()
                if not x and not parts:
                    continue
                if not x or re.match(r"#{1,6}\s+|[-*]\s+", x) or parts and re.search(r"[.!?]$", parts[-1]):
                    break
                parts.append(x)
            if parts:
                return " ".join(parts)[:200]
    m = re.match(r"(.+?[.!?])(?:\s|$)", clean)
    return (m[1] if m else lines[0]).strip()[:200]


def test_semantic_summaries_of_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").where("text is not null").collect()]
    texts += ["", "  \n ", "One. Two.", "no end\nsecond.", "**Responsibility**: a\nb.\nc", "x\n- Responsibility:\n\n does it\nall\n# h", "Responsibility: only this! And more."]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.semantic_summary("t").alias("s")).collect()
    wrong = [(texts[r.k][:80], r.s, plain_summary(texts[r.k])) for r in rows if r.s != plain_summary(texts[r.k])]
    assert not wrong, wrong[:3]


def small_known(spark):
    """A class with two members, a caller in each of three files (one of tests), a cycle, an import chain and a binding."""
    from graphloom.operators import known_graph as kg

    keys = {
        "S": "ts|src/s.ts|class|exported|S|0", "Sa": "ts|src/s.ts|method|member|S.a|0", "Sb": "ts|src/s.ts|method|member|S.b|0", "f": "ts|src/f.ts|function|exported|f|0",
        "g": "ts|src/g.ts|function|local|g|0", "t": "ts|tests/t.test.ts|function|exported|t|0", "m": "ts|bin/m.ts|function|exported|m|0",
    }
    rows = [(k, k, v.split("|")[2], "member" if "|member|" in v else "symbol", v.split("|")[1], v, None) for k, v in keys.items()]
    n = spark.createDataFrame(rows, "id string, label string, kind string, node_kind string, source_file string, symbol_key string, meta_key string")
    legacy = spark.createDataFrame([("f", "Sa", "calls"), ("g", "f", "calls"), ("f", "g", "calls"), ("m", "g", "calls"), ("t", "Sb", "calls"), ("S", "Sa", "method")], EDGES)
    native = spark.createDataFrame([(keys["t"], keys["Sa"], "calls"), ("file|tests/t.test.ts", "file|src/s.ts", "imports"), ("file|src/f.ts", "file|src/s.ts", "imports"), ("file|bin/m.ts", "file|src/f.ts", "imports")], EDGES)
    bind = spark.createDataFrame([("file|src/f.ts", keys["S"])], "source_id string, target string")
    ranked = spark.createDataFrame([(keys["m"], "cli-command", "entrypoint"), (keys["S"], "service", "application"), (keys["g"], "controller", None)], "id string, role string, layer string")
    index = spark.createDataFrame([], "symbol_key string, graph_node_id string")
    return kg, keys, kg.known_graph(spark, n, legacy, native, bind, ranked, index)


def test_impact_and_walks_on_a_small_known_graph(spark):
    kg, keys, g = small_known(spark)
    name = {v: k for k, v in keys.items()}
    rows, by_role, rounds, done = kg.impact(spark, g, "S")
    got = {name.get(r.symbol_key, r.symbol_key): (r.distance, r.is_test, r.role) for r in rows.collect()}
    # f reaches S by its binding and S.a by a call, t by its native call, g and m through f; t is a test too; files don't call
    assert got == {"f": (1, False, None), "t": (1, True, None), "g": (2, False, "controller"), "m": (3, False, "cli-command")} and done
    ids = [r.id for r in kg.ranking_graph(g)[0].collect()]
    pairs = [(r.source, r.target) for r in kg.ranking_graph(g)[1].collect()]
    rank, out = dict.fromkeys(ids, 1 / len(ids)), {i: [b for a, b in pairs if a == i] for i in ids}
    for _ in range(rounds):
        loose = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / len(ids) + 0.85 * loose / len(ids) + 0.85 * sum(rank[a] / len(out[a]) for a, b in pairs if b == i) for i in ids}
    assert all(abs(r["rank"] - rank[r.symbol_key]) < 1e-9 for r in rows.collect())
    roles_ = {r.role: (r.members, r.layer) for r in by_role.collect()}
    assert roles_ == {"controller": (1, None), "cli-command": (1, "entrypoint")}
    assert {name[r.id]: (r.entry, r.distance) for r in kg.entrypoints(spark, g, "S").collect()} == {"g": (False, 2), "m": (True, 3)}
    found = [(name[r.id], r.distance, [name[x] for x in r.path]) for r in kg.stop_at_role(spark, g, "g", "service", "out", ("calls",), 2).collect()]
    assert found == [("S", 2, ["g", "f", "Sa", "S"])]
    assert {(name[r.source], name[r.target]) for r in kg.relations(spark, g, "t", relations=("calls",)).collect()} == {("t", "Sa")}
    assert kg.resolve(g, "src/f.ts")[:3] == ("resolved", "file", "src/f.ts") and kg.resolve(g, "zzz")[0] == "missing"
    for bad in ({"direction": "up"}, {"depth": 4}, {"relations": ("likes",)}):
        with pytest.raises(TypeError):
            kg.relations(spark, g, "t", **bad)
    with pytest.raises(TypeError):
        kg.stop_at_role(spark, g, "g", "king")
    with pytest.raises(LookupError):
        kg.relations(spark, g, "zzz")


def resolved_by_pairs(symbols, nodes):
    """J2 by all pairs: what the rule says, row by row."""
    met = [(i, p, n, abs(line - y) if i is not None and line is not None and y is not None else None) for i, p, name, line in symbols for n, q, m, y in nodes if (q, m) == (p, name) and None not in (p, name)]
    met += [(i, p, None, None) for i, p, name, line in symbols if None in (p, name) or not any((q, m) == (p, name) for _, q, m, _ in nodes)]
    out = {}
    for i, p, n, d in met:
        best = min((x[3] for x in met if x[0] == i and x[3] is not None), default=None)
        if n is None or d is not None and d == best:
            out.setdefault((i, p), set()).update({n} - {None})
    said = lambda p, found: "no-file-node" if p is None or p not in {q for _, q, _, _ in nodes} else "no-label-match" if not found else "ambiguous" if len(found) > 1 else None
    return sorted(((i, min(found) if said(p, found) is None else None, said(p, found)) for (i, p), found in out.items()), key=str)


def test_nearest_nodes_are_found_without_pairs(spark):
    import random

    rng = random.Random(5)
    one = lambda xs: rng.choice(xs)
    symbols = [(rng.randrange(150), one(["a", "b", "c", None]), one(["f", "g", "h", None]), one([None, *range(30)])) for _ in range(200)]
    nodes = [(one([None, *(f"n{k}" for k in range(40))]), one(["a", "b", None]), one(["f", "g", None]), one([None, *range(0, 60, 3)])) for _ in range(40)]
    s, n = spark.createDataFrame(symbols, "id int, path string, name string, line int"), spark.createDataFrame(nodes, "node_id string, path string, name string, line bigint")
    for nodes_, df in ((nodes, n), ([], n.limit(0)), (nodes[:9], spark.createDataFrame(nodes[:9], n.schema))):
        assert sorted((tuple(r) for r in relations.resolved(s, df).collect()), key=str) == resolved_by_pairs(symbols, nodes_)
    # 3,000 symbols and 3,000 nodes of one name in one file were nine million pairs: of two sides that meet, one has each key once
    s, n = (spark.range(3000).selectExpr(f"cast(id as string) as {x}", "'p' as path", "'x' as name", "id as line") for x in ("id", "node_id"))
    found = relations.resolved(s, n)

    def sides(plan):
        return [plan.children().apply(k) for k in range(plan.children().size())]

    def raw(plan):
        return plan.nodeName() == "Join" and not any("Aggregate" in x.toString() for x in sides(plan)) or any(map(raw, sides(plan)))

    assert not raw(found._jdf.queryExecution().optimizedPlan()) and found.where("id = node_id").count() == 3000
