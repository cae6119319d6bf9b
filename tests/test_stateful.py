"""Keyed state over streams: restarts, any order of files, and no rewrite of what didn't change."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.graph_store import BucketTable
from graphloom.streaming.stateful import EnrichmentStore, Refresher, debounced


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_debounce_gives_out_quiet_keys_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    day = "2024-01-01T"

    def run():
        rows = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).json(str(src))
        q = debounced(rows, 300, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return sorted((r.key, r.first.strftime("%H:%M"), r.last.strftime("%H:%M"), r.changes) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write(src, "a.json", [{"key": "a", "at": day + "10:00:00Z"}, {"key": "a", "at": day + "10:02:00Z"}, {"key": "b", "at": day + "10:04:00Z"}])
    write(src, "b.json", [{"key": "a", "at": day + "10:06:00Z"}, {"key": "c", "at": day + "10:07:00Z"}])
    assert run() == []  # nobody has been quiet for five minutes
    write(src, "c.json", [{"key": "d", "at": day + "10:11:30Z"}])  # a restart from the checkpoint
    assert run() == [("a", "10:00", "10:06", 3), ("b", "10:04", "10:04", 1)]
    write(src, "d.json", [{"key": "a", "at": day + "10:30:00Z"}])
    assert run() == [("a", "10:00", "10:06", 3), ("b", "10:04", "10:04", 1), ("c", "10:07", "10:07", 1), ("d", "10:11", "10:11", 1)]


OUTCOMES = [{"symbol_key": f"k{k}", "at": f"2024-01-01T00:0{a}:00Z", "seq": a, "ok": a >= k % 4, "error": None if a >= k % 4 else "timeout" if k % 5 else "schema", "mode": "m"} for k in range(20) for a in range(4)]


def plain(k, most):
    for a in range(4):
        if a >= k % 4:
            return "enriched", a + 1
        if k % 5 == 0 or a + 1 >= most:
            return "error", a + 1


def test_outcomes_in_any_order_and_twice(spark, tmp_path):
    symbols = spark.range(21).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("symbol_key"), F.col("id").alias("seq"))
    want = {f"k{k}": plain(k, 3) for k in range(20)} | {"k20": ("pending", 0)}
    for seed in (1, 2):
        store, src = EnrichmentStore(spark, str(tmp_path / f"s{seed}"), 4, most=3), tmp_path / f"in{seed}"
        store.create(symbols)
        rows = OUTCOMES * 2
        random.Random(seed).shuffle(rows)
        for n in range(4):
            write(src, f"{n}.json", rows[n::4])
        stream = spark.readStream.schema("symbol_key string, at timestamp, seq long, ok boolean, error string, mode string").option("maxFilesPerTrigger", 1).json(str(src))
        store.stream(stream, str(tmp_path / f"cp{seed}")).awaitTermination(240)
        assert {r.symbol_key: (r.status, r.attempts) for r in store.read().collect()} == want
        version = store.table.whole()["version"]
        assert store.record(spark.createDataFrame([("k1", None, 1, True, None, "m")], "symbol_key string, at timestamp, seq long, ok boolean, error string, mode string"), source=store.table.whole()["source"]) == []
        assert store.table.whole()["version"] == version


def test_bounded_queue_run(spark, tmp_path):
    store = EnrichmentStore(spark, str(tmp_path / "q"), 4, most=2, backoff_s=60)
    store.create(spark.createDataFrame([(f"k{k}", k) for k in range(10)], "symbol_key string, seq int"))
    asked = []

    def provider(items, k):
        asked.append(sorted(r.seq for r in items.collect()))
        return items.where("seq <> 9").select("symbol_key", ((F.col("seq") % 3 == 0) | ((F.col("attempts") > 0) & (F.col("seq") % 3 == 1))).alias("ok"), F.when(F.col("seq") % 3 > 0, F.when(F.col("seq") == 8, "schema").otherwise("network")).alias("error"), F.lit("x").alias("mode"))

    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:30", "2024-01-01 00:02:00"]
    reports = store.run(provider, times, batch=6)
    assert asked == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9], [1, 2, 4, 5, 7, 9]]
    assert {r.symbol_key: r.status for r in store.read().collect()} == {f"k{k}": "pending" if k == 9 else "error" if k % 3 == 2 else "enriched" for k in range(10)}
    assert reports[-1] == {"round": 2, "recorded": True, "enriched": 6, "error": 3, "pending": 1}


def state(r):
    return [sorted(map(tuple, t.read().select(*c).collect())) for t, c in ((r.files, ["path", "hash"]), (r.symbols, ["path", "symbol_key", "code_hash"]), (r.worklist, ["path", "symbol_key", "status"]), (r.log, ["path", "symbol_key", "action"]))]


def test_refresh_of_changed_files_survives_a_stop(spark, tmp_path, monkeypatch):
    def version(k, text):
        return f"class C{k} {{\n  // {text}\n}}\nexport function f{k}() {{\n}}\n"

    first = [{"path": f"src/m{k}.ts", "seq": k, "content": version(k, "a")} for k in range(40)]
    second = [{"path": "src/m3.ts", "seq": 100, "content": version(3, "b")}, {"path": "src/m4.ts", "seq": 101, "content": None}, {"path": "src/m5.ts", "seq": 102, "content": version(5, "a")}, {"path": "src/m9.ts", "seq": 104, "content": "class Only {\n}\n"}, {"path": "src/m9.ts", "seq": 103, "content": "class Late {\n}\n"}]
    src = tmp_path / "in"
    write(src, "1.json", first)
    stream = lambda: spark.readStream.schema("path string, seq long, content string").option("maxFilesPerTrigger", 1).json(str(src))
    one = Refresher(spark, str(tmp_path / "one"), 8)
    one.stream(stream(), str(tmp_path / "cp")).awaitTermination(240)
    write(src, "2.json", second)
    held, upsert = {p: 1 for p in glob.glob(f"{tmp_path}/one/**/*.parquet", recursive=True)}, BucketTable.upsert

    def stops(self, *a, **b):
        if self.path.endswith("/symbols"):
            raise RuntimeError("stopped")
        return upsert(self, *a, **b)

    monkeypatch.setattr(BucketTable, "upsert", stops)
    with pytest.raises(Exception):
        one.stream(stream(), str(tmp_path / "cp")).awaitTermination(240)
    monkeypatch.setattr(BucketTable, "upsert", upsert)
    assert one.worklist.read().where("status = 'stale'").count() == 1  # the batch was half done
    one.stream(stream(), str(tmp_path / "cp")).awaitTermination(240)
    whole = Refresher(spark, str(tmp_path / "whole"), 8)
    schema = "path string, seq long, content string"
    for n, batch in enumerate((first, second)):
        whole.apply(spark.createDataFrame([(r["path"], r["seq"], r["content"]) for r in batch], schema), f"b{n}")
    assert state(one) == state(whole)
    by = {r.symbol_key: r.status for r in one.worklist.read().collect()}
    assert by["typescript|src/m3.ts|class|top|C3|0"] == "stale" and by["typescript|src/m3.ts|function|top|f3|0"] == "pending" and not any("m4.ts" in k for k in by) and "typescript|src/m9.ts|class|top|Only|0" in by
    assert len(by) == 40 * 2 - 2 - 1
    new = [p for p in glob.glob(f"{tmp_path}/one/symbols/**/*.parquet", recursive=True) if p not in held]
    assert len(new) <= 3  # the buckets of the three files whose symbols changed
    assert whole.apply(spark.createDataFrame([("src/m5.ts", 900, version(5, "a"))], schema), "b2") == {}
