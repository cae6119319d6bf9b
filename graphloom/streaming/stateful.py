"""Keyed state over streams: debounce to quiet, enrichment outcomes, refresh of changed files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.functions.keys import symbol_key
from graphloom.operators import delta
from graphloom.operators.graph_store import BucketTable
from graphloom.session import Scratch
from graphloom.sources.files import DECLARATIONS
from graphloom.sources.lexical import lexed, symbol_blocks

# ── T1, T2: debounce ───────────────────────────────────────────────────────

QUIET = "key string, first timestamp, last timestamp, changes long"


class Debounce(StatefulProcessor):
    """One state a key: its first and last change and their number; a timer at the last change plus the quiet time gives them out."""

    def __init__(self, quiet_ms: int, event_time: bool):
        self.quiet_ms, self.event_time = quiet_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, changes long, timer long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802 (Spark's name)
        first, last, n, timer = self.seen.get() if self.seen.exists() else (None, None, 0, None)
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64") // 1000
            first, last, n = min(x for x in (first, int(at.min())) if x is not None), max(last or 0, int(at.max())), n + len(frame)
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        due = last + self.quiet_ms if self.event_time else now + self.quiet_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self.seen.update((first, last, n, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        if self.seen.exists():
            first, last, n, timer = self.seen.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                self.seen.clear()
                yield pd.DataFrame({"key": [key[0]], "first": pd.to_datetime([first], unit="ms"), "last": pd.to_datetime([last], unit="ms"), "changes": [n]})

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, quiet_s: int = 300, late: str | None = None) -> DataFrame:
    """A row for each key (column ``key``, time ``at``) that has had no change for ``quiet_s``: first and last change and their number.

    By the clock, or by the watermark where ``late`` is given. A change in the meantime moves the timer, so none is lost, and what was given out
    begins anew. The state store must be RocksDB.
    """
    rows = changes.select("key", "at")
    rows = rows if late is None else rows.withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Debounce(quiet_s * 1000, late is not None), QUIET, "append", "ProcessingTime" if late is None else "EventTime")


# ── E1-E6: enrichment ──────────────────────────────────────────────────────

# Errors after which another mode or attempt may help, and the attempts of one symbol.
PASSING_ERRORS, MOST_ATTEMPTS = ("auth", "timeout", "network", "rate-limit", "provider"), 2
OUTCOME = "struct<at:timestamp,seq:long,ok:boolean,error:string,mode:string>"


def folded(outcomes: Column, most: int = MOST_ATTEMPTS, backoff_s: int = 60) -> Column:
    """The state that outcomes (array of OUTCOME, in any order) lead to: status, attempts, error, mode and next_at.

    They count in order of time and seq, each once, up to the first success or final error: an error that is no passing one, or the ``most``-th.
    After a passing error a symbol waits ``backoff_s``, twice as long each time, from the time of the outcome.
    """
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("timestamp").alias("next_at"))

    def step(s, x):
        n = s["attempts"] + 1
        final = ~F.coalesce(x["error"].isin(*PASSING_ERRORS), F.lit(False)) | (n >= most)
        wait = F.timestamp_seconds(F.unix_seconds(x["at"]) + F.lit(backoff_s) * F.pow(F.lit(2), n - 1).cast("long"))
        after = F.when(x["ok"], F.struct(F.lit("enriched").alias("status"), n.alias("attempts"), F.lit(None).cast("string").alias("error"), x["mode"].alias("mode"), F.lit(None).cast("timestamp").alias("next_at"))).otherwise(
            F.struct(F.when(final, "error").otherwise("pending").alias("status"), n.alias("attempts"), x["error"].alias("error"), x["mode"].alias("mode"), F.when(~final, wait).alias("next_at"))
        )
        return F.when(s["status"] != "pending", s).otherwise(after)

    return F.aggregate(F.array_sort(F.array_distinct(outcomes)), start, step)


class EnrichmentStore:
    """The worklist as a keyed table: symbol_key, seq (its place), outcomes so far, and the state they lead to."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most: int = MOST_ATTEMPTS, backoff_s: int = 60):
        self.table, self.most, self.backoff_s = BucketTable(spark, path, "symbol_key", buckets), most, backoff_s

    def _with_state(self, rows: DataFrame) -> DataFrame:
        s = rows.withColumn("s", folded(F.col("outcomes"), self.most, self.backoff_s))
        return s.select("symbol_key", "seq", "outcomes", "s.status", "s.attempts", "s.error", "s.mode", "s.next_at")

    def create(self, symbols: DataFrame) -> None:
        """Symbols (symbol_key, seq) without outcomes."""
        self.table.open_or_rebuild(self._with_state(symbols.select("symbol_key", F.col("seq").cast("long").alias("seq"), F.array().cast(f"array<{OUTCOME}>").alias("outcomes"))))

    def read(self) -> DataFrame:
        return self.table.read()

    def record(self, outcomes: DataFrame, source: str | None = None) -> list[int]:
        """Add outcomes (symbol_key and the fields of OUTCOME) of known symbols; only buckets with such symbols are rewritten.

        ``source`` names the batch: one that was recorded before, wholly or in part, changes nothing, since equal outcomes count once.
        """
        if source is not None and (self.table.whole() or {}).get("source") == source:
            return []
        new = outcomes.groupBy("symbol_key").agg(F.collect_set(F.struct(F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "ok", "error", "mode")).alias("_new"))
        rows = self.read().join(new, "symbol_key")
        merged = rows.select("symbol_key", "seq", F.array_union("outcomes", F.col("_new").cast(f"array<{OUTCOME}>")).alias("outcomes"))
        return self.table.upsert(self._with_state(merged), source=source)

    def stream(self, outcomes: DataFrame, checkpoint: str):
        """Record a stream of outcomes, a micro-batch at a time, until what is there has been read."""

        def batch(rows, number):
            self.record(rows, f"{checkpoint}#{number}")

        return outcomes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def due(self, now) -> DataFrame:
        """Pending symbols whose waiting time is over, in their order."""
        return self.read().where((F.col("status") == "pending") & (F.col("next_at").isNull() | (F.col("next_at") <= F.lit(now).cast("timestamp")))).orderBy("seq", "symbol_key")

    def run(self, provider: Callable[[DataFrame, int], DataFrame], times: list, batch: int | None = None) -> list[dict]:
        """At each of ``times`` hand the symbols that are due to ``provider`` and record what comes back; a report of each round.

        ``provider`` turns rows (symbol_key, seq, attempts) and the number of the round into outcomes (symbol_key, ok, error, mode): a ``mapInPandas`` of calls, or expressions. ``batch``
        bounds a round. A symbol without an outcome stays due. Outcomes count in the order of the worklist, whatever task was first; a run that was
        stopped goes on with what is still due.
        """
        reports, scratch = [], Scratch(self.table.spark, "queue")
        for k, now in enumerate(times):
            items = self.due(now)
            items = items if batch is None else items.limit(batch)
            made = provider(items.select("symbol_key", "seq", "attempts"), k).select("symbol_key", F.lit(now).cast("timestamp").alias("at"), F.lit(k).alias("seq"), "ok", "error", "mode")
            before = self.table.whole()["version"]
            self.record(scratch.write(made, f"round-{k}"))
            counts = self.read().groupBy("status").count().collect()
            reports.append({"round": k, "recorded": self.table.whole()["version"] > before} | {r.status: r["count"] for r in counts})
        return reports


# ── T10: refresh ───────────────────────────────────────────────────────────


class Refresher:
    """A project's files, symbols, worklist and change log in keyed tables, brought up to date by the files that changed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        part = lambda name, key: BucketTable(spark, f"{path.rstrip('/')}/{name}", key, buckets)
        self.spark, self.files, self.symbols, self.worklist, self.log = spark, part("files", "path"), part("symbols", "path"), part("worklist", "path"), part("log", "path")
        empty = lambda schema: spark.createDataFrame([], schema)
        for t, schema in ((self.files, "path string, hash string"), (self.symbols, "path string, symbol_key string, code_hash string, start_line int, end_line int"), (self.worklist, "path string, symbol_key string, status string"), (self.log, "path string, batch string, symbol_key string, action string")):
            if t.whole() is None:
                t.open_or_rebuild(empty(schema))

    @staticmethod
    def symbols_of(files: DataFrame) -> DataFrame:
        """path, symbol_key, code_hash and lines of the symbols of files; of equal keys the first stays."""
        found = symbol_blocks(lexed(files), DECLARATIONS)
        name = F.concat_ws(".", "container", "name")
        scope = F.when(F.col("container").isNull(), "top").otherwise("member")
        rows = found.join(files.select("path", "content"), "path")
        code = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
        keyed = rows.select("path", symbol_key("language", "path", "kind", scope, name, F.lit(0)).alias("symbol_key"), F.sha2(code, 256).alias("code_hash"), "start_line", "end_line")
        return keyed.groupBy("path", "symbol_key").agg(F.min(F.struct("start_line", "end_line", "code_hash")).alias("x")).select("path", "symbol_key", "x.code_hash", "x.start_line", "x.end_line")

    def apply(self, versions: DataFrame, batch: str) -> dict[str, list[int]]:
        """Bring all tables up to the last version (by ``seq``) of each file of a batch (path, seq, content; null content: gone).

        Only files whose hash changed are scanned, and only buckets of their paths are read and rewritten. The log and the worklist come first and the
        files last, each under the batch's name: after a stop in between, the same batch finds the same changes and skips what is done.
        """
        last = delta.last_wins(versions.select("path", "seq", "content"), "path", "seq").select("path", "content")
        known = self.files.read()
        told = last.withColumn("hash", F.sha2("content", 256)).join(known.select("path", F.col("hash").alias("_old")), "path", "left")
        scratch = Scratch(self.spark, "refresh")
        changed = scratch.write(told.where(~F.col("hash").eqNullSafe(F.col("_old"))).select("path", "content", "hash"), "changed")
        if changed.isEmpty():
            return {}
        now = scratch.write(self.symbols_of(changed.where("content is not null")), "now")
        paths = changed.select("path")
        then = self.symbols.read().join(paths, "path", "left_semi")
        old, new = then.select("path", "symbol_key", F.col("code_hash").alias("_old")), now.select("path", "symbol_key", F.col("code_hash").alias("_new"))
        both = old.join(new, ["path", "symbol_key"], "full")
        change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "stale").otherwise("unchanged")
        moved = scratch.write(both.select("path", "symbol_key", change.alias("change")).where("change <> 'unchanged'"), "moved")
        actions = F.when(F.col("change") == "new", F.array(F.lit("upsert"))).when(F.col("change") == "removed", F.array(F.lit("delete"))).otherwise(F.array(F.lit("delete"), F.lit("upsert")))
        done = lambda t: t.whole()["source"] == batch
        out = {}
        if not done(self.log):
            out["log"] = self.log.upsert(moved.select("path", F.lit(batch).alias("batch"), "symbol_key", F.explode(actions).alias("action")), ["path", "batch", "symbol_key", "action"], source=batch)
        if not done(self.worklist):
            kept = moved.where("change <> 'removed'").select("path", "symbol_key", F.when(F.col("change") == "new", "pending").otherwise("stale").alias("status"))
            out["worklist"] = self.worklist.upsert(kept, ["path", "symbol_key"], moved.where("change = 'removed'").select("path", "symbol_key"), batch)
        if not done(self.symbols):
            out["symbols"] = self.symbols.upsert(now, ["path", "symbol_key"], then.join(now.select("path", "symbol_key"), ["path", "symbol_key"], "left_anti").select("path", "symbol_key"), batch)
        out["files"] = self.files.upsert(changed.where("content is not null").select("path", "hash"), ["path"], changed.where("content is null").select("path"), batch)
        return out

    def stream(self, versions: DataFrame, checkpoint: str):
        """Apply a stream of file versions, a micro-batch at a time, until what is there has been read."""

        def batch(rows, number):
            self.apply(rows, f"{checkpoint}#{number}")

        return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
