"""Operator 2: token counts by a map-side two-tier lookup."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import slices, texts, tuned
from graphloom.llm.pretokens import ODD, PIECES, tokenizer_path, worker_pretokens

#: Entries of the broadcast tier (a few hundred kB) and of the summary that each task sends for it.
FREQUENT = 32_768
SUMMARY = 8_192
#: A task's counter is cut back to its SUMMARY largest entries whenever it holds this many.
COUNTER_ROWS = 262_144


def frequent_pretokens(docs: DataFrame, frequent: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent pre-tokens of all texts.

    Every task counts its own pre-tokens in a bounded heavy-hitters summary and sends its ``summary`` largest
    entries; Spark adds those up. The pre-tokens themselves are never shuffled, and what returns to the driver is
    at most ``frequent`` short strings. A pre-token that is left out costs a worker one cache miss; no count changes.
    """

    def summarise(batches):
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for text in texts(batch):
                    if not ODD.search(text):
                        seen.update(PIECES.findall(text))
                if len(seen) > COUNTER_ROWS:
                    seen = Counter(dict(seen.most_common(summary)))
        top = seen.most_common(summary)
        yield pa.RecordBatch.from_pydict({"piece": [x for x, _ in top], "n": [n for _, n in top]}, pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    tops = docs.select("text").mapInArrow(summarise, "piece string, n long").where(F.length("piece") <= 64)
    best = tops.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(frequent)
    return [r.piece for r in best.select("piece").collect()]


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    The first tier is a compact broadcast table (two arrays: pre-tokens and their lengths in tokens) of at most
    ``frequent`` entries; misses are encoded by the tokenizer and kept in a bounded cache of the worker.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows each give a row; other columns are ignored; an
    empty table gives an empty result. Texts of any length are counted whole. Special strings inside a text count
    as the tokenizer's default has them, and texts with characters that Python's ``re`` and the tokenizer might
    class differently go to the tokenizer whole.
    """
    tuned(spark)
    path = path or tokenizer_path()
    common = frequent_pretokens(docs, frequent)
    lengths = worker_pretokens(path, "count")
    tag = uuid.uuid4().hex
    tier = spark.sparkContext.broadcast((common, bytes(min(255, len(lengths.ids(x))) for x in common)))

    def count(batches):
        cache = worker_pretokens(path, "count")
        if getattr(cache, "tier", None) != tag:
            names, sizes = tier.value
            cache.preload({x: n for x, n in zip(names, sizes) if n < 255})
            cache.tier = tag
        get = cache.__getitem__
        for whole in batches:
            for batch in slices(whole):
                n_bytes, n_tokens = [], []
                for text in texts(batch):
                    pieces = cache.pieces(text)
                    n_bytes.append(len(text.encode()))
                    n_tokens.append(len(cache.ids(text)) if pieces is None else sum(map(get, pieces)))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())}
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
