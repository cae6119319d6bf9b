"""Arrow batches in and out of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch. Documents can be long, so batches are kept short to bound a worker's memory.
BATCH_ROWS = 512


def tuned(spark: SparkSession) -> SparkSession:
    """Batches of few rows: a text column makes a batch of the default 10,000 rows hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS):
    """Parts of a batch of at most ``rows`` rows, so that memory doesn't follow the session's batch size."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` turns a record batch of at most BATCH_ROWS rows into a dict of columns, a pyarrow table or None."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                out = f(batch)
                if out is None:
                    continue
                table = pa.table({n: out[n] for n in names}) if isinstance(out, dict) else out
                yield from table.to_batches()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], f, schema: str, rows: int = 1 << 16, size: int = 1 << 25) -> DataFrame:
    """``f`` of tables that hold whole groups of equal ``keys``, many small ones at once, in the order of the keys.

    A table ends with the first group that ends after ``rows`` rows or ``size`` bytes, so memory follows the largest group only.
    ``f`` gives dicts of columns, one after the other. Groups share calls, which for small groups costs far less than a call for each.
    """
    names = [x.split()[0] for x in schema.split(",")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys)

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            codes = table.column(k).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def run(batches):
        held, n, mb = [], 0, 0

        def done(table):
            for out in f(table, np.cumsum(starts(table))):
                yield from pa.table({c: out[c] for c in names}).to_batches()

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n, mb = n + batch.num_rows, mb + batch.nbytes
            if n < rows and mb < size:
                continue
            table = pa.concat_tables(held)
            cut = np.flatnonzero(starts(table))
            if cut.size:  # the last group may go on
                yield from done(table.slice(0, int(cut[-1])))
                table = table.slice(int(cut[-1])).combine_chunks()
            held, n, mb = [table], table.num_rows, table.nbytes if cut.size else 0
        if n:
            yield from done(pa.concat_tables(held))

    return dealt.mapInArrow(run, schema)
