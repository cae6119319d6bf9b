"""Filters of bounded size for keys, to leave most rows of a large table out before a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashing import mix

#: Bits of a filter: 2**23 (1 MB) up to 2**27 (16 MB), by the number of keys; and hashes of a key.
BITS, MOST_BITS, HASHES = 23, 27, 3


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(hashes + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)])


def id_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """The 64-bit keys of a batch of one long column."""
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _filter(keys: DataFrame, hashes_of=id_hashes) -> tuple:
    """(broadcast bytes, bits) of a filter of the 64-bit keys that ``hashes_of`` has for the batches of ``keys``: each task sends its own, and they are OR-ed in parts.

    There are eight bits a key while MOST_BITS allow it; with more keys it lets more rows through, and never fewer. Keys are hashed where
    their bits are set: a step of its own before would take a second Python worker a task, and idle workers keep their memory.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(BITS, (8 * n).bit_length()))
    parts = 16

    def add(batches):
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            own[_places(hashes_of(batch), bits).ravel()] = True
        cut = np.packbits(own).reshape(parts, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "bits": [x.tobytes() for x in cut]})

    def join(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                total[part] = total[part] | x if part in total else x
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "bits": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    schema = "part int, bits binary"
    few = keys.coalesce(min(32, max(1, keys.rdd.getNumPartitions())))
    rows = few.mapInArrow(add, schema).repartition(parts, "part").mapInArrow(join, schema).collect()
    out = np.zeros((parts, (1 << (bits - 3)) // parts), np.uint8)
    for r in rows:
        out[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.tobytes()), bits


def _test(held, bits: int, hashes: np.ndarray) -> np.ndarray:
    raw, out = np.frombuffer(held.value, np.uint8), np.ones(hashes.size, bool)
    for at in _places(hashes, bits):
        out &= (raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def maybe_in(ids: DataFrame, column: str):
    """A function of a column that is true for every id of ``ids`` (one long column) and for few others.

    It never says no to an id that is there, so a join behind it stays exact.
    """
    held, bits = _filter(ids.select(F.col(column).cast("long").alias("id")).where("id is not null"))

    @F.pandas_udf("boolean")
    def test(x):
        import pandas as pd

        known = x.notna().to_numpy()
        return pd.Series(known & _test(held, bits, x.fillna(0).to_numpy().astype(np.int64).view(np.uint64)))

    return test


def maybe_id(ids: DataFrame):
    """A function of an array of longs that is true for every id of ``ids`` (one long column) and for few others."""
    held, bits = _filter(ids)
    return lambda x: _test(held, bits, x.astype(np.int64).view(np.uint64))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of (long, int) pairs."""
    return mix(mix(a.astype(np.int64).view(np.uint64)) ^ b.astype(np.int64).view(np.uint64))


def maybe_among(pairs: DataFrame):
    """A function of two arrays that is true for every pair of ``pairs`` (a long, an int column) and for few others."""
    held, bits = _filter(pairs, lambda batch: pair_hash(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))))
    return lambda a, b: _test(held, bits, pair_hash(a, b))


def maybe_token(tokens: DataFrame):
    """A function of an array of longs that is true for every one of ``tokens`` (a long column) and for few others."""
    held, bits = _filter(tokens)
    return lambda x: _test(held, bits, x.view(np.uint64))
