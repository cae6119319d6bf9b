"""Corpus counts of hashed tokens in a table of fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.arrow import slices

#: Counters, and the parts that they are added up in. The sum is 4 MB whatever the input's size.
SKETCH_BITS, PARTS = 20, 16


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(df: DataFrame, hashes_of) -> np.ndarray:
    """How often each slot occurs in what ``hashes_of`` (record batch -> arrays of hashes) gives for all rows of ``df``.

    Each task adds into its own counters and sends them once; they are added up in PARTS streams. A count is never too
    low, and too high by what else falls in the slot, so tokens that many rows share stand out at any size.
    """
    size = (1 << SKETCH_BITS) // PARTS

    def add(batches):
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole):
                for hashes in hashes_of(batch):
                    if hashes.size * 50 > seen.size:
                        seen += np.bincount(slot(hashes), minlength=seen.size)
                    else:
                        np.add.at(seen, slot(hashes), 1)
        cut = np.minimum(seen, 2**32 - 1).astype("<u4").reshape(PARTS, size)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": [x.tobytes() for x in cut]})

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(raw, "<u4").astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary())})

    rows = df.mapInArrow(add, "part int, counts binary").repartition(PARTS, "part").mapInArrow(total, "part int, counts binary").collect()
    out = np.zeros((PARTS, size), np.uint32)
    for r in rows:
        out[r.part] = np.frombuffer(bytes(r.counts), "<u4")
    return out.ravel()
