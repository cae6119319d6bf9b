"""Exact joins of vectors by a least cosine, without comparing all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that the space is divided by, and a margin for rounding, in radians.
PIVOTS, MARGIN = 64, 1e-6
PLACED = "id long, vector array<double>, dim int, pivot int, angle double"


def clean(rows: DataFrame) -> DataFrame:
    """id and vector of rows whose vector has a direction: not null, not empty, finite, not zero."""
    vector = F.col("vector").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col("id").cast("long").alias("id"), vector.alias("vector"))


def units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def placed(rows: DataFrame, pivots: dict[int, np.ndarray], reach: dict[tuple[int, int], float] | None) -> DataFrame:
    """Each row at its nearest pivot, or, where ``reach`` is given, at every pivot no farther than its reach; with the angle to it.

    A row of a dimension that no pivot has is at pivot -1, with angle 0.
    """

    def run(frames):
        for frame in frames:
            out = []
            for dim, same in frame.groupby(frame["vector"].map(len)):
                here = pivots.get(dim)
                if here is None:
                    out.append(same.assign(dim=dim, pivot=-1, angle=0.0))
                    continue
                far = angles(units(same["vector"]), here)
                if reach is None:
                    near = far.argmin(axis=1)
                    out.append(same.assign(dim=dim, pivot=near, angle=far[np.arange(len(near)), near]))
                else:
                    k, p = np.nonzero(far <= np.array([reach.get((dim, q), -1.0) for q in range(len(here))])[None, :])
                    out.append(same.iloc[k].assign(dim=dim, pivot=p, angle=far[k, p]))
            yield pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in PLACED.split(", ")})

    return rows.mapInPandas(run, PLACED)


def compare(least: float):
    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["first"]], frame[~frame["first"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        cos = units(a["vector"]) @ units(b["vector"]).T
        i, j = np.nonzero(cos >= least)
        return pd.DataFrame({"a": a["id"].to_numpy()[i], "b": b["id"].to_numpy()[j], "cosine": cos[i, j]})

    return cell


def regions(left: DataFrame, right: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Left and right rows by region (dim, pivot, ring): a left row is in one, and every right row that may fit it is there too.

    Left rows go to their nearest pivot, into rings as wide as the largest angle that fits. By the triangle inequality a fitting right row is within that angle of
    the ring, so it goes to the three rings around its own angle, at the pivots whose farthest left row it may fit. Only the pivots and the reach
    of each, one number, come to the driver.
    """
    theta = math.acos(max(-1.0, min(1.0, least))) + MARGIN
    left, right = clean(left), clean(right)
    found: dict[int, list] = {}
    for r in left.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect():
        found.setdefault(len(r.vector), []).append(r.vector)
    pivots = {dim: units(v) for dim, v in found.items()}
    a = placed(left, pivots, None)
    reach = {(r.dim, r.pivot): r.far + theta for r in a.groupBy("dim", "pivot").agg(F.max("angle").alias("far")).where("pivot >= 0").collect()}
    b = placed(right, pivots, reach)
    ring = lambda x: F.floor(x / theta).cast("int")
    a = a.withColumn("ring", ring(F.col("angle")))
    b = b.withColumn("ring", F.explode(F.sequence(ring(F.col("angle") - theta), ring(F.col("angle") + theta))))
    return a, b


def cosine_pairs(left: DataFrame, right: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(a, b, cosine) of the rows (id, vector) of two tables whose cosine is ``least`` or more; only pairs of one region are compared.

    Regions with many rows are dealt into cells of ``block`` by ``block`` rows, so no task gets a whole one. Vectors without a direction fit nothing; ``least`` must be over -1.
    """
    a, b = regions(left, right, least)
    key = ["dim", "pivot", "ring"]
    size = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cells = size(a, "na").join(size(b, "nb"), key)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = a.join(cells, key).select(*key, own("na").alias("i"), every("nb").alias("j"), F.lit(True).alias("first"), "id", "vector")
    y = b.join(cells, key).select(*key, every("na").alias("i"), own("nb").alias("j"), F.lit(False).alias("first"), "id", "vector")
    return x.unionByName(y).groupBy(*key, "i", "j").applyInPandas(compare(least), "a long, b long, cosine double")


#: Pairs of a left row that a task keeps, right rows that it compares at once, and how far a product of matrices may be off.
KEPT, SLICE, OFF = 64, 512, 1e-9


def squares(x: np.ndarray) -> np.ndarray:
    """Sums of squares, term by term."""
    out = np.zeros(len(x))
    for c in x.T:
        out += c * c
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows and no bit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def best_pairs(vectors: list, least: float):
    """A function of batches (id, vector): k (the place in ``vectors``), b, cosine and more of the ``KEPT`` best rows of each vector, with a cosine of ``least`` or more.

    Cosines are summed term by term, so equal vectors have equal ones wherever they stand. ``more`` is at the last pair kept where others were left out.
    """
    dims: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        dims.setdefault(len(v), []).append(k)
    known = {}
    for dim, ks in dims.items():
        x = scaled(np.array([vectors[k] for k in ks], float))
        known[dim] = (np.array(ks), x, squares(x))
    count = len(vectors)

    def pairs(batch, floor):
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for dim, (ks, x, xx) in known.items():
            here = np.flatnonzero(lengths == dim)
            if not len(here):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[here]
            y = scaled(batch.column(1).take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            yy = squares(y)
            u, v, xt, yt = x / np.sqrt(xx)[:, None], y / np.sqrt(yy)[:, None], np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
            for s in range(0, len(y), SLICE):
                i, j = np.nonzero(u @ v[s : s + SLICE].T >= floor[ks][:, None] - OFF)
                j, dot = j + s, np.zeros(len(i))
                for d in range(dim):
                    dot += xt[d][i] * yt[d][j]
                cos = np.clip(dot / np.sqrt(xx[i] * yy[j]), -1, 1)
                fit = cos >= least
                yield ks[i[fit]], ids[j[fit]], cos[fit]

    def best(held, floor, cut):
        k, b, c = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, -c, k))
        k, b, c = k[order], b[order], c[order]
        rank = np.arange(len(k)) - np.searchsorted(k, k)
        over, last = k[rank == KEPT], rank == KEPT - 1
        cut[over] = True
        floor[k[last]] = np.where(cut[k[last]], c[last], floor[k[last]])
        keep = rank < KEPT
        return k[keep], b[keep], c[keep], last[keep] & cut[k[keep]]

    def run(batches):
        floor, cut, held, size = np.full(count, least), np.zeros(count, bool), [], 0
        for batch in batches:
            for found in pairs(batch, floor):
                held.append(found)
                size += len(found[0])
                if size > 2 * KEPT * count + 1_000_000:
                    held = [best(held, floor, cut)[:3]]
                    size = len(held[0][0])
        if held:
            k, b, c, more = best(held, floor, cut)
            for s in range(0, len(k), 65_536):
                part = slice(s, s + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(k[part], pa.int64()), pa.array(b[part], pa.int64()), pa.array(c[part]), pa.array(more[part])], ["k", "b", "cosine", "more"])

    return run


def in_turn(ids: list[int]):
    """A function of batches (k, b, cosine, more), sorted: each k takes the first b that none before it took, as rows (a, b, cosine) with a from ``ids``.

    Where that may be a pair that was left out, it ends with a row that has only ``stop``, the k that is still open.
    """

    def run(batches):
        used, decided, stop = set(), -1, None
        for batch in batches:
            if stop is not None or not batch.num_rows:
                continue
            k, b, c, more = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            starts = np.flatnonzero(np.diff(k, prepend=-1))
            a = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(k)]):
                if k[s] == decided:
                    continue
                for r in range(s, e):
                    if b[r] not in used:
                        used.add(b[r])
                        decided = k[s]
                        a.append(r)
                        break
                    if more[r]:
                        stop = int(k[s])
                        break
                if stop is not None:
                    break
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in k[a]], pa.int64()), pa.array(b[a], pa.int64()), pa.array(c[a], pa.float64()), pa.nulls(len(a), pa.int64())], ["a", "b", "cosine", "stop"])
        if stop is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([stop], pa.int64())], ["a", "b", "cosine", "stop"])

    return run
