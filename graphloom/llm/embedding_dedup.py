"""Operator 9: near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_batches, map_groups, slices, tuned
from graphloom.llm.components import connected
from graphloom.session import Scratch

#: Passes, neighbours that a row is compared with in each, and bits of a pass's concatenated hash.
PASSES, WINDOW, BITS = 12, 64, 40
#: Bits of a vector's signature, by which candidates are chosen from a window.
SIGNATURE = 256
#: Classes of a component that one task compares with each other.
BLOCK = 256
SEED = 20_240_917
#: Signatures of cosine ``least`` differ in a share of their bits that follows a binomial; a pair beyond so many deviations is no candidate.
DEVIATIONS = 6.0


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PASSES * BITS))


def unit(vectors: list) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors are padded with zeros."""
    width = max(map(len, vectors))
    x = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_dim(vectors: list):
    """(rows, matrix of unit rows) of each length among ``vectors``."""
    rows: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        rows.setdefault(len(v), []).append(k)
    for own in rows.values():
        yield own, unit([vectors[k] for k in own])


def vector_classes(spark: SparkSession, vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(all rows as vec_id, label, digest or null; one row a class of equal vectors of a label: rep, label, dim, digest, n, vector).

    Vectors stay as the table has them, single precision where it is so.
    """
    tuned(spark)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))

    def run(batch):
        digests = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
            ok = label is not None and v and None not in v
            x = np.array(v, float) + 0.0 if ok else None  # -0.0 becomes 0.0
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if ok else None)
        return pa.table({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vector": batch.column("vector"), "digest": pa.array(digests, pa.string())})

    marked = scratch.write(map_batches(rows, run, f"vec_id long, label long, vector array<{kind}>, digest string"), "marked")
    classes = marked.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = scratch.write(classes.select("rep", "label", F.size("vector").alias("dim"), "digest", "n", "vector"), "classes")
    keyed = scratch.write(marked.select("vec_id", "label", "digest"), "keyed")
    scratch.drop("marked")
    return keyed, classes


def label_centres(classes: DataFrame) -> DataFrame:
    """label, dim and centre (the mean of the unit vectors) of each; summed up in the tasks first."""

    def sums(batches):
        held: dict[tuple[int, int], list] = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_pydict({"label": pa.array([k for k, _ in keys], pa.int64()), "dim": pa.array([d for _, d in keys], pa.int32()), "n": pa.array([held[k][0] for k in keys], pa.int64()), "total": pa.array([held[k][1].tolist() for k in keys], pa.list_(pa.float64()))})

        for whole in batches:
            for batch in slices(whole):
                labels = batch.column("label").to_numpy()
                for own, x in by_dim(batch.column("vector").to_pylist()):
                    names, at = np.unique(labels[own], return_inverse=True)
                    for k, name in enumerate(names.tolist()):
                        seen = held.setdefault((name, x.shape[1]), [0, np.zeros(x.shape[1])])
                        seen[0] += int((at == k).sum())
                        seen[1] += x[at == k].sum(axis=0)
                if len(held) > 512:
                    yield out()
                    held.clear()
        if held:
            yield out()

    parts = classes.select("label", "vector").mapInArrow(sums, "label long, dim int, n long, total array<double>")
    each = parts.select("label", "dim", F.posexplode("total").alias("k", "x")).groupBy("label", "dim", "k").agg(F.sum("x").alias("x"))
    counts = parts.groupBy("label", "dim").agg(F.sum("n").alias("n"))
    whole = each.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]).alias("total"))
    return whole.join(counts, ["label", "dim"]).select("label", "dim", F.transform("total", lambda y: y / F.col("n")).alias("centre"))


def projected(classes: DataFrame, centres: DataFrame, passes: int) -> DataFrame:
    """A row for each class and pass: pass, label, dim, key, rep and sig.

    A bit says on which side of a random plane a vector lies. The planes of ``key`` (a pass's bits, the first bit highest) go through the
    centre of the vector's label, so that labels whose vectors are close together are spread as well as others; those of ``sig`` go
    through 0, so that the share of bits in which two signatures differ follows from their vectors' angle.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                vectors, centres_ = batch.column("vector").to_pylist(), batch.column("centre").to_pylist()
                bits, plain = np.zeros((len(vectors), PASSES * BITS), bool), np.zeros((len(vectors), SIGNATURE), bool)
                for own, x in by_dim(vectors):
                    at = planes(x.shape[1])
                    bits[own] = (x - np.array([centres_[k] for k in own])) @ at > 0
                    plain[own] = x @ at[:, :SIGNATURE] > 0
                sigs = [r.tobytes() for r in np.packbits(plain, axis=1)]
                power = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
                for k in range(passes):
                    key = bits[:, k * BITS : (k + 1) * BITS].astype(np.int64) @ power
                    yield pa.RecordBatch.from_pydict({"pass": pa.array(np.full(len(vectors), k, np.int32)), "label": batch.column("label"), "dim": batch.column("dim"), "key": pa.array(key), "rep": batch.column("rep"), "sig": pa.array(sigs, pa.binary())})

    joined = classes.join(centres, ["label", "dim"]).select("rep", "label", "dim", "vector", "centre")
    return joined.mapInArrow(run, "pass int, label long, dim int, key long, rep long, sig binary")


def most_bits(least: float) -> int:
    """Bits in which the signatures of vectors of cosine ``least`` may differ."""
    share = np.arccos(min(1.0, max(-1.0, least))) / np.pi
    return int(np.ceil(share * SIGNATURE + DEVIATIONS * np.sqrt(SIGNATURE * share * (1 - share))))


def windows(rep, group, sig, fresh: int, window: int, most: int):
    """(i, j, best): the rows j from ``fresh`` on and the ``window`` rows i before each, of one group, whose signatures differ in at most ``most`` bits.

    ``best`` marks the nearest of a row's candidates, the later row of equals.
    """
    found = []
    least = np.full(rep.size, np.iinfo(np.int64).max)
    for d in range(1, min(window, rep.size - 1) + 1):
        j = np.arange(max(fresh, d), rep.size)
        i = j - d
        same = group[i] == group[j]
        i, j = i[same], j[same]
        bits = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)
        near = bits <= most
        i, j, bits = i[near], j[near], bits[near]
        least[j] = np.minimum(least[j], bits * (window + 1) + d)
        found.append((i, j, bits * (window + 1) + d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    i, j, rank = (np.concatenate(x) for x in zip(*found))
    return i, j, rank == least[j]


def columns_of(batch):
    """(rep, group, sig as words) of sorted rows; a group is a run of equal (pass, label, dim)."""
    p, label, dim = (batch.column(c).to_numpy() for c in ("pass", "label", "dim"))
    group = [p.astype(np.int64) << 32 | dim.astype(np.int64), label]
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(p), -1)
    return batch.column("rep").to_numpy(), np.stack(group, axis=1).view([("a", np.int64), ("b", np.int64)]).ravel(), sig.view(np.uint64)


ROW = "pass int, label long, dim int, key long, rep long, sig binary"
COLUMNS = ("pass", "label", "dim", "key", "rep", "sig")


def candidates(rows: DataFrame, window: int, most: int, scratch: Scratch) -> DataFrame:
    """(a, b, best) of rows that stand within ``window`` places of each other in a pass's order and whose signatures are near.

    Rows are sorted by (pass, label, dim, key, rep) over the cluster by ranges; a task keeps the last ``window`` rows that it has
    read. The first and last ``window`` rows of each range are handed on with their places in the whole order; those within ``window`` places
    of a cut, from as many short ranges as it takes, are compared in a second step. So the pairs are the same wherever the ranges are cut.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("pass", "label", "dim", "key", "rep")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("best", pa.bool_()), ("part", pa.int32()), ("place", pa.int64()), ("pass", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()), ("key", pa.int64()), ("rep", pa.int64()), ("sig", pa.binary())])

    def pairs(rep, i, j, best):
        a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(best), *(pa.nulls(a.size, f.type) for f in list(schema)[3:])], schema=schema)

    def edge(table, first, part):
        n = table.num_rows
        return pa.Table.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, part, np.int32)), pa.array(first + np.arange(n)), *(table.column(c) for c in COLUMNS)], schema=schema)

    def compare(batches):
        from pyspark import TaskContext

        part, carry, count = TaskContext.get().partitionId(), None, 0
        for whole in batches:
            for batch in slices(whole, 4096):
                if not batch.num_rows:
                    continue
                new = pa.Table.from_batches([batch]).select(COLUMNS)
                if count < window:
                    yield from edge(new.slice(0, window - count), count, part).to_batches()
                both = pa.concat_tables([carry, new]).combine_chunks() if carry is not None else new
                rep, group, sig = columns_of(both)
                i, j, best = windows(rep, group, sig, both.num_rows - new.num_rows, window, most)
                if i.size:
                    yield pairs(rep, i, j, best)
                carry, count = both.slice(max(0, both.num_rows - window)), count + new.num_rows
        if carry is not None:
            # The rows that were not given as first ones; the last row always is, so that the end of the range is known.
            begin = min(max(count - carry.num_rows, window), count - 1)
            yield from edge(carry.slice(begin - (count - carry.num_rows)), begin, part).to_batches()

    found = scratch.write(dealt.mapInArrow(compare, "a long, b long, best boolean, part int, place long, " + ROW), "windows")
    edges = found.where("b is null").drop("a", "b", "best")
    sizes = {r.part: r.n for r in edges.groupBy("part").agg((F.max("place") + 1).alias("n")).collect()}  # one number a range
    starts = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[p] for p in sorted(sizes)])]).tolist()))
    cuts = np.array(sorted(starts.values()))[1:]

    def seams(batches):
        for batch in batches:
            rank = np.array([starts[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("place").to_numpy()
            low, high = np.searchsorted(cuts, rank - window, side="right"), np.searchsorted(cuts, rank + window, side="right")
            at = np.repeat(np.arange(rank.size), high - low)
            seam = np.arange(at.size) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[at]
            rows_ = batch.select(list(COLUMNS)).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cuts[seam] if at.size else np.zeros(0, np.int64)), pa.array(rank[at]), *rows_.columns], names=["seam", "rank", *COLUMNS])

    def across(table, bucket):
        rank, seam = table.column("rank").to_numpy(), table.column("seam").to_numpy()
        order_ = np.lexsort((rank, bucket))
        order_ = order_[np.append(True, (np.diff(rank[order_]) != 0) | (np.diff(bucket[order_]) != 0))]
        rep, group, sig = columns_of(table.take(pa.array(order_)).combine_chunks())
        rank, seam = rank[order_], seam[order_]
        i, j, best = windows(rep, group, sig, 0, 2 * window, most)
        ok = (seam[i] == seam[j]) & (rank[i] < seam[i]) & (rank[j] >= seam[j]) & (rank[j] - rank[i] <= window)
        yield {"a": pa.array(np.minimum(rep[i[ok]], rep[j[ok]])), "b": pa.array(np.maximum(rep[i[ok]], rep[j[ok]])), "best": pa.array(best[ok])}

    joined = map_groups(edges.mapInArrow(seams, "seam long, rank long, " + ROW), ["seam"], across, "a long, b long, best boolean")
    return found.where("b is not null").select("a", "b", "best").unionByName(joined).groupBy("a", "b").agg(F.max("best").alias("best"))


def verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose vectors have a cosine of ``least`` or more in double precision; only vectors of candidates move."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("vector").alias(f"vector_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "vector_a", "vector_b")

    def run(batch):
        x, y = unit(batch.column("vector_a").to_pylist()), unit(batch.column("vector_b").to_pylist())
        ok = pa.array((x * y).sum(axis=1) >= least)
        return pa.table({c: batch.column(c).filter(ok) for c in ("a", "b")})

    return map_batches(joined, run, "a long, b long")


def count_links(grouped: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """rep and linked (vectors of other classes of the component that are linked directly), from rep, n, component, vector.

    Components are dealt into blocks of about BLOCK classes by the hash of rep; each pair of blocks is a cell with a task's work, whichever component it is of.
    """
    sizes = grouped.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = scratch.write(sizes.where("blocks > 1"), "large")  # few: written, so that the planner knows whether it can be broadcast
    dealt = grouped.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j"))
    dealt = dealt.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)))
    cells = dealt.select("component", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "n", "own", "vector")

    def count(table, bucket):
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        for begin, end in zip(cut, [*cut[1:], table.num_rows]):
            cell = table.slice(begin, end - begin)
            vectors, n, own = cell.column("vector").to_pylist(), cell.column("n").to_numpy(), cell.column("own").to_numpy()
            x, width = unit(vectors), np.array([len(v) for v in vectors])
            across = own.min() != own.max()
            linked = np.zeros(len(n), np.int64)
            for at in range(0, len(n), 256):
                near = (x[at : at + 256] @ x.T >= least) & (width[at : at + 256, None] == width)
                near &= own[at : at + 256, None] != own if across else np.arange(at, at + len(near))[:, None] != np.arange(len(n))
                linked[at : at + 256] = near @ n
            yield {"rep": cell.column("rep"), "linked": pa.array(linked)}

    counted = map_groups(cells, ["component", "i", "j"], count, "rep long, linked long")
    return counted.groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one class. Each pass sorts the classes by other random hashes; each is compared with
    its neighbours by the hash bits of all passes, and candidates by their cosine in double precision. Pairs of ``least`` or more are joined
    across passes. Within each component found every pair is then compared, so ``n_links`` is exact there and no group is limited by
    the window. A link is missed only where its two vectors stand more than ``window`` places apart in every pass and no
    chain of other links joins them.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, are linked
    with nothing and kept; so are vectors of another length than the rest of their label. Repeated rows (one vec_id twice with equal
    vectors) each give a row and count as links; other columns are ignored; an empty table gives an empty result.
    """
    if passes > PASSES:
        raise ValueError(f"at most {PASSES} passes")
    scratch = Scratch(spark, "vectors")
    keyed, classes = vector_classes(spark, vectors, scratch)
    centres = scratch.write(label_centres(classes), "centres")
    found = scratch.write(candidates(projected(classes, centres, passes), window, most_bits(least), scratch), "candidates")
    scratch.drop("windows")
    # The nearest candidates join most of what belongs together; of the others only those between components are verified.
    first = scratch.write(verified(found.where("best").select("a", "b"), classes, least), "links1")
    near = connected(scratch, first, "cc1")
    side = lambda x: near.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    apart = found.where("not best").join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    more = scratch.write(verified(apart, classes, least), "links2")
    scratch.drop("candidates")
    labels = scratch.write(connected(scratch, first.unionByName(more), "cc2").withColumnRenamed("node", "rep"), "labels")
    linked = count_links(classes.join(labels, "rep"), least, scratch)
    per_class = classes.select("label", "digest", "rep", "n").join(labels, "rep", "left").join(linked, "rep", "left")
    per_class = per_class.select("label", "digest", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = keyed.join(per_class, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
