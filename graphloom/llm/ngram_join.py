"""Operator 1: exact Jaccard join of word n-gram sets by signature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import map_groups, slices, text_bytes, tuned
from graphloom.llm.components import connected
from graphloom.llm.hashing import bytes_set, mix, set_bytes, set_key, shingle_sets, word_chunks
from graphloom.llm.id_filter import maybe_id
from graphloom.llm.signature_tree import SignatureTree, bitmap, bucket_runs, folded, link_sets, similar, wide_fit
from graphloom.llm.sketch import count_sketch, slot
from graphloom.session import Scratch

#: Words of a shingle, and the least similarity in percent.
SIZE, PERCENT = 5, 80
#: Documents of a tree with their texts, and with their bitmaps alone.
TREE, WIDE_TREE = 512, 2048
#: Postings of a shingle that one task takes; those of a shingle that stands out with more are dealt.
HOT = 1 << 15


def batch_sets(batch: pa.RecordBatch, size: int):
    """The sorted distinct shingle hashes of each row."""
    raw, offsets = text_bytes(batch)
    for _, hashed, where in word_chunks(raw, offsets):
        yield from shingle_sets(hashed, where, size)


def rare_first(values: np.ndarray, counts: np.ndarray, take: int) -> np.ndarray:
    """The ``take`` rarest hashes by (count of the sketch, hash): one order for the whole corpus."""
    return values[np.lexsort((values, counts[slot(values)]))[:take]]


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of n, rarest first, of which two similar sets share one at least."""
    return n - -(-percent * n // 100) + 1 if n else 0


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, key1, key2 and sig of every row: size, 128-bit key and bitmap of its shingle set."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = list(batch_sets(batch, size))
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array([s.size for s in sets], pa.int64()), "key1": pa.array([k for k, _ in keys], pa.int64()), "key2": pa.array([k for _, k in keys], pa.int64()), "sig": pa.array([bitmap(s) for s in sets], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, key1 long, key2 long, sig binary")


def shared_postings(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """token and key1 of the prefix tokens that sets of more than one key1 have; a pair may occur more than once.

    The tokens go from the texts straight into one shuffle; what comes out of it is the small part that is shared. A task posts a
    set that it has posted before no second time. A token that stands out of the sketch is dealt over many tasks and counts as shared.
    """
    noise = 2 * int(np.median(counts)) + 1
    held = docs.sparkSession.sparkContext.broadcast(counts)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def post(batches):
        done: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                tokens, keys, lengths = [], [], []
                for s, doc in zip(batch_sets(batch, size), batch.column("doc_id").is_valid().to_pylist()):
                    key = set_key(s)[0]
                    if not s.size or not doc or key in done:
                        continue
                    done.add(key)
                    tokens.append(rare_first(s, held.value, prefix_size(s.size, percent)))
                    keys.append(key)
                    lengths.append(tokens[-1].size)
                if len(done) > 1 << 20:
                    done.clear()
                if tokens:
                    token, key = np.concatenate(tokens), np.repeat(np.array(keys, np.int64), lengths)
                    deals = np.maximum(held.value[slot(token)].astype(np.int64) - noise, 0) // HOT
                    salt = np.where(deals > 0, 1 + (mix(key.view(np.uint64)) % np.maximum(deals, 1).astype(np.uint64)).astype(np.int64), 0)
                    yield pa.RecordBatch.from_pydict({"token": pa.array(token.view(np.int64)), "key1": pa.array(key), "salt": pa.array(salt.astype(np.int32))})

    dealt = docs.mapInArrow(post, "token long, key1 long, salt int").repartition(parts, "token", "salt").sortWithinPartitions("token")

    def shared(batches):
        last = None  # (token, key1, whether it is out) of the last row
        for batch in batches:
            token, key = batch.column("token").to_numpy(), batch.column("key1").to_numpy()
            if not token.size:
                continue
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(start, token.size))
            several = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)
            going_on = last is not None and last[0] == token[0]
            if going_on:
                several[0] |= bool((key[: length[0]] != last[1]).any()) or last[2]
            if going_on and several[0] and not last[2]:
                yield pa.RecordBatch.from_pydict({"token": pa.array([last[0]], pa.int64()), "key1": pa.array([last[1]], pa.int64())})
            out = np.repeat(several, length) | (batch.column("salt").to_numpy() > 0)
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[out]), "key1": pa.array(key[out])})
            # Of a run that has had one key1 so far, that key1 is still to be given.
            last = (int(token[-1]), int(key[-1]), bool(out[-1]) or going_on and len(start) == 1 and last[2])

    return dealt.mapInArrow(shared, "token long, key1 long")


def narrowed(docs: DataFrame, wanted) -> DataFrame:
    """rep and text of the rows whose id ``wanted`` lets through: only they are moved."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                ids = batch.column("doc_id")
                ok = pa.array(wanted(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([ids.filter(ok), batch.column("text").filter(ok)], names=["rep", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, text string")


def own_sets(table, size: int):
    """(row, set) of the rows whose text has the key that the row names: where an id occurs with several texts, only that one counts."""
    k1, k2 = table.column("key1").to_pylist(), table.column("key2").to_pylist()
    for k, s in enumerate(batch_sets(table, size)):
        if set_key(s) == (k1[k], k2[k]):
            yield k, s


def with_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rep and ``set``, the sorted shingle hashes as bytes, of the documents of ``wanted`` (rep, key1, key2)."""
    joined = wanted.join(narrowed(docs, maybe_id(wanted.select("rep"))), "rep")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                own = list(own_sets(batch, size))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array([k for k, _ in own], pa.int64())), pa.array([set_bytes(s) for _, s in own], pa.binary())], names=["rep", "set"])

    return joined.mapInArrow(run, "rep long, set binary")


def tree_links(docs: DataFrame, seats: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of the rows of ``seats`` (token, salt, rep, key1, key2) of each (token, salt) by one signature tree.

    The texts move, which are less than half as large as the sets; a task makes the sets of some cells at a time.
    """

    def join(table, bucket):
        reps = table.column("rep").to_numpy()
        rows, sets = [], []
        for k, s in own_sets(table, size):
            rows.append(k)
            sets.append(s)
        rows = np.array(rows, np.int64)
        order = np.lexsort((reps[rows], bucket[rows]))
        r, b = reps[rows][order], bucket[rows][order]
        order = order[np.append(True, (np.diff(r) != 0) | (np.diff(b) != 0))] if order.size else order
        bucket = bucket[rows][order]
        for begin, end in bucket_runs(bucket):
            own = order[begin:end]
            links = link_sets(reps[rows[own]].tolist(), [sets[k] for k in own], bucket[begin:end], percent)
            yield {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())}

    rows = seats.join(narrowed(docs, maybe_id(seats.select("rep"))), "rep")
    return map_groups(rows.select("token", "salt", "rep", "key1", "key2", "text"), ["token", "salt"], join, "a long, b long")


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that the bitmaps of a cell's (token, kind, i, j, rep, n, sig, component) rows can't tell apart."""

    def join(table, bucket):
        reps = table.column("rep").to_numpy()
        order = np.lexsort((reps, bucket))
        order = order[np.append(True, (np.diff(reps[order]) != 0) | (np.diff(bucket[order]) != 0))]
        codes = np.unique(table.column("component").to_numpy()[order], return_inverse=True)[1]
        sigs = table.column("sig").take(order).to_pylist()
        n = table.column("n").to_numpy()[order]
        tree = SignatureTree(folded(sigs), n, codes, bucket[order])
        reps = reps[order]
        for a, b, _ in tree.pairs(percent):
            ok = wide_fit(sigs, n, a, b, percent)
            a, b = a[ok], b[ok]
            yield {"a": pa.array(np.minimum(reps[a], reps[b])), "b": pa.array(np.maximum(reps[a], reps[b]))}

    cells = rows.select("token", F.col("cell.kind").alias("kind"), F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "rep", "n", "sig", "component")
    return map_groups(cells, ["token", "kind", "i", "j"], join, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                ok = [similar(bytes_set(x), bytes_set(y), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def dealt_buckets(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (token, rep, component, lead_component, ...) with ``cell``: the groups that one task joins.

    A bucket of up to ``most`` rows is one cell. A larger one is cut into blocks of its leading component and blocks
    of the others; a cell is a pair of blocks of which one at least is of others, since rows of one component need not meet.
    """
    other = F.col("component") != F.col("lead_component")
    sizes = rows.groupBy("token").agg(F.count("*").alias("_n"), F.sum(other.cast("long")).alias("_o"))
    rows = rows.join(sizes, "token")
    blocks_o = F.when(F.col("_n") <= most, F.lit(0)).otherwise(F.ceil(F.col("_o") / most)).cast("int")
    blocks_m = F.ceil((F.col("_n") - F.col("_o")) / most).cast("int")
    rows = rows.withColumn("_ko", blocks_o).withColumn("_km", blocks_m)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(other, F.col("_ko")).otherwise(F.col("_km")))).cast("int"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).cast("int").alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("_own")
    of_main = F.transform(upto(F.col("_ko")), lambda o: cell(1, own, o))
    of_other = F.concat(F.transform(upto(F.col("_km")), lambda m: cell(1, m, own)), F.transform(upto(F.col("_ko")), lambda o: cell(2, F.least(own, o), F.greatest(own, o))))
    cells = F.when(F.col("_ko") == 0, F.array(cell(0, F.lit(0), F.lit(0)))).when(other, of_other).otherwise(of_main)
    return rows.withColumn("cell", F.explode(cells)).drop("_n", "_o", "_ko", "_km", "_own")


def near_copies(spark: SparkSession, docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles (words are runs
    of characters other than space and \\x09 to \\x0D, A-Z as a-z); a document of fewer words is one shingle.
    component_id is the smallest doc_id reachable by links.

    Equal sets are one class, which its smallest doc_id stands for. Classes that share a token of their rarest-first
    prefixes meet in a bucket. First every class goes, with its set, to the signature tree of its largest bucket, which
    finds and verifies all that links there; this joins large groups of copies in one go. Then only buckets that
    still hold several components are traversed again, by bitmaps, for pairs between different components, and those
    pairs are verified. Hot buckets are dealt into blocks, and no step drops or samples candidates.

    A null or empty text has 0 shingles and is linked with nothing. A null doc_id links with nothing either, and its
    component is null. Repeated rows each give a row, rows of one id with different texts too: each is linked by its own text;
    other columns are ignored; an empty table gives an empty result. Whole texts count.
    """
    tuned(spark)
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = count_sketch(docs.select("text"), lambda batch: batch_sets(batch, size))
    rows = scratch.write(shingle_rows(docs, size), "rows")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"))
    classes = scratch.write(classes.select("key1", "key2", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig")), "classes")
    keyed = scratch.write(rows.drop("sig"), "keyed")
    scratch.drop("rows")

    shared = scratch.write(shared_postings(docs, counts, size, percent).distinct().join(classes.select("key1", "rep"), "key1").select("token", "rep"), "shared")
    buckets = shared.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lead"))
    buckets = buckets.where("size > 1").groupBy("size", "x", "lead").agg(F.min("token").alias("token"))  # of buckets with the same classes one is enough
    inside = scratch.write(shared.join(buckets.drop("x"), "token"), "inside")
    scratch.drop("shared")

    best = inside.groupBy("rep").agg(F.max(F.struct("size", "token", "lead")).alias("x")).select("rep", "x.*")
    best = best.withColumn("salts", F.ceil(F.col("size") / TREE).cast("int"))
    # The rows of a bucket larger than a tree sit in two trees, dealt by two hashes, so that what links in it soon hangs together.
    seat = lambda k: F.pmod(F.xxhash64(F.lit(k), "rep"), F.col("salts")).cast("int") + k * F.col("salts")
    seats = best.select("token", "lead", "rep", F.explode(F.when(F.col("salts") > 1, F.array(seat(0), seat(1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    seats = seats.select("token", "salt", "rep").unionByName(seats.select("token", "salt", F.col("lead").alias("rep")).distinct()).distinct()
    keys = classes.select("rep", "key1", "key2")
    seats = scratch.write(seats.join(keys, "rep"), "seats")
    first = scratch.write(tree_links(docs, seats, size, percent), "links1")
    scratch.drop("seats")

    labels = connected(scratch, first, "cc1").withColumnRenamed("node", "rep")
    placed = inside.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("rep") == F.col("lead"), F.col("component"))).alias("lead_component")).where("low <> high")
    open_ = placed.join(mixed.select("token", "lead_component"), "token").join(classes.select("rep", "n", "sig"), "rep").select("token", "rep", "component", "lead_component", "n", "sig")
    pairs = scratch.write(tree_pairs(dealt_buckets(open_, WIDE_TREE), percent).distinct(), "pairs")
    scratch.drop("inside")
    links = first
    if not pairs.isEmpty():
        asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(keys, "rep")
        sets = scratch.write(with_sets(docs, asked, size), "sets")
        more = scratch.write(verified(pairs, sets, percent), "links2")
        scratch.drop("sets", "pairs")
        links = first.unionByName(more)
    final = connected(scratch, links, "cc2").withColumnRenamed("node", "rep")
    per_class = scratch.write(classes.select("key1", "key2", "rep").join(final, "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component_id")), "components")
    scratch.drop("classes", "links1", "links2", "cc1", "cc2")
    out = keyed.join(per_class, ["key1", "key2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
