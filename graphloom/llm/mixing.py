"""Operator 7: mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import Scratch

#: Words of a block and the weights that sources take in turn, by name.
BLOCK = 1024
WEIGHTS = (3, 1, 2)
#: Slots of the schedule that are ranked together, and shuffle buckets of a source: ranks and running sums are taken in
#: two steps, so that no source is one task's work however many rows it has.
CHUNK = 65_536
BUCKETS, BUCKET_ROWS = 1024, 1_000_000
#: Bits of a point that are cut off to look up the few sources whose stretch may hold it.
BIN_BITS = 20
#: The golden ratio's fractional part, as a 32-bit fraction (fixed value).
GOLDEN_32 = 2654435769


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target from (source, size) rows.

    Sources in order of their code points, null last, take ``weights`` in turn and share ``share`` of all sizes by them; a
    target stops at ``most`` times its source's size, and the excess goes to the others by weight. With L the
    target of one unit of weight, that is min(most * size, L * weight): sources reach their limit in order of limit
    over weight, so L follows from running sums in that order. The windows here run over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (F.col("_total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_total", total).withColumn("_level", level)
    # The first source in that order whose limit its level doesn't reach: its level holds for it and all after it.
    rows = rows.withColumn("_held", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("_ratio"), "_level"))).over(everything)["_level"])
    held = F.coalesce("_held", F.lit(float("inf")))
    target = F.when(held * F.col("weight") >= F.col("limit"), F.col("limit")).otherwise(held * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def slots_needed(block: int):
    """Slots that reach a source's target: whole rounds of its blocks, the last of which is short, and what is left."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (rounds * F.ceil(F.col("source_size") / block) + F.ceil((F.floor("target") - rounds * F.col("source_size")) / block)).cast("long")


def schedule(spark: SparkSession, targets: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """slot, source_id and rank of every block that the mix takes, in the order it is read.

    Slot i stands at the fractional part of i times the golden ratio; the source whose stretch of the cumulative
    weights holds that point gets it. The rank is the number of earlier slots of the source. A source uses its first
    slots_needed() slots; where its points fall short of that by a few, the missing ones follow at the end.
    ``targets`` has source_id, source_size, target, low and high (the stretch, as 32-bit points), one row a source. Points and stretches meet by the
    high bits of the points, so a point is compared with the sources of its bin only.
    """
    slots = targets.agg(F.coalesce(F.sum(slots_needed(block)), F.lit(0)).cast("long").alias("n")).where("n > 0")
    numbered = slots.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)))).alias("chunk"), "n")
    points = numbered.repartition("chunk").select("chunk", "n", F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("n"), (F.col("chunk") + 1) * chunk) - 1, F.lit(1).cast("long"))).alias("slot")).where(F.col("slot") < F.col("n"))
    points = points.withColumn("point", F.pmod(F.col("slot") * F.lit(GOLDEN_32).cast("long"), F.lit(1 << 32)))
    bins = F.sequence(F.shiftright("low", BIN_BITS), F.shiftright(F.col("high") - 1, BIN_BITS))
    stretches = targets.where("high > low").select("source_id", "low", "high", slots_needed(block).alias("needs"), F.explode(bins).alias("bin"))
    drawn = points.withColumn("bin", F.shiftright("point", BIN_BITS)).join(stretches, "bin").where("point >= low and point < high").drop("bin")
    counts = drawn.groupBy("source_id", "chunk").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("source_id").orderBy("chunk")) - F.col("_n")).select("source_id", "chunk", "_before")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source_id", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(before, ["source_id", "chunk"]).select("slot", "source_id", (F.col("rank") + F.col("_before")).cast("long").alias("rank"), "needs").where(F.col("rank") < F.col("needs"))
    got = counts.groupBy("source_id").agg(F.sum("_n").alias("got"))
    short = targets.select("source_id", slots_needed(block).alias("needs")).join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where(F.col("got") < F.col("needs"))
    tail = short.select(F.lit(None).cast("long").alias("slot"), "source_id", F.explode(F.sequence("got", F.col("needs") - 1)).alias("rank"))
    return ranked.select("slot", "source_id", "rank").unionByName(tail)


def mix_sources(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source).

    Each source's documents are put in a shuffled order (by a hash of the id), end to end, and cut into blocks of
    ``block`` words; the source's slots of the schedule take block 0, 1, ... and begin again after the last. The last slot is
    cut where the target is reached, so a source's taken words are its target rounded down. ``taken`` counts the
    words of the document in the blocks taken, repeats included: at most ``most`` times its size.

    A null text has size 0; a null source is a source of its own, last in order. Rows without words are kept with
    taken 0; repeated rows each give a row; other columns are ignored; an empty table gives an empty result. The
    order depends on ids and sizes alone, so reruns agree.
    """
    scratch = Scratch(spark, "mixing")
    buckets = buckets or max(BUCKETS, docs.count() // BUCKET_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    sums = docs.groupBy("source", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(buckets)).cast("int").alias("bucket")).agg(F.sum("size").alias("size"))
    sums = scratch.write(sums, "sums")
    by_source = source_targets(sums, weights, share, most)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    span = float(1 << 32)
    everything = F.sum("target").over(Window.partitionBy())
    high = F.when(everything > 0, F.round(F.sum("target").over(order) / everything * span)).otherwise(F.lit(0.0)).cast("long")
    targets = by_source.withColumn("source_id", F.row_number().over(order)).withColumn("high", high)
    targets = targets.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0).cast("long")))
    # Written, so that the planner knows their size: they are broadcast where they are small.
    targets = scratch.write(targets, "targets")
    per_source = targets.select("source", "source_id", "source_size", "target")
    before = sums.withColumn("_before", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).select("source", "bucket", "_before")
    placed = docs.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "size")
    placed = placed.withColumn("at", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("row", F.row_number().over(own))
    placed = placed.join(before, (placed["source"].eqNullSafe(before["source"])) & (placed["bucket"] == before["bucket"])).select("doc_id", placed["source"], placed["bucket"], "row", "size", (F.col("at") + F.col("_before")).alias("at"))
    placed = placed.join(per_source, placed["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    # (source, block, words of it that are taken, times) of the schedule: repeats of a block are one row
    slots = schedule(spark, targets, block).join(targets.select("source_id", "source_size", F.floor("target").alias("_target")), "source_id")
    blocks = F.ceil(F.col("source_size") / block)
    # The source's words are a ring; block b of round r covers words r * source_size + b * block onwards.
    slots = slots.withColumn("block", F.pmod("rank", blocks)).withColumn("_round", F.floor(F.col("rank") / blocks))
    start = F.col("_round") * F.col("source_size") + F.col("block") * block
    taken_to = F.least(F.col("_target") - start, F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    uses = slots.withColumn("to", taken_to).where(F.col("to") > 0).groupBy("source_id", "block").agg(F.collect_list("to").alias("tos"))
    pieces = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))))
    joined = pieces.join(uses, ["source_id", "block"], "left")
    begin = F.greatest(F.col("at") - F.col("block") * block, F.lit(0).cast("long"))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    took = F.coalesce(F.aggregate("tos", F.lit(0).cast("long"), lambda acc, to: acc + F.greatest(F.least(end, to) - begin, F.lit(0).cast("long"))), F.lit(0).cast("long"))
    one = joined.withColumn("took", took).groupBy("source_id", "bucket", "row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("took").alias("taken"))
    return one.select("doc_id", "source", "size", "source_size", "target", "taken")
