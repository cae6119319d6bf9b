"""Operator 12: what each filter of a quality chain removes, for every order of the filters, by windows over a long form."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters in the order of their bits, and the number of the last: copies, which only the whole table shows.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER = "[^A-Z]+"
SYMBOLS = r"[#$%&*|]"


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: few words (A), repeated words (B), capitals (C), symbols (D)."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    return (
        F.when(F.size(words) < 100, 1).otherwise(0)
        .bitwiseOR(F.when(100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"), 2).otherwise(0))
        .bitwiseOR(F.when(100 * F.length(F.regexp_replace(text, UPPER, "")).cast("long") > 10 * F.length(text).cast("long"), 4).otherwise(0))
        .bitwiseOR(F.when(text.rlike(SYMBOLS), 8).otherwise(0))
    )


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells (part, mask, n, good, toxic): how many documents of a part fail exactly the filters of ``mask``, and how many of those are labelled.

    A null text is an empty one, a null lang the part "". A row fails E where a smaller doc_id has the same text; a null doc_id is neither
    smaller nor larger, so such rows never fail E, and rows of one doc_id don't fail by each other. A document is good (toxic) where any row of
    ``labels`` with its doc_id has quality = 1 (toxic = 1). Only digests of texts are shuffled. Rows of one text are summed before they meet, so
    however many copies a text has, its group is one row for each part and label.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"), own_failures(text).alias("mask"),
    ).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    no = F.lit(False)
    marked = rows.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    #: A doc_id occurs once in such a group, so its first member's count is that of the smallest doc_id.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("loose") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    sums = texts.withColumn("least", least).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(passing).alias("passing"))
    cell = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    both = F.explode(F.array(cell(F.col("mask"), F.col("passing")), cell(F.col("mask").bitwiseOR(COPY), F.col("n") - F.col("passing"))))
    cells = sums.select("part", "good", "toxic", both.alias("cell"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("cell.n")).otherwise(0)).alias(c)
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum("cell.n").alias("n"), counted("good"), counted("toxic"))


def interaction_audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts of every step of every order of the filters, from cells (part, mask, n, good, toxic); bit k of a mask is filter ``letters[k]``.

    The cells are unpivoted: one row for each cell, order and step. A running bit-or over the steps before says which filters a cell has met, so
    whether it is still there; sums under conditions give the counts of a step, and a window over all orders of a filter its Shapley total. The long
    form has at most 2^k cells a part times k! orders of k steps: it doesn't grow with the documents. No cells give no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bit_of = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))])
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    long = steps.withColumns({"step": F.col("at") + 1, "bit": bit_of[F.col("letter")]})
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda condition, of, name: F.sum(F.when(condition, F.col(of)).otherwise(0)).alias(name)
    counts = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"), total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"), total(fails & ~gone, "toxic", "toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of op12 for ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic).

    Other columns are ignored, repeated rows count each, an empty table gives an empty result, and texts are read whole.
    """
    return interaction_audit(document_masks(docs, labels))
