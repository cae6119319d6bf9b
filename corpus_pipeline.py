"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing of sources, best-two-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import language_id, line_dedup, mixing, ngram_join, packing
from graphloom.session import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_row(spark: SparkSession, docs: DataFrame, job: str) -> DataFrame:
    """``docs`` (COLUMNS) with _row: a long of each row's own, in order of doc_id, nulls last.

    It is the doc_id itself where every row has one of its own. Otherwise the rows are numbered in the order of a range sort of their
    ids, written once so that the numbers hold, and joined to their rows.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    scratch = Scratch(spark, job)
    rows = scratch.write(docs.withColumn("_u", F.monotonically_increasing_id()), "rows")
    order = [F.col("doc_id").asc_nulls_last(), F.col("_u")]
    numbers = scratch.write(rows.select("doc_id", "_u").repartitionByRange(*order).sortWithinPartitions(*order).select("_u", F.monotonically_increasing_id().alias("_row")), "numbers")
    return rows.join(numbers, "_u").drop("_u")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the classifier rejects go.

    The classifier learns from the labelled documents that aren't held out. A text that is null, or has no letter, or is far
    from every language, goes. Rows are judged by their text alone, so a repeated row gets the same decision again and null ids
    are no matter; null languages are left out of the fit; other columns than COLUMNS go; an empty table gives an empty one, and one
    without labels too, as no language is known then.
    """
    model = language_id.fit(spark, docs.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    return language_id.identify(spark, docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; a document of which nothing is left goes.

    Every row is a document of its own: of rows that repeat an id or a text the first keeps its lines. Null ids are last in order. A null or
    empty text has no lines and stays as it is; n_chars is counted anew where lines went; other columns than COLUMNS go; an empty table
    gives an empty one.
    """
    rows = with_row(spark, docs, "fresh-lines").withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("_row", "doc_id")
    rows = line_dedup.without_repeated_lines(spark, rows).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.withColumn("doc_id", F.col("_doc_id")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Every row is a document of its own: of equal rows one stays, of rows with one id and different texts each that is no near copy of
    another. Null ids are last in order. Null and empty texts are near copies of nothing and stay; other columns than COLUMNS go; an empty table
    gives an empty one.
    """
    rows = with_row(spark, docs, "one-of-each")
    groups = ngram_join.near_copies(spark, rows.select(F.col("_row").alias("doc_id"), "text"))
    return rows.join(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Of a source's documents in shuffled order the mix takes whole ones but for the last, which counts as taken.
    Each row has a decision of its own: rows of one id, source and number of words, null ids too, take theirs in turn. A text without
    words, null or empty, is never taken; a null source is one of its own; other columns than COLUMNS go; an empty table gives an empty one.
    """
    own = ["doc_id", "source", "size"]
    rows = mixing.mix_sources(spark, docs.select(*COLUMNS)).withColumn("_nth", F.row_number().over(Window.partitionBy(*own).orderBy("taken"))).where("taken > 0")
    times = rows.select(*[F.col(c).alias(f"_{c}") for c in own], F.col("_nth").alias("_row"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    kept = docs.select(*COLUMNS, mixing.word_count().alias("size")).withColumn("_nth", F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64("text"))))
    same = F.col("_nth") == F.col("_row")
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return kept.join(times, same).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of the documents that are left: a row a piece.

    Every row is packed, repeated ones and null ids too; a null or empty text is the end token alone; an empty table gives an empty result.
    """
    return packing.pack_documents(spark, docs.select(*COLUMNS))


STAGES = [
    ("language_id", identified),
    ("line_dedup", fresh_lines),
    ("ngram_join", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]
#: SQL cannot express clustering, tokenizing and packing; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``; each is written as Parquet and read again by the next.

    The stages say what becomes of nulls, repeated rows and other columns; an empty table gives an empty result.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"{k}-{name}")
    return docs
