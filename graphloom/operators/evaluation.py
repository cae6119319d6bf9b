"""Set metrics against golden answers (A-12-A-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(rows: DataFrame) -> DataFrame:
    """A-12: id, precision and recall of arrays expected and observed as sets; both empty give 1, one empty gives 0."""
    e, o = F.array_distinct("expected"), F.array_distinct("observed")
    hit = F.size(F.array_intersect(e, o))
    rate = lambda n: F.when((F.size(e) == 0) & (F.size(o) == 0), 1.0).when((F.size(e) == 0) | (F.size(o) == 0), 0.0).otherwise(hit / n)
    return rows.select("id", rate(F.size(o)).alias("precision"), rate(F.size(e)).alias("recall"))


def macro(scores: DataFrame) -> DataFrame:
    """A-12: means and the f1 of the means."""
    p, r = F.avg("precision"), F.avg("recall")
    return scores.agg(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def micro_macro(rows: DataFrame) -> DataFrame:
    """A-13: micro and macro rates; null where there is nothing to divide by, and the macro means leave those out."""
    e, o = F.array_distinct("expected"), F.array_distinct("observed")
    hit = F.size(F.array_intersect(e, o))
    div = lambda a, b: F.try_divide(a, b)
    return rows.agg(div(F.sum(hit), F.sum(F.size(o))).alias("micro_precision"), div(F.sum(hit), F.sum(F.size(e))).alias("micro_recall"), F.avg(div(hit, F.size(o))).alias("macro_precision"), F.avg(div(hit, F.size(e))).alias("macro_recall"))


def mention_validity(narratives: DataFrame, keys: DataFrame) -> DataFrame:
    """A-14: total, valid and the distinct unknown mentions, sorted."""
    told = narratives.select(F.explode("mentions").alias("m")).join(keys.select(F.col("symbol_key").alias("m"), F.lit(True).alias("_ok")).distinct(), "m", "left")
    return told.agg(F.count("*").alias("total"), F.count("_ok").alias("valid"), F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("m")))).alias("unknown"))


def task_summary(rows: DataFrame) -> DataFrame:
    """A-15: tasks, success rate, mean file reads and pass rate of judged rows."""
    return rows.agg(F.count("*").alias("tasks"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("file_reads").alias("mean_file_reads"), F.avg(F.col("judge_pass").cast("int")).alias("pass_rate"))
