"""An inverted index in buckets of tokens: searches read the postings of their words, changes rewrite the postings of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import tokens
from graphloom.operators.graph_store import BucketTable, Manifests
from graphloom.operators.search import K1, B, query_tokens


class InvertedIndex:
    """Postings (token, doc, tf, len) by token and documents (doc, len, words) by doc; a version names one of each, and the numbers that scores need."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, path = spark, path.rstrip("/")
        self.postings, self.docs = BucketTable(spark, f"{path}/postings", "token", buckets), BucketTable(spark, f"{path}/docs", "doc", buckets)
        self.versions = Manifests(spark, f"{path}/manifest")

    @staticmethod
    def cut(rows: DataFrame) -> DataFrame:
        """doc and its tokens in order, of rows (doc, text); a null text is an empty one, of several rows of a doc the first by text stays."""
        return rows.groupBy("doc").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc", tokens("text").alias("all"))

    @staticmethod
    def posted(cut: DataFrame) -> DataFrame:
        each = cut.select("doc", F.size("all").alias("len"), F.explode("all").alias("token"))
        return each.groupBy("token", "doc", "len").agg(F.count("*").cast("int").alias("tf")).select("token", "doc", "tf", "len")

    @staticmethod
    def listed(cut: DataFrame) -> DataFrame:
        return cut.select("doc", F.size("all").alias("len"), F.array_sort(F.array_distinct("all")).alias("words"))

    def _commit(self, source: str | None) -> None:
        last, now = self.versions.last(), {"postings": self.postings.whole()["version"], "docs": self.docs.whole()["version"], "source": source}
        if last is None or any(last[k] != now[k] for k in now):
            n, total = self.docs.read().agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            self.versions.add(last, now | {"n": n, "total": total})

    def open_or_build(self, rows: DataFrame, source: str | None = None) -> None:
        """Make the index hold ``rows`` (doc, text); nothing is read where ``source`` is that of the last version."""
        last = self.versions.last()
        if last and source is not None and last["source"] == source:
            return
        cut = self.cut(rows)
        self.postings.open_or_rebuild(self.posted(cut), source)
        self.docs.open_or_rebuild(self.listed(cut), source)
        self._commit(source)

    def upsert(self, rows: DataFrame, removed: DataFrame | None = None) -> dict[str, list[int]]:
        """Put documents (doc, text) in or in the place of those there, take ``removed`` (doc) out; the buckets that were rewritten.

        The words that the documents had come from their rows of the index: postings of other words and other documents' buckets are not read.
        """
        cut = self.cut(rows)
        gone = cut.select("doc") if removed is None else cut.select("doc").unionByName(removed.select("doc"))
        gone = gone.distinct()
        old = self.docs.read_keys(gone).join(gone, "doc", "left_semi").select(F.explode("words").alias("token"), "doc")
        done = {"postings": self.postings.upsert(self.posted(cut), ["token", "doc"], old)}
        done["docs"] = self.docs.upsert(self.listed(cut), ["doc"], gone)
        self._commit(None)
        return done

    def search(self, question: str, every: bool = True, top: int | None = None, floor: float = 1e-6) -> DataFrame:
        """Doc and score of the documents that hold every word of a question, or any; the ``top`` best ones by score, ties by doc.

        Only files of the words' buckets are read, and in them only the words' rows, which lie together.
        """
        words, last = sorted(set(query_tokens(question))), self.versions.last()
        asked = self.spark.createDataFrame([(w,) for w in words], "token string")
        version = self.postings.versions.get(last["postings"])
        rows = self.postings.read_keys(asked, version).where(F.col("token").isin(words)) if words else self.postings.read(version).limit(0)
        df = rows.groupBy("token").agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((F.lit(float(last["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(floor))
        mean = max(last["total"], 1) / max(last["n"], 1)
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
        scored = rows.join(df.select("token", idf.alias("idf")), "token").groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("hits"))
        scored = (scored.where(F.col("hits") == len(words)) if every else scored).select("doc", "score")
        return scored if top is None else scored.orderBy(F.desc("score"), "doc").limit(top)
