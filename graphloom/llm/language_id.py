"""Operator 3: language identification by nearest clustered centroids."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrow import slices, texts, tuned
from graphloom.llm.hashing import mix

#: Slots that n-grams are hashed to; a vector is never larger.
SLOTS = 4096
#: Labelled documents a language that the centroids are fitted on, at most, and centroids a language.
SAMPLE, CLUSTERS = 400, 4
#: Languages that a model may have: it is held by the driver and broadcast, 64 kB a language. More are an error.
LANGUAGES = 2048
#: A text is rejected when its cosine to the nearest centroid is below this share of what all but the LEAST share of the centroid's
#: fitted documents have; one odd document doesn't set the limit.
REACH, LEAST = 0.8, 0.01
#: A text with fewer distinct grams than FULL_GRAMS can't come as near; the limit falls with the root of their number, and by TINY_SHARE for very few.
FULL_GRAMS, TINY_GRAMS, TINY_SHARE = 256, 64, 0.6
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of letters, one space around each."""
    return f" {NOT_LETTERS.sub(' ', text).strip().lower()} "


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed grams of 1, 2 and 3 characters; None if the text has no letter."""
    clean = letters(text)
    if not any(map(str.isalpha, clean)):  # \w has numbers such as "½" and "Ⅷ" too
        return None
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pairs = codes[:-1] << np.uint64(21) | codes[1:]
    triples = pairs[:-1] << np.uint64(21) | codes[2:]
    slots = np.concatenate([mix(codes[1:-1]), mix(pairs + np.uint64(1 << 50)), mix(triples)]) >> np.uint64(64 - 12)
    return np.bincount(slots.astype(np.int64), minlength=SLOTS)


def vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: damped counts times inverse document frequency."""
    if not counts:
        return np.zeros((0, SLOTS), np.float32)
    x = np.log1p(np.array(counts, np.float32)) * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that each slot occurs in, documents with letters) over all rows of ``docs``: a row of fixed size from each task."""

    def run(batches):
        seen, n = np.zeros(SLOTS, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                for text in texts(batch):
                    counts = gram_counts(text)
                    if counts is not None:
                        seen += counts > 0
                        n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([-1, *at], pa.int32()), "n": pa.array([n, *seen[at]], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(SLOTS, np.int64), 0
    for r in rows:
        if r.slot < 0:
            total = int(r.n)
        else:
            out[r.slot] = r.n
    return out, total


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of at most k clusters by cosine, each started at the row farthest from those before it."""
    centres = [x.mean(axis=0)]
    centres[0] = centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres, np.float32)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))], np.float32)
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def nearness(counts: np.ndarray) -> float:
    """How near a text with such gram counts comes to a centroid of its language, compared with a long one."""
    n = int((counts > 0).sum())
    return min(1.0, n / FULL_GRAMS) ** 0.5 * (TINY_SHARE if n < TINY_GRAMS else 1.0)


class LanguageModel:
    """Centroids of each language, with the cosine, made comparable by ``nearness``, that nearly all fitted documents of each centroid have to it."""

    def __init__(self, langs: list[str], centroids: np.ndarray, reach: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.reach, self.idf = langs, centroids, reach, idf

    def predict(self, batch_texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """(language, cosine, rejected) of each text; a text without letters is ``und``, 0.0 and rejected."""
        langs, scores, rejected = [], [], []
        counted = [gram_counts(x) for x in batch_texts]
        there = [c for c in counted if c is not None]
        cosines = vectors(there, self.idf) @ self.centroids.T if len(self.langs) else np.zeros((len(there), 0))
        k = 0
        for c in counted:
            if c is None or not self.langs:
                langs.append("und")
                scores.append(0.0)
                rejected.append(True)
                k += c is not None
                continue
            at = int(cosines[k].argmax())
            cosine = min(1.0, max(0.0, float(cosines[k, at])))
            langs.append(self.langs[at])
            scores.append(cosine)
            rejected.append(bool(cosine < self.reach[at] * REACH * nearness(c)))
            k += 1
        return langs, scores, rejected


def fit(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> LanguageModel:
    """Fit on ``labelled`` (doc_id, text, lang; null languages are left out).

    Document frequencies count all of its rows. The centroids are fitted on at most ``sample`` documents a language, those with the
    smallest hashes of doc_id and text; each language is clustered by its own task, and ``clusters`` vectors of it
    come back. Ties between languages go to the first by name. More than LANGUAGES languages are an error. Repeated rows count as
    often as they occur; other columns are ignored; without labelled rows the model is empty and every text ``und``.
    """
    tuned(spark)
    labelled = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen, total = document_frequencies(labelled)
    idf = np.log((1 + total) / (1 + seen)) + 1
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # A hash threshold leaves about 1.5 * sample rows of each language, before any text is moved.
    shares = spark.createDataFrame([(r.lang, min(1.0, (1.5 * sample + 50) / r.n)) for r in counts], "lang string, _share double")
    picked = labelled.join(F.broadcast(shares), "lang").withColumn("_at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    picked = picked.where(F.col("_at") < F.col("_share") * float(1 << 40))

    def cluster(key, frame):
        frame = frame.sort_values(["_at", "doc_id"])
        counted = [c for c in map(gram_counts, frame["text"].fillna("").head(sample)) if c is not None]
        if not counted:
            return pd.DataFrame({"lang": [], "centroid": [], "reach": []})
        x = vectors(counted, idf)
        c = clustered(x, clusters)
        cosines = x @ c.T
        own = cosines.argmax(axis=1)
        near = np.array([nearness(x) for x in counted])
        reach = [float(np.quantile(cosines[own == j, j] / near[own == j], LEAST)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [key[0]] * len(c), "centroid": [v.astype(float).tolist() for v in c], "reach": reach})

    rows = picked.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<double>, reach double").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.centroid))
    return LanguageModel([r.lang for r in rows], np.array([r.centroid for r in rows], np.float32).reshape(-1, SLOTS), np.array([r.reach for r in rows]), idf)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected; columns of these names are replaced.

    A null or empty text and one without a letter are ``und`` with score 0.0, and rejected. Other texts get the
    language of the nearest centroid and its cosine; they are rejected if that is far below what the centroid's own
    documents have. Every row is kept, repeated rows too; whole texts are read; an empty table gives an empty result.
    """
    tuned(spark)
    held = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                langs, scores, rejected = held.value.predict(texts(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, fields + ", lang_pred string, score double, rejected boolean")


def held_out(doc_id="doc_id"):
    """Whether a document is kept from the fit: crc32 of its id as text, mod 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def language_ids(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row, learnt from the rows that are not held out.

    A null doc_id counts as not held out. Ids, sources and labels are no inputs of a prediction. A text that is null or has no letter
    (Unicode category L) is ``und``; repeated rows each give a row with equal values; other columns are ignored; an
    empty table gives an empty result, and one without labels ``und`` for all.
    """
    out = F.coalesce(held_out(), F.lit(False))
    model = fit(spark, docs.where(~out))
    rows = identify(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out")), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "rejected")

