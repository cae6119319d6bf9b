"""Session helpers shared by every part of the library."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver found it.

    On a cluster the package is normally installed or sent with ``--py-files``; this covers drivers that
    were started from another folder.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where that setting is unset and all is one machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        own = spark.sparkContext.getCheckpointDir()
        if not own:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-"))
            own = spark.sparkContext.getCheckpointDir()
        shared = own
    return shared.rstrip("/")


class Scratch:
    """Intermediate tables of one job, written to the shared folder so that a lost executor costs no recomputation.

    What a job has not dropped itself goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.marked, self.base = spark, False, f"{scratch_dir(spark)}/graphloom-{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back: cuts the lineage and gives the planner true sizes."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.mark()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
        """Like ``write``, in buckets sorted by a key: joins on the key that need a shuffle move the other side only."""
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        known = "graphloom_" + hashlib.sha256(self.path(name).encode()).hexdigest()[:24]
        df.repartition(buckets, key).write.format("parquet").option("path", self.path(name)).bucketBy(buckets, key).sortBy(key).saveAsTable(known)
        self.mark()
        return self.spark.table(known)

    def kept(self, name: str) -> str:
        """The path of a table that others write; it goes with this job's."""
        self.mark()
        return self.path(name)

    def mark(self) -> None:
        if not self.marked:
            base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            base.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(base)
            self.marked = True

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files below some paths: it changes when a table is written anew. No data is read."""
    seen = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def kept_until_end(spark: SparkSession, name: str) -> str:
    """A folder of this application in the shared folder, the same at each call; it goes when the driver's JVM ends."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/graphloom-{spark.sparkContext.applicationId}-{name}")
    base.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(base)
    return base.toString()
