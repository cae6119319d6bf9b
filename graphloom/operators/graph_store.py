"""A versioned store of keyed tables in buckets, and the graph in it.

Rows lie in a fixed number of buckets by the hash of a key, each bucket sorted in a Parquet file of its own, so that a join on the key moves
only the other side. A version is a manifest that names each bucket's generation, file and digest; it is written last, and by one writer
only. A change rewrites the buckets that it alters; readers see the last whole version.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from graphloom.operators.graph import directed
from graphloom.session import Scratch

GEN = "_gen"


class Conflict(RuntimeError):
    """Another writer has made the version that a change was to become."""


class Manifests:
    """Numbered versions in a folder, each a small JSON file that can be created once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        fs, p = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))

    def get(self, number: int) -> dict | None:
        """A version, or None where its writer ended before it was whole."""
        fs, p = self._fs(f"{number:08d}.json")
        stream = fs.open(p)
        raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def last(self) -> dict | None:
        return next((x for n in reversed(self.numbers()) if (x := self.get(n))), None)

    def add(self, base: dict | None, value: dict) -> dict:
        """The version after ``base``; a Conflict where there is one already."""
        after = [n for n in self.numbers() if n > (base["version"] if base else 0)]
        number = (after[-1] if after else base["version"] if base else 0) + 1
        fs, p = self._fs(f"{number:08d}.json")
        if any(self.get(n) for n in after):
            raise Conflict(f"{p}: made from an older version than the last")
        try:
            stream = fs.create(p, False)
        except Exception as e:  # py4j passes the file system's error on
            raise Conflict(f"{p}: is there already") from e
        value = value | {"version": number}
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        return value


class BucketTable:
    """A table below ``path``, its rows by ``key`` in ``buckets`` files. With another schema version or number of buckets all is built anew."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, schema_version: int = 1):
        self.spark, self.path, self.key, self.buckets, self.schema_version = spark, path.rstrip("/"), key, buckets, schema_version
        self.versions = Manifests(spark, f"{self.path}/manifest")
        self.data = f"{self.path}/data-{schema_version}-{buckets}"
        self.name = "graphloom_" + hashlib.sha256(f"{self.data} {key}".encode()).hexdigest()[:24]

    def bucket(self) -> Column:
        """The bucket of a row, as Spark's bucketed writer has it."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def digests(self, df: DataFrame) -> dict[str, str]:
        """A digest of the rows of each bucket, whatever their order; at most ``buckets`` rows come to the driver."""
        columns = sorted(c for c in df.columns if c != GEN)
        one, two = F.xxhash64(*columns), F.shiftrightunsigned(F.xxhash64(F.lit(7), *columns), 20)
        rows = df.groupBy(self.bucket().alias("b")).agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(two.cast("decimal(38,0)")).alias("s")).collect()
        return {str(r.b): f"{r.n}:{r.x}:{r.s}" for r in rows}

    def whole(self) -> dict | None:
        """The last version that this table can go on from."""
        found = self.versions.last()
        return found if found and found["schema_version"] == self.schema_version and found["buckets"] == self.buckets else None

    def open(self, schema: StructType) -> None:
        """Let the session know the bucketed files that another one may have written."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.add(GEN, LongType()).fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.data}'")
        self.spark.catalog.refreshTable(self.name)

    def read(self, version: dict | None = None) -> DataFrame:
        """The rows of a version, the last if none is given. Rows of generations that a bucket has left behind are passed over."""
        version = version or self.whole()
        if version is None:
            raise ValueError(f"{self.path}: no version that fits")
        schema = StructType.fromJson(version["schema"])
        self.open(schema)
        rows, gens = self.spark.table(self.name), {int(b): x["gen"] for b, x in version["entries"].items()}
        if len(set(gens.values())) <= 1:
            live = F.col(GEN) == F.lit(next(iter(gens.values()), -1))
        else:
            live = F.col(GEN).isin(*set(gens.values())) & (F.col(GEN) == F.element_at(F.array(*[F.lit(gens.get(b, -1)).cast("long") for b in range(self.buckets)]), self.bucket() + 1))
        return rows.where(live).drop(GEN)

    def read_keys(self, keys: DataFrame, version: dict | None = None) -> DataFrame:
        """The rows of the buckets that ``keys`` (the key column) fall into: no other file is opened. At most one number a bucket comes to the driver."""
        version = version or self.whole()
        schema = StructType.fromJson(version["schema"])
        hit = {str(r.b) for r in keys.select(self.bucket().alias("b")).distinct().collect()}
        paths = [f"{self.data}/{version['entries'][b]['file']}" for b in sorted(hit) if b in version["entries"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, changed: set[str], digests: dict[str, str], found: dict | None, base: dict | None, source: str | None) -> list[int]:
        """Write the whole new rows of the changed buckets as one generation and commit; the buckets' numbers."""
        schema, entries = rows.schema, dict(base["entries"]) if base else {}
        self.open(StructType(schema.fields.copy()))
        gen = uuid.uuid4().int >> 65
        if changed & digests.keys():
            new = rows.withColumn(GEN, F.lit(gen).cast("long")).repartition(self.buckets, self.key)
            new.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)
            self.spark.catalog.refreshTable(self.name)
        files = self.spark.table(self.name).where(F.col(GEN) == gen).select(self.bucket().alias("b"), F.col("_metadata.file_name").alias("f")).distinct().collect()
        files = {str(r.b): r.f for r in files}
        for b in changed:
            entries.pop(b, None)
            if b in digests:
                entries[b] = {"gen": gen, "file": files[b], "digest": digests[b]}
        self.versions.add(found, {"schema_version": self.schema_version, "buckets": self.buckets, "source": source, "schema": schema.jsonValue(), "entries": entries})
        return sorted(map(int, changed))

    def open_or_rebuild(self, df: DataFrame, source: str | None = None) -> list[int]:
        """Make the store hold ``df``; the numbers of the buckets that were rewritten.

        None are where ``source`` (what tells one state of the origin from another) is the last version's. Else the digests of the buckets are
        compared, and those that differ are written.
        """
        found, base = self.versions.last(), self.whole()
        if base and source is not None and base["source"] == source:
            return []
        now, then = self.digests(df), {b: x["digest"] for b, x in base["entries"].items()} if base else {}
        changed = {b for b in now.keys() | then.keys() if now.get(b) != then.get(b)}
        some = df.where(self.bucket().isin(*map(int, changed))) if base and changed else df
        return self.put(some, changed, now, found, base, source)

    def upsert(self, changes: DataFrame, on: list[str] | None = None, removed: DataFrame | None = None, source: str | None = None) -> list[int]:
        """Put ``changes`` (one row for each ``on``, the key by default) in the place of the rows they match and take ``removed`` (their ``on``)
        away; the numbers of the buckets that were rewritten. Only files of buckets that a change may touch are read."""
        on, base = on or [self.key], self.whole()
        if base is None:
            raise ValueError(f"{self.path}: no version that fits")
        gone = changes.select(*on) if removed is None else changes.select(*on).unionByName(removed.select(*on))
        touched = {str(r.b) for r in gone.select(self.bucket().alias("b")).distinct().collect()}
        schema = StructType.fromJson(base["schema"])
        old = self.read_keys(gone, base)
        marks = gone.distinct()
        same = [old[c].eqNullSafe(marks[c]) for c in on]
        new = old.join(marks, same, "left_anti").unionByName(changes.select(*schema.names))
        now = self.digests(new)
        changed = {b for b in touched if now.get(b) != base["entries"].get(b, {}).get("digest")}
        return self.put(new.where(self.bucket().isin(*map(int, changed))), changed, now, base, base, source) if changed else []

    def vacuum(self) -> int:
        """Delete the files that the last version doesn't name; how many. Readers of older versions must be done."""
        live = {x["file"] for x in (self.whole() or {"entries": {}})["entries"].values()}
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.data)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        dead = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet") and x.getPath().getName() not in live] if fs.exists(p) else []
        for x in dead:
            fs.delete(x, False)
        self.spark.catalog.refreshTable(self.name) if self.spark.catalog.tableExists(self.name) else None
        return len(dead)


class StoredGraph:
    """Nodes by id, and edges by the end that a walk leaves, once for each direction; a version of the graph names one of each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, schema_version: int = 1):
        self.spark = spark
        part = lambda name, key: BucketTable(spark, f"{path.rstrip('/')}/{name}", key, buckets, schema_version)
        self.parts = {"nodes": part("nodes", "id"), "out": part("out", "src"), "in": part("in", "src")}
        self.versions = Manifests(spark, f"{path.rstrip('/')}/manifest")

    def _commit(self) -> None:
        now = {k: t.whole()["version"] for k, t in self.parts.items()}
        last = self.versions.last()
        if last is None or {k: last[k] for k in now} != now:
            self.versions.add(last, now)

    def open_or_rebuild(self, nodes: DataFrame, edges: DataFrame, source: str | None = None) -> dict[str, list[int]]:
        """Make the store hold a graph; the buckets of each table that were rewritten. Of nodes with one id the last by ``seq``, where there is one, stays."""
        if "seq" in nodes.columns:
            nodes = nodes.groupBy("id").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").drop("seq")
        if source is not None and self.versions.last() and all((t.whole() or {}).get("source") == source for t in self.parts.values()):
            return {name: [] for name in self.parts}
        scratch = Scratch(self.spark, "store")  # each is read several times
        nodes, edges = scratch.write(nodes, "nodes"), scratch.write(edges.select("source", "target", "relation").distinct(), "edges")
        done = {"nodes": self.parts["nodes"].open_or_rebuild(nodes, source)}
        done |= {way: self.parts[way].open_or_rebuild(directed(edges, way), source) for way in ("out", "in")}
        self._commit()
        scratch.drop("nodes", "edges")
        return done

    def merge(self, nodes: DataFrame, edges: DataFrame, removed: DataFrame | None = None) -> dict[str, list[int]]:
        """Nodes take the place of those with their id, edges are a union of (source, target, relation), ``removed`` edges go."""
        done = {"nodes": self.parts["nodes"].upsert(nodes)}
        for way in ("out", "in"):
            gone = None if removed is None else directed(removed, way)
            done[way] = self.parts[way].upsert(directed(edges, way).distinct(), ["src", "dst", "relation"], gone)
        self._commit()
        return done

    def read(self, part: str) -> DataFrame:
        """``nodes``, or the edges of a walk ``out`` or ``in`` with src, dst, source, target and relation, of the last whole version of the graph."""
        last, t = self.versions.last(), self.parts[part]
        return t.read(t.versions.get(last[part]))
