"""Durable tables: sealed datasets, read-through caches, releases, journals.

All are folders of Parquet beside small JSON files, written whole and then
named; a reader never sees half a table. Paths go through Hadoop's file systems,
so they may be in any store that Spark writes.
"""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.json_records import cache_key


class SealError(ValueError):
    pass


class Store:
    """A folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self._path(f"{self.root}/{a}"), self._path(f"{self.root}/{b}"))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))) if self.fs.exists(self._path(self.root)) else []

    def modified(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime()

    def put(self, name: str, value) -> None:
        """A small JSON file, replaced in one step."""
        out = self.fs.create(self._path(f"{self.root}/{name}.tmp"), True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        self.fs.delete(self._path(f"{self.root}/{name}"), False)
        self.rename(f"{name}.tmp", name)

    def claim(self, name: str) -> bool:
        """Make an empty file, if nobody else has: one of several callers gets True."""
        path = self._path(f"{self.root}/{name}")
        self.fs.mkdirs(path.getParent())
        if self.fs.getScheme() == "file":  # Hadoop looks before it creates there; the operating system does both at once
            return self.spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            self.fs.create(path, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def get(self, name: str):
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return json.loads(rows[0]["value"])


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: the count and the sums of two hashes of every row."""
    cols = [F.col(c) for c in sorted(df.columns)]
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)"))).first()
    return cache_key("table", {"rows": r[0], "a": str(r[1]), "b": str(r[2])})


def seal(store: Store, name: str, df: DataFrame) -> str:
    """Write a table and its digest; it appears under its name when both are whole. A name is sealed once."""
    if store.exists(name):
        raise SealError(f"{name} is sealed already")
    store.remove(name + ".part")
    df.write.parquet(f"{store.root}/{name}.part/rows")
    digest = content_digest(store.spark.read.parquet(f"{store.root}/{name}.part/rows"))
    store.put(f"{name}.part/seal.json", {"digest": digest, "schema": df.schema.simpleString()})
    if not store.rename(name + ".part", name):
        raise SealError(f"{name} could not be put in place")
    return digest


def unseal(store: Store, name: str) -> DataFrame:
    """A sealed table, its rows checked against its digest."""
    df = store.spark.read.parquet(f"{store.root}/{name}/rows")
    if content_digest(df) != store.get(f"{name}/seal.json")["digest"]:
        raise SealError(f"{name} was changed after it was sealed")
    return df


def cached(store: Store, request: dict, make, patience: float = 3600.0) -> DataFrame:
    """The table of a request: read where it was made before, made and sealed otherwise. Of several callers one makes it, under a
    lock; the others wait for it, `patience` seconds at most."""
    name = "key=" + cache_key("cache", request)
    until = time.monotonic() + patience
    while not store.exists(name):
        if store.claim(name + ".lock"):
            try:
                if not store.exists(name):
                    seal(store, name, make())
            finally:
                store.remove(name + ".lock")
        elif time.monotonic() > until:
            raise SealError(f"{name} is being made by somebody else")
        else:
            time.sleep(0.2)
    return unseal(store, name)


def newest(store: Store, prefix: str = "") -> str | None:
    """The sealed table that was put in place last; ties by name."""
    found = [n for n in store.names() if n.startswith(prefix) and not n.endswith(".part") and store.exists(f"{n}/seal.json")]
    return max(found, key=lambda n: (store.modified(n), n), default=None)


def release(store: Store, df: DataFrame, created: str) -> str:
    """A table under its own digest, and the pointer moved to it. Equal content is one release."""
    digest = content_digest(df)
    if not store.exists(f"release={digest}"):
        seal(store, f"release={digest}", df)
        store.put(f"release={digest}.json", {"digest": digest, "created": created})
    store.put("current.json", {"digest": digest})
    return digest


def releases(store: Store) -> DataFrame:
    """name, created, digest, error of every release; what can't be read is kept with its error."""
    rows = []
    for n in store.names():
        if n.startswith("release=") and not n.endswith((".json", ".part")):
            digest = n.removeprefix("release=")
            try:
                rows.append((n, store.get(n + ".json")["created"], digest, None))
            except Exception as e:  # noqa: BLE001  whatever is wrong with it is the finding
                rows.append((n, None, digest, type(e).__name__))
    return store.spark.createDataFrame(rows, "name string, created string, digest string, error string")


def rollback(store: Store) -> str:
    """Point at the valid release before the current one, by creation time then digest."""
    now = store.get("current.json")["digest"]
    valid = sorted(((r["created"], r["digest"]) for r in releases(store).where("error is null").collect()), reverse=True)
    order = [d for _, d in valid]
    after = order[order.index(now) + 1 :] if now in order else order
    if not after:
        raise SealError("there is no earlier release")
    store.put("current.json", {"digest": after[0]})
    return after[0]


def resolve(names: list[str], prefix: str) -> str:
    found = [n for n in names if n.startswith(prefix)]
    if len(found) != 1:
        raise SealError(f"{prefix!r} names {len(found)} releases")
    return found[0]


def unanswered(requests: DataFrame, journal: DataFrame) -> DataFrame:
    """Requests that no response was journalled for, by key and ordinal."""
    return requests.join(journal.select("request", "ordinal"), ["request", "ordinal"], "left_anti")


def collect_batch(requests: DataFrame, results: DataFrame) -> DataFrame:
    """All results of a batch, or an error naming how many are missing; each billed result is counted once."""
    missing = requests.join(results.select("request").distinct(), "request", "left_anti").count()
    if missing:
        raise SealError(f"{missing} requests have no result")
    return results.dropDuplicates(["request"])


def answered_by(df: DataFrame, key: list[str], answers: DataFrame, default: str | None = None) -> DataFrame:
    """Decisions from a table of fixed answers by input; a default where an input has none."""
    out = df.join(answers, key, "left")
    return out.withColumn("answer", F.coalesce("answer", F.lit(default))) if default is not None else out


def verify_manifest(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """path, fault of every file of a manifest (path, length, sha256) that is missing or differs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    got = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("l"), F.sha2("content", 256).alias("h"))
    fault = F.when(F.col("h").isNull(), "missing").when((F.col("l") != F.col("length")) | (F.col("h") != F.col("sha256")), "differs")
    return manifest.join(got, "path", "left").select("path", fault.alias("fault")).where("fault is not null")
