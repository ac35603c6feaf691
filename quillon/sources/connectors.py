"""Connectors: split scans, zipped workbooks, keyed tables, databases, price lists."""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.tables import SealError, Store


def split(spark: SparkSession, root: str, workflow: str, name: str) -> DataFrame:
    """One split of a workflow's labelled decisions, in id order."""
    return spark.read.parquet(f"{root}/{workflow}/{name}*.parquet").orderBy("id")


def zipped_sheets(spark: SparkSession, path: str, schema: str, required: list[str], read: Callable[[str, bytes], pd.DataFrame] | None = None) -> DataFrame:
    """The tables inside zip archives as one, rows without the required columns dropped. Archives are read
    where they are scheduled, one a row; read makes a frame of a member (by default CSV), or None to leave it out."""
    make = read or (lambda name, data: pd.read_csv(io.BytesIO(data)) if name.lower().endswith(".csv") else None)
    columns = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        frame = make(name, z.read(name))
                        if frame is not None:
                            yield frame[columns]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema).dropna(subset=required)


def put_keyed(store: Store, name: str, key: str, df: DataFrame) -> None:
    """Replace the partitions of a keyed table that df has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{store.root}/{name}")


def keyed(store: Store, name: str) -> DataFrame:
    return store.spark.read.parquet(f"{store.root}/{name}")


def seen_inputs(spark: SparkSession, root: str, function_id: str, inputs: str = "struct<text:string>") -> DataFrame:
    """Every input that cached JSON datasets under a folder hold for a function; unreadable files are skipped."""
    schema = f"function_id string, cases array<struct<inputs:{inputs}>>"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root, schema=schema, multiLine=True, mode="PERMISSIVE")
    return df.where(F.col("function_id") == function_id).select(F.explode("cases.inputs").alias("inputs")).distinct()


def from_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows by JDBC; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def transactional(connect: Callable[[], object], body: Callable[[object], object]):
    """Run body on a driver-side database connection: committed as a whole, rolled back on any error."""
    c = connect()
    try:
        out = body(c)
        c.commit()
        return out
    except BaseException:
        c.rollback()
        raise
    finally:
        c.close()


def into_database(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of a stream through write(batch, number); a batch may come again after a failure, so write by number or upsert."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prices(store: Store, name: str, fetch: Callable[[], list[dict]], most_age: float = 86_400, now: Callable[[], float] = time.time) -> DataFrame:
    """model, input, output: prices per million tokens from a list that is fetched once a day; rows without usable prices are skipped."""
    file = name + ".json"
    held = store.get(file) if store.exists(file) else None
    if held is None or now() - held["at"] > most_age:
        held = {"at": now(), "rows": fetch()}
        store.put(file, held)
    rows = []
    for r in held["rows"]:
        try:
            a, b = float(r["input"]), float(r["output"])
        except (KeyError, TypeError, ValueError):
            continue
        if a >= 0 and b >= 0 and isinstance(r.get("model"), str):
            rows.append((r["model"], a, b))
    return store.spark.createDataFrame(rows, "model string, input double, output double")


def bundle_text(functions: list[dict]) -> str:
    """A bundle of function records as JSON, in id order; an id twice is an error."""
    ids = [f["id"] for f in functions]
    if len(set(ids)) != len(ids):
        raise SealError("a function id is repeated")
    return json.dumps({"functions": sorted(functions, key=lambda f: f["id"])}, ensure_ascii=False, sort_keys=True, allow_nan=False)
