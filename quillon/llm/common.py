"""What the training-data operators share: table access and durable tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (tests
    on one machine) is a temporary folder made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete durable tables of which nothing that is still to run reads."""
    for t in tables:
        if path := getattr(t, "_durable_path", None):
            jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df has none of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := "_" + name).lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of ids, signatures and the like up to which a side is broadcast; beyond, the same join goes by key.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on between tasks, beside a JVM."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def drawn(salt: str, key: str, rows: int, of: int) -> Column:
    """Whether a key is in a sample of about `rows` of `of` keys, by its hash: a threshold of 63 bits, so that a small share of very many isn't rounded away."""
    share = min(1.0, rows / max(1, of))
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col(key)), 1) <= F.lit(min((1 << 63) - 1, int(share * (1 << 63))))


def crc32_mod(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; a null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
