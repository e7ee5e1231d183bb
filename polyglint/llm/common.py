"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: What the operators call white space, as the characters of a regular-expression class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; one of our own only where none is set."""
    base = checkpoint_root(spark)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "/tmp/checkpoints"  # one machine: it is shared
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def saved(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame, shuffles: bool = True) -> None:
    """Deletes tables that saved() wrote and nothing reads any more, and lets Spark drop shuffle files of finished jobs,
    which it does after its driver has collected garbage."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2 if shuffles else 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 32) -> None:
    """Before Python runs on the executors: sends them the package, and bounds what one Arrow batch holds, so that very
    long texts don't add up in a worker."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """In a Python worker: returns to the system what this process holds free. Workers live on from task to task and from
    stage to stage, and would keep it beside what their next task takes."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def lookup(rows: DataFrame, found: DataFrame, key: str, weight: str, most: int = 200_000) -> DataFrame:
    """rows joined with found, a saved table of unique keys, without its weight: how many rows a key has. The keys of most
    rows are broadcast, `most` at most; only rows of rarer keys, if there are any, are shuffled, so no hot key meets in one
    task."""
    if found.count() <= most:
        return rows.join(F.broadcast(found.drop(weight)), key)
    hot = saved(rows.sparkSession, found.orderBy(F.desc(weight), key).limit(most).drop(weight), "hot-keys")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.drop(weight), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same, and faster, where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def inputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash with an operator's own."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
