"""What the operators share: the work folder, stored tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

_stored: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a new
    one in local mode and an error on a cluster, whose machines share no temp folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the work folder and read back, and its path there."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/gridloom-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """An operator's intermediate table, written and read back: it cuts the lineage, and
    any executor can read it when another one is lost.  ``release`` deletes it, or
    ``temporary_tables``, or else the end of the application."""
    out, path = written(df, name)
    if not _stored:
        atexit.register(_release_rest, df.sparkSession)
    _stored.append(path)
    return out


def stored_paths() -> list[str]:
    """The intermediate tables that exist now, in the order in which they were made."""
    return list(_stored)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete intermediate tables, all by default; only when the results that read them
    are written, as DataFrames are lazy."""
    jvm = spark.sparkContext._jvm
    for name in stored_paths() if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _stored:
            _stored.remove(name)


def _release_rest(spark: SparkSession) -> None:
    """At the end of the application, while its context is still open."""
    atexit.unregister(_release_rest)
    if spark.sparkContext._jsc is not None and _stored:
        release(spark)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the intermediate tables that were made in it; write
    the results inside.

    >>> with temporary_tables(spark):
    ...     near_duplicates(docs).write.parquet(path)
    """
    before = set(_stored)
    try:
        yield
    finally:
        release(spark, [p for p in stored_paths() if p not in before])


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it has at most ``BROADCAST_ROWS`` rows, else leave the join to Spark."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Most bits that ``members`` may broadcast (16 MB).
FILTER_BITS = 1 << 27


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (one column, ``key``, distinct).

    A bitmap of the hashed keys, 64 bits for each and at most ``FILTER_BITS``, is broadcast
    to leave out most other rows before the exchange; the join decides.  Beyond that
    size the bitmap fills up and leaves out less."""
    n = ids.count()
    buckets = min(FILTER_BITS, 1 << max(15, (64 * n).bit_length())) >> 15  # of 32,768 bits each
    place = F.pmod(F.xxhash64(key), F.lit(buckets << 15))
    bucket, at = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    maps = ids.select(bucket.alias("__bucket"), at.alias("__at")).groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    near = df.withColumn("__bucket", bucket).join(F.broadcast(maps), "__bucket").where(seen).select(*df.columns)
    return near.join(ids, key).select(*df.columns)  # a semi-join would be moved before the bitmap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
