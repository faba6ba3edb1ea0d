"""Test grids derived from the driver's tables: (t, y, x, v) with v float32."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import lattice
from ..operators import bands

FRAMES, ROWS, COLUMNS = 83, 8, 10


def _dense(spark: SparkSession, nt: int, ny: int, nx: int) -> DataFrame:
    """Every (t, y, x) of a grid, made from one range."""
    i = F.col("id")
    return spark.range(nt * ny * nx).select((i / (ny * nx)).cast("int").alias("t"), F.pmod((i / nx).cast("long"), F.lit(ny)).cast("int").alias("y"), F.pmod("id", F.lit(nx)).cast("int").alias("x"))


def _month(ts: Column) -> Column:
    return ((F.year(ts) - 1995) * 12 + F.month(ts) - 1).cast("int")


def reference(t: Column) -> Column:
    """The per-frame reference in units of 2**-16, from 200 up to 201 K."""
    return (F.lit(200 * 65536).cast("long") + F.pmod(t.cast("long") * 7919, F.lit(65536))).cast("long")


def packed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-packed grid from lineitem: t, y, x, packed, r, Q, v."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = items.groupBy(_month(F.col("l_shipdate")).alias("t"), F.pmod("l_suppkey", F.lit(ROWS)).cast("int").alias("y"), F.pmod(F.col("l_quantity").cast("int"), F.lit(COLUMNS)).cast("int").alias("x"))
    sums = sums.agg(F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) div count(1) div 200").alias("packed"))
    return _lattice(_dense(spark, FRAMES, ROWS, COLUMNS).join(sums, ["t", "y", "x"], "left").withColumn("packed", F.coalesce("packed", F.lit(0).cast("long"))))


def smooth_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shape, smooth in space and time with small noise from the table; it
    crosses 256 K inside rows."""
    packed = packed_cells(spark, sf_dir).select("t", "y", "x", F.col("packed").alias("noise"))
    x = 15000 + 3000 * F.col("y") + 330 * F.col("x") + F.pmod(F.col("t") * 37, F.lit(211)) + F.pmod("noise", F.lit(5))
    return _lattice(packed.select("t", "y", "x", x.cast("long").alias("packed")))


def _lattice(cells: DataFrame) -> DataFrame:
    df = cells.withColumn("r", reference(F.col("t"))).withColumn("Q", lattice(F.col("r"), F.col("packed")))
    return df.withColumn("v", (F.col("Q").cast("double") / 65536.0).cast("float"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native float32 of both signs: 50 vectors to a frame, their elements along x."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = F.posexplode("embedding").alias("x", "v")
    return rows.select((F.col("vec_id") / 50).cast("int").alias("t"), F.pmod("vec_id", F.lit(50)).cast("int").alias("y"), at)


def field_bands(spark: SparkSession, nt: int, ny: int, nx: int) -> DataFrame:
    """Row bands of a generated temperature field of any size on a lattice of 1/512 K, one
    frame at a time in the tasks, to measure throughput."""
    lat, lon = np.linspace(np.pi / 2, -np.pi / 2, ny)[:, None], np.linspace(0, 2 * np.pi, nx, endpoint=False)[None, :]

    def run(batches):
        for batch in batches:
            for t in batch.column("id").to_pylist():
                noise = np.random.default_rng(t).integers(-3, 4, (ny, nx))
                field = 250 + 40 * np.cos(lat) + 8 * np.sin(3 * lon + t / 24) * np.cos(lat) ** 2
                yield bands.frame_bands(t, ((np.rint(field * 512) + noise) / 512).astype("<f4"))

    return spark.range(nt).mapInArrow(run, bands.BAND)


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of values by day, hour and event type; 0 where there is no event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin(*EVENT_TYPES))
    kind = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")) - 1
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    sums = events.groupBy(day.alias("t"), F.hour("ts").alias("y"), kind.cast("int").alias("x")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    dense = _dense(spark, 30, 24, len(EVENT_TYPES)).join(sums, ["t", "y", "x"], "left")
    return dense.withColumn("v", (F.coalesce("cents", F.lit(0).cast("long")).cast("double") / 100.0).cast("float")).drop("cents")
