"""Benchmark records: comparisons between variants, modes and formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gains(records: DataFrame, baseline: str, rate: str = "bits_per_value", by: Sequence[str] = ("variant",)) -> DataFrame:
    """Adds baseline and gain: how much less a mode needs than the baseline mode of its group."""
    base = records.where(F.col("mode") == baseline).groupBy(*by).agg(F.min(rate).alias("baseline"))
    return records.join(base, list(by), "left").withColumn("gain", F.col("baseline") - F.col(rate))


def best(records: DataFrame, rate: str = "bits_per_value", by: Sequence[str] = ("variant",)) -> DataFrame:
    """The record of each group with the least rate; the first mode by name among equals."""
    key = F.struct(F.col(rate), F.col("mode"))
    return records.groupBy(*by).agg(F.min_by(F.struct(*[c for c in records.columns if c not in by]), key).alias("r")).select(*by, "r.*")


def penalties(records: DataFrame, original: str = "original", rate: str = "bits_per_value") -> DataFrame:
    """Adds penalty: what a variant needs more than the original in the same mode."""
    base = records.where(F.col("variant") == original).select("mode", F.col(rate).alias("original_rate"))
    return records.join(base, "mode", "left").withColumn("penalty", F.col(rate) - F.col("original_rate"))


def by_size(records: DataFrame, size: str = "size") -> DataFrame:
    """Records ordered by size, those without one last."""
    return records.orderBy(F.asc_nulls_last(size), *[c for c in ("variant", "mode") if c in records.columns])


def agreeing_counts(frames: DataFrame) -> DataFrame:
    """(variant, frames, agrees): every variant must have as many frames as the others."""
    counts = frames.groupBy("variant").agg(F.countDistinct("t").alias("frames"))
    every = Window.partitionBy()
    return counts.withColumn("agrees", F.min("frames").over(every) == F.max("frames").over(every))
