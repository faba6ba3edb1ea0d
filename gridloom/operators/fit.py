"""How well discretised normal and log-normal laws fit an exact distribution.

The dense integer range between the extremes is never built: where the data have
no value the empirical distribution is flat and the fitted one monotone, so the
largest gap lies at the ends of such stretches, and the mass of a stretch is a
difference of the fitted distribution.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .dist import moments, ranked


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """The standard normal distribution function."""
    return pd.Series(np.fromiter((0.5 * (1.0 + math.erf(x / math.sqrt(2.0))) for x in z), float, len(z)))


def _distance(dist: DataFrame, lower: Column, upper: Column, before_gap: Column, first_lower: Column) -> DataFrame:
    """KS and total variation of ``dist`` (value, n, upto, total) against a fitted law.

    ``lower`` and ``upper`` are standardised bin edges; ``before_gap`` is the
    upper edge of the value before, where the stretch without data begins.
    """
    df = dist.withColumns({"p": F.col("n") / F.col("total"), "upto": F.col("upto") / F.col("total")})
    df = df.withColumns({"zl": lower, "zu": upper, "zg": before_gap})
    df = df.withColumns({"fl": normal_cdf("zl"), "fu": normal_cdf("zu"), "fg": normal_cdf("zg")})
    from_ = F.col("upto") - F.col("p")
    gap = F.col("fl") - F.col("fg")
    return df.agg(
        F.max(F.greatest(F.abs(F.col("upto") - F.col("fu")), F.abs(from_ - F.col("fl")), F.abs(from_ - F.col("fg")))).alias("ks"),
        (0.5 * (F.sum(F.abs(F.col("p") - (F.col("fu") - F.col("fl"))) + gap) + F.min(first_lower) + 1.0 - F.max("fu"))).alias("total_variation"),
    )


def normal_fit(dist: DataFrame) -> DataFrame:
    """(mean, sd, ks, total_variation) against a normal law on bins of +-0.5."""
    spread = moments(dist).select("mean", "sd")
    df = ranked(dist).crossJoin(F.broadcast(spread))
    z = lambda x: (x - F.col("mean")) / F.col("sd")
    value = F.col("value")
    before = F.coalesce(F.col("before") + 0.5, value - 0.5)
    out = _distance(df, z(value - 0.5), z(value + 0.5), z(before), F.col("fl"))
    return spread.crossJoin(F.broadcast(out))


def lognormal_fit(dist: DataFrame) -> DataFrame:
    """(log_mean, log_sd, ks, total_variation) of the magnitudes of non-zero values."""
    sizes = dist.where("value <> 0").groupBy(F.abs("value").alias("value")).agg(F.sum("n").alias("n"))
    n, log = F.col("n"), F.log(F.col("value").cast("double"))
    mean = sizes.agg((F.sum(n * log) / F.sum(n)).alias("log_mean"))
    both = sizes.crossJoin(F.broadcast(mean))
    spread = both.groupBy("log_mean").agg(F.sqrt(F.sum(n * F.pow(log - F.col("log_mean"), 2)) / F.sum(n)).alias("log_sd"))
    df = ranked(sizes).crossJoin(F.broadcast(spread))
    z = lambda x: (F.log(x) - F.col("log_mean")) / F.col("log_sd")
    value = F.col("value").cast("double")
    # the dense range starts at magnitude 1, whose lower edge is 0.5
    before = F.coalesce(F.col("before") + 0.5, F.lit(0.5))
    start = normal_cdf(z(F.lit(0.5)))
    out = _distance(df.withColumn("f0", start), z(value - 0.5), z(value + 0.5), z(before), F.col("f0"))
    return spread.crossJoin(F.broadcast(out))
