"""Exact distributions: frequencies and all statistics that follow from them.

A distribution is a DataFrame (keys..., value, n).  It is one partial and one
final aggregation away from the cells, and everything else works on its
distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits

PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def frequencies(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged(dist: DataFrame, *keys: str) -> DataFrame:
    """Distributions added up: one row for each of ``keys`` and value."""
    return dist.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def summary(dist: DataFrame, *keys: str) -> DataFrame:
    """count, unique_count, min, max, mean, population sd, entropy, zeros and multiples.

    Two passes over the distinct values: the means, then the squared deviations.
    """
    value, n = F.col("value").cast("double"), F.col("n")
    mean = dist.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(value * n) / F.sum("n")).alias("mean"))
    both = dist.join(mean, list(keys)) if keys else dist.crossJoin(F.broadcast(mean))
    p = n / F.col("count")
    share = lambda k: F.sum(F.when(F.pmod("value", F.lit(k)) == 0, n).otherwise(0))
    return both.groupBy(*keys, "count", "mean").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sqrt(F.sum(n * F.pow(value - F.col("mean"), 2)) / F.first("count")).alias("sd"),
        F.sum(-p * F.log2(p)).alias("entropy"),
        F.sum(F.when(F.col("value") == 0, n).otherwise(0)).alias("zero_count"),
        (share(64) / F.first("count")).alias("multiple_64"),
        (share(128) / F.first("count")).alias("multiple_128"),
    ).withColumn("zero_fraction", F.col("zero_count") / F.col("count"))


def entropy(dist: DataFrame, *keys: str) -> DataFrame:
    """Bits per value, in one pass: log2 N - sum(n log2 n) / N."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    return dist.groupBy(*keys).agg(F.sum("n").alias("count"), (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy"))


def weighted_entropy(entropies: DataFrame) -> DataFrame:
    """The mean of entropies weighted by their counts."""
    return entropies.agg((F.sum(F.col("count") * F.col("entropy")) / F.sum("count")).alias("entropy"))


def bucket(value: Column) -> Column:
    """A monotone bucket of a whole number: its sign, bit length and top seven bits."""
    size = F.abs(value)
    length = F.length(F.bin(size))
    top = F.call_function("shiftright", size, F.greatest(length - 7, F.lit(0)))
    return F.signum(value.cast("double")).cast("long") * (length * 128 + top)


def ranked(dist: DataFrame, *keys: str) -> DataFrame:
    """Adds upto, the counts up to each value in order, total, and before, the value before.

    Values are ordered inside ``bucket``s; only the buckets' sums, some thousand rows for
    each of ``keys``, are added up in one task."""
    placed = dist.withColumn("__bucket", bucket(F.col("value")))
    sums = placed.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__sum"), F.max("value").alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__bucket")
    sums = sums.withColumns(
        {
            "__below": F.coalesce(F.sum("__sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("__sum").over(Window.partitionBy(*keys)),
            "__before": F.lag("__last").over(along),
        }
    ).drop("__sum", "__last")
    inside = Window.partitionBy(*keys, "__bucket").orderBy("value")
    upto = F.col("__below") + F.sum("n").over(inside)
    before = F.coalesce(F.lag("value").over(inside), F.col("__before"))
    return placed.join(sums, [*keys, "__bucket"]).withColumns({"upto": upto, "before": before}).drop("__bucket", "__below", "__before")


def quantiles(dist: DataFrame, *keys: str, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """Order statistics at the 0-based index p * (n - 1), rounded half to even."""
    rows = ranked(dist, *keys)
    wanted = rows.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    index = F.rint(F.col("p") * (F.col("total") - 1))
    return wanted.where((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)).select(*keys, "p", "value")


#: Buckets of equal width in which real values are ordered.
REAL_BUCKETS = 4_096


def percentiles(df: DataFrame, value: str | Column, probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """(p, value): percentiles with linear interpolation between order statistics.

    Rows are counted by value and by buckets of equal width; only those buckets that
    hold a wanted rank are ordered."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value IS NOT NULL")
    span = counts.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # rounded subtraction and multiplication keep the order
    share = F.coalesce(F.try_divide(F.lit(float(REAL_BUCKETS)), F.col("high") - F.col("low")), F.lit(0.0))
    placed = counts.crossJoin(F.broadcast(span)).withColumn("bucket", F.floor((F.col("value") - F.col("low")) * share))
    sums = placed.groupBy("bucket").agg(F.sum("n").alias("sum"))
    sums = sums.withColumns({"below": F.sum("sum").over(Window.orderBy("bucket")) - F.col("sum"), "total": F.sum("sum").over(Window.partitionBy())})
    ranks = sums.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    ranks = ranks.withColumn("at", F.col("p") * (F.col("total") - 1)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    ranks = ranks.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("sum"))).select("bucket", "below", "p", "at", "rank")
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("bucket", "p", "rank").orderBy("value"))
    found = placed.select("value", "n", "bucket").join(ranks, "bucket").withColumn("upto", upto)
    found = found.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    low, high, part = F.min("value"), F.max("value"), F.first("at") - F.floor(F.first("at"))
    return found.groupBy("p").agg((low + (high - low) * part).alias("value"))


def width_histogram(dist: DataFrame, *keys: str) -> DataFrame:
    """How many values need how many bits after zigzag."""
    return dist.groupBy(*keys, bits.bit_width(bits.zigzag(F.col("value"))).alias("width")).agg(F.sum("n").alias("n"))


def width_cdf(dist: DataFrame, *keys: str) -> DataFrame:
    """The share of values that fit in each width."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("width"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return width_histogram(dist, *keys).withColumn("share", upto / total)


def top_values(dist: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent values; the smaller value first among equals."""
    return dist.orderBy(F.desc("n"), F.asc("value")).limit(k)


def moments(dist: DataFrame, *keys: str) -> DataFrame:
    """count, mean, sd, skewness and excess kurtosis, all of the population."""
    value, n = F.col("value").cast("double"), F.col("n")
    mean = dist.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(value * n) / F.sum("n")).alias("mean"))
    both = dist.join(mean, list(keys)) if keys else dist.crossJoin(F.broadcast(mean))
    central = lambda k: F.sum(n * F.pow(value - F.col("mean"), k)) / F.first("count")
    powers = both.groupBy(*keys, "count", "mean").agg(*[central(k).alias(f"m{k}") for k in (2, 3, 4)])
    return powers.select(
        *keys, "count", "mean", F.sqrt("m2").alias("sd"), F.try_divide(F.col("m3"), F.pow("m2", 1.5)).alias("skewness"), (F.try_divide(F.col("m4"), F.pow("m2", 2)) - 3).alias("kurtosis")
    )


def sigma_coverage(dist: DataFrame, sigmas: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The share of values within k sd of the mean, with zeros and without them."""
    spread = moments(dist).select("mean", "sd")
    k = F.explode(F.array(*[F.lit(s) for s in sigmas])).alias("k")
    near = F.abs(F.col("value") - F.col("mean")) <= F.col("k") * F.col("sd")
    rows = dist.crossJoin(F.broadcast(spread)).select("value", "n", "mean", "sd", k)
    share = lambda cond: F.try_divide(F.sum(F.when(near & cond, F.col("n")).otherwise(0)), F.sum(F.when(cond, F.col("n")).otherwise(0)))
    return rows.groupBy("k").agg(share(F.lit(True)).alias("share"), share(F.col("value") != 0).alias("share_nonzero"))


def sign_parity(dist: DataFrame) -> DataFrame:
    """Shares of even, positive and negative values; even also without zeros."""
    n, value = F.col("n"), F.col("value")
    of = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    even = F.pmod("value", F.lit(2)) == 0
    return dist.agg(
        (of(even) / F.sum("n")).alias("even"),
        F.try_divide(of(even & (value != 0)), of(value != 0)).alias("even_nonzero"),
        (of(value > 0) / F.sum("n")).alias("positive"),
        (of(value < 0) / F.sum("n")).alias("negative"),
    )
