"""Histogram, summary and report files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; in local mode without
    that setting, in a temp folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/gridloom-{uuid.uuid4().hex}-{name}"


def write_histogram(dist: DataFrame, path: str, mode: str = "error") -> None:
    """One distribution (value, n) as sorted, gzipped CSV parts with a header."""
    dist.select("value", F.col("n").alias("count")).orderBy("value").write.mode(mode).option("header", True).option("compression", "gzip").csv(path)


def read_histogram(spark: SparkSession, path: str, multiple_of: int = 1) -> DataFrame:
    """(value, n); only multiples of ``multiple_of``, divided by it."""
    rows = spark.read.csv(path, header=True, schema="value LONG, count LONG")
    kept = rows.where(F.pmod("value", F.lit(multiple_of)) == 0)
    return kept.select(F.expr(f"value div {multiple_of}").alias("value"), F.col("count").alias("n"))


def write_summary(summary: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line for each row of a small summary."""
    summary.write.mode(mode).json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def description(**fields: Column) -> Column:
    """JSON text with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def coordinates(spark: SparkSession, ny: int, nx: int) -> tuple[DataFrame, DataFrame]:
    """(y, lat) from 90 to -90 and (x, lon) from 0 to 359.75."""
    lat = spark.range(ny).select(F.col("id").cast("int").alias("y"), (90.0 - F.col("id") * 180.0 / max(1, ny - 1)).alias("lat"))
    lon = spark.range(nx).select(F.col("id").cast("int").alias("x"), (F.col("id") * 359.75 / max(1, nx - 1)).alias("lon"))
    return lat, lon


def markdown(rows: DataFrame, columns: Sequence[str] | None = None, limit: int = 1_000) -> str:
    """A small table as Markdown; an error if it has more than ``limit`` rows."""
    columns = list(columns or rows.columns)
    found = rows.select(*columns).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    lines = [columns, ["---"] * len(columns), *[["" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in found]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of all files under a path, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
