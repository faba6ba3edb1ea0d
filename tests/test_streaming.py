"""Streaming differences against the batch operator."""

import numpy as np
import pytest

from gridloom.operators import delta
from gridloom.streaming.frames import streaming_delta_t, windowed_counts

SCHEMA = "t int, y int, x int, w long"


def write(spark, path, frames, a):
    rows = [(t, y, x, int(a[t, y, x])) for t in frames for y in range(a.shape[1]) for x in range(a.shape[2])]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, tmp_path, name):
    stream = streaming_delta_t(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).queryName(name).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    a = np.random.default_rng(4).integers(0, 1000, (6, 3, 4))
    path = str(tmp_path / "in")
    for frames in ((0, 1), (2,), (3, 4, 5)):
        write(spark, path, frames, a)
        out = run(spark, path, tmp_path, f"f{frames[0]}")  # a restart goes on from the stored state
    batch = delta.delta_t(spark.read.parquet(path)).select("t", "y", "x", "d")
    assert sorted(map(tuple, out.where("t > 0").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()
