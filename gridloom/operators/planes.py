"""Bit planes: the 32 bits of every word as packed sequences over the whole grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

#: Packed bytes of one stored piece of a plane.
PIECE = 1 << 20


def plane_bits(cells: DataFrame) -> DataFrame:
    """(bit, position, on) for each of the 32 bits; ``cells`` has position and w."""
    each = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")
    return cells.select("position", "w", each).select("bit", "position", bits.plane(F.col("w"), F.col("bit")).alias("on"))


def plane_ones(cells: DataFrame) -> DataFrame:
    """(bit, field, name, ones): one aggregation of 32 sums, no exploding."""
    sums = cells.agg(*[F.sum(F.shiftright("w", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(32)])
    rows = sums.select(F.posexplode(F.array(*[F.col(f"b{b}") for b in range(32)])).alias("bit", "ones"))
    return rows.select("bit", bits.plane_field(F.col("bit")).alias("field"), bits.plane_name(F.col("bit")).alias("name"), "ones")


def position(t: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    """The place of a cell in time, row, column order."""
    return (t.cast("long") * ny + y) * nx + x


def packed_planes(cells: DataFrame) -> DataFrame:
    """(bit, byte_idx, byte): eight positions to a byte, the first in the lowest bit.

    Each group of eight words yields its 32 bytes in one aggregation; the last
    byte of a plane is padded with zeros.
    """
    place = F.pmod("position", F.lit(8)).cast("int")
    sums = [F.sum(F.call_function("shiftleft", F.shiftright("w", b).bitwiseAND(F.lit(1).cast("long")), place)).alias(f"b{b}") for b in range(32)]
    bytes_ = cells.groupBy(F.floor(F.col("position") / 8).alias("byte_idx")).agg(*sums)
    return bytes_.select("byte_idx", F.posexplode(F.array(*[F.col(f"b{b}") for b in range(32)])).alias("bit", "byte")).select("bit", "byte_idx", "byte")


def plane_pieces(cells: DataFrame, level: int = 5, piece: int = PIECE) -> DataFrame:
    """(bit, piece, n, frame): planes in pieces of ``piece`` bytes, each a Zstandard frame.

    A grid of any size is cut at fixed places, so no task gets a whole plane;
    frames of a plane, one after another, are the plane's stream.
    """
    bytes_ = packed_planes(cells).withColumn("piece", F.floor(F.col("byte_idx") / piece))

    def run(table: pa.Table) -> pa.Table:
        at = np.asarray(table.column("byte_idx"))
        data = np.asarray(table.column("byte")).astype(np.uint8)[np.argsort(at)].tobytes()
        frame = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=False).compress(data)
        return pa.table({"bit": table.column("bit")[:1], "piece": table.column("piece")[:1], "n": pa.array([len(data)], pa.int64()), "frame": pa.array([frame], pa.binary())})

    return bytes_.groupBy("bit", "piece").applyInArrow(run, "bit int, piece long, n long, frame binary")


def unpacked_pieces(pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """(bit, byte_idx, byte) from ``plane_pieces``: the decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bit, k, frame in zip(*[batch.column(c).to_pylist() for c in ("bit", "piece", "frame")], strict=True):
                data = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(frame), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(data), bit), pa.int32()), pa.array(k * piece + np.arange(len(data)), pa.int64()), pa.array(data, pa.int64())], names=["bit", "byte_idx", "byte"]
                )

    return pieces.mapInArrow(run, "bit int, byte_idx long, byte long")
