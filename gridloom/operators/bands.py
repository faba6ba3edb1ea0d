"""Row bands: frames as binary strips, for grids too large for a row per cell.

A band holds some rows of one frame as float32 bytes, with the row above it as a
halo.  Slabs of frames of a band are dealt to the tasks, each with the frame before it,
and lagging the binary column there aligns each band with the same band a frame
before.  So a 3-D difference of any grid costs one exchange of the packed bytes, in as
many parts as the grid has slabs, and NumPy works on whole strips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .delta import REGIONS

#: Rows of a band: at 1,440 columns a strip has 0.4 MB.
ROWS = 64
BAND = "t int, band int, y0 int, halo int, nx int, data binary"
#: Frames of one slab of a band, which one task takes, besides the frame before them.
SLAB = 32
#: Distinct residuals that a task gathers before it gives out its counts.
HELD = 2_000_000


def frame_bands(t: int, frame: np.ndarray, rows: int = ROWS) -> pa.RecordBatch:
    """The bands of one float32 frame."""
    starts = range(0, frame.shape[0], rows)
    tops = [max(0, y - 1) for y in starts]
    strips = [np.ascontiguousarray(frame[top : y + rows], "<f4").tobytes() for top, y in zip(tops, starts, strict=True)]
    ints = lambda values: pa.array(list(values), pa.int32())
    n = len(strips)
    return pa.RecordBatch.from_arrays(
        [ints([t] * n), ints(range(n)), ints(starts), ints(y - top for top, y in zip(tops, starts, strict=True)), ints([frame.shape[1]] * n), pa.array(strips, pa.binary())],
        names=["t", "band", "y0", "halo", "nx", "data"],
    )


def to_bands(cells: DataFrame, rows: int = ROWS) -> DataFrame:
    """Cells (t, y, x, v) as bands; sources that have whole frames use ``frame_bands``."""

    def run(table: pa.Table) -> pa.Table:
        y, x = np.asarray(table.column("y")), np.asarray(table.column("x"))
        band, t = table.column("band")[0].as_py(), table.column("t")[0].as_py()
        top = int(y.min())
        strip = np.empty((int(y.max()) - top + 1, int(x.max()) + 1), "<f4")
        if strip.size != table.num_rows:
            raise ValueError(f"band {band} of frame {t} has {table.num_rows} cells, not {strip.size}")
        strip[y - top, x] = np.asarray(table.column("v"))
        one = lambda v: pa.array([v], pa.int32())
        return pa.table({"t": one(t), "band": one(band), "y0": one(band * rows), "halo": one(band * rows - top), "nx": one(strip.shape[1]), "data": pa.array([strip.tobytes()], pa.binary())})

    own = F.floor(F.col("y") / rows).cast("int")
    # the last row of a band is also the halo of the next one
    bands = F.when(F.pmod("y", F.lit(rows)) == rows - 1, F.array(own, own + 1)).otherwise(F.array(own))
    spread = cells.select("t", "y", "x", "v", F.explode(bands).alias("band"))
    last = cells.agg(F.max("y").alias("last"))
    spread = spread.join(F.broadcast(last), F.col("band") * rows <= F.col("last"))
    return spread.select("t", "band", "y", "x", "v").groupBy("t", "band").applyInArrow(run, BAND)


def delta3d_counts(bands: DataFrame) -> DataFrame:
    """(region, value, n): the exact distribution of 3-D differences of the words.

    The frames must be 0, 1, 2 and so on, without gaps."""
    own = F.floor(F.col("t") / SLAB).cast("int")
    slabs = F.when(F.pmod("t", F.lit(SLAB)) == SLAB - 1, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = bands.withColumn("slab", F.explode(slabs))
    order = Window.partitionBy("band", "slab").orderBy("t")
    pairs = dealt.withColumn("before", F.lag("data").over(order)).where(F.col("slab") == own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in REGIONS]

        def given() -> Iterator[pa.RecordBatch]:
            for name, parts in zip(REGIONS, held, strict=True):
                if parts:
                    values, counts = merged(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), name)).cast(pa.string()), pa.array(values), pa.array(counts)], names=["region", "value", "n"])
                    parts.clear()

        for batch in batches:
            for r in batch.to_pylist():
                strip = np.frombuffer(r["data"], "<u4").reshape(-1, r["nx"]).astype(np.int64)
                if r["before"] is None and r["t"]:
                    raise ValueError(f"the frame before {r['t']} is missing")
                if r["t"]:
                    strip = strip - np.frombuffer(r["before"], "<u4").reshape(-1, r["nx"])
                d = np.diff(np.diff(strip, axis=1, prepend=0), axis=0, prepend=0)[r["halo"] :]
                for k, part in enumerate(_regions(d, r["t"] == 0, r["y0"] == 0)):
                    if part.size:
                        held[k].append(np.unique(part, return_counts=True))
                        if len(held[k]) > 16:
                            held[k][:] = [merged(held[k])]
            if sum(len(v) for parts in held for v, _ in parts) > HELD:
                yield from given()
        yield from given()

    counts = pairs.select("t", "y0", "halo", "nx", "data", "before").mapInArrow(run, "region string, value long, n long")
    return counts.groupBy("region", "value").agg(F.sum("n").alias("n"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(values)).astype(np.int64)


def _regions(d: np.ndarray, first_frame: bool, first_row: bool) -> list[np.ndarray]:
    """The parts of a strip by region, in the order of ``REGIONS``."""
    none = d[:0].ravel()
    top, rest = (d[0], d[1:]) if first_row else (none, d)
    inner, side, row, corner = rest[:, 1:].ravel(), rest[:, :1].ravel(), top[1:], top[:1]
    if first_frame:
        return [none, inner, none, none, row, side, none, corner]
    return [inner, none, row, side, none, none, corner, none]
