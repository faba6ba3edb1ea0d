"""Reversible differencing of grids in three dimensions, globally and in chunks.

Both in-frame differences work on one hash partitioning by time, so a full 3-D
difference exchanges the cells twice: once by t, once by (y, x).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits

#: Cells of one chunk in time, rows and columns.
CHUNK = (24, 128, 256)
# The regions of the difference tensor by which coordinates are 0, in storage order.
REGIONS = ("interior", "t0_face", "lat0_face", "lon0_face", "t0_lat0_edge", "t0_lon0_edge", "lat0_lon0_edge", "vertex")


def words(grid: DataFrame, value: str = "v") -> DataFrame:
    """(t, y, x, w): the bit pattern of every cell."""
    return bits.with_float_bits(grid.select("t", "y", "x", value), value).select("t", "y", "x", "w")


def region(t: Column, y: Column, x: Column) -> Column:
    zero = (t == 0).cast("int") * 4 + (y == 0).cast("int") * 2 + (x == 0).cast("int")
    names = ("interior", "lon0_face", "lat0_face", "lat0_lon0_edge", "t0_face", "t0_lon0_edge", "t0_lat0_edge", "vertex")
    return F.element_at(F.array(*[F.lit(n) for n in names]), zero + 1)


def region_group(name: Column) -> Column:
    """planes for faces, edges for edges, else null."""
    return F.when(name.endswith("_face"), "planes").when(name.endswith("_edge"), "edges")


def _step(df: DataFrame, value: str, by: Sequence[str | Column], along: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(along))
    return df.withColumn(value, F.col(value) - F.coalesce(before, F.lit(0)))


def delta3d(cells: DataFrame, value: str = "w", to: str = "d") -> DataFrame:
    """Forward difference along x, y and t; the first cell of a line keeps its value.

    Sums undo it, so the result is reversible for any dense grid.
    """
    df = cells.repartition("t").withColumn(to, F.col(value))
    df = _step(df, to, ["t", "y"], "x")
    df = _step(df, to, ["t", "x"], "y")
    return _step(df, to, ["y", "x"], "t")


def undelta3d(cells: DataFrame, value: str = "d", to: str = "w") -> DataFrame:
    """Running sums along t, y and x: the inverse of ``delta3d``."""
    df = cells.withColumn(to, F.col(value))
    for by, along in ((["y", "x"], "t"), (["t", "x"], "y"), (["t", "y"], "x")):
        df = df.withColumn(to, F.sum(to).over(Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)))
        df = df.repartition("t") if along == "t" else df
    return df


def with_chunk(cells: DataFrame, chunk: Sequence[int] = CHUNK) -> DataFrame:
    """Adds the chunk (ct, cy, cx) of every cell."""
    return cells.withColumns({f"c{a}": F.floor(F.col(a) / n).cast("int") for a, n in zip("tyx", chunk, strict=True)})


def delta3d_chunks(cells: DataFrame, chunk: Sequence[int] = CHUNK, value: str = "w", to: str = "d") -> DataFrame:
    """Difference modulo 2**32 that starts anew in each chunk: one exchange, by chunk."""
    key = ["ct", "cy", "cx"]
    df = with_chunk(cells, chunk).repartition(*key).withColumn(to, F.col(value))
    for by, along in ((["t", "y"], "x"), (["t", "x"], "y"), (["y", "x"], "t")):
        df = _step(df, to, [*key, *by], along)
    return df.withColumn(to, bits.modular(F.col(to)))


def undelta3d_chunks(cells: DataFrame, value: str = "d", to: str = "w") -> DataFrame:
    """Running sums modulo 2**32 in each chunk; ``cells`` has ct, cy, cx."""
    key = ["ct", "cy", "cx"]
    df = cells.repartition(*key).withColumn(to, F.col(value))
    for by, along in ((["y", "x"], "t"), (["t", "x"], "y"), (["t", "y"], "x")):
        order = Window.partitionBy(*key, *by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(to, bits.modular(F.sum(to).over(order)))
    return df


def chunk_order(cells: DataFrame, chunk: Sequence[int] = CHUNK) -> DataFrame:
    """Adds the place of each cell in its chunk when regions are stored one after another."""
    df = with_chunk(cells, chunk)
    local = region(*[F.pmod(F.col(a), F.lit(n)) for a, n in zip("tyx", chunk, strict=True)])
    rank = F.array_position(F.array(*[F.lit(r) for r in REGIONS]), local)
    order = Window.partitionBy("ct", "cy", "cx").orderBy(rank, "t", "y", "x")
    return df.withColumn("region", local).withColumn("place", F.row_number().over(order) - 1)


def chunk_cells(stored: DataFrame, shape: Sequence[int], chunk: Sequence[int] = CHUNK) -> DataFrame:
    """Adds t, y and x to rows (ct, cy, cx, place): the inverse of ``chunk_order`` for a grid
    of ``shape``.  A region's cells are in row order, so its place alone gives a cell."""
    start = {a: F.col(f"c{a}") * n for a, n in zip("tyx", chunk, strict=True)}
    sides = {a: F.least(F.lit(n), F.lit(whole) - start[a]) for a, n, whole in zip("tyx", chunk, shape, strict=True)}
    found, below = None, F.lit(0)
    for name in REGIONS:
        fixed = set("tyx") if name == "vertex" else {a for a, zero in zip("tyx", ("t0", "lat0", "lon0"), strict=True) if zero in name.split("_")}
        at, size, cell = F.col("place") - below, F.lit(1), {}
        for a in "xyt":
            if a in fixed:
                cell[a] = start[a]
            else:
                inner = F.greatest(sides[a] - 1, F.lit(1))
                cell[a] = start[a] + 1 + F.pmod(at, inner)
                at, size = F.floor(at / inner), size * (sides[a] - 1)
        below = below + size
        one = F.struct(*[cell[a].cast("int").alias(a) for a in "tyx"])
        found = F.when(F.col("place") < below, one) if found is None else found.when(F.col("place") < below, one)
    return stored.withColumn("__cell", found).select(*stored.columns, "__cell.*")


def mixed2d(cells: DataFrame, value: str = "w", to: str = "d") -> DataFrame:
    """The mixed difference of each 2x2 square of a frame; t, y >= 1, x >= 1."""
    df = cells.repartition("t").withColumn(to, F.col(value))
    df = _step(df, to, ["t", "y"], "x")
    return _step(df, to, ["t", "x"], "y").where("y > 0 AND x > 0")


def delta_t(cells: DataFrame, value: str = "w", to: str = "d") -> DataFrame:
    """Each cell minus the same cell a frame before; t >= 1."""
    order = Window.partitionBy("y", "x").orderBy("t")
    return cells.withColumn(to, F.col(value) - F.lag(value).over(order)).where("t > 0")


def series_delta(series: DataFrame, value: str, to: str = "d") -> DataFrame:
    """Difference along t of one value per frame (a small table: one row per frame)."""
    return series.withColumn(to, F.col(value) - F.lag(value).over(Window.orderBy("t")))


def naive_diff(cells: DataFrame, block: int, value: str = "v") -> DataFrame:
    """Blocks of ``block`` frames: the first is a key frame, the others float32
    differences to the frame before."""
    if block < 2:
        raise ValueError("a block has at least 2 frames")
    order = Window.partitionBy("y", "x", "block").orderBy("t")
    df = cells.withColumn("block", F.floor(F.col("t") / block).cast("int"))
    before = F.lag(value).over(order)
    kind = F.when(F.pmod("t", F.lit(block)) == 0, "key").otherwise("diff")
    changed = F.when(before.isNull(), F.col(value)).otherwise((F.col(value) - before).cast("float"))
    return df.withColumns({"kind": kind, "diff": changed})


def naive_undiff(cells: DataFrame, value: str = "diff", to: str = "v") -> DataFrame:
    """Decodes ``naive_diff`` by adding up float32 values frame by frame, for one row of
    cells of one block at a time.

    Rounded differences don't always add up to the exact value; compare to see.
    """
    schema = cells.drop(to).withColumn(to, F.lit(0.0).cast("float")).schema
    names = [n for n in schema.names if n != to]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending"), ("t", "ascending")])
        x, t = (np.asarray(table.column(c)) for c in "xt")
        part = np.asarray(table.column(value)).astype(np.float32)
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        out = part.copy()
        for step in range(1, int(place.max()) + 1):
            now = np.flatnonzero(place == step)
            out[now] = out[now - 1] + part[now]
        return pa.table({**{n: table.column(n) for n in names}, to: pa.array(out, pa.float32())})

    return cells.select(*names).groupBy("y", "block").applyInArrow(run, schema)
