"""Simple packing of grids: 16-bit integers over a per-frame reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_BITS = 16


def q16(reference: Column) -> Column:
    """A reference value in units of 2**-16; an error if it has finer bits."""
    scaled = reference.cast("double") * float(1 << FRACTION_BITS)
    return F.when(scaled == F.rint(scaled), F.rint(scaled).cast("long")).otherwise(F.raise_error("reference is not a multiple of 2**-16").cast("long"))


def unpack(reference: Column, x: Column, binary_scale: int = -9, decimal_scale: int = 0) -> Column:
    """``(reference + x * 2**binary_scale) / 10**decimal_scale`` in DOUBLE."""
    value = reference.cast("double") + x * 2.0**binary_scale
    return value if decimal_scale == 0 else value / 10.0**decimal_scale


def lattice(r: Column, x: Column, step: int = 128) -> Column:
    """The common integer lattice of all frames: ``r + step * x``."""
    return r + step * x


def quantize8(v: Column, low: Column, high: Column) -> Column:
    """0 to 255 by float32 steps, ties to even."""
    span = (high.cast("float") - low.cast("float")).cast("float")
    scaled = ((v.cast("float") - low.cast("float")).cast("float") * F.lit(255.0).cast("float")).cast("float")
    share = (scaled / span).cast("float")
    return F.rint(F.least(F.greatest(share, F.lit(0.0).cast("float")), F.lit(255.0).cast("float"))).cast("int")


def dequantize8(q: Column, low: Column, high: Column) -> Column:
    step = ((high.cast("float") - low.cast("float")).cast("float") / F.lit(255.0).cast("float")).cast("float")
    return ((q.cast("float") * step).cast("float") + low.cast("float")).cast("float")


def bits_per_value(size: Column, n: Column) -> Column:
    return size * 8.0 / n


def compression_ratio(raw: Column, size: Column) -> Column:
    """Null if there is no size to compare with."""
    return F.try_divide(raw.cast("double"), size)


def mib_per_second(size: Column, seconds: Column) -> Column:
    return F.try_divide(size / float(1 << 20), seconds)


def human_bytes(size: Column) -> Column:
    """B to TiB with two decimals."""
    size = size.cast("double")
    out = F.format_string("%.2f TiB", size / 2.0**40)
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(F.abs(size) < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", size / 1024.0**power)).otherwise(out)
    return out


def frame_name(index: Column, short_name: Column, valid: Column) -> Column:
    return F.format_string("%04d_%s_%s.tiff", index, short_name, F.date_format(valid, "yyyyMMdd'T'HHmm"))


def valid_time(t: Column, start: str) -> Column:
    """The time of frame ``t``: hours after ``start``."""
    return F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), t.cast("int"))
