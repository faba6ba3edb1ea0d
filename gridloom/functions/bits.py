"""Bit views of float32 and integer codes, as plain column expressions.

Words are the 32 bits of a float32, carried as BIGINT in [0, 2**32), because
Spark has no unsigned 32-bit type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 1 << 32
MASK = WORD - 1


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _magnitude(v: Column) -> Column:
    return F.abs(v.cast("double"))


def _guess(a: Column) -> Column:
    """The exponent that a logarithm proposes; 0 where there is none."""
    return F.floor(F.log2(F.when((a >= 2.0**-126) & (a < float("inf")), a).otherwise(1.0))).cast("int")


def _exponent(a: Column, guess: Column) -> Column:
    """The exact exponent: two comparisons with powers of two correct the guess."""
    return guess + F.when(F.pow(F.lit(2.0), guess + 1) <= a, 1).when(F.pow(F.lit(2.0), guess) > a, -1).otherwise(0)


def _word(v: Column, a: Column, exponent: Column) -> Column:
    scaled = (a / F.pow(F.lit(2.0), exponent) * float(1 << 23)).cast("long")  # 2**23 + mantissa
    magnitude = (
        F.when(F.isnan(v), _long(0x7FC00000))
        .when(a == float("inf"), _long(0x7F800000))
        .when(a >= 2.0**-126, (exponent + 126).cast("long") * _long(1 << 23) + scaled)
        .otherwise((a * 2.0**149).cast("long"))
    )
    negative = (v < 0) | ((v == 0) & (v.cast("string") == "-0.0"))
    return F.when(v.isNotNull(), magnitude + F.when(negative & ~F.isnan(v), _long(1 << 31)).otherwise(_long(0)))


def float_bits(v: Column) -> Column:
    """The word of a float32; null for null.

    Exponent and mantissa come from the value by exact steps.  Every NaN has the
    word of the quiet NaN.  ``with_float_bits`` does the same in fewer operations.
    """
    v = v.cast("float")
    a = _magnitude(v)
    return _word(v, a, _exponent(a, _guess(a)))


def with_float_bits(df: DataFrame, value: str = "v", to: str = "w") -> DataFrame:
    """Adds ``to``, the word of ``value``: each step is a projection, so that none is
    evaluated again for every use of it."""
    v = F.col(value).cast("float")
    df = df.withColumn("__a", _magnitude(v)).withColumn("__guess", _guess(F.col("__a")))
    df = df.withColumn("__exponent", _exponent(F.col("__a"), F.col("__guess")))
    return df.withColumn(to, _word(v, F.col("__a"), F.col("__exponent"))).drop("__a", "__guess", "__exponent")


def bits_float(w: Column) -> Column:
    """The float32 of a word."""
    magnitude = w.bitwiseAND(_long((1 << 31) - 1))
    exponent, mantissa = F.shiftright(magnitude, 23).cast("int"), magnitude.bitwiseAND(_long((1 << 23) - 1))
    value = (
        F.when(exponent == 0, mantissa * 2.0**-149)
        .when((exponent == 255) & (mantissa == 0), F.lit(float("inf")))
        .when(exponent == 255, F.lit(float("nan")))
        .otherwise((mantissa + _long(1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
    )
    return (value * F.when(w >= 1 << 31, -1.0).otherwise(1.0)).cast("float")


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... -> 0, 1, 2, 3 ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def zigzag32(u: Column) -> Column:
    """Zigzag of a word read as a signed 32-bit number."""
    return F.shiftleft(u, 1).bitwiseAND(_long(MASK)).bitwiseXOR(F.when(u >= 1 << 31, _long(MASK)).otherwise(_long(0)))


def unzigzag32(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(F.when(z.bitwiseAND(_long(1)) == 1, _long(MASK)).otherwise(_long(0)))


def bit_width(z: Column) -> Column:
    """Bits of a non-negative integer; 0 has none."""
    return F.when(z == 0, 0).otherwise(F.length(F.bin(z)))


def cut_low(w: Column, bits: int) -> Column:
    return w.bitwiseAND(_long(MASK ^ ((1 << bits) - 1)))


def low_bits(w: Column, bits: int) -> Column:
    return w.bitwiseAND(_long((1 << bits) - 1))


def plane(w: Column, bit: Column) -> Column:
    """Bit number ``bit`` of a word."""
    return F.call_function("shiftright", w, bit).bitwiseAND(_long(1))


def plane_field(bit: Column) -> Column:
    """Which IEEE-754 field a bit belongs to; null beyond 0 to 31."""
    return F.when(bit.between(0, 22), "mantissa").when(bit.between(23, 30), "exponent").when(bit == 31, "sign")


def plane_name(bit: Column) -> Column:
    suffix = F.when(bit == 0, F.lit("lsb")).otherwise(plane_field(bit))
    return F.format_string("bit_%02d_%s", bit, suffix)


def byte_of(w: Column, i: int) -> Column:
    """Byte ``i`` of the word, the least significant first."""
    return F.shiftright(w, 8 * i).bitwiseAND(_long(255))


def modular(v: Column) -> Column:
    """``v`` modulo 2**32."""
    return F.pmod(v, _long(WORD))


def noise(t: Column, y: Column, x: Column, bits: int, seed: int) -> Column:
    """``bits`` uniform bits of a cell: a multiply and xor-shift hash of its place.

    It draws from the same law as a sequential generator but needs no order of
    the cells, so every task makes its own part.
    """
    h = (t.cast("long") * 73856093 + y.cast("long") * 19349663 + x.cast("long") * 83492791 + seed).bitwiseAND(_long(MASK))
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * 73244475).bitwiseAND(_long(MASK))
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(_long((1 << bits) - 1))


def whiten(w: Column, t: Column, y: Column, x: Column, bits: int, seed: int = 2311) -> Column:
    """The word with its low bits replaced by noise; the high bits stay."""
    return cut_low(w, bits).bitwiseOR(noise(t, y, x, bits, seed))
