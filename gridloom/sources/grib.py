"""GRIB: messages, metadata and 16-bit simple-packed payloads of editions 1 and 2."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def messages(data: bytes) -> Iterator[bytes]:
    """The GRIB messages of a file, in order; bytes between them are skipped."""
    at = data.find(b"GRIB")
    while at >= 0:
        edition = data[at + 7]
        if edition not in (1, 2):
            raise ValueError(f"unsupported GRIB edition {edition}")
        size = int.from_bytes(data[at + 4 : at + 7], "big") if edition == 1 else int.from_bytes(data[at + 8 : at + 16], "big")
        yield data[at : at + size]
        at = data.find(b"GRIB", at + max(size, 4))


def sections(message: bytes) -> dict[int, bytes]:
    """The sections of a message by number (edition 1: 1 product, 2 grid, 3 bitmap, 4 data)."""
    out: dict[int, bytes] = {}
    if message[7] == 1:
        at = 8
        flags = message[at + 7]
        for number, there in ((1, True), (2, flags & 0x80), (3, flags & 0x40), (4, True)):
            if there:
                size = int.from_bytes(message[at : at + 3], "big")
                out[number] = message[at : at + size]
                at += size
        return out
    at = 16
    while at < len(message) - 4:
        size = int.from_bytes(message[at : at + 4], "big")
        if size < 5:
            raise ValueError(f"section of {size} bytes")
        out[message[at + 4]] = message[at : at + size]
        at += size
    return out


def _ibm(raw: bytes) -> float:
    """An IBM System/360 single-precision number."""
    n = int.from_bytes(raw, "big")
    return (-1) ** (n >> 31) * (n & 0xFFFFFF) * 16.0 ** ((n >> 24 & 0x7F) - 70)


def _signed(raw: bytes) -> int:
    """Sign and magnitude."""
    n, top = int.from_bytes(raw, "big"), 1 << (8 * len(raw) - 1)
    return -(n - top) if n >= top else n


def _scan(flags: int) -> dict:
    """The order of the cells, from a grid's scanning flags."""
    return {"i_negative": bool(flags & 0x80), "j_positive": bool(flags & 0x40), "j_consecutive": bool(flags & 0x20)}


# Fixed values of the formats: unit of time -> seconds (254: edition 1's second, 13: edition 2's).
_UNITS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1, 254: 1}


def _steps(message: dict[int, bytes], edition: int) -> dict:
    """The step range in seconds; None for units of no fixed length or other templates."""
    p = message[1] if edition == 1 else message[4]
    if edition == 1:
        unit, (first, last), kind = p[17], p[18:20], p[20]
        if kind == 10:
            first = last = first * 256 + last
        elif kind not in (2, 3, 4, 5):  # one time, not a range
            last = first
    else:
        unit = p[17] if int.from_bytes(p[7:9], "big") in (0, 1, 8, 11) else 255
        first = last = int.from_bytes(p[18:22], "big")
    seconds = _UNITS.get(unit)
    return {"step_start": None if seconds is None else first * seconds, "step_end": None if seconds is None else last * seconds}


def describe(message: bytes) -> dict:
    """Edition, times, grid and packing; what a message lacks is None."""
    s = sections(message)
    if message[7] == 1:
        p, g, d = s[1], s.get(2), s[4]
        century = p[24] - 1
        date = (century * 100 + p[12]) * 10000 + p[13] * 100 + p[14]
        degrees = (lambda a: _signed(g[a : a + 3]) / 1000) if g else (lambda a: None)
        return {
            "edition": 1, "centre": p[4], "param": p[8], "level_type": p[9], "level": int.from_bytes(p[10:12], "big"), "data_date": date, "data_time": p[15] * 100 + p[16],
            "ni": int.from_bytes(g[6:8], "big") if g else None, "nj": int.from_bytes(g[8:10], "big") if g else None, "first_lat": degrees(10), "first_lon": degrees(13), "last_lat": degrees(17), "last_lon": degrees(20),
            "grid": g[5] if g else None, "i_increment": int.from_bytes(g[23:25], "big") / 1000 if g else None, "j_increment": int.from_bytes(g[25:27], "big") / 1000 if g else None,
            **(_scan(g[27]) if g else {}), **_steps(s, 1), "bitmap": bool(p[7] & 0x40), "simple": d[3] >> 4 == 0, "bits": d[10], "binary_scale": _signed(d[4:6]), "decimal_scale": _signed(p[26:28]), "reference": _ibm(d[6:10]), "payload": d[11:],
        }
    i, g, p, r = s[1], s[3], s[4], s[5]
    year, month, day, hour, minute = struct.unpack_from(">H4B", i, 12)
    corner = lambda a: _signed(g[a : a + 4]) / 1e6
    return {
        "edition": 2, "centre": int.from_bytes(i[5:7], "big"), "param": p[9] * 256 + p[10], "level_type": p[22] if len(p) > 22 else None, "level": int.from_bytes(p[24:28], "big") if len(p) > 27 else None,
        "data_date": year * 10000 + month * 100 + day, "data_time": hour * 100 + minute, "ni": int.from_bytes(g[30:34], "big"), "nj": int.from_bytes(g[34:38], "big"),
        "first_lat": corner(46), "first_lon": corner(50), "last_lat": corner(55), "last_lon": corner(59),
        "grid": int.from_bytes(g[12:14], "big"), "i_increment": corner(63), "j_increment": corner(67), **_scan(g[71]), **_steps(s, 2), "bitmap": s.get(6, b"\0\0\0\0\0\xff")[5] != 255, "simple": int.from_bytes(r[9:11], "big") == 0,
        "bits": r[19], "binary_scale": _signed(r[15:17]), "decimal_scale": _signed(r[17:19]), "reference": struct.unpack_from(">f", r, 11)[0], "payload": s[7][5:],
    }


_SCHEMA = pa.schema(
    [
        *[(n, pa.int64()) for n in ("edition", "centre", "param", "level_type", "level", "data_date", "data_time", "step_start", "step_end", "grid", "ni", "nj")],
        *[(n, pa.float64()) for n in ("first_lat", "first_lon", "last_lat", "last_lon", "i_increment", "j_increment")],
        *[(n, pa.bool_()) for n in ("i_negative", "j_positive", "j_consecutive")],
        ("bitmap", pa.bool_()),
        ("simple", pa.bool_()),
        *[(n, pa.int64()) for n in ("bits", "binary_scale", "decimal_scale")],
        ("reference", pa.float64()),
        ("payload", pa.binary()),
    ]
)
_DDL = ", ".join(f"{f.name} {({pa.int64(): 'long', pa.float64(): 'double', pa.bool_(): 'boolean', pa.binary(): 'binary'})[f.type]}" for f in _SCHEMA)


def read_messages(files: DataFrame, start: int = 1, limit: int | None = None) -> DataFrame:
    """(path, message from 1, metadata, payload) of ``binaryFile`` rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for n, message in enumerate(messages(content), 1):
                    if n < start or limit is not None and n >= start + limit:
                        continue
                    row = describe(message)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), *[pa.array([row.get(f.name)], f.type) for f in _SCHEMA]], names=["path", "message", *_SCHEMA.names])

    return files.select("path", "content").mapInArrow(run, f"path string, message long, {_DDL}")


def data_time(date: Column, time: Column) -> Column:
    """A date number yyyyMMdd and a time number HHmm as a timestamp; null if they are none."""
    return F.try_to_timestamp(F.concat(date.cast("string"), F.lpad(time.cast("string"), 4, "0")), F.lit("yyyyMMddHHmm"))


def validity_time(read: DataFrame) -> Column:
    """When a message's field holds: its data time and the end of its step."""
    return F.timestamp_add("SECOND", read["step_end"], data_time(read["data_date"], read["data_time"]))


def with_parameters(read: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds the columns of a parameter table (edition, centre, param, such as short_name,
    name, units) to messages; null for parameters that it lacks."""
    return read.join(parameters, ["edition", "centre", "param"], "left")


def unpack_messages(read: DataFrame) -> DataFrame:
    """(message, y, x, packed): the packed integers; an error unless simple, 16 bits, no bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["simple"] or r["bits"] != 16 or r["bitmap"]:
                    raise ValueError(f"message {r['message']} is not simple-packed in 16 bits without a bitmap")
                n = r["ni"] * r["nj"]
                if len(r["payload"]) < 2 * n:
                    raise ValueError(f"message {r['message']} has {len(r['payload'])} bytes of data, not {2 * n}")
                packed = np.frombuffer(r["payload"], ">u2", n).astype(np.int64)
                y, x = np.divmod(np.arange(n, dtype=np.int32), r["ni"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["message"], np.int64)), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(packed)], names=["message", "y", "x", "packed"])

    return read.select("message", "simple", "bits", "bitmap", "ni", "nj", "payload").mapInArrow(run, "message long, y int, x int, packed long")


def metadata_counts(read: DataFrame) -> DataFrame:
    """Messages by field, grid and packing, with their distinct times and range."""
    time = data_time(F.col("data_date"), F.col("data_time"))
    return read.groupBy("edition", "centre", "param", "level_type", "level", "ni", "nj", "simple", "bits").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("times"), F.min(time).alias("first"), F.max(time).alias("last")
    )


def write_message(x: np.ndarray, reference: float, date: int, time: int, binary_scale: int = -9) -> bytes:
    """An edition 1 message of one 16-bit simple-packed frame, for tests and round trips."""
    nj, ni = x.shape
    three = lambda n: n.to_bytes(3, "big")
    two = lambda n: (abs(n) | (0x8000 if n < 0 else 0)).to_bytes(2, "big")
    exponent, fraction = 0, abs(reference)
    while fraction >= 1:
        fraction, exponent = fraction / 16, exponent + 1
    ibm = ((reference < 0) << 31 | (exponent + 64) << 24 | int(fraction * (1 << 24))).to_bytes(4, "big")
    year = date // 10000
    product = three(28) + bytes([128, 98, 145, 255, 0x80, 167, 1, 0, 0, (year - 1) % 100 + 1, date // 100 % 100, date % 100, time // 100, time % 100, 1, 0, 0, 0, 0, 0, 0, (year - 1) // 100 + 1, 0]) + two(0)
    grid = three(32) + bytes([0, 255, 0]) + ni.to_bytes(2, "big") + nj.to_bytes(2, "big") + three(90000) + three(0) + bytes([128]) + three(0x800000 | 90000) + three(359750) + two(250) + two(250) + bytes([0] * 5)
    payload = x.astype(">u2").tobytes()
    body = bytes([0]) + two(binary_scale) + ibm + bytes([16]) + payload
    data = three(3 + len(body)) + body
    size = 8 + len(product) + len(grid) + len(data) + 4
    return b"GRIB" + three(size) + bytes([1]) + product + grid + data + b"7777"
