"""TIFF: a tag reader, a float32 frame reader, and Spark data sources over both.

Files are read with ``binaryFile``, so any storage that Spark reaches will do;
each file is parsed in the task that read it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bands

# Fixed values of the TIFF 6.0 and BigTIFF formats: type number -> (name, struct code, bytes).
_TYPES = {
    1: ("BYTE", "B", 1), 2: ("ASCII", "s", 1), 3: ("SHORT", "H", 2), 4: ("LONG", "I", 4), 5: ("RATIONAL", "II", 8), 6: ("SBYTE", "b", 1), 7: ("UNDEFINED", "B", 1), 8: ("SSHORT", "h", 2),
    9: ("SLONG", "i", 4), 10: ("SRATIONAL", "ii", 8), 11: ("FLOAT", "f", 4), 12: ("DOUBLE", "d", 8), 13: ("IFD", "I", 4), 16: ("LONG8", "Q", 8), 17: ("SLONG8", "q", 8), 18: ("IFD8", "Q", 8),
}
_TAGS = {
    254: "NewSubfileType", 255: "SubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation",
    277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 286: "XPosition", 287: "YPosition", 296: "ResolutionUnit", 305: "Software",
    306: "DateTime", 315: "Artist", 317: "Predictor", 320: "ColorMap", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 330: "SubIFDs", 338: "ExtraSamples", 339: "SampleFormat",
    340: "SMinSampleValue", 341: "SMaxSampleValue", 347: "JPEGTables", 42112: "GDAL_METADATA", 42113: "GDAL_NODATA",
}
# Fixed values of the same formats: what the numbers of some tags stand for.
_MEANINGS = {
    "Compression": {1: "None", 5: "LZW", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 32946: "Deflate", 34925: "LZMA", 50000: "ZSTD", 50001: "WebP"},
    "PhotometricInterpretation": {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette", 4: "TransparencyMask", 5: "CMYK", 6: "YCbCr", 8: "CIELab"},
    "PlanarConfiguration": {1: "Chunky", 2: "Planar"},
    "SampleFormat": {1: "UnsignedInteger", 2: "SignedInteger", 3: "IEEEFloat", 4: "Undefined"},
    "Predictor": {1: "None", 2: "Horizontal", 3: "FloatingPoint"},
}
#: File names that may be broadcast; more are joined by a shuffle.
BROADCAST_FILES = 500_000


class Tiff:
    """The directories of one file's bytes; ``entries`` yields (ifd, tag, type, count, values)."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if data[:2] == b"II" else ">"
        magic = self._get("H", 2)[0]
        if magic not in (42, 43):
            raise ValueError(f"not a TIFF file: version {magic}")
        self.big = magic == 43
        self.first = self._get("Q", 8)[0] if self.big else self._get("I", 4)[0]

    def _get(self, code: str, at: int) -> tuple:
        return struct.unpack_from(self.order + code, self.data, at)

    def entries(self) -> Iterator[tuple[int, int, str, int, tuple]]:
        at, ifd, seen = self.first, 0, set()
        while at:
            if at in seen:
                raise ValueError("the directories form a cycle")
            seen.add(at)
            n = self._get("Q" if self.big else "H", at)[0]
            at += 8 if self.big else 2
            for _ in range(n):
                tag, kind = self._get("HH", at)
                count = self._get("Q" if self.big else "I", at + 4)[0]
                place, room = at + (12 if self.big else 8), 8 if self.big else 4
                name, code, size = _TYPES.get(kind, (str(kind), "B", 1))
                start = place if size * count <= room else self._get("Q" if self.big else "I", place)[0]
                yield ifd, tag, name, count, self._get(f"{count}s" if code == "s" else code * count if len(code) > 1 else f"{count}{code}", start)
                at += 20 if self.big else 12
            at = self._get("Q" if self.big else "I", at)[0]
            ifd += 1

    def frame(self, strict: bool = True) -> np.ndarray:
        """The first image as 2-D float32; ``strict`` refuses any other sample type."""
        tags: dict[int, Any] = {tag: values for ifd, tag, _, _, values in self.entries() if ifd == 0}
        one = lambda tag, otherwise: tags.get(tag, (otherwise,))[0]
        width, height, bits, form = one(256, 0), one(257, 0), one(258, 1), one(339, 1)
        if one(277, 1) != 1:
            raise ValueError("not a 2-D frame: several samples a pixel")
        if strict and (bits, form) != (32, 3):
            raise ValueError(f"not float32: {bits} bits, sample format {form}")
        kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
        tiled = 322 in tags
        rows, columns = (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width)
        offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        out, across = np.zeros((height, width), kind), -(-width // columns)
        for i, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
            top, left = i // across * rows, i % across * columns
            high = rows if tiled else min(rows, height - top)
            raw = _decoded(self.data[start : start + size], one(259, 1))
            piece = _unpredicted(raw, high, columns, kind, one(317, 1))
            out[top : top + rows, left : left + columns] = piece[: height - top, : width - left]
        return out.astype("<f4")


def _unpredicted(raw: bytes, high: int, columns: int, kind: np.dtype, predictor: int) -> np.ndarray:
    if predictor == 3:  # bytes of floats by significance, each row differenced
        flat = np.frombuffer(raw, np.uint8, high * columns * kind.itemsize).reshape(high, -1)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(high, kind.itemsize, columns)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0]
    piece = np.frombuffer(raw, kind, high * columns).reshape(high, columns)
    return np.cumsum(piece, axis=1, dtype=kind) if predictor == 2 else piece


def _decoded(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression in (8, 32946):
        import zlib

        return zlib.decompress(raw)
    if compression == 5:
        return _lzw(raw)
    if compression in (50000, 34926):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if compression == 34925:
        import lzma

        return lzma.decompress(raw)
    raise ValueError(f"unsupported compression {compression}")


def _lzw(raw: bytes) -> bytes:
    """The LZW variant of TIFF: codes of 9 to 12 bits, the most significant bit first."""
    clear, end = 256, 257
    table: list[bytes] = []
    out, previous = [], b""
    held = have = at = 0
    width = 9
    while True:
        while have < width:
            if at >= len(raw):
                return b"".join(out)
            held, have, at = (held << 8) | raw[at], have + 8, at + 1
        code = (held >> (have - width)) & ((1 << width) - 1)
        have -= width
        held &= (1 << have) - 1
        if code == end:
            return b"".join(out)
        if code == clear:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else previous + previous[:1]
        out.append(word)
        if previous:
            table.append(previous + word[:1])
            width = 9 + sum(len(table) + 1 >= 1 << w for w in (9, 10, 11))
        previous = word


def write_frame(frame: np.ndarray, description: str = "", tile: int = 256, level: int = 6) -> bytes:
    """A classic little-endian TIFF of one float32 frame in Deflate tiles."""
    import zlib

    height, width = frame.shape
    tiles = []
    for top in range(0, height, tile):
        for left in range(0, width, tile):
            piece = np.zeros((tile, tile), "<f4")
            part = frame[top : top + tile, left : left + tile]
            piece[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(piece.tobytes(), level))
    body, offsets = b"".join(tiles), np.cumsum([8, *[len(t) for t in tiles[:-1]]]).tolist()
    text = description.encode() + b"\0"
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [32]), (259, 3, [8]), (262, 3, [1]), (270, 2, text), (277, 3, [1]), (322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, [len(t) for t in tiles]), (339, 3, [3])]
    start = 8 + len(body) + len(body) % 2
    extra_at, extra, directory = start + 2 + 12 * len(entries) + 4, b"", struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        packed = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_TYPES[kind][1]}", *values)
        if len(packed) > 4:
            packed, extra = struct.pack("<I", extra_at + len(extra)), extra + packed + b"\0" * (len(packed) % 2)
        directory += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, start) + body + b"\0" * (len(body) % 2) + directory + struct.pack("<I", 0) + extra


def tiff_files(spark: SparkSession, folder: str, recursive: bool = False, limit: int | None = None, exclude: str | None = None) -> DataFrame:
    """(t, path, length, content) of a folder's .tif and .tiff files; t follows the path.

    An error if there is none, or if ``limit`` is under 1.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.where(F.lower("path").rlike(r"\.tiff?$"))
    if exclude:
        files = files.where(~F.contains("path", F.lit(exclude)))
    # the listing alone is ordered: names are few, contents are not
    order = files.select("path").withColumn("t", F.row_number().over(Window.orderBy("path")) - 1)
    order = order.where(F.col("t") < limit) if limit else order
    n = order.count()
    if not n:
        raise FileNotFoundError(f"no TIFF files in {folder}")
    return files.join(F.broadcast(order) if n <= BROADCAST_FILES else order, "path").select("t", "path", "length", "content")


def tiff_tags(files: DataFrame) -> DataFrame:
    """(path, ifd, tag, name, type, count, value array<string>) of every directory entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for ifd, tag, kind, count, values in Tiff(content).entries():
                    if kind == "ASCII":
                        shown = [s.decode("utf-8", "replace") for s in values[0].rstrip(b"\0").split(b"\0")]
                    elif kind in ("RATIONAL", "SRATIONAL"):
                        shown = [f"{a}/{b}" for a, b in zip(values[::2], values[1::2], strict=True)]
                    else:
                        shown = [str(v) for v in values]
                    rows.append((path, ifd, tag, _TAGS.get(tag, str(tag)), kind, count, shown))
            names = ["path", "ifd", "tag", "name", "type", "count", "value"]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, ifd int, tag int, name string, type string, count long, value array<string>")


def named_values(tags: DataFrame) -> DataFrame:
    """Adds ``meaning`` to tags: what a coded value stands for, its number if unknown, and
    null where values are not codes."""
    known = F.create_map(*[F.lit(x) for name, values in _MEANINGS.items() for n, shown in values.items() for x in (f"{name} {n}", shown)])
    code = F.concat_ws(" ", "name", F.get("value", F.lit(0)))
    return tags.withColumn("meaning", F.when(F.col("name").isin(*_MEANINGS), F.coalesce(F.try_element_at(known, code), F.get("value", F.lit(0)))))


def byte_counts(tags: DataFrame) -> DataFrame:
    """(path, ifd, pieces, total, min, max) of strip or tile byte counts."""
    sizes = tags.where("name IN ('StripByteCounts', 'TileByteCounts')").select("path", "ifd", F.explode(F.col("value").cast("array<long>")).alias("size"))
    return sizes.groupBy("path", "ifd").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("total"), F.min("size").alias("min"), F.max("size").alias("max"))


def read_grid(files: DataFrame, strict: bool = True, finite: bool = False) -> DataFrame:
    """(t, y, x, v) of frames, one file at a time; all must have the first one's shape.

    ``strict`` demands float32; ``finite`` refuses NaN and infinities.
    """
    first = files.where("t = 0").select("content").first()
    shape = Tiff(bytes(first.content)).frame(strict).shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, path, content in zip(*[batch.column(c).to_pylist() for c in ("t", "path", "content")], strict=True):
                frame = Tiff(content).frame(strict)
                if frame.shape != shape:
                    raise ValueError(f"{path} has shape {frame.shape}, not {shape}")
                if finite and not np.isfinite(frame).all():
                    raise ValueError(f"{path} has values that are not finite")
                y, x = np.indices(shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(frame.size, t, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(frame.ravel())], names=["t", "y", "x", "v"])

    return files.select("t", "path", "content").mapInArrow(run, "t int, y int, x int, v float")


def read_bands(files: DataFrame, rows: int = bands.ROWS, strict: bool = True) -> DataFrame:
    """The frames as row bands: no row per cell is made, and one frame is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, content in zip(batch.column("t").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield bands.frame_bands(t, Tiff(content).frame(strict), rows)

    return files.select("t", "content").mapInArrow(run, bands.BAND)


def frames_as_tiff(cells: DataFrame, description: str = "", tile: int = 256) -> DataFrame:
    """(t, content): every frame as the bytes of a TIFF file."""

    def run(table: pa.Table) -> pa.Table:
        y, x = np.asarray(table.column("y")), np.asarray(table.column("x"))
        frame = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan, "<f4")
        frame[y, x] = np.asarray(table.column("v"))
        return pa.table({"t": table.column("t")[:1], "content": pa.array([write_frame(frame, description, tile)], pa.binary())})

    return cells.select("t", "y", "x", "v").groupBy("t").applyInArrow(run, "t int, content binary")
