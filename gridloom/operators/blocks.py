"""Block codecs: grids as chunked binary blocks, transformed and compressed in tasks.

A block is one chunk of the grid, a few MB at the default chunk size, so a task
holds one block at a time however large the grid is.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delta import CHUNK, with_chunk


#: The reversible steps of a block, in the order in which they can follow each other;
#: planes, the bits of all words plane by plane, may follow any of them.
CHAIN, PLANES = ("delta", "zigzag", "reorder"), "planes"


def _chains() -> dict[str, tuple[str, ...]]:
    """Every start of the chain, with planes and without, but for no step at all."""
    starts = [CHAIN[:n] for n in range(len(CHAIN) + 1)]
    return {"+".join(steps): steps for start in starts for steps in (start, (*start, PLANES)) if steps}


#: The transform modes to compare: name -> steps.
MODES = _chains()


def _zstd(level: int) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    return lambda b: zstandard.ZstdCompressor(level=level).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b)


def _arrow(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    size = 8

    def encode(b: bytes) -> bytes:
        return len(b).to_bytes(size, "little") + pa.compress(b, codec=name, asbytes=True)

    def decode(b: bytes) -> bytes:
        return pa.decompress(b[size:], decompressed_size=int.from_bytes(b[:size], "little"), codec=name, asbytes=True)

    return encode, decode


def byte_shuffle(b: bytes, undo: bool = False) -> bytes:
    """All first bytes of the 4-byte words, then all second ones, and so on."""
    a = np.frombuffer(b, np.uint8)
    return (a.reshape(4, -1).T if undo else a.reshape(-1, 4).T).tobytes()


def _turned(squares: np.ndarray) -> np.ndarray:
    """Each uint64, as 8 rows of 8 bits, with rows and columns exchanged, in place: bits swap
    with their mirror images in squares of 2, then of 4, then of 8."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        swap = squares >> np.uint64(shift)
        swap ^= squares
        swap &= np.uint64(mask)
        squares ^= swap
        swap <<= np.uint64(shift)
        squares ^= swap
    return squares


def bit_shuffle(b: bytes, undo: bool = False) -> bytes:
    """Bit 0 of all words, then bit 1, and so on; the count of words is padded to 8."""
    if undo:
        n = int.from_bytes(b[:4], "little")
        planes = np.frombuffer(b[4:], np.uint8).reshape(4, 8, -(-n // 8))
        squares = planes.transpose(0, 2, 1).copy().reshape(4, -(-n // 8) * 8).view("<u8")
        return _turned(squares).view(np.uint8)[:, :n].T.tobytes()
    n = len(b) // 4
    octets = np.zeros((4, -(-n // 8) * 8), np.uint8)
    octets[:, :n] = np.frombuffer(b, np.uint8).reshape(n, 4).T
    squares = _turned(octets.view("<u8")).view(np.uint8)
    return n.to_bytes(4, "little") + squares.reshape(4, -(-n // 8), 8).transpose(0, 2, 1).tobytes()


#: name -> (encode, decode), bytes to bytes.  ``register_codec`` adds one.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "none": (bytes, bytes),
    **{f"zstd_{level}": _zstd(level) for level in (1, 2, 3, 5, 9, 15, 19, 22)},
    "zlib_6": (lambda b: zlib.compress(b, 6), zlib.decompress),
    "gzip_6": (lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress),
    "bzip2_6": (lambda b: bz2.compress(b, 6), bz2.decompress),
    "lzma": (lzma.compress, lzma.decompress),
    "lz4": _arrow("lz4_raw"),
    "snappy": _arrow("snappy"),
}


def register_codec(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> None:
    """Make a codec known; its functions must be picklable to reach the tasks."""
    CODECS[name] = (encode, decode)


def _filtered(name: str, shuffle: Callable) -> None:
    encode, decode = CODECS[name]
    kind = "bitshuffle" if shuffle is bit_shuffle else "shuffle"
    register_codec(f"{name}_{kind}", lambda b: encode(shuffle(b)), lambda b: shuffle(decode(b), undo=True))


for _name, _shuffle in (("zstd_5", byte_shuffle), ("zstd_5", bit_shuffle), ("lz4", bit_shuffle), ("lz4", byte_shuffle), ("zlib_6", byte_shuffle), ("gzip_6", byte_shuffle)):
    _filtered(_name, _shuffle)


def codec_names(wanted: str | Sequence[str]) -> list[str]:
    """``all`` or some names; an error for unknown ones."""
    names = list(CODECS) if wanted == "all" else [wanted] if isinstance(wanted, str) else list(wanted)
    if unknown := sorted(set(names) - set(CODECS)):
        raise ValueError(f"unknown codecs: {', '.join(unknown)}")
    return names


def parse_chunk(text: str) -> tuple[int, int, int]:
    """``t,y,x`` as three positive numbers."""
    try:
        parts = tuple(int(p) for p in text.split(","))
    except ValueError:
        parts = ()
    if len(parts) != 3 or min(parts) < 1:
        raise ValueError(f"a chunk is three positive numbers t,y,x, not {text!r}")
    return parts


def _region_order(shape: tuple[int, ...]) -> np.ndarray:
    """The permutation that stores regions one after another."""
    t, y, x = (axis.ravel() == 0 for axis in np.indices(shape))
    rank = np.array([0, 3, 2, 6, 1, 5, 4, 7])[t * 4 + y * 2 + x]
    return np.argsort(rank, kind="stable")


def _delta(flat: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    out = flat.reshape(shape)
    for axis in range(out.ndim):
        out = np.diff(out, axis=axis, prepend=np.uint32(0))
    return out.ravel()


def _undo_delta(flat: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    out = flat.reshape(shape)
    for axis in range(out.ndim):
        out = np.cumsum(out, axis=axis, dtype=np.uint32)
    return out.ravel()


def _undo_reorder(flat: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    out = np.empty_like(flat)
    out[_region_order(shape)] = flat
    return out


#: step -> (forward, backward), from flat words and their block's shape to flat words.
_STEPS = {
    "delta": (_delta, _undo_delta),
    "zigzag": (
        lambda w, _: (w << np.uint32(1)) ^ (np.uint32(0) - (w >> np.uint32(31))),
        lambda w, _: (w >> np.uint32(1)) ^ (np.uint32(0) - (w & np.uint32(1))),
    ),
    "reorder": (lambda w, shape: w[_region_order(shape)], _undo_reorder),
}


def encode_words(words: np.ndarray, mode: Sequence[str]) -> bytes:
    """A chunk of uint32 words through a mode's steps."""
    flat = words.ravel()
    for step in mode:
        if step != PLANES:
            flat = _STEPS[step][0](flat, words.shape)
    return bit_shuffle(flat.tobytes()) if PLANES in mode else flat.tobytes()


def decode_words(coded: bytes, shape: tuple[int, ...], mode: Sequence[str]) -> np.ndarray:
    flat = np.frombuffer(bit_shuffle(coded, undo=True) if PLANES in mode else coded, "<u4")
    for step in reversed(mode):
        if step != PLANES:
            flat = _STEPS[step][1](flat, shape)
    return flat.reshape(shape)


def _words(r: dict) -> np.ndarray:
    return np.frombuffer(r["data"], "<u4").reshape(r["nt"], r["ny"], r["nx"])


BLOCK = "ct int, cy int, cx int, nt int, ny int, nx int, data binary"


def to_blocks(cells: DataFrame, chunk: Sequence[int] = CHUNK) -> DataFrame:
    """Cells (t, y, x, v) as blocks of float32 bytes; an error if a block has holes."""

    def run(table: pa.Table) -> pa.Table:
        axes = [np.asarray(table.column(a)) for a in "tyx"]
        shape = [int(a.max() - a.min()) + 1 for a in axes]
        if table.num_rows != np.prod(shape):
            raise ValueError(f"a block of shape {shape} has {table.num_rows} cells")
        block = np.empty(shape, "<f4")
        block[tuple(a - a.min() for a in axes)] = np.asarray(table.column("v"))
        sides = {f"n{a}": pa.array([n], pa.int32()) for a, n in zip("tyx", shape, strict=True)}
        return pa.table({**{f"c{a}": table.column(f"c{a}")[:1] for a in "tyx"}, **sides, "data": pa.array([block.tobytes()], pa.binary())})

    return with_chunk(cells, chunk).groupBy("ct", "cy", "cx").applyInArrow(run, BLOCK)


def bands_to_blocks(strips: DataFrame, chunk: Sequence[int] = CHUNK) -> DataFrame:
    """Row bands (``bands.BAND``) as blocks, without a row per cell: each strip is cut at
    the chunks' edges, and one exchange brings the packed pieces of a chunk together."""
    kt, ky, kx = chunk

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                strip = np.frombuffer(r["data"], "<f4").reshape(-1, r["nx"])[r["halo"] :]
                rows = []
                for cy in range(r["y0"] // ky, (r["y0"] + len(strip) - 1) // ky + 1):
                    top = max(r["y0"], cy * ky)
                    part = strip[top - r["y0"] : (cy + 1) * ky - r["y0"]]
                    for cx in range(-(-r["nx"] // kx)):
                        piece = part[:, cx * kx : (cx + 1) * kx]
                        rows.append((r["t"] // kt, cy, cx, r["t"], top, *piece.shape, piece.tobytes()))
                kinds = [*[pa.int32()] * 7, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["ct", "cy", "cx", "t", "y0", "ny", "nx", "data"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("y0", "ascending")])
        t, ny = (np.asarray(table.column(c)) for c in ("t", "ny"))
        nt, nx = int(t.max() - t.min()) + 1, table.column("nx")[0].as_py()
        rows = int(ny[t == t[0]].sum())
        if len(np.unique(t)) != nt or int(ny.sum()) != nt * rows:
            raise ValueError(f"a block of shape {[nt, rows, nx]} has {int(ny.sum())} rows")
        sides = {n: pa.array([v], pa.int32()) for n, v in (("nt", nt), ("ny", rows), ("nx", nx))}
        return pa.table({**{c: table.column(c)[:1] for c in ("ct", "cy", "cx")}, **sides, "data": pa.array([b"".join(table.column("data").to_pylist())], pa.binary())})

    pieces = strips.mapInArrow(cut, "ct int, cy int, cx int, t int, y0 int, ny int, nx int, data binary")
    return pieces.groupBy("ct", "cy", "cx").applyInArrow(joined, BLOCK)


def from_blocks(blocks: DataFrame, chunk: Sequence[int] = CHUNK) -> DataFrame:
    """The cells (t, y, x, v) of blocks."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["nt"], r["ny"], r["nx"])
                axes = [np.indices(shape)[i].ravel() + r[f"c{a}"] * n for i, (a, n) in enumerate(zip("tyx", chunk, strict=True))]
                yield pa.RecordBatch.from_arrays([*[pa.array(a, pa.int32()) for a in axes], pa.array(np.frombuffer(r["data"], "<f4"), pa.float32())], names=["t", "y", "x", "v"])

    return blocks.mapInArrow(run, "t int, y int, x int, v float")


def encode_blocks(blocks: DataFrame, mode: Sequence[str], codec: str) -> DataFrame:
    """Blocks with data transformed and compressed, and size, their bytes."""
    encode, _ = CODECS[codec_names(codec)[0]]

    def run(batches):
        for batch in batches:
            out = [encode(encode_words(_words(r), mode)) for r in batch.to_pylist()]
            columns = [pa.array(out, pa.binary()) if n == "data" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in out], pa.int64())], names=[*batch.schema.names, "size"])

    return blocks.mapInArrow(run, f"{BLOCK}, size long")


def decode_blocks(stored: DataFrame, mode: Sequence[str], codec: str) -> DataFrame:
    """The blocks again, bit by bit."""
    _, decode = CODECS[codec_names(codec)[0]]

    def run(batches):
        for batch in batches:
            out = [decode_words(decode(r["data"]), (r["nt"], r["ny"], r["nx"]), mode).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "data" else batch.column(n) for n in batch.schema.names if n != "size"], names=[n for n in batch.schema.names if n != "size"])

    return stored.mapInArrow(run, BLOCK)


def write_blocks(blocks: DataFrame, path: str, mode: str, codec: str, save: str = "error") -> None:
    """A table of encoded blocks that says how to decode them: mode and codec are columns."""
    coded = encode_blocks(blocks, MODES[mode], codec)
    coded.withColumns({"mode": F.lit(mode), "codec": F.lit(codec)}).write.mode(save).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a table that ``write_blocks`` wrote, each decoded by its own attributes."""
    known = {name: decode for name, (_, decode) in CODECS.items()}

    def run(batches):
        for batch in batches:
            out = [decode_words(known[r["codec"]](r["data"]), (r["nt"], r["ny"], r["nx"]), MODES[r["mode"]]).tobytes() for r in batch.to_pylist()]
            names = [n for n in batch.schema.names if n not in ("mode", "codec")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "data" else batch.column(n) for n in names], names=names)

    return spark.read.parquet(path).select("ct", "cy", "cx", "nt", "ny", "nx", "data", "mode", "codec").mapInArrow(run, BLOCK)


def codec_records(blocks: DataFrame, modes: Sequence[str] = tuple(MODES), codecs: Sequence[str] = ("zstd_5",)) -> DataFrame:
    """(mode, codec, blocks, raw_bytes, size_bytes, bits_per_value, ratio, mismatches).

    Every block is encoded, decoded again and compared with its source, bit by bit, in
    one pass over the blocks for all modes and codecs; only sizes leave the tasks.
    """
    ways = [(mode, MODES[mode], codec, *CODECS[codec]) for mode in modes for codec in codec_names(codecs)]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = _words(r)
                for mode, steps, codec, encode, decode in ways:
                    coded = encode(encode_words(words, steps))
                    again = decode_words(decode(coded), words.shape, steps)
                    rows.append((mode, codec, len(r["data"]), len(coded), int(again.tobytes() != r["data"])))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["mode", "codec", "raw", "size", "differs"])

    sizes = blocks.mapInArrow(run, "mode string, codec string, raw long, size long, differs long")
    total = sizes.groupBy("mode", "codec").agg(F.count(F.lit(1)).alias("blocks"), F.sum("raw").alias("raw_bytes"), F.sum("size").alias("size_bytes"), F.sum("differs").alias("mismatches"))
    return total.withColumns({"bits_per_value": F.col("size_bytes") * 32.0 / F.col("raw_bytes"), "ratio": F.col("raw_bytes") / F.col("size_bytes")})


def best_mode(records: DataFrame) -> DataFrame:
    """The delta mode with the least mean bits per value; the first by name among equals."""
    means = records.where(F.col("mode").startswith("delta")).groupBy("mode").agg(F.avg("bits_per_value").alias("mean_bits"))
    return means.orderBy("mean_bits", "mode").limit(1)


def boundary_percent(chunk: Sequence[int]) -> float:
    """The percentage of a chunk's cells that lie on a boundary face."""
    inside = whole = 1.0
    for c in chunk:
        inside, whole = inside * (c - 1), whole * c
    return 100.0 * (1.0 - inside / whole)
