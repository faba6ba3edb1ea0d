"""Operators on hand-made and random cells, against NumPy."""

import io
import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.functions import bits, packing
from gridloom.operators import bands, blocks, delta, dist, fit, planes, stencil
from gridloom.sources import grib, grids, tables, tiff

HAND = np.array([[[10, 12], [15, 20]], [[11, 13], [18, 30]]])


def cells(spark, array, name="w", kind="long"):
    rows = [(*map(int, i), array[i].item()) for i in np.ndindex(array.shape)]
    return spark.createDataFrame(rows, f"t int, y int, x int, {name} {kind}")


def dense(df, name, shape):
    out = np.zeros(shape, np.float64 if name in ("v", "back") else np.int64)
    for r in df.select("t", "y", "x", name).collect():
        out[r.t, r.y, r.x] = r[name]
    return out


def np_delta(a):
    for axis in range(3):
        a = np.diff(a, axis=axis, prepend=0)
    return a


def test_float_bits_of_special_and_random_values(spark):
    special = [0.0, -0.0, 1.5, -1.5, 256.0, 261.99053955078125, 2.0**-126, 2.0**-127, 2.0**-149, -(2.0**-149), 3.4028234663852886e38, math.inf, -math.inf]
    rng = np.random.default_rng(1)
    random = rng.integers(0, 2**32, 4000, dtype=np.uint32).view(np.float32)
    edges = np.nextafter(np.float32(2.0) ** np.arange(-125, 127, dtype=np.float32), np.float32(0))
    values = np.concatenate([np.array(special, np.float32), random[~np.isnan(random)], edges])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", F.col("v").cast("float").alias("v"))
    got = df.select("i", bits.float_bits(F.col("v")).alias("w")).withColumn("back", bits.float_bits(bits.bits_float(F.col("w")))).orderBy("i").toPandas()
    assert got["w"].tolist() == values.view(np.uint32).tolist() == got["back"].tolist()
    assert [r.w for r in bits.with_float_bits(df).orderBy("i").collect()] == got["w"].tolist()
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v float").select(bits.float_bits(F.col("v")).alias("w")).collect()
    assert [r.w for r in odd] == [0x7FC00000, None]


def test_zigzag_vectors(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2147483647, 4294967294), (2147483648, 4294967295), (4294967295, 1)], "w long, z long")
    got = df.select("*", bits.zigzag32(F.col("w")).alias("a"), bits.unzigzag32(F.col("z")).alias("b"), bits.bit_width(F.col("w")).alias("n")).collect()
    assert all(r.a == r.z and r.b == r.w and r.n == r.w.bit_length() for r in got)


def test_hand_checked_difference(spark):
    got = dense(delta.delta3d(cells(spark, HAND)), "d", HAND.shape)
    assert got.tolist() == [[[10, 2], [5, 3]], [[1, 0], [2, 7]]]


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 3, 2), (4, 1, 3), (5, 7, 11)])
def test_differences_invert(spark, shape):
    rng = np.random.default_rng(2311)
    a = rng.integers(0, 2**32, shape, dtype=np.int64)
    d = delta.delta3d(cells(spark, a))
    assert (dense(d, "d", shape) == np_delta(a)).all()
    assert (dense(delta.undelta3d(d, to="back"), "back", shape) == a).all()
    chunked = delta.delta3d_chunks(cells(spark, a), (2, 3, 4))
    assert (dense(delta.undelta3d_chunks(chunked, to="back"), "back", shape) == a).all()


def test_empty_grid(spark):
    empty = spark.createDataFrame([], "t int, y int, x int, w long")
    assert delta.delta3d(empty).count() == 0
    assert dist.quantiles(dist.frequencies(empty, "w")).count() == 0


def test_naive_diff_blocks(spark):
    a = np.arange(7, dtype=np.float32).reshape(7, 1, 1) ** 2
    df = delta.naive_diff(cells(spark, a, "v", "double").withColumn("v", F.col("v").cast("float")), 3)
    assert [(r.kind, r["diff"]) for r in df.orderBy("t").collect()] == [("key", 0), ("diff", 1), ("diff", 3), ("key", 9), ("diff", 7), ("diff", 9), ("key", 36)]
    assert df.join(delta.naive_undiff(df, to="back"), ["t", "y", "x"]).where("back <> t * t").count() == 0
    with pytest.raises(ValueError):
        delta.naive_diff(df, 1)


def test_stencil_corners(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(256, 3, (3, 4, 5)).astype(np.float32)
    w = a.view(np.uint32).astype(np.int64)
    both = cells(spark, w).join(cells(spark, a, "v", "double").withColumn("v", F.col("v").cast("float")), ["t", "y", "x"])
    got = stencil.geometry(stencil.stencils(both, "v", "w")).withColumn("d", stencil.difference("w"))
    rows = {(r.t, r.y, r.x): r for r in got.collect()}
    assert len(rows) == 2 * 3 * 4
    d = np_delta(w)
    for (t, y, x), r in rows.items():
        cube = a[t - 1 : t + 1, y - 1 : y + 1, x - 1 : x + 1]
        assert r.d == d[t, y, x] and r.low == cube.min() and r.high == cube.max()
        assert r.nearest == np.abs(cube - np.float32(256)).min()
    cross = lambda part: bool(part.min() < 256 <= part.max())
    want = {k: 0 for k in stencil.CATEGORIES}
    for t, y, x in rows:
        cube = a[t - 1 : t + 1, y - 1 : y + 1, x - 1 : x + 1]
        before, now, any_ = cross(cube[0]), cross(cube[1]), cross(cube)
        for k, here in zip(want, (not before and not now, before and not now, now and not before, before and now, before or now, any_, any_ and not (before or now)), strict=True):
            want[k] += here
    counts = stencil.category_counts(got, F.col("t") == 1)
    assert {r.category: r.n for r in counts.collect()} == want and {r.category: r.bad for r in counts.collect()} != want


def test_quantile_rule_and_moments(spark):
    d = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "value long, n long")
    assert {r.p: r.value for r in dist.quantiles(d).collect()}[0.5] == 3
    m = dist.moments(spark.createDataFrame([(1, 1), (2, 1), (9, 1), (4, 1)], "value long, n long")).first()
    assert round(m.skewness, 3) == 0.768 and round(m.kurtosis, 3) == -1.0


def test_ranks_and_percentiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    values, counts = np.unique(np.rint(rng.standard_cauchy(4000) * 300).astype(np.int64), return_counts=True)
    df = spark.createDataFrame(list(zip(values.tolist(), counts.tolist(), ["k"] * len(values), strict=True)), "value long, n long, k string").repartition(3)
    got = dist.ranked(df, "k").orderBy("value").collect()
    assert [r.upto for r in got] == np.cumsum(counts).tolist() and {r.total for r in got} == {4000}
    assert [r.before for r in got] == [None, *values[:-1].tolist()]
    buckets = [r.b for r in df.select("value", dist.bucket(F.col("value")).alias("b")).orderBy("value").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 500
    real = rng.normal(0, 3, 999)
    rows = spark.createDataFrame([(float(v),) for v in [*real, real[0], real[0]]], "v double").repartition(3)
    found = {r.p: r.value for r in dist.percentiles(rows, "v").collect()}
    assert all(found[p] == pytest.approx(np.quantile([*real, real[0], real[0]], p), rel=1e-12) for p in dist.PROBABILITIES) and len(found) == 7
    one = {r.value for r in dist.percentiles(spark.createDataFrame([(2.5,)], "v double"), "v").collect()}
    assert one == {2.5} and dist.percentiles(rows.limit(0), "v").count() == 0


def test_fits_against_the_dense_range(spark):
    rng = np.random.default_rng(5)
    values, counts = np.unique(np.rint(rng.normal(3, 20, 3000)).astype(int) * 3, return_counts=True)
    df = spark.createDataFrame(list(zip(values.tolist(), counts.tolist(), strict=True)), "value long, n long")
    full = np.arange(values[0], values[-1] + 1)
    mass = np.zeros(len(full))
    mass[values - values[0]] = counts / counts.sum()
    mean = (values * counts).sum() / counts.sum()
    sd = math.sqrt((counts * (values - mean) ** 2).sum() / counts.sum())
    cdf = lambda x: np.array([0.5 * (1 + math.erf((v - mean) / sd / math.sqrt(2))) for v in x])
    low, high, upto = cdf(full - 0.5), cdf(full + 0.5), np.cumsum(mass)
    ks = max(np.abs(upto - high).max(), np.abs(upto - mass - low).max())
    tv = 0.5 * (np.abs(mass - (high - low)).sum() + low[0] + 1 - high[-1])
    got = fit.normal_fit(df).first()
    assert got.ks == pytest.approx(ks) and got.total_variation == pytest.approx(tv)
    sizes = {}
    for v, c in zip(values, counts, strict=True):
        if v:
            sizes[abs(v)] = sizes.get(abs(v), 0) + c
    n = sum(sizes.values())
    mean = sum(c * math.log(v) for v, c in sizes.items()) / n
    sd = math.sqrt(sum(c * (math.log(v) - mean) ** 2 for v, c in sizes.items()) / n)
    full = np.arange(1, max(sizes) + 1)
    mass = np.array([sizes.get(v, 0) / n for v in full])
    low, high, upto = cdf(np.log(np.maximum(full - 0.5, 0.5))), cdf(np.log(full + 0.5)), np.cumsum(mass)
    got = fit.lognormal_fit(df).first()
    assert got.ks == pytest.approx(max(np.abs(upto - high).max(), np.abs(upto - mass - low).max()))
    assert got.total_variation == pytest.approx(0.5 * (np.abs(mass - (high - low)).sum() + low[0] + 1 - high[-1]))


@pytest.mark.parametrize("mode", blocks.MODES.values(), ids="+".join)
def test_modes_and_codecs_round_trip(mode):
    rng = np.random.default_rng(2311)
    cases = [rng.integers(0, 2**32, (5, 7, 11), dtype=np.uint32), np.array([0, 1, 2**31 - 1, 2**31, 2**32 - 1], np.uint32).reshape(1, 1, 5)]
    for words in cases:
        coded = blocks.encode_words(words, mode)
        assert (blocks.decode_words(coded, words.shape, mode) == words).all()
        for encode, decode in blocks.CODECS.values():
            assert decode(encode(coded)) == coded or len(coded) % 4


@pytest.mark.parametrize("n", [0, 1, 8, 77])
def test_bit_shuffle_against_packed_bits(n):
    w = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    want = b"".join(np.packbits((w >> np.uint32(bit)).astype(np.uint8) & 1, bitorder="little").tobytes() for bit in range(32))
    assert blocks.bit_shuffle(w.tobytes()) == n.to_bytes(4, "little") + want
    assert blocks.bit_shuffle(blocks.bit_shuffle(w.tobytes()), undo=True) == w.tobytes()


def test_block_order_matches_cell_order(spark):
    a = np.arange(3 * 4 * 5, dtype=np.uint32).reshape(3, 4, 5)
    placed = delta.chunk_order(cells(spark, a.astype(np.int64)), (3, 4, 5)).orderBy("place").collect()
    assert [r.w for r in placed] == np.frombuffer(blocks.encode_words(a, ["reorder"]), np.uint32).tolist()


def test_blocks_refuse_holes(spark):
    df = cells(spark, np.zeros((2, 2, 2), np.float32), "v", "double").withColumn("v", F.col("v").cast("float")).where("t + y + x < 3")
    with pytest.raises(PySparkException):
        blocks.to_blocks(df, (2, 2, 2)).collect()


def test_names_and_chunks():
    assert blocks.parse_chunk("24,128,256") == (24, 128, 256)
    for bad in ("1,2", "0,1,1", "a,b,c"):
        with pytest.raises(ValueError):
            blocks.parse_chunk(bad)
    with pytest.raises(ValueError):
        blocks.codec_names(["zstd_1", "nothing"])
    assert round(blocks.boundary_percent((24, 128, 256)), 3) == 5.287


def test_planes_round_trip(spark):
    rng = np.random.default_rng(7)
    w = rng.integers(0, 2**32, 77, dtype=np.uint32)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(w)], "position long, w long")
    got = planes.unpacked_pieces(planes.plane_pieces(df, piece=3), piece=3).toPandas()
    for bit in range(32):
        packed = np.packbits((w >> np.uint32(bit)) & np.uint32(1), bitorder="little")
        assert got[got.bit == bit].sort_values("byte_idx")["byte"].tolist() == packed.tolist()


def test_packing(spark):
    row = spark.range(1).select(packing.q16(F.lit(200.5)).alias("q"), packing.human_bytes(F.lit(1536)).alias("h"), packing.compression_ratio(F.lit(8), F.lit(None).cast("long")).alias("r")).first()
    assert (row.q, row.h, row.r) == (200 * 65536 + 32768, "1.50 KiB", None)
    with pytest.raises(PySparkException):
        spark.range(1).select(packing.q16(F.lit(0.1)).alias("q")).collect()


@pytest.mark.parametrize("compression,predictor", list(itertools.product((1, 5, 8), (1, 2))))
def test_tiff_reader_variants(compression, predictor):
    import zlib

    frame = np.arange(6 * 5, dtype="<u4").reshape(6, 5)
    stored = np.diff(frame, axis=1, prepend=np.uint32(0)) if predictor == 2 else frame
    raw = stored.astype("<u4").tobytes()
    body = {1: raw, 8: zlib.compress(raw), 5: lzw(raw)}[compression]
    entries = [(256, 4, 5), (257, 4, 6), (258, 3, 32), (259, 3, compression), (273, 4, 8), (277, 3, 1), (278, 4, 6), (279, 4, len(body)), (317, 3, predictor), (339, 3, 1)]
    out = io.BytesIO()
    out.write(struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(entries)))
    for tag, kind, value in entries:
        out.write(struct.pack("<HHII", tag, kind, 1, value))
    out.write(struct.pack("<I", 0))
    data = out.getvalue()
    assert (tiff.Tiff(data).frame(strict=False) == frame).all()
    with pytest.raises(ValueError):
        tiff.Tiff(data).frame()


def lzw(data):
    """A plain encoder for the reader's test."""
    table, width = {bytes([i]): i for i in range(256)}, 9
    bits_, word = [(256, 9)], b""
    for b in data:
        nxt = word + bytes([b])
        if nxt in table:
            word = nxt
            continue
        bits_.append((table[word], width))
        table[nxt] = len(table) + 2
        width = 9 + sum(len(table) + 2 >= 1 << w for w in (9, 10, 11))
        word = bytes([b])
    if word:
        bits_.append((table[word], width))
    bits_.append((257, width))
    text = "".join(f"{c:0{n}b}" for c, n in bits_)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_tiff_folder(spark, tmp_path):
    frames = np.random.default_rng(1).normal(size=(3, 20, 30)).astype(np.float32)
    for t, f in enumerate(frames):
        (tmp_path / f"{t:02d}.TIF{'F' * (t % 2)}").write_bytes(tiff.write_frame(f, "x", tile=16))
    (tmp_path / "note.tiff.bak").write_text("no")
    files = tiff.tiff_files(spark, str(tmp_path))
    assert (dense(tiff.read_grid(files), "v", frames.shape) == frames).all()
    assert tiff.tiff_files(spark, str(tmp_path), limit=2).count() == 2
    assert tiff.byte_counts(tiff.tiff_tags(files)).where("pieces = 4 AND total >= max").count() == 3
    with pytest.raises(ValueError):
        tiff.tiff_files(spark, str(tmp_path), limit=0)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        tiff.tiff_files(spark, str(tmp_path / "empty"))


def test_grib_messages(spark, tmp_path):
    x = np.arange(12).reshape(3, 4)
    (tmp_path / "a.grib").write_bytes(b"junk" + grib.write_message(x, 200.5, 20260501, 600) + grib.write_message(x + 1, 201.25, 20260501, 1200))
    read = grib.read_messages(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = read.orderBy("message").collect()
    assert [(r.reference, r.data_date, r.data_time, r.ni, r.nj, r.first_lat, r.last_lat, r.binary_scale) for r in rows] == [(200.5, 20260501, 600, 4, 3, 90.0, -90.0, -9), (201.25, 20260501, 1200, 4, 3, 90.0, -90.0, -9)]
    assert {(r.message, r.y, r.x): r.packed for r in grib.unpack_messages(read).collect()} == {(m, y, c): int(x[y, c]) + m - 1 for m in (1, 2) for y in range(3) for c in range(4)}
    counts = grib.metadata_counts(read).first()
    assert (counts.n, counts.times) == (2, 2)
    assert grib.read_messages(spark.read.format("binaryFile").load(str(tmp_path)), start=2, limit=1).count() == 1


def test_histogram_files(spark, tmp_path):
    d = spark.createDataFrame([(-128, 2), (-5, 1), (64, 3)], "value long, n long")
    tables.write_histogram(d, str(tmp_path / "h"))
    assert sorted(map(tuple, tables.read_histogram(spark, str(tmp_path / "h")).collect())) == [(-128, 2), (-5, 1), (64, 3)]
    assert sorted(map(tuple, tables.read_histogram(spark, str(tmp_path / "h"), 64).collect())) == [(-2, 2), (1, 3)]
    with pytest.raises(PySparkException):
        tables.write_histogram(d, str(tmp_path / "h"))
    assert tables.stored_bytes(spark, str(tmp_path / "h")) > 0
    assert "| value | n |" in tables.markdown(d)
    tables.write_summary(d, str(tmp_path / "s"))
    assert tables.read_summary(spark, str(tmp_path / "s")).count() == 3


@pytest.mark.parametrize("shape", [(5, 7, 11), (1, 3, 4), (4, 1, 1)])
def test_stored_order_gives_cells_again(spark, shape):
    a = np.arange(np.prod(shape)).reshape(shape)
    stored = delta.chunk_order(cells(spark, a), (2, 3, 4)).select("ct", "cy", "cx", "place", "w")
    assert (dense(delta.chunk_cells(stored, shape, (2, 3, 4)), "w", shape) == a).all()


@pytest.mark.parametrize("rows", [1, 3, 4, 64])
def test_blocks_from_bands_and_from_cells(spark, rows):
    a = np.random.default_rng(5).normal(size=(5, 10, 11)).astype(np.float32)
    df = cells(spark, a, "v", "double").withColumn("v", F.col("v").cast("float"))
    key = lambda r: tuple(r)[:3]
    want = sorted(blocks.to_blocks(df, (2, 4, 4)).collect(), key=key)
    assert sorted(blocks.bands_to_blocks(bands.to_bands(df, rows), (2, 4, 4)).collect(), key=key) == want
    with pytest.raises(PySparkException):
        blocks.bands_to_blocks(bands.to_bands(df, rows).where("t <> 1 OR y0 > 0"), (3, 4, 4)).collect()


def test_generated_field_counts(spark):
    strips = grids.field_bands(spark, 3, 70, 8)
    got = {tuple(r) for r in bands.delta3d_counts(strips).collect()}
    v = blocks.from_blocks(blocks.bands_to_blocks(strips, (2, 64, 8)), (2, 64, 8))
    d = delta.delta3d(delta.words(v)).withColumn("region", delta.region(F.col("t"), F.col("y"), F.col("x")))
    assert got == {tuple(r) for r in dist.frequencies(d, "d", "region").collect()}


def test_tag_meanings(spark):
    tags = spark.createDataFrame([("Compression", ["5"]), ("Compression", ["77"]), ("ImageWidth", ["5"]), ("Predictor", [])], "name string, value array<string>")
    assert [r.meaning for r in tiff.named_values(tags).collect()] == ["LZW", "77", None, None]


def test_grib_steps_and_parameters(spark):
    message = bytearray(grib.write_message(np.arange(12).reshape(3, 4), 200.5, 20260501, 600))
    message[8 + 17 : 8 + 21] = bytes([1, 6, 9, 4])  # accumulated from hour 6 to hour 9
    files = spark.createDataFrame([("a", bytes(message))], "path string, content binary")
    read = grib.read_messages(files)
    named = grib.with_parameters(read, spark.createDataFrame([(1, 98, 167, "2t", "K")], "edition long, centre long, param long, short_name string, units string"))
    r = named.withColumn("valid", grib.validity_time(named)).first()
    assert (r.step_start, r.step_end, str(r.valid), r.short_name, r.units) == (21600, 32400, "2026-05-01 15:00:00", "2t", "K")
    assert (r.grid, r.i_increment, r.j_increment, r.i_negative, r.j_positive, r.j_consecutive) == (0, 0.25, 0.25, False, False, False)
    assert grib._steps({1: bytes(message[8:36])[:17] + bytes([3, 6, 9, 0])}, 1) == {"step_start": None, "step_end": None}
