"""The registered queries: each applies operators to a test grid or table, whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, packing
from ..operators import bands, blocks, delta, dist, fit, planes, records, stencil
from ..sources import grib, grids, tables, tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Chunk of the test grids.
CHUNK = (24, 4, 5)
NAIVE_BLOCK = 6
SEED = 2311


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def sig9(c) -> F.Column:
    """A double at nine significant digits: sums in another order agree."""
    return F.format_string("%.8e", c).cast("double")


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.smooth_cells(spark, sf_dir)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.words(_smooth(spark, sf_dir))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.delta3d(_words(spark, sf_dir))


_INSIDE = "t > 0 AND y > 0 AND x > 0"


def _interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution (value, n) of interior differences."""
    return dist.frequencies(_deltas(spark, sf_dir).where(_INSIDE), "d")


def _regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _deltas(spark, sf_dir).withColumn("region", delta.region(F.col("t"), F.col("y"), F.col("x")))
    return dist.frequencies(cells, "d", "region")


@query
def grid_pack_cells(spark, sf_dir):
    return grids.packed_cells(spark, sf_dir).select("t", "y", "x", "packed", "v")


@query
def float_bits(spark, sf_dir):
    return _words(spark, sf_dir)


@query
def float_bits_embeddings(spark, sf_dir):
    return delta.words(grids.embedding_cells(spark, sf_dir))


@query
def bits_roundtrip(spark, sf_dir):
    cells = grids.embedding_cells(spark, sf_dir).withColumn("w", bits.float_bits(F.col("v")))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(bits.bits_float(F.col("w")) != F.col("v")).alias("mismatches"))


@query
def zigzag(spark, sf_dir):
    return _interior(spark, sf_dir).select("value", bits.zigzag(F.col("value")).alias("zigzag"))


@query
def zigzag32(spark, sf_dir):
    return delta.delta3d_chunks(_words(spark, sf_dir), CHUNK).select("t", "y", "x", bits.zigzag32(F.col("d")).alias("zigzag"))


@query
def unzigzag32(spark, sf_dir):
    d = delta.delta3d_chunks(_words(spark, sf_dir), CHUNK)
    back = bits.unzigzag32(bits.zigzag32(F.col("d")))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(back).alias("total"), F.count_if(back != F.col("d")).alias("mismatches"))


@query
def bit_width_hist(spark, sf_dir):
    return dist.width_histogram(_interior(spark, sf_dir))


@query
def ieee_planes_ones(spark, sf_dir):
    return planes.plane_ones(_words(spark, sf_dir))


def _placed(spark, sf_dir):
    place = planes.position(F.col("t"), F.col("y"), F.col("x"), grids.ROWS, grids.COLUMNS)
    return _words(spark, sf_dir).select(place.alias("position"), "w")


@query
def packbits_bytes(spark, sf_dir):
    return planes.packed_planes(_placed(spark, sf_dir))


@query
def plane_bits(spark, sf_dir):
    return planes.plane_bits(_placed(spark, sf_dir)).groupBy("bit", "on").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"))


@query
def byte_planes(spark, sf_dir):
    return _words(spark, sf_dir).select("t", "y", "x", *[bits.byte_of(F.col("w"), i).alias(f"b{i}") for i in range(4)])


@query
def mask_low_bits(spark, sf_dir):
    w = F.col("w")
    return _words(spark, sf_dir).select("t", "y", "x", bits.cut_low(w, 7).alias("cut7"), bits.cut_low(w, 6).alias("cut6"), bits.low_bits(w, 7).alias("low7"), bits.low_bits(w, 6).alias("low6"))


@query
def delta_t(spark, sf_dir):
    return delta.delta_t(_words(spark, sf_dir)).select("t", "y", "x", "d")


@query
def mixed2d(spark, sf_dir):
    return delta.mixed2d(_words(spark, sf_dir)).select("t", "y", "x", "d")


@query
def delta3d_hist(spark, sf_dir):
    return _interior(spark, sf_dir)


@query
def delta3d_regions(spark, sf_dir):
    return _regional(spark, sf_dir)


@query
def delta3d_regions_bands(spark, sf_dir):
    """The same distributions over row bands instead of cells."""
    return bands.delta3d_counts(bands.to_bands(_smooth(spark, sf_dir), rows=3))


@query
def tiff_delta3d_regions(spark, sf_dir):
    """The same distributions from the frames as TIFF files, by row bands."""
    return bands.delta3d_counts(tiff.read_bands(tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16), rows=5))


@query
def region_counts_check(spark, sf_dir):
    seen = dist.merged(_regional(spark, sf_dir).withColumn("value", F.lit(0)), "region").select("region", "n")
    nt, ny, nx = grids.FRAMES, grids.ROWS, grids.COLUMNS
    sizes = {
        "interior": (nt - 1) * (ny - 1) * (nx - 1), "t0_face": (ny - 1) * (nx - 1), "lat0_face": (nt - 1) * (nx - 1), "lon0_face": (nt - 1) * (ny - 1),
        "t0_lat0_edge": nx - 1, "t0_lon0_edge": ny - 1, "lat0_lon0_edge": nt - 1, "vertex": 1,
    }
    expected = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("region"))
    return seen.select("region", "n", expected.cast("long").alias("expected"), (F.col("n") == expected).alias("agrees"))


@query
def planes_edges_merge(spark, sf_dir):
    grouped = _regional(spark, sf_dir).withColumn("region_group", delta.region_group(F.col("region"))).where("region_group IS NOT NULL")
    return dist.merged(grouped, "region_group")


@query
def inverse_delta_mismatch(spark, sf_dir):
    back = delta.undelta3d(_deltas(spark, sf_dir), to="back")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("back").alias("total"), F.count_if(F.col("back") != F.col("w")).alias("mismatches"))


@query
def delta3d_mod_chunk(spark, sf_dir):
    return delta.delta3d_chunks(_words(spark, sf_dir), CHUNK).select("t", "y", "x", "ct", "cy", "cx", "d")


@query
def inverse_mod_chunk_mismatch(spark, sf_dir):
    back = delta.undelta3d_chunks(delta.delta3d_chunks(_words(spark, sf_dir), CHUNK), to="back")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("back").alias("total"), F.count_if(F.col("back") != F.col("w")).alias("mismatches"))


@query
def region_reorder(spark, sf_dir):
    return delta.chunk_order(_words(spark, sf_dir), CHUNK).select("t", "y", "x", "region", "place")


@query
def reorder_roundtrip(spark, sf_dir):
    """Words in stored order, without their coordinates, put back where they were."""
    stored = delta.chunk_order(_words(spark, sf_dir), CHUNK).select("ct", "cy", "cx", "place", F.col("w").alias("stored"))
    cells = delta.chunk_cells(stored, (grids.FRAMES, grids.ROWS, grids.COLUMNS), CHUNK)
    back = cells.join(_words(spark, sf_dir), ["t", "y", "x"])
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stored") != F.col("w")).alias("mismatches"))


@query
def dist_summary(spark, sf_dir):
    s = dist.summary(_regional(spark, sf_dir), "region")
    rounded = ("mean", "sd", "entropy", "multiple_64", "multiple_128", "zero_fraction")
    return s.select("region", *[sig9(F.col(c)).alias(c) if c in rounded else F.col(c) for c in s.columns if c != "region"])


@query
def dist_entropy(spark, sf_dir):
    return dist.entropy(_regional(spark, sf_dir), "region").select("region", "count", F.round("entropy", 9).alias("entropy"))


@query
def weighted_entropy(spark, sf_dir):
    merged = _regional(spark, sf_dir).withColumn("part", F.coalesce(delta.region_group(F.col("region")), F.col("region")))
    parts = dist.entropy(dist.merged(merged, "part"), "part")
    return dist.weighted_entropy(parts).select(F.round("entropy", 9).alias("entropy"))


@query
def dist_quantiles(spark, sf_dir):
    return dist.quantiles(_regional(spark, sf_dir), "region")


@query
def interp_percentiles(spark, sf_dir):
    cells = _geometry(spark, sf_dir).where(_BAD)
    near, span = (dist.percentiles(cells, c).withColumnRenamed("value", n) for n, c in (("nearest", F.col("nearest")), ("span", F.col("high") - F.col("low"))))
    place = F.array_position(F.array(*[F.lit(p) for p in dist.PROBABILITIES]), F.col("p")).cast("int") - 1
    return near.join(span, "p").select(place.alias("i"), F.round("nearest", 8).alias("nearest"), F.round("span", 8).alias("span"))


@query
def top_values(spark, sf_dir):
    return dist.top_values(_interior(spark, sf_dir), 20)


@query
def width_cdf(spark, sf_dir):
    return dist.width_cdf(_interior(spark, sf_dir)).select("width", "n", sig9(F.col("share")).alias("share"))


@query
def histogram_multiples(spark, sf_dir):
    return _interior(spark, sf_dir).where(F.pmod("value", F.lit(64)) == 0).select(F.expr("value div 64").alias("value"), "n")


@query
def naive_diff(spark, sf_dir):
    return delta.naive_diff(_smooth(spark, sf_dir), NAIVE_BLOCK).select("t", "y", "x", "block", "kind", F.col("diff").cast("double").alias("diff"))


@query
def naive_diff_stats(spark, sf_dir):
    d = F.col("diff").cast("double")
    cells = delta.naive_diff(_smooth(spark, sf_dir), NAIVE_BLOCK)
    stats = cells.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.sqrt(F.var_pop(d)).alias("sd"))
    return stats.select("kind", "n", "min", "max", sig9(F.col("mean")).alias("mean"), F.round("sd", 7).alias("sd"))


@query
def naive_diff_inverse_mismatch(spark, sf_dir):
    cells = delta.naive_undiff(delta.naive_diff(_smooth(spark, sf_dir), NAIVE_BLOCK), to="back")
    error = F.abs(F.col("back").cast("double") - F.col("v").cast("double"))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("back") != F.col("v")).alias("mismatches"), F.max(error).alias("max_error"))


@query
def packed_x_delta(spark, sf_dir):
    return dist.frequencies(delta.delta3d(_smooth(spark, sf_dir).select("t", "y", "x", "packed"), "packed").where(_INSIDE), "d")


@query
def q16_lattice_delta(spark, sf_dir):
    cells = _smooth(spark, sf_dir).select("t", "y", "x", packing.lattice(packing.q16(F.col("r") / 65536.0), F.col("packed")).alias("q"))
    return dist.frequencies(delta.delta3d(cells, "q").where(_INSIDE), "d")


@query
def unpack_error(spark, sf_dir):
    cells = _smooth(spark, sf_dir)
    error = F.abs(packing.unpack(F.col("r") / 65536.0, F.col("packed")) - F.col("Q") / 65536.0)
    return cells.agg(F.count(F.lit(1)).alias("n"), F.max(error).alias("max_error"))


@query
def reference_series_delta(spark, sf_dir):
    series = _smooth(spark, sf_dir).groupBy("t").agg(F.min("r").alias("r"))
    return delta.series_delta(series, "r").select("t", "r", "d")


def _tailed(spark, sf_dir):
    return bits.with_float_bits(_smooth(spark, sf_dir).select("t", "y", "x", "v"))


@query
def tail_values(spark, sf_dir):
    return stencil.tails(_tailed(spark, sf_dir))


@query
def tail_uniqueness(spark, sf_dir):
    return stencil.tails(_tailed(spark, sf_dir)).groupBy("side").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("tails") != 1).alias("several"))


@query
def tail_series_delta(spark, sf_dir):
    found = stencil.tails(_tailed(spark, sf_dir))
    d = F.col("tail") - F.lag("tail").over(Window.partitionBy("side").orderBy("t"))
    return found.select("t", "side", "tail", d.alias("d"))


@query
def tail_cut_delta(spark, sf_dir):
    return dist.frequencies(delta.delta3d(stencil.cut_tails(_tailed(spark, sf_dir)), "cut").where(_INSIDE), "d")


@query
def tail_restore_mismatch(spark, sf_dir):
    cells = _tailed(spark, sf_dir)
    back = stencil.restore_tails(stencil.cut_tails(cells), stencil.tails(cells))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("restored") != F.col("w")).alias("mismatches"), F.count_if(F.pmod("cut", F.lit(64)) != 0).alias("not_multiples"))


@query
def threshold_classes(spark, sf_dir):
    return _smooth(spark, sf_dir).groupBy(stencil.threshold_class(F.col("v")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


def _geometry(spark, sf_dir):
    cells = stencil.stencils(_tailed(spark, sf_dir), "v", "w")
    return stencil.geometry(cells).withColumn("d", stencil.difference("w"))


_BAD = "pmod(d, 64) <> 0"


@query
def stencil_minmax(spark, sf_dir):
    return _geometry(spark, sf_dir).select("t", "y", "x", "d", *[F.col(c).cast("double").alias(c) for c in ("low", "high", "nearest")])


@query
def crossing_categories(spark, sf_dir):
    return stencil.category_counts(_geometry(spark, sf_dir), F.expr(_BAD)).select("category", "n")


@query
def non64_by_category(spark, sf_dir):
    return stencil.category_counts(_geometry(spark, sf_dir), F.expr(_BAD)).select("category", "n", "bad", sig9(F.col("rate")).alias("rate"))


@query
def side_class_delta(spark, sf_dir):
    cells = _geometry(spark, sf_dir).withColumn("side", stencil.side_class())
    return dist.frequencies(cells, "d", "side")


@query
def non64_by_lat(spark, sf_dir):
    return _non64_by("y", spark, sf_dir)


@query
def non64_by_time(spark, sf_dir):
    return _non64_by("t", spark, sf_dir)


def _non64_by(axis, spark, sf_dir):
    crosses = stencil.in_category(stencil.crossing_state(), "any_spatial_face_crosses")
    return _geometry(spark, sf_dir).groupBy(axis).agg(F.count_if(F.expr(_BAD)).alias("bad"), F.count_if(crosses).alias("crossing"))


@query
def top_latitudes(spark, sf_dir):
    return non64_by_lat(spark, sf_dir).orderBy(F.desc("bad"), "y").limit(20)


@query
def residue_hist(spark, sf_dir):
    return _geometry(spark, sf_dir).where(_BAD).groupBy(F.pmod("d", F.lit(64)).alias("residue")).agg(F.count(F.lit(1)).alias("n"))


@query
def non64_examples(spark, sf_dir):
    corners = [F.col(f"{c}_v").cast("double").alias(c) for c in stencil.CORNERS]
    middle = ((90.0 - (F.col("y") - 0.5) * 0.25).alias("lat"), ((F.col("x") - 0.5) * 0.25).alias("lon"))
    return _geometry(spark, sf_dir).where(_BAD).orderBy("t", "y", "x").limit(8).select("t", "y", "x", "d", F.pmod("d", F.lit(64)).alias("residue"), *middle, *corners)


@query
def moments(spark, sf_dir):
    m = dist.moments(_interior(spark, sf_dir))
    return m.select("count", *[sig9(F.col(c)).alias(c) for c in ("mean", "sd", "skewness", "kurtosis")])


@query
def sigma_coverage(spark, sf_dir):
    return dist.sigma_coverage(_interior(spark, sf_dir)).select("k", sig9(F.col("share")).alias("share"), sig9(F.col("share_nonzero")).alias("share_nonzero"))


@query
def parity_shares(spark, sf_dir):
    s = dist.sign_parity(_interior(spark, sf_dir))
    return s.select(*[sig9(F.col(c)).alias(c) for c in s.columns])


@query
def ks_tv_normal(spark, sf_dir):
    return fit.normal_fit(histogram_multiples(spark, sf_dir))


@query
def ks_tv_lognormal(spark, sf_dir):
    return fit.lognormal_fit(histogram_multiples(spark, sf_dir))


@query
def global_range(spark, sf_dir):
    cells = _smooth(spark, sf_dir)
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    return cells.agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"), F.count_if(bad).alias("not_finite"))


def _quantized(spark, sf_dir):
    cells = _smooth(spark, sf_dir).select("t", "y", "x", "v")
    span = cells.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return cells.crossJoin(F.broadcast(span)).withColumn("q", packing.quantize8(F.col("v"), F.col("low"), F.col("high")))


@query
def quantize8(spark, sf_dir):
    return _quantized(spark, sf_dir).select("t", "y", "x", "q")


@query
def error_metrics(spark, sf_dir):
    d = packing.dequantize8(F.col("q"), F.col("low"), F.col("high")).cast("double") - F.col("v").cast("double")
    span = F.first("high").cast("double") - F.first("low").cast("double")
    sums = _quantized(spark, sf_dir).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_error"), span.alias("span"))
    psnr = F.when(F.col("rmse") > 0, 20 * F.log10(F.col("span") / F.col("rmse"))).otherwise(float("inf"))
    return sums.select(*[F.round(c, 7).alias(n) for n, c in (("mae", F.col("mae")), ("rmse", F.col("rmse")), ("max_error", F.col("max_error")), ("psnr", psnr))])


@query
def chunk_boundary_fraction(spark, sf_dir):
    chunks = [(24, 128, 256), (48, 128, 256), (96, 128, 256), CHUNK]
    rows = [F.struct(F.lit(",".join(map(str, c))).alias("chunk"), F.lit(round(blocks.boundary_percent(c), 9)).alias("percent")) for c in chunks]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _blocks(spark, sf_dir):
    return blocks.to_blocks(_smooth(spark, sf_dir).select("t", "y", "x", "v"), CHUNK)


@query
def block_encode_verify(spark, sf_dir):
    return blocks.codec_records(_blocks(spark, sf_dir)).select("mode", "blocks", "raw_bytes", "mismatches")


@query
def block_roundtrip(spark, sf_dir):
    mode = blocks.MODES["delta+zigzag+reorder+planes"]
    again = blocks.from_blocks(blocks.decode_blocks(blocks.encode_blocks(_blocks(spark, sf_dir), mode, "zstd_5"), mode, "zstd_5"), CHUNK)
    return again.select("t", "y", "x", F.col("v").cast("double").alias("v"))


@query
def codec_sizes(spark, sf_dir):
    return blocks.codec_records(_blocks(spark, sf_dir), ["delta+zigzag"], ["none", "zstd_1", "zstd_5", "zstd_19", "zlib_6", "gzip_6", "bzip2_6", "lzma", "lz4", "zstd_5_shuffle", "lz4_bitshuffle"])


@query
def ablation_best_mode(spark, sf_dir):
    return blocks.best_mode(blocks.codec_records(_blocks(spark, sf_dir)))


@query
def plane_zstd_roundtrip(spark, sf_dir):
    pieces = planes.plane_pieces(_placed(spark, sf_dir), piece=512)
    return planes.unpacked_pieces(pieces, piece=512).select(F.col("bit"), "byte_idx", "byte")


def _whitened(spark, sf_dir, k):
    w = _words(spark, sf_dir)
    return w.withColumn("noisy", bits.whiten(F.col("w"), F.col("t"), F.col("y"), F.col("x"), k, SEED))


@query
def whiten_delta_hist(spark, sf_dir):
    return dist.frequencies(delta.delta3d(_whitened(spark, sf_dir, 7), "noisy").where(_INSIDE), "d")


@query
def whiten_highbits_mismatch(spark, sf_dir):
    both = [_whitened(spark, sf_dir, k).agg(F.lit(k).alias("bits"), F.count(F.lit(1)).alias("n"), F.count_if(bits.cut_low(F.col("noisy"), k) != bits.cut_low(F.col("w"), k)).alias("mismatches")) for k in (7, 8)]
    return both[0].unionByName(both[1])


@query
def whiten_rmse(spark, sf_dir):
    def row(k):
        d = bits.bits_float(F.col("noisy")).cast("double") - bits.bits_float(F.col("w")).cast("double")
        return _whitened(spark, sf_dir, k).agg(F.lit(k).alias("bits"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_error"))

    return row(7).unionByName(row(8)).select("bits", sig9(F.col("rmse")).alias("rmse"), "max_error")


def _records(spark, sf_dir):
    """(variant, mode, n, size, bits_per_value): bits of the original and whitened words,
    plain and as zigzag widths of their differences."""
    out = None
    for variant, k in (("original", 0), ("noise7", 7), ("noise8", 8)):
        cells = _whitened(spark, sf_dir, k)
        wide = delta.delta3d(cells, "noisy")
        for mode, width in (("raw", F.lit(32)), ("delta", bits.bit_width(bits.zigzag(F.col("d"))))):
            row = wide.agg(F.lit(variant).alias("variant"), F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.sum(width).alias("size"))
            out = row if out is None else out.unionByName(row)
    return out.withColumn("bits_per_value", F.col("size") / F.col("n"))


@query
def record_gains(spark, sf_dir):
    out = records.gains(_records(spark, sf_dir), "raw")
    return out.select("variant", "mode", "size", sig9(F.col("gain")).alias("gain"))


@query
def best_records(spark, sf_dir):
    return records.best(_records(spark, sf_dir)).select("variant", "mode", "size")


@query
def whitening_penalty(spark, sf_dir):
    return records.penalties(_records(spark, sf_dir)).select("variant", "mode", sig9(F.col("penalty")).alias("penalty"))


@query
def records_by_size(spark, sf_dir):
    return records.by_size(_records(spark, sf_dir)).select("variant", "mode", "size")


@query
def variant_frame_counts(spark, sf_dir):
    frames = _words(spark, sf_dir).select("t", F.explode(F.array(F.lit("original"), F.lit("noise7"), F.lit("noise8"))).alias("variant"))
    return records.agreeing_counts(frames)


@query
def metadata_counts(spark, sf_dir):
    """Event metadata grouped as message metadata is: by kind, with times and range."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", "ts")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(hour).alias("times"), F.min(hour).alias("first"), F.max(hour).alias("last"))


@query
def emb_delta3d_hist(spark, sf_dir):
    return dist.frequencies(delta.delta3d(delta.words(grids.embedding_cells(spark, sf_dir))).where(_INSIDE), "d")


@query
def evt_delta3d_hist(spark, sf_dir):
    return dist.frequencies(delta.delta3d(delta.words(grids.event_cells(spark, sf_dir))).where(_INSIDE), "d")


@query
def pack_delta3d_hist(spark, sf_dir):
    return dist.frequencies(delta.delta3d(delta.words(grids.packed_cells(spark, sf_dir))).where(_INSIDE), "d")


@query
def tiff_roundtrip(spark, sf_dir):
    """Every frame as a TIFF file's bytes, and its cells read back."""
    files = tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16)
    named = files.select("t", F.format_string("%04d.tiff", "t").alias("path"), "content")
    return tiff.read_grid(named).select("t", "y", "x", F.col("v").cast("double").alias("v"))


@query
def tiff_tag_table(spark, sf_dir):
    files = tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16).select(F.format_string("%04d.tiff", "t").alias("path"), "content")
    return tiff.tiff_tags(files).where("name IN ('ImageWidth', 'ImageLength', 'BitsPerSample', 'SampleFormat', 'TileWidth')").groupBy("tag", "name", "type", "count", F.col("value")[0].alias("value")).agg(F.count(F.lit(1)).alias("files"))


def _messages(spark, sf_dir):
    """Every frame as a packed message, in a file of its own."""

    def run(table: pa.Table) -> pa.Table:
        x = np.empty((grids.ROWS, grids.COLUMNS), np.int64)
        x[np.asarray(table.column("y")), np.asarray(table.column("x"))] = np.asarray(table.column("packed"))
        t, r = table.column("t")[0].as_py(), table.column("r")[0].as_py()
        message = grib.write_message(x, r / 65536.0, 20260501 + t // 24, t % 24 * 100)
        return pa.table({"path": pa.array([f"{t:04d}"]), "content": pa.array([message], pa.binary())})

    files = _smooth(spark, sf_dir).select("t", "y", "x", "packed", "r").groupBy("t").applyInArrow(run, "path string, content binary")
    return grib.read_messages(files)


@query
def grib_roundtrip(spark, sf_dir):
    """The integers of every frame, read back from its message."""
    # one message a file here, so the file's name is the frame
    cells = grib.unpack_messages(_messages(spark, sf_dir).withColumn("message", F.col("path").cast("long")))
    return cells.select(F.col("message").cast("int").alias("t"), "y", "x", F.col("packed"))


@query
def grib_metadata(spark, sf_dir):
    read = _messages(spark, sf_dir)
    return read.select(F.col("path").cast("int").alias("t"), "message", "edition", "ni", "nj", "first_lat", "simple", "bits", "binary_scale", "reference", grib.data_time(F.col("data_date"), F.col("data_time")).alias("time"))


@query
def grib_metadata_counts(spark, sf_dir):
    return grib.metadata_counts(_messages(spark, sf_dir)).select("edition", "ni", "nj", "bits", "n", "times", "first", "last")


@query
def grid_coordinates(spark, sf_dir):
    lat, lon = tables.coordinates(spark, grids.ROWS, grids.COLUMNS)
    cells = _smooth(spark, sf_dir).where("t = 0").select("y", "x")
    return cells.join(F.broadcast(lat), "y").join(F.broadcast(lon), "x").select("y", "x", sig9(F.col("lat")).alias("lat"), sig9(F.col("lon")).alias("lon"))


@query
def frame_names(spark, sf_dir):
    frames = _smooth(spark, sf_dir).select("t").distinct()
    return frames.select("t", packing.frame_name(F.col("t") + 1, F.lit("2t"), packing.valid_time(F.col("t"), "2026-05-01 00:00:00")).alias("name"))


@query
def size_records(spark, sf_dir):
    """Ratios and rates of a benchmark record: bytes of words against their widths."""
    widths = dist.width_histogram(_interior(spark, sf_dir))
    record = widths.agg(F.sum("n").alias("n"), F.ceil(F.sum(F.col("n") * F.col("width")) / 8).alias("size"))
    return record.select(
        "n", "size", sig9(packing.bits_per_value(F.col("size"), F.col("n"))).alias("bits_per_value"), sig9(packing.compression_ratio(F.col("n") * 4, F.col("size"))).alias("ratio"),
        sig9(packing.mib_per_second(F.col("size"), F.lit(2.0))).alias("mib_per_second"), packing.human_bytes(F.col("size")).alias("shown"),
    )


@query
def description_json(spark, sf_dir):
    frames = _smooth(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("cells"), F.min("r").alias("reference"))
    return frames.select("t", tables.description(cells=F.col("cells"), reference=F.col("reference"), block=F.floor(F.col("t") / NAIVE_BLOCK)).alias("text"))


@query
def windowed_event_counts(spark, sf_dir):
    from ..streaming.frames import windowed_counts

    out = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), window="1 day")
    return out.select("start", "event_type", "n", sig9(F.col("total")).alias("total"))


@query
def quantiles9(spark, sf_dir):
    return dist.quantiles(_interior(spark, sf_dir), probabilities=(0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0))


@query
def top_time_pairs(spark, sf_dir):
    return non64_by_time(spark, sf_dir).orderBy(F.desc("bad"), "t").limit(20)


@query
def histogram_file(spark, sf_dir):
    """The distribution of interior differences, written as a histogram file and read back."""
    path = tables.scratch_path(spark, "histogram")
    tables.write_histogram(_interior(spark, sf_dir), path)
    return tables.read_histogram(spark, path)


@query
def histogram_file_multiples(spark, sf_dir):
    path = tables.scratch_path(spark, "histogram")
    tables.write_histogram(_interior(spark, sf_dir), path)
    return tables.read_histogram(spark, path, multiple_of=64)


@query
def summary_file(spark, sf_dir):
    """Summaries of all regions, written as JSON and read back."""
    path = tables.scratch_path(spark, "summary")
    tables.write_summary(dist.summary(_regional(spark, sf_dir), "region"), path)
    read = tables.read_summary(spark, path)
    return read.select("region", *[F.col(c).cast("long").alias(c) for c in ("count", "unique_count", "min", "max", "zero_count")], sig9(F.col("mean")).alias("mean"), sig9(F.col("entropy")).alias("entropy"))


@query
def block_table_roundtrip(spark, sf_dir):
    """Encoded blocks as a table that carries their transform, and their cells read back."""
    path = tables.scratch_path(spark, "blocks")
    blocks.write_blocks(_blocks(spark, sf_dir), path, "delta+zigzag+planes", "zstd_5")
    blocks.write_blocks(_blocks(spark, sf_dir).where("ct = 0"), path, "planes", "lz4", "append")
    cells = blocks.from_blocks(blocks.read_blocks(spark, path), CHUNK)
    return cells.groupBy("t", "y", "x").agg(F.max("v").cast("double").alias("v"), F.min("v").cast("double").alias("same"), F.count(F.lit(1)).alias("copies"))


@query
def tiff_byte_counts(spark, sf_dir):
    files = tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16).select(F.format_string("%04d.tiff", "t").alias("path"), "content")
    counts = tiff.byte_counts(tiff.tiff_tags(files))
    return counts.select("path", "ifd", "pieces", (F.col("min") > 0).alias("filled"), (F.col("total").between(F.col("min") * F.col("pieces"), F.col("max") * F.col("pieces"))).alias("adds_up"))


@query
def tiff_frames_coerced(spark, sf_dir):
    """Frames read without asking for float32, but refusing what is not finite."""
    files = tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16).select("t", F.format_string("%04d.tiff", "t").alias("path"), "content")
    cells = tiff.read_grid(files, strict=False, finite=True)
    return cells.groupBy("t").agg(F.count(F.lit(1)).alias("cells"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))


@query
def tiff_block_roundtrip(spark, sf_dir):
    """Frames from files to blocks and back, by row bands: no row per cell on the way in."""
    files = tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16)
    cells = blocks.from_blocks(blocks.bands_to_blocks(tiff.read_bands(files, rows=3), CHUNK), CHUNK)
    return cells.select("t", "y", "x", F.col("v").cast("double").alias("v"))


@query
def tiff_tag_meanings(spark, sf_dir):
    files = tiff.frames_as_tiff(_smooth(spark, sf_dir), tile=16).select(F.format_string("%04d.tiff", "t").alias("path"), "content")
    named = tiff.named_values(tiff.tiff_tags(files))
    return named.groupBy("tag", "name", "meaning").agg(F.count(F.lit(1)).alias("files"))


@query
def grib_grid(spark, sf_dir):
    """Scan order, increments, steps and validity of every message."""
    read = _messages(spark, sf_dir)
    return read.select(F.col("path").cast("int").alias("t"), "grid", "last_lat", "last_lon", "i_increment", "j_increment", "i_negative", "j_positive", "j_consecutive", "step_start", "step_end", grib.validity_time(read).alias("valid"))


@query
def whiten_reverify(spark, sf_dir):
    """Whitened frames read back from files, against noise that is made again for each cell."""
    out = None
    for k in (7, 8):
        noisy = _whitened(spark, sf_dir, k).select("t", "y", "x", bits.bits_float(F.col("noisy")).alias("v"))
        files = tiff.frames_as_tiff(noisy, tile=16).select("t", F.format_string("%04d.tiff", "t").alias("path"), "content")
        again = delta.words(tiff.read_grid(files))
        both = again.join(_words(spark, sf_dir).withColumnRenamed("w", "source"), ["t", "y", "x"])
        want = bits.whiten(F.col("source"), F.col("t"), F.col("y"), F.col("x"), k, SEED)
        row = both.agg(F.lit(k).alias("bits"), F.count(F.lit(1)).alias("n"), F.sum(F.pmod("w", F.lit(1 << k))).alias("noise"), F.count_if(F.col("w") != want).alias("mismatches"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def variant_frame_gaps(spark, sf_dir):
    """Frames of variants that are tables of their own, one of which lacks some frames."""
    own = [_whitened(spark, sf_dir, k).where(kept).select("t", F.lit(name).alias("variant")) for name, k, kept in (("original", 0, "true"), ("noise7", 7, "true"), ("noise8", 8, "t % 10 <> 9"))]
    return records.agreeing_counts(own[0].unionByName(own[1]).unionByName(own[2]))


@query
def streamed_delta_t(spark, sf_dir):
    """Differences to the frame before, from a stream of cells that is read to its end."""
    from ..streaming.frames import streaming_delta_t

    source, out = tables.scratch_path(spark, "frames"), tables.scratch_path(spark, "streamed")
    words = _words(spark, sf_dir)
    words.write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = streaming_delta_t(spark.readStream.schema(words.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", tables.scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(out).where("t > 0").select("t", "y", "x", "d")
