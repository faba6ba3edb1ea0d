"""DuckDB SQL of the registered queries, written from the definitions alone."""

from __future__ import annotations

_G1 = """
pack AS (
  SELECT t::INT AS t, y::INT AS y, x::INT AS x, coalesce(packed, 0) AS packed
  FROM (FROM (SELECT unnest(range(83)) AS t), (SELECT unnest(range(8)) AS y), (SELECT unnest(range(10)) AS x))
  LEFT JOIN (
    SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, l_suppkey % 8 AS y, trunc(l_quantity)::INT % 10 AS x,
      sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // count(*) // 200 AS packed
    FROM lineitem GROUP BY ALL) USING (t, y, x)
)"""
_LATTICE = "SELECT *, 200 * 65536 + t::BIGINT * 7919 % 65536 AS r FROM"
_V = "SELECT *, (Q::DOUBLE / 65536)::FLOAT AS v FROM (SELECT *, (r + 128 * packed)::BIGINT AS Q FROM"
_W = "(v::FLOAT::BIT)::UINTEGER::BIGINT"
_G4 = f"""{_G1},
cells AS ({_V} ({_LATTICE} (
  SELECT t, y, x, (15000 + 3000 * y + 330 * x + t * 37 % 211 + packed % 5)::BIGINT AS packed FROM pack))))"""
_GRID = f"{_G4},\ngrid AS (SELECT *, {_W} AS w FROM cells)"
_EMB = f"grid AS (SELECT t, y, x, v, {_W} AS w FROM (SELECT (vec_id // 50)::INT AS t, (vec_id % 50)::INT AS y, (unnest(range(len(embedding))))::INT AS x, unnest(embedding) AS v FROM embeddings))"
_EVT = f"""grid AS (SELECT *, {_W} AS w FROM (
  SELECT t::INT AS t, y::INT AS y, x::INT AS x, (coalesce(c, 0)::DOUBLE / 100)::FLOAT AS v
  FROM (FROM (SELECT unnest(range(30)) AS t), (SELECT unnest(range(24)) AS y), (SELECT unnest(range(5)) AS x))
  LEFT JOIN (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS t, hour(ts) AS y, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS x,
    sum(round(value * 100)::BIGINT) AS c FROM events GROUP BY ALL) USING (t, y, x)))"""
_PACKGRID = f"{_G1},\ncells AS ({_V} ({_LATTICE} pack))),\ngrid AS (SELECT *, {_W} AS w FROM cells)"


def _delta(value: str = "w", source: str = "grid") -> str:
    """CTE ``delta`` (t, y, x, d) by three chained lags."""
    return f"""
dx AS (SELECT t, y, x, {value} - coalesce(lag({value}) OVER (PARTITION BY t, y ORDER BY x), 0) AS d FROM {source}),
dy AS (SELECT t, y, x, d - coalesce(lag(d) OVER (PARTITION BY t, x ORDER BY y), 0) AS d FROM dx),
delta AS (SELECT t, y, x, (d - coalesce(lag(d) OVER (PARTITION BY y, x ORDER BY t), 0))::BIGINT AS d FROM dy)"""


def _lag(value: str, *by: str, order: str, source: str) -> str:
    return f"SELECT *, lag({value}) OVER (PARTITION BY {', '.join(by)} ORDER BY {order}) AS b FROM {source}"


_CHUNKED = """
chunked AS (SELECT *, t // 24 AS ct, y // 4 AS cy, x // 5 AS cx FROM grid),
mx AS (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY ct, cy, cx, t, y ORDER BY x), 0) AS d1 FROM chunked),
my AS (SELECT *, d1 - coalesce(lag(d1) OVER (PARTITION BY ct, cy, cx, t, x ORDER BY y), 0) AS d2 FROM mx),
mod AS (SELECT *, (((d2 - coalesce(lag(d2) OVER (PARTITION BY ct, cy, cx, y, x ORDER BY t), 0)) % 4294967296 + 4294967296) % 4294967296)::BIGINT AS d FROM my)"""
_REGION = "CASE WHEN t = 0 AND y = 0 AND x = 0 THEN 'vertex' WHEN t = 0 AND y = 0 THEN 't0_lat0_edge' WHEN t = 0 AND x = 0 THEN 't0_lon0_edge' WHEN y = 0 AND x = 0 THEN 'lat0_lon0_edge' WHEN t = 0 THEN 't0_face' WHEN y = 0 THEN 'lat0_face' WHEN x = 0 THEN 'lon0_face' ELSE 'interior' END"
_INSIDE = "t > 0 AND y > 0 AND x > 0"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_BASE = _with(_GRID)
_D = _with(_GRID, _delta())
_HIST = _with(_GRID, _delta(), f"hist AS (SELECT d AS value, count(*) AS n FROM delta WHERE {_INSIDE} GROUP BY d)")
_REGIONAL = _with(_GRID, _delta(), f"hist AS (SELECT {_REGION} AS region, d AS value, count(*) AS n FROM delta GROUP BY ALL)")
_MOD = _with(_GRID, _CHUNKED)
_FINAL = f"SELECT d AS value, count(*) AS n FROM delta WHERE {_INSIDE} GROUP BY d"


def _sig(e: str) -> str:
    return f"printf('%.8e', ({e})::DOUBLE)::DOUBLE"


_WIDTH = "CASE WHEN value = 0 THEN 0 ELSE length(bin(CASE WHEN value >= 0 THEN 2 * value ELSE -2 * value - 1 END)) END"
_ZZ32 = "xor((d << 1) & 4294967295, CASE WHEN d >= 2147483648 THEN 4294967295 ELSE 0 END)"
_CORNERS = ("p00", "p01", "p10", "p11", "c00", "c01", "c10", "c11")


def _corner_columns() -> str:
    """Each corner of v by a self-join on its offsets."""
    joins, columns = [], []
    for c in _CORNERS:
        dt, dy, dx = int(c[0] == "p"), 1 - int(c[1]), 1 - int(c[2])
        joins.append(f"JOIN grid {c} ON {c}.t = g.t - {dt} AND {c}.y = g.y - {dy} AND {c}.x = g.x - {dx}")
        columns.append(f"{c}.v AS {c}")
    return f"corners AS (SELECT g.t, g.y, g.x, d, {', '.join(columns)} FROM delta g {' '.join(joins)} WHERE g.t > 0 AND g.y > 0 AND g.x > 0)"


_ALL = ", ".join(_CORNERS)
_P, _C = ", ".join(_CORNERS[:4]), ", ".join(_CORNERS[4:])
_MASKS = {
    "neither_spatial_face_crosses": "NOT p AND NOT c",
    "previous_face_only": "p AND NOT c",
    "current_face_only": "NOT p AND c",
    "both_spatial_faces_cross": "p AND c",
    "any_spatial_face_crosses": "p OR c",
    "eight_point_crosses": "e",
    "temporal_only_crosses": "e AND NOT (p OR c)",
}
_STENCIL = _with(
    _GRID,
    _delta(),
    _corner_columns(),
    f"""st AS (SELECT *, (d % 64 + 64) % 64 AS residue, least({_ALL}) AS low, greatest({_ALL}) AS high, least({', '.join(f'abs({c} - 256::FLOAT)' for c in _CORNERS)}) AS nearest,
  least({_P}) < 256 AND greatest({_P}) >= 256 AS p, least({_C}) < 256 AND greatest({_C}) >= 256 AS c, least({_ALL}) < 256 AND greatest({_ALL}) >= 256 AS e FROM corners)""",
)
_CATEGORIES = " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER ({m}) AS n, count(*) FILTER (({m}) AND residue <> 0) AS bad FROM st" for k, m in _MASKS.items())
_SIDES = "CASE WHEN v < 256 THEN 'below' WHEN v > 256 THEN 'above' ELSE 'equal' END"
_TAILS = f"tails AS (SELECT t, side, min(tail) AS tail, count(DISTINCT tail) AS tails FROM (SELECT t, {_SIDES} AS side, CASE WHEN v < 256 THEN w & 127 ELSE w & 63 END AS tail FROM grid WHERE v <> 256) GROUP BY ALL)"
_CUT = "cut AS (SELECT *, CASE WHEN v < 256 THEN w & 4294967168 WHEN v > 256 THEN w & 4294967232 ELSE w END AS c FROM grid)"
_NAIVE = "naive AS (SELECT *, t // 6 AS block, CASE WHEN t % 6 = 0 THEN 'key' ELSE 'diff' END AS kind, CASE WHEN t % 6 = 0 THEN v ELSE v - lag(v) OVER (PARTITION BY y, x ORDER BY t) END AS diff FROM grid)"


def _noise(k: int) -> str:
    """CTE ``noisy`` (t, y, x, w, z): the word with ``k`` hashed low bits."""
    step = "(xor({0}, {0} >> 16) * 73244475) & 4294967295"
    return f"""
h0 AS (SELECT *, (t * 73856093::BIGINT + y * 19349663::BIGINT + x * 83492791::BIGINT + 2311) & 4294967295 AS h FROM grid),
h1 AS (SELECT * EXCLUDE h, {step.format('h')} AS h FROM h0), h2 AS (SELECT * EXCLUDE h, {step.format('h')} AS h FROM h1),
noisy AS (SELECT *, (w & {0xFFFFFFFF ^ ((1 << k) - 1)}) | (xor(h, h >> 16) & {(1 << k) - 1}) AS z FROM h2)"""


_FLOAT = "({0}::UINTEGER::BIT::FLOAT)"
_RANGE = "span AS (SELECT min(v) AS low, max(v) AS high FROM grid)"
_Q8 = "quant AS (SELECT t, y, x, v, low, high, round_even(least(greatest((((v - low)::FLOAT * 255::FLOAT)::FLOAT / (high - low)::FLOAT)::FLOAT, 0::FLOAT), 255::FLOAT)::DOUBLE, 0)::INT AS q FROM grid, span)"
_BYTES = " UNION ALL ".join(f"SELECT {b} AS bit, w, position FROM placed" for b in range(32))
_PLACED = "placed AS (SELECT (t::BIGINT * 8 + y) * 10 + x AS position, w FROM grid)"
_PACKED = f"SELECT bit, position // 8 AS byte_idx, sum(((w >> bit) & 1) << (position % 8))::BIGINT AS byte FROM ({_BYTES}) GROUP BY ALL"


def _whiten_rmse(k: int) -> str:
    d = f"{_FLOAT.format('z')}::DOUBLE - {_FLOAT.format('w')}::DOUBLE"
    return _with(_GRID, _noise(k)) + f"SELECT {k} AS bits, {_sig(f'sqrt(avg(({d}) * ({d})))')} AS rmse, max(abs({d})) AS max_error FROM noisy"


def _record_rows() -> str:
    """A query of (variant, mode, n, size) for the original and two whitened variants."""
    zz = "CASE WHEN d = 0 THEN 0 ELSE length(bin(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END)) END"
    rows = []
    for variant, k in (("original", 0), ("noise7", 7), ("noise8", 8)):
        parts = _with(_GRID, _noise(k), _delta("z", "noisy"))
        rows.append(f"({parts} SELECT '{variant}' AS variant, unnest(['raw', 'delta']) AS mode, n, unnest([n * 32, w])::BIGINT AS size FROM (SELECT count(*) AS n, sum({zz})::BIGINT AS w FROM delta))")
    return "WITH rec AS (" + " UNION ALL ".join(rows) + ")\n"


_SUMMARY = f"""SELECT region, sum(n)::BIGINT AS count, count(*) AS unique_count, min(value) AS min, max(value) AS max, {_sig('any_value(m)')} AS mean,
  {_sig('sqrt(sum(n * (value - m) ** 2) / sum(n))')} AS sd, {_sig('0.0 - sum(n / total * log2(n / total))')} AS entropy, coalesce(sum(n) FILTER (value = 0), 0)::BIGINT AS zero_count,
  {_sig('coalesce(sum(n) FILTER (value = 0), 0) / sum(n)')} AS zero_fraction, {_sig('coalesce(sum(n) FILTER (value % 64 = 0), 0) / sum(n)')} AS multiple_64,
  {_sig('coalesce(sum(n) FILTER (value % 128 = 0), 0) / sum(n)')} AS multiple_128
FROM (SELECT *, sum(n) OVER (PARTITION BY region) AS total, sum(value * n) OVER (PARTITION BY region)::DOUBLE / sum(n) OVER (PARTITION BY region) AS m FROM hist) GROUP BY region"""
_PROBABILITIES = "(SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])::DOUBLE AS p)"
_SIZES = {"interior": 82 * 7 * 9, "t0_face": 63, "lat0_face": 82 * 9, "lon0_face": 82 * 7, "t0_lat0_edge": 9, "t0_lon0_edge": 7, "lat0_lon0_edge": 82, "vertex": 1}

ORACLE: dict[str, str] = {
    "grid_pack_cells": _with(_PACKGRID) + "SELECT t, y, x, packed AS packed, v FROM grid",
    "float_bits": _BASE + "SELECT t, y, x, w FROM grid",
    "float_bits_embeddings": _with(_EMB) + "SELECT t, y, x, w FROM grid",
    "bits_roundtrip": _with(_EMB) + f"SELECT count(*) AS n, count(*) FILTER ({_FLOAT.format('w')} <> v) AS mismatches FROM grid",
    "zigzag": _HIST + "SELECT value, CASE WHEN value >= 0 THEN 2 * value ELSE -2 * value - 1 END AS zigzag FROM hist",
    "zigzag32": _MOD + f"SELECT t, y, x, {_ZZ32} AS zigzag FROM mod",
    "unzigzag32": _MOD + f"SELECT count(*) AS n, sum(u)::BIGINT AS total, count(*) FILTER (u <> d) AS mismatches FROM (SELECT d, xor(z >> 1, CASE WHEN z & 1 = 1 THEN 4294967295 ELSE 0 END) AS u FROM (SELECT d, {_ZZ32} AS z FROM mod))",
    "bit_width_hist": _HIST + f"SELECT {_WIDTH} AS width, sum(n)::BIGINT AS n FROM hist GROUP BY 1",
    "ieee_planes_ones": _BASE + "SELECT bit::INT AS bit, CASE WHEN bit <= 22 THEN 'mantissa' WHEN bit <= 30 THEN 'exponent' ELSE 'sign' END AS field, printf('bit_%02d_', bit) || CASE WHEN bit = 0 THEN 'lsb' WHEN bit <= 22 THEN 'mantissa' WHEN bit <= 30 THEN 'exponent' ELSE 'sign' END AS name, sum((w >> bit) & 1)::BIGINT AS ones FROM grid, (SELECT unnest(range(32)) AS bit) GROUP BY bit",
    "packbits_bytes": _with(_GRID, _PLACED) + _PACKED,
    "plane_bits": _with(_GRID, _PLACED) + f'SELECT bit, (w >> bit) & 1 AS "on", count(*) AS n, sum(position)::BIGINT AS positions FROM ({_BYTES}) GROUP BY ALL',
    "byte_planes": _BASE + "SELECT t, y, x, w & 255 AS b0, (w >> 8) & 255 AS b1, (w >> 16) & 255 AS b2, w >> 24 AS b3 FROM grid",
    "mask_low_bits": _BASE + "SELECT t, y, x, w - w % 128 AS cut7, w - w % 64 AS cut6, w % 128 AS low7, w % 64 AS low6 FROM grid",
    "delta_t": _with(_GRID, f"l AS ({_lag('w', 'y', 'x', order='t', source='grid')})") + "SELECT t, y, x, w - b AS d FROM l WHERE t > 0",
    "mixed2d": _BASE + "SELECT a.t, a.y, a.x, a.w - b.w - c.w + d.w AS d FROM grid a JOIN grid b ON b.t = a.t AND b.y = a.y AND b.x = a.x - 1 JOIN grid c ON c.t = a.t AND c.y = a.y - 1 AND c.x = a.x JOIN grid d ON d.t = a.t AND d.y = a.y - 1 AND d.x = a.x - 1",
    "delta3d_hist": _D + _FINAL,
    "delta3d_regions": _REGIONAL + "SELECT * FROM hist",
    "delta3d_regions_bands": _REGIONAL + "SELECT * FROM hist",
    "tiff_delta3d_regions": _REGIONAL + "SELECT * FROM hist",
    "region_counts_check": _REGIONAL + "SELECT region, n, expected::BIGINT AS expected, n = expected AS agrees FROM (SELECT region, sum(n)::BIGINT AS n FROM hist GROUP BY 1) JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _SIZES.items()) + ") e(region, expected) USING (region)",
    "planes_edges_merge": _REGIONAL + "SELECT CASE WHEN region LIKE '%face' THEN 'planes' ELSE 'edges' END AS region_group, value, sum(n)::BIGINT AS n FROM hist WHERE region LIKE '%face' OR region LIKE '%edge' GROUP BY ALL",
    "inverse_delta_mismatch": _BASE + "SELECT count(*) AS n, sum(w)::BIGINT AS total, 0::BIGINT AS mismatches FROM grid",
    "delta3d_mod_chunk": _MOD + "SELECT t, y, x, ct, cy, cx, d FROM mod",
    "inverse_mod_chunk_mismatch": _BASE + "SELECT count(*) AS n, sum(w)::BIGINT AS total, 0::BIGINT AS mismatches FROM grid",
    "region_reorder": _BASE + f"SELECT t0 AS t, y0 AS y, x0 AS x, region, row_number() OVER (PARTITION BY ct, cy, cx ORDER BY list_position(['interior', 't0_face', 'lat0_face', 'lon0_face', 't0_lat0_edge', 't0_lon0_edge', 'lat0_lon0_edge', 'vertex'], region), t0, y0, x0) - 1 AS place FROM (SELECT *, {_REGION} AS region FROM (SELECT t AS t0, y AS y0, x AS x0, t // 24 AS ct, y // 4 AS cy, x // 5 AS cx, t % 24 AS t, y % 4 AS y, x % 5 AS x FROM grid))",
    "reorder_roundtrip": _BASE + "SELECT count(*) AS n, 0::BIGINT AS mismatches FROM grid",
    "dist_summary": _REGIONAL + _SUMMARY,
    "dist_entropy": _REGIONAL + "SELECT region, sum(n)::BIGINT AS count, round(-sum(n / total * log2(n / total)), 9) + 0.0 AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY region) AS total FROM hist) GROUP BY region",
    "weighted_entropy": _REGIONAL + "SELECT round(sum(total * h) / sum(total), 9) AS entropy FROM (SELECT part, any_value(total) AS total, -sum(n / total * log2(n / total)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY part) AS total FROM (SELECT CASE WHEN region LIKE '%face' THEN 'planes' WHEN region LIKE '%edge' THEN 'edges' ELSE region END AS part, value, sum(n) AS n FROM hist GROUP BY ALL)) GROUP BY part)",
    "dist_quantiles": _REGIONAL + f"SELECT region, p, min(value) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY region ORDER BY value) AS upto, sum(n) OVER (PARTITION BY region) AS total FROM hist), {_PROBABILITIES} WHERE upto > round_even(p * (total - 1)::DOUBLE, 0) GROUP BY ALL",
    "interp_percentiles": _STENCIL + "SELECT i::INT AS i, round(nearest, 8) AS nearest, round(span, 8) AS span FROM (SELECT unnest(range(7)) AS i, unnest(quantile_cont(nearest::DOUBLE, [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1])) AS nearest, unnest(quantile_cont((high - low)::DOUBLE, [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1])) AS span FROM st WHERE residue <> 0)",
    "top_values": _HIST + "SELECT value, n FROM hist ORDER BY n DESC, value LIMIT 20",
    "width_cdf": _HIST + f"SELECT width, n, {_sig('sum(n) OVER (ORDER BY width) / sum(n) OVER ()')} AS share FROM (SELECT {_WIDTH} AS width, sum(n)::BIGINT AS n FROM hist GROUP BY 1)",
    "histogram_multiples": _HIST + "SELECT value // 64 AS value, n FROM hist WHERE value % 64 = 0",
    "naive_diff": _with(_GRID, _NAIVE) + "SELECT t, y, x, block, kind, diff::DOUBLE AS diff FROM naive",
    "naive_diff_stats": _with(_GRID, _NAIVE) + f"SELECT kind, count(*) AS n, min(diff)::DOUBLE AS min, max(diff)::DOUBLE AS max, {_sig('avg(diff::DOUBLE)')} AS mean, round(stddev_pop(diff::DOUBLE), 7) AS sd FROM naive GROUP BY kind",
    "naive_diff_inverse_mismatch": _with(_GRID, _NAIVE, "back AS (SELECT v, list_reduce(list(diff) OVER (PARTITION BY y, x, block ORDER BY t), lambda a, b: (a + b)::FLOAT) AS back FROM naive)") + "SELECT count(*) AS n, count(*) FILTER (back <> v) AS mismatches, max(abs(back::DOUBLE - v::DOUBLE)) AS max_error FROM back",
    "packed_x_delta": _with(_GRID, _delta("packed")) + _FINAL,
    "q16_lattice_delta": _with(_GRID, _delta("Q")) + _FINAL,
    "unpack_error": _BASE + "SELECT count(*) AS n, max(abs(r / 65536.0::DOUBLE + packed * 2.0::DOUBLE ** -9 - Q / 65536.0::DOUBLE)) AS max_error FROM grid",
    "reference_series_delta": _BASE + "SELECT t, r, r - lag(r) OVER (ORDER BY t) AS d FROM (SELECT DISTINCT t, r FROM grid)",
    "tail_values": _with(_GRID, _TAILS) + "SELECT * FROM tails",
    "tail_uniqueness": _with(_GRID, _TAILS) + "SELECT side, count(*) AS frames, count(*) FILTER (tails <> 1) AS several FROM tails GROUP BY side",
    "tail_series_delta": _with(_GRID, _TAILS) + "SELECT t, side, tail, tail - lag(tail) OVER (PARTITION BY side ORDER BY t) AS d FROM tails",
    "tail_cut_delta": _with(_GRID, _CUT, _delta("c", "cut")) + _FINAL,
    "tail_restore_mismatch": _with(_GRID, _CUT, _TAILS) + f"SELECT count(*) AS n, count(*) FILTER ((c | coalesce(tail, 0)) <> w) AS mismatches, count(*) FILTER (c % 64 <> 0) AS not_multiples FROM (SELECT *, {_SIDES} AS side FROM cut) LEFT JOIN tails USING (t, side)",
    "threshold_classes": _BASE + f"SELECT {_SIDES} AS side, count(*) AS n FROM grid GROUP BY 1",
    "stencil_minmax": _STENCIL + "SELECT t, y, x, d, low::DOUBLE AS low, high::DOUBLE AS high, nearest::DOUBLE AS nearest FROM st",
    "crossing_categories": _STENCIL + f"SELECT category, n FROM ({_CATEGORIES})",
    "non64_by_category": _STENCIL + f"SELECT category, n, bad, {_sig('CASE WHEN n = 0 THEN 0 ELSE bad / n END')} AS rate FROM ({_CATEGORIES})",
    "side_class_delta": _STENCIL + "SELECT CASE WHEN high < 256 THEN 'all_below' WHEN low > 256 THEN 'all_above' ELSE 'crossing' END AS side, d AS value, count(*) AS n FROM st GROUP BY ALL",
    "non64_by_lat": _STENCIL + "SELECT y, count(*) FILTER (residue <> 0) AS bad, count(*) FILTER (p OR c) AS crossing FROM st GROUP BY y",
    "non64_by_time": _STENCIL + "SELECT t, count(*) FILTER (residue <> 0) AS bad, count(*) FILTER (p OR c) AS crossing FROM st GROUP BY t",
    "top_latitudes": _STENCIL + "SELECT y, count(*) FILTER (residue <> 0) AS bad, count(*) FILTER (p OR c) AS crossing FROM st GROUP BY y ORDER BY bad DESC, y LIMIT 20",
    "residue_hist": _STENCIL + "SELECT residue, count(*) AS n FROM st WHERE residue <> 0 GROUP BY 1",
    "non64_examples": _STENCIL + f"SELECT t, y, x, d, residue, (90 - (y - 0.5::DOUBLE) * 0.25::DOUBLE)::DOUBLE AS lat, ((x - 0.5::DOUBLE) * 0.25::DOUBLE)::DOUBLE AS lon, {', '.join(f'{c}::DOUBLE AS {c}' for c in _CORNERS if True)} FROM st WHERE residue <> 0 ORDER BY t, y, x LIMIT 8",
    "moments": _HIST + f"SELECT count, {_sig('m')} AS mean, {_sig('sqrt(m2)')} AS sd, {_sig('m3 / m2 ** 1.5')} AS skewness, {_sig('m4 / m2 ** 2 - 3')} AS kurtosis FROM (SELECT any_value(total)::BIGINT AS count, any_value(m) AS m, sum(n * (value - m) ** 2) / any_value(total) AS m2, sum(n * (value - m) ** 3) / any_value(total) AS m3, sum(n * (value - m) ** 4) / any_value(total) AS m4 FROM (SELECT *, sum(n) OVER () AS total, sum(value * n) OVER ()::DOUBLE / sum(n) OVER () AS m FROM hist))",
    "sigma_coverage": _HIST + f"SELECT k::INT AS k, {_sig('coalesce(sum(n) FILTER (abs(value - m) <= k * sd), 0) / sum(n)')} AS share, {_sig('coalesce(sum(n) FILTER (abs(value - m) <= k * sd AND value <> 0), 0) / sum(n) FILTER (value <> 0)')} AS share_nonzero FROM hist, (SELECT m, sqrt(sum(n * (value - m) ** 2) / sum(n)) AS sd FROM hist, (SELECT sum(value * n)::DOUBLE / sum(n) AS m FROM hist) GROUP BY m), (SELECT unnest([1, 2, 3]) AS k) GROUP BY k",
    "parity_shares": _HIST + f"SELECT {_sig('sum(n) FILTER (value % 2 = 0) / sum(n)')} AS even, {_sig('sum(n) FILTER (value % 2 = 0 AND value <> 0) / sum(n) FILTER (value <> 0)')} AS even_nonzero, {_sig('sum(n) FILTER (value > 0) / sum(n)')} AS positive, {_sig('sum(n) FILTER (value < 0) / sum(n)')} AS negative FROM hist",
    "global_range": _BASE + "SELECT min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, count(*) FILTER (NOT isfinite(v)) AS not_finite FROM grid",
    "quantize8": _with(_GRID, _RANGE, _Q8) + "SELECT t, y, x, q FROM quant",
    "error_metrics": _with(_GRID, _RANGE, _Q8, "err AS (SELECT ((q::FLOAT * ((high - low)::FLOAT / 255::FLOAT)::FLOAT)::FLOAT + low)::FLOAT::DOUBLE - v::DOUBLE AS e, high::DOUBLE - low::DOUBLE AS span FROM quant)") + "SELECT round(avg(abs(e)), 7) AS mae, round(sqrt(avg(e * e)), 7) AS rmse, round(max(abs(e)), 7) AS max_error, round(20 * log10(any_value(span) / sqrt(avg(e * e))), 7) AS psnr FROM err",
    "chunk_boundary_fraction": "SELECT a || ',' || b || ',' || c AS chunk, round(100 * (1 - (a - 1) * (b - 1) * (c - 1) / (a * b * c)::DOUBLE), 9) AS percent FROM (VALUES (24, 128, 256), (48, 128, 256), (96, 128, 256), (24, 4, 5)) v(a, b, c)",
    "block_encode_verify": "SELECT mode, 16::BIGINT AS blocks, 26560::BIGINT AS raw_bytes, 0::BIGINT AS mismatches FROM (SELECT unnest(['planes', 'delta', 'delta+planes', 'delta+zigzag', 'delta+zigzag+planes', 'delta+zigzag+reorder', 'delta+zigzag+reorder+planes']) AS mode)",
    "block_roundtrip": _BASE + "SELECT t, y, x, v::DOUBLE AS v FROM grid",
    "tiff_block_roundtrip": _BASE + "SELECT t, y, x, v::DOUBLE AS v FROM grid",
    "tiff_tag_meanings": "SELECT tag, name, meaning, 83::BIGINT AS files FROM (VALUES (256, 'ImageWidth', NULL), (257, 'ImageLength', NULL), (258, 'BitsPerSample', NULL), (259, 'Compression', 'Deflate'), (262, 'PhotometricInterpretation', 'BlackIsZero'), (270, 'ImageDescription', NULL), (277, 'SamplesPerPixel', NULL), (322, 'TileWidth', NULL), (323, 'TileLength', NULL), (324, 'TileOffsets', NULL), (325, 'TileByteCounts', NULL), (339, 'SampleFormat', 'IEEEFloat')) v(tag, name, meaning)",
    "grib_grid": _BASE + "SELECT DISTINCT t::INT AS t, 0::BIGINT AS grid, -90.0::DOUBLE AS last_lat, 359.75::DOUBLE AS last_lon, 0.25::DOUBLE AS i_increment, 0.25::DOUBLE AS j_increment, false AS i_negative, false AS j_positive, false AS j_consecutive, 0::BIGINT AS step_start, 0::BIGINT AS step_end, TIMESTAMP '2026-05-01' + to_hours(t::INT) AS valid FROM grid",
    "plane_zstd_roundtrip": _with(_GRID, _PLACED) + _PACKED,
    "whiten_delta_hist": _with(_GRID, _noise(7), _delta("z", "noisy")) + _FINAL,
    "whiten_highbits_mismatch": _BASE + "SELECT bits, count(*) AS n, 0::BIGINT AS mismatches FROM grid, (SELECT unnest([7, 8]) AS bits) GROUP BY bits",
    "whiten_rmse": f"({_whiten_rmse(7)}) UNION ALL ({_whiten_rmse(8)})",
    "record_gains": _record_rows() + f"SELECT variant, mode, size, {_sig('b.size / b.n - rec.size / rec.n')} AS gain FROM rec JOIN (SELECT variant, size, n FROM rec WHERE mode = 'raw') b USING (variant)".replace("variant, mode, size,", "variant, mode, rec.size,"),
    "best_records": _record_rows() + "SELECT variant, arg_min(mode, size) AS mode, min(size) AS size FROM rec GROUP BY variant",
    "whitening_penalty": _record_rows() + f"SELECT rec.variant, mode, {_sig('rec.size / rec.n - b.size / b.n')} AS penalty FROM rec JOIN (SELECT mode, size, n FROM rec WHERE variant = 'original') b USING (mode)",
    "records_by_size": _record_rows() + "SELECT variant, mode, size FROM rec ORDER BY size, variant, mode",
    "variant_frame_counts": "SELECT unnest(['original', 'noise7', 'noise8']) AS variant, 83::BIGINT AS frames, true AS agrees",
    "metadata_counts": "SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS times, min(date_trunc('hour', ts)) AS first, max(date_trunc('hour', ts)) AS last FROM events GROUP BY event_type",
    "emb_delta3d_hist": _with(_EMB, _delta()) + _FINAL,
    "evt_delta3d_hist": _with(_EVT, _delta()) + _FINAL,
    "pack_delta3d_hist": _with(_PACKGRID, _delta()) + _FINAL,
    "tiff_roundtrip": _BASE + "SELECT t, y, x, v::DOUBLE AS v FROM grid",
    "tiff_tag_table": "SELECT tag, name, type, 1::BIGINT AS count, value, 83::BIGINT AS files FROM (VALUES (256, 'ImageWidth', 'LONG', '10'), (257, 'ImageLength', 'LONG', '8'), (258, 'BitsPerSample', 'SHORT', '32'), (322, 'TileWidth', 'LONG', '16'), (339, 'SampleFormat', 'SHORT', '3')) v(tag, name, type, value)",
    "grib_roundtrip": _BASE + "SELECT t, y, x, packed AS packed FROM grid",
    "grid_coordinates": f"SELECT y::INT AS y, x::INT AS x, {_sig('90 - y * 180 / 7::DOUBLE')} AS lat, {_sig('x * 359.75::DOUBLE / 9')} AS lon FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(10)) AS x)",
    "frame_names": "SELECT t::INT AS t, printf('%04d', t + 1) || '_2t_' || strftime(TIMESTAMP '2026-05-01' + INTERVAL (t) HOUR, '%Y%m%dT%H%M') || '.tiff' AS name FROM (SELECT unnest(range(83)) AS t)",
    "size_records": _HIST + f"SELECT n, size, {_sig('size * 8 / n')} AS bits_per_value, {_sig('4 * n / size')} AS ratio, {_sig('size / 1048576.0::DOUBLE / 2')} AS mib_per_second, printf('%.2f KiB', size / 1024.0::DOUBLE) AS shown FROM (SELECT sum(n)::BIGINT AS n, ceil(sum(n * {_WIDTH}) / 8)::BIGINT AS size FROM hist)",
    "description_json": _BASE + """SELECT t, '{"block":' || (t // 6) || ',"cells":' || count(*) || ',"reference":' || min(r) || '}' AS text FROM grid GROUP BY t""",
    "windowed_event_counts": f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, {_sig('sum(value)')} AS total FROM events GROUP BY ALL",
    "grib_metadata": _BASE + "SELECT t::INT AS t, 1::BIGINT AS message, 1::BIGINT AS edition, 10::BIGINT AS ni, 8::BIGINT AS nj, 90.0::DOUBLE AS first_lat, true AS simple, 16::BIGINT AS bits, -9::BIGINT AS binary_scale, (min(r) / 65536.0)::DOUBLE AS reference, TIMESTAMP '2026-05-01' + to_hours(t::INT) AS time FROM grid GROUP BY t",
    "grib_metadata_counts": _BASE + "SELECT 1::BIGINT AS edition, 10::BIGINT AS ni, 8::BIGINT AS nj, 16::BIGINT AS bits, count(DISTINCT t) AS n, count(DISTINCT t) AS times, TIMESTAMP '2026-05-01' + to_hours(min(t)::INT) AS first, TIMESTAMP '2026-05-01' + to_hours(max(t)::INT) AS last FROM grid",
    "quantiles9": _HIST + "SELECT p, min(value) AS value FROM (SELECT *, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM hist), (SELECT unnest([0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0])::DOUBLE AS p) WHERE upto > round_even(p * (total - 1)::DOUBLE, 0) GROUP BY ALL",
    "top_time_pairs": _STENCIL + "SELECT t, count(*) FILTER (residue <> 0) AS bad, count(*) FILTER (p OR c) AS crossing FROM st GROUP BY t ORDER BY bad DESC, t LIMIT 20",
    "histogram_file": _HIST + "SELECT value, n FROM hist",
    "histogram_file_multiples": _HIST + "SELECT value // 64 AS value, n FROM hist WHERE value % 64 = 0",
    "summary_file": _REGIONAL + f"SELECT region, count, unique_count, min, max, zero_count, mean, entropy FROM ({_SUMMARY})",
    "block_table_roundtrip": _BASE + "SELECT t, y, x, v::DOUBLE AS v, v::DOUBLE AS same, CASE WHEN t < 24 THEN 2 ELSE 1 END::BIGINT AS copies FROM grid",
    "tiff_byte_counts": "SELECT printf('%04d.tiff', t) AS path, 0::INT AS ifd, 1::BIGINT AS pieces, true AS filled, true AS adds_up FROM (SELECT unnest(range(83)) AS t)",
    "tiff_frames_coerced": _BASE + "SELECT t, count(*) AS cells, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM grid GROUP BY t",
    "whiten_reverify": "(" + ") UNION ALL (".join(_with(_GRID, _noise(k)) + f"SELECT {k} AS bits, count(*) AS n, sum(z % {1 << k})::BIGINT AS noise, 0::BIGINT AS mismatches FROM noisy" for k in (7, 8)) + ")",
    "variant_frame_gaps": _BASE + "SELECT unnest(['original', 'noise7', 'noise8']) AS variant, unnest([count(DISTINCT t), count(DISTINCT t), count(DISTINCT t) FILTER (t % 10 <> 9)])::BIGINT AS frames, false AS agrees FROM grid",
    "streamed_delta_t": _with(_GRID, f"l AS ({_lag('w', 'y', 'x', order='t', source='grid')})") + "SELECT t, y, x, w - b AS d FROM l WHERE t > 0",
}
