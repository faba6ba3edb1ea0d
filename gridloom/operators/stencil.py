"""2x2x2 stencils: geometry, threshold crossings and diagnostics.

The corners come from lags: two inside a frame, on one exchange by t, and one
along time.  A stencil is named by its last corner, so t, y and x are at least 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where float32 exponents change inside the data: 256 K.
BOUNDARY = 256.0
#: Corner columns: frame before (p) or this frame (c), then row and column offsets.
CORNERS = ("p00", "p01", "p10", "p11", "c00", "c01", "c10", "c11")


def stencils(cells: DataFrame, *values: str) -> DataFrame:
    """(t, y, x) with the eight corners of each of ``values`` as ``<corner>_<value>``.

    A face of two corners by two: the first digit is the row, the second the
    column, 0 for the smaller coordinate.
    """
    row = Window.partitionBy("t", "y").orderBy("x")
    column = Window.partitionBy("t", "x").orderBy("y")
    time = Window.partitionBy("y", "x").orderBy("t")
    df = cells.repartition("t").select("t", "y", "x", *[F.col(v).alias(f"c11_{v}") for v in values])
    df = df.withColumns({f"c10_{v}": F.lag(f"c11_{v}").over(row) for v in values})
    df = df.withColumns({f"c0{k}_{v}": F.lag(f"c1{k}_{v}").over(column) for v in values for k in "01"})
    df = df.withColumns({f"p{k}_{v}": F.lag(f"c{k}_{v}").over(time) for v in values for k in ("00", "01", "10", "11")})
    return df.where("t > 0 AND y > 0 AND x > 0")


def _all(value: str, face: str = "pc") -> list[Column]:
    return [F.col(f"{c}_{value}") for c in CORNERS if c[0] in face]


def difference(value: str) -> Column:
    """The mixed 3-D difference of a stencil."""
    return sum((F.col(f"{c}_{value}") * (1 if (c[0] == "c") ^ (c[1] == "0") ^ (c[2] == "0") else -1) for c in CORNERS), F.lit(0))


def geometry(df: DataFrame, value: str = "v", boundary: float = BOUNDARY) -> DataFrame:
    """Adds low, high and nearest: the extremes of the corners, and the least distance to the boundary."""
    corners = _all(value)
    edge = F.lit(boundary).cast("float")
    return df.withColumns({"low": F.least(*corners), "high": F.greatest(*corners), "nearest": F.least(*[F.abs(c - edge) for c in corners])})


def face_crosses(face: str, value: str = "v", boundary: float = BOUNDARY) -> Column:
    """Some but not all corners of a face lie below the boundary."""
    corners = _all(value, face)
    return (F.least(*corners) < boundary) & (F.greatest(*corners) >= boundary)


#: The category labels of results, each with the states that it counts.
CATEGORIES = {
    "neither_spatial_face_crosses": (0, 4),
    "previous_face_only": (5,),
    "current_face_only": (6,),
    "both_spatial_faces_cross": (7,),
    "any_spatial_face_crosses": (5, 6, 7),
    "eight_point_crosses": (4, 5, 6, 7),
    "temporal_only_crosses": (4,),
}


def crossing_state(value: str = "v", boundary: float = BOUNDARY) -> Column:
    """How a stencil crosses the boundary: 1 if the face of the frame before does, plus 2
    if its own frame's face does, plus 4 if the cube does, as it must where a face does."""
    flags = [face_crosses(face, value, boundary).cast("int") * weight for face, weight in (("p", 1), ("c", 2), ("pc", 4))]
    return flags[0] + flags[1] + flags[2]


def in_category(state: Column, category: str) -> Column:
    return state.isin(*CATEGORIES[category])


def side_class(value: str = "v", boundary: float = BOUNDARY) -> Column:
    """all_below, all_above, or crossing, to which the boundary itself belongs."""
    corners = _all(value)
    return F.when(F.greatest(*corners) < boundary, "all_below").when(F.least(*corners) > boundary, "all_above").otherwise("crossing")


def threshold_class(value: Column, boundary: float = BOUNDARY) -> Column:
    return F.when(value < boundary, "below").when(value > boundary, "above").when(value == boundary, "equal")


def category_counts(df: DataFrame, bad: Column, boundary: float = BOUNDARY) -> DataFrame:
    """(category, n, bad, rate): stencils are counted once by state; categories overlap."""
    states = df.groupBy(crossing_state(boundary=boundary).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    all_ = states.groupBy().pivot("state", list(range(8))).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = lambda of, name: sum((F.coalesce(f"{s}_{of}", F.lit(0)) for s in CATEGORIES[name]), F.lit(0).cast("long"))
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("category"), total("n", k).alias("n"), total("bad", k).alias("bad")) for k in CATEGORIES]))
    return all_.select(rows).withColumn("rate", F.coalesce(F.try_divide(F.col("bad"), F.col("n")), F.lit(0.0)))


def tails(cells: DataFrame, boundary: float = BOUNDARY) -> DataFrame:
    """(t, side, tail, tails): the low bits (7 below the boundary, 6 above) of each frame's
    words, and how many distinct ones there are; 1 means the tail can be cut."""
    w, v = F.col("w"), F.col("v")
    low = F.when(v < boundary, w.bitwiseAND(F.lit(127).cast("long"))).otherwise(w.bitwiseAND(F.lit(63).cast("long")))
    sided = cells.where(v != boundary).select("t", threshold_class(v, boundary).alias("side"), low.alias("tail"))
    return sided.groupBy("t", "side").agg(F.min("tail").alias("tail"), F.countDistinct("tail").alias("tails"))


def cut_tails(cells: DataFrame, boundary: float = BOUNDARY) -> DataFrame:
    """Adds cut: the word without its tail; words at the boundary stay."""
    w, v = F.col("w"), F.col("v")
    mask = lambda bits: w.bitwiseAND(F.lit(0xFFFFFFFF ^ ((1 << bits) - 1)).cast("long"))
    return cells.withColumn("cut", F.when(v < boundary, mask(7)).when(v > boundary, mask(6)).otherwise(w))


def restore_tails(cut: DataFrame, tails: DataFrame) -> DataFrame:
    """Adds restored: the cut word with its frame's and side's tail put back."""
    sides = tails.select("t", "side", "tail")
    sided = cut.withColumn("side", threshold_class(F.col("v")))
    joined = sided.join(sides, ["t", "side"], "left")
    return joined.withColumn("restored", F.col("cut").bitwiseOR(F.coalesce("tail", F.lit(0).cast("long"))))
