"""Planar geometry as columns and narrow rows.

A line travels as ``array<struct<x,y>>``, a feature as an array of such parts. Work on lines is done on *pieces*: a row
for each straight piece between two vertices, with its place along its part in metres. Pieces are what joins, shuffles
and sums want; no operator loops over a line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
MULTILINE = f"array<{LINE}>"


def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"), F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = c(x2) - c(x1), c(y2) - c(y1)
    return F.sqrt(dx * dx + dy * dy)


def fraction_along(px, py, x1, y1, x2, y2) -> Column:
    """Where on the piece its point nearest to (px, py) lies, 0 to 1; 0 on a piece without length."""
    dx, dy = c(x2) - c(x1), c(y2) - c(y1)
    square = dx * dx + dy * dy
    t = ((c(px) - c(x1)) * dx + (c(py) - c(y1)) * dy) / square
    return F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def point_piece_distance(px, py, x1, y1, x2, y2) -> Column:
    t = fraction_along(px, py, x1, y1, x2, y2)
    return distance(px, py, c(x1) + (c(x2) - c(x1)) * t, c(y1) + (c(y2) - c(y1)) * t)


def line_length(line: Column) -> Column:
    """Length of one ``array<struct<x,y>>``."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, d: s + d))


def feature_length(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, line_length), F.lit(0.0), lambda s, d: s + d)


def without_repeats(line: Column) -> Column:
    """The line less points equal to the one before them."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def shape_hash(parts: Column, grid: float = 0.01) -> Column:
    """Equal for features that are the same on the grid, whatever the direction and order of their parts."""
    snapped = F.transform(parts, lambda line: without_repeats(F.transform(line, lambda p: F.struct((F.round(p["x"] / grid) * grid + 0.0).alias("x"), (F.round(p["y"] / grid) * grid + 0.0).alias("y")))))
    one_way = F.transform(snapped, lambda line: F.least(line, F.reverse(line)))
    return F.md5(F.to_json(F.array_sort(one_way)))


def vertices(features: DataFrame, id_col: str = "id", geom_col: str = "geom") -> DataFrame:
    """``(id, part, seq, x, y)``, parts and places from 0; null features and parts give no rows."""
    parts = features.select(F.col(id_col).alias("id"), F.posexplode(geom_col).alias("part", "_line"))
    return parts.select("id", "part", F.posexplode("_line").alias("seq", "_p")).select("id", "part", "seq", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def pieces(points: DataFrame, keys: tuple[str, ...] = ("id", "part"), carry: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, k, x1, y1, x2, y2, from_m, to_m, part_m, last)`` of points ordered by ``seq`` within ``keys``."""
    along = Window.partitionBy(*keys).orderBy("seq")
    step = points.withColumn("x2", F.lead("x").over(along)).withColumn("y2", F.lead("y").over(along)).where("x2 is not null")
    step = step.select(*keys, *carry, F.col("seq").alias("k"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    step = step.withColumn("len", distance("x1", "y1", "x2", "y2"))
    order = Window.partitionBy(*keys).orderBy("k")
    step = step.withColumn("to_m", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys)
    return step.select(
        *keys, *carry, "k", "x1", "y1", "x2", "y2", "len", F.coalesce(F.lag("to_m").over(order), F.lit(0.0)).alias("from_m"), "to_m",
        F.max("to_m").over(whole).alias("part_m"), (F.col("k") == F.max("k").over(whole)).alias("last"),
    )


def feature_pieces(features: DataFrame, id_col: str = "id", geom_col: str = "geom") -> DataFrame:
    return pieces(vertices(features, id_col, geom_col))


def lines(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``(*keys, line)``: the points of each key collected in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), point("x", "y").alias("p"))))
    return points.groupBy(*keys).agg(F.transform(rows, lambda r: r["p"]).alias("line"))


def at_metres(m, x1="x1", y1="y1", x2="x2", y2="y2", from_m="from_m", length="len") -> tuple[Column, Column]:
    """The point of a piece ``m`` metres along its part."""
    t = F.when(c(length) == 0, F.lit(0.0)).otherwise((c(m) - c(from_m)) / c(length))
    return c(x1) + (c(x2) - c(x1)) * t, c(y1) + (c(y2) - c(y1)) * t


def even_points(parts: DataFrame, spacing: float, keys: tuple[str, ...] = ("id", "part"), carry: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, seq, n, x, y)``: points at i/n of each part, i from 0 to n, n the fewest steps of at most ``spacing``.

    Each piece makes the points that lie on it, so the rows made are the points and no join is needed.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("part_m") / spacing)).cast("long")
    with_n = parts.withColumn("n", n).withColumn("_step", F.col("part_m") / F.col("n"))
    eps = 1e-9
    first = F.when(F.col("_step") == 0, F.lit(0)).otherwise(F.ceil(F.col("from_m") / F.col("_step") - eps))
    # the piece that a point ends belongs to the next one, but for the last
    upto = F.when(F.col("last"), F.col("n")).otherwise(F.ceil(F.col("to_m") / F.col("_step") - eps) - 1)
    span = with_n.withColumn("_a", first.cast("long")).withColumn("_b", upto.cast("long")).where("_a <= _b and part_m > 0")
    each = span.withColumn("seq", F.explode(F.sequence("_a", "_b")))
    x, y = at_metres(F.col("part_m") * F.col("seq") / F.col("n"))
    return each.select(*keys, *carry, "seq", "n", x.alias("x"), y.alias("y"))


def substrings(parts: DataFrame, bounds: DataFrame, keys: tuple[str, ...] = ("id", "part"), name: str = "cut") -> DataFrame:
    """Pieces of each part between ``a`` and ``b``, fractions of its length: ``(*keys, cut, k, x1..y2, len)``.

    ``bounds`` has ``(*keys, cut, a, b)``. A piece is cut by the bounds that overlap it, found by the part and a range.
    """
    joined = parts.join(bounds, list(keys)).withColumn("_a", F.col("a") * F.col("part_m")).withColumn("_b", F.col("b") * F.col("part_m"))
    hit = joined.where((F.col("from_m") < F.col("_b")) & (F.col("to_m") > F.col("_a")))
    lo, hi = F.greatest("from_m", "_a"), F.least("to_m", "_b")
    (xa, ya), (xb, yb) = at_metres(lo), at_metres(hi)
    cut = hit.select(*keys, name, "a", "b", "k", xa.alias("x1"), ya.alias("y1"), xb.alias("x2"), yb.alias("y2"))
    return cut.withColumn("len", distance("x1", "y1", "x2", "y2"))


def piece_lines(cut: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, line, length_m)``: consecutive pieces joined into a line again."""
    steps = F.array_sort(F.collect_list(F.struct("k", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("q"))))
    line = F.concat(F.transform("steps", lambda s: s["p"]), F.array(F.element_at("steps", -1)["q"]))
    return cut.groupBy(*keys).agg(steps.alias("steps"), F.sum("len").alias("length_m")).select(*keys, without_repeats(line).alias("line"), "length_m")


def far_from_chord(xs: np.ndarray, ys: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay: both ends, and of each stretch between kept points the farthest from its chord, if beyond ``tolerance``."""
    keep = np.zeros(len(xs), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(xs) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        px, py = xs[a + 1 : b] - xs[a], ys[a + 1 : b] - ys[a]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square else np.zeros(b - a - 1)
        off = np.hypot(px - t * dx, py - t * dy)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify(line: Column, tolerance: float) -> Column:
    """The line by Douglas and Peucker's rule, for display; null stays null, lines of up to two points stay as they are.

    Which points stay is found in Arrow batches from the two coordinate arrays; the points are filtered beside it.
    """

    @F.pandas_udf("array<boolean>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else far_from_chord(x, y, tolerance) if len(x) > 2 else [True] * len(x) for x, y in zip(xs, ys)])

    flags = kept(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]))
    marked = F.filter(F.arrays_zip(line.alias("p"), flags.alias("f")), lambda z: z["f"])
    return F.transform(marked, lambda z: z["p"])


def extent(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def crossing(a: str = "a", b: str = "b") -> tuple[Column, Column, Column]:
    """Do two pieces (columns ``a_x1`` ... ``b_y2``) cross in one point: (flag, t along a, u along b). Parallel pieces do not."""
    v = {f"{s}{n}": F.col(f"{s}_{n}") for s in (a, b) for n in ("x1", "y1", "x2", "y2")}
    ax, ay = v[f"{a}x2"] - v[f"{a}x1"], v[f"{a}y2"] - v[f"{a}y1"]
    bx, by = v[f"{b}x2"] - v[f"{b}x1"], v[f"{b}y2"] - v[f"{b}y1"]
    cross = ax * by - ay * bx
    dx, dy = v[f"{b}x1"] - v[f"{a}x1"], v[f"{b}y1"] - v[f"{a}y1"]
    t = F.when(cross != 0, (dx * by - dy * bx) / cross)
    u = F.when(cross != 0, (dx * ay - dy * ax) / cross)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False)), t, u
