"""Turn cues along routes over a graph, as window functions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import c
from pathloom.operators.components import connected_components

EARTH_M = 6_371_000.0
# Degrees beyond which a change of bearing is a bear, a turn, a sharp turn, a U-turn.
STRAIGHT, SLIGHT, TURN, SHARP = 20.0, 45.0, 135.0, 170.0
CLUSTER_M, WINDOW_M = 20.0, 15.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(c(lat1)), F.radians(c(lat2))
    s, t = F.sin((a2 - a1) / 2), F.sin((F.radians(c(lon2)) - F.radians(c(lon1))) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s * s + F.cos(a1) * F.cos(a2) * t * t))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees from north, 0 to 360."""
    a1, a2 = F.radians(c(lat1)), F.radians(c(lat2))
    d = F.radians(c(lon2)) - F.radians(c(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d))), F.lit(360.0))


def angle_difference(a, b) -> Column:
    """a less b, from -180 to under 180."""
    return F.pmod(c(a) - c(b) + 180, F.lit(360.0)) - 180


def classify_turn(angle, straight: float = STRAIGHT, slight: float = SLIGHT, turn: float = TURN, sharp: float = SHARP) -> Column:
    """Negative is left; a threshold itself belongs to the gentler class."""
    a, side = F.abs(c(angle)), F.when(c(angle) < 0, "left").otherwise("right")
    return F.when(a > sharp, "u_turn").when(a > turn, F.concat(F.lit("sharp_"), side)).when(a > slight, side).when(a > straight, F.concat(F.lit("slight_"), side)).otherwise("straight")


def refine(cue, out_bearing, branches: Column, straight_cues: str = "ambiguous") -> Column:
    """The cue in view of the other branches' bearings; null drops it.

    Straight on stays if a branch is within 45 degrees of it (or always, or never, by ``straight_cues``); a slight turn
    with a branch within 30 degrees, in order of the array, is a fork away from it.
    """
    off = F.transform(branches, lambda b: angle_difference(b, out_bearing))
    straight = {"none": F.lit(None).cast("string"), "all": F.lit("straight")}.get(straight_cues, F.when(F.exists(off, lambda d: F.abs(d) <= 45), F.lit("straight")))
    close = F.get(F.filter(off, lambda d: F.abs(d) <= 30), F.lit(0))
    fork = F.when(close > 0, "right_fork").when(close <= 0, "left_fork").otherwise(c(cue))
    return F.when(c(cue) == "straight", straight).when(c(cue).isin("slight_left", "slight_right"), fork).otherwise(c(cue))


def cumulative(points: DataFrame, key: str = "route") -> DataFrame:
    """``points`` with ``cum_m``, the running distance from the start of each route."""
    order = Window.partitionBy(key).orderBy("seq")
    step = F.coalesce(haversine(F.lag("lat").over(order), F.lag("lon").over(order), "lat", "lon"), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("cum_m", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def window_bearings(points: DataFrame, window_m: float = WINDOW_M, key: str = "route") -> DataFrame:
    """``points`` (with ``cum_m``) with ``in_bearing`` and ``out_bearing``: from the last point at least ``window_m`` back,
    and to the first one as far ahead, or the route's end.

    The two points are the ends of range frames over the running distance, so no route is compared with itself.
    """
    whole = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("lat", "lon")
    reach = f"OVER (PARTITION BY {key} ORDER BY cum_m RANGE BETWEEN"  # the column functions take whole numbers only
    back = F.coalesce(F.expr(f"last(struct(lat, lon)) {reach} UNBOUNDED PRECEDING AND {float(window_m)}D PRECEDING)"), F.first(place).over(whole))
    ahead = F.coalesce(F.expr(f"first(struct(lat, lon)) {reach} {float(window_m)}D FOLLOWING AND UNBOUNDED FOLLOWING)"), F.last(place).over(whole))
    rows = points.withColumn("_b", back).withColumn("_a", ahead)
    return rows.withColumn("in_bearing", bearing("_b.lat", "_b.lon", "lat", "lon")).withColumn("out_bearing", bearing("lat", "lon", "_a.lat", "_a.lon")).drop("_a", "_b")


def junctions(on_edges: DataFrame, key: str = "route") -> DataFrame:
    """``(route, vertex, seq, layer_in, layer_out, from_vertex, to_vertex)`` where a route changes edges.

    ``on_edges`` has each route point's edge: ``route, seq, source, target, layer``. Points in a row on one pair of ends are a
    run; the vertex that a run shares with the next is passed at the run's last point.
    """
    order = Window.partitionBy(key).orderBy("seq")
    change = F.when((F.lag("source").over(order) == F.col("source")) & (F.lag("target").over(order) == F.col("target")), 0).otherwise(1)
    run = on_edges.withColumn("_c", change).withColumn("_run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = run.groupBy(key, "_run").agg(F.max("seq").alias("seq"), F.first("source").alias("s"), F.first("target").alias("t"), F.max_by("layer", "seq").alias("layer"))
    following = Window.partitionBy(key).orderBy("_run")
    pair = each.withColumn("s2", F.lead("s").over(following)).withColumn("t2", F.lead("t").over(following)).withColumn("layer_out", F.lead("layer").over(following)).where("s2 is not null")
    shared = F.get(F.array_sort(F.array_intersect(F.array("s", "t"), F.array("s2", "t2"))), F.lit(0))
    pair = pair.withColumn("vertex", shared).where("vertex is not null")
    return pair.select(key, "vertex", "seq", F.col("layer").alias("layer_in"), "layer_out", F.when(F.col("t") == F.col("vertex"), F.col("s")).otherwise(F.col("t")).alias("from_vertex"), F.when(F.col("s2") == F.col("vertex"), F.col("t2")).otherwise(F.col("s2")).alias("to_vertex"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct ``(vertex, neighbour, layer)`` of a graph's edges, both ways."""
    one = edges.select(F.col("source").alias("vertex"), F.col("target").alias("neighbour"), "layer")
    return one.unionByName(edges.select(F.col("target").alias("vertex"), F.col("source").alias("neighbour"), "layer")).distinct()


def course_points(points: DataFrame, passed: DataFrame, edges: DataFrame, places: DataFrame, cluster_m: float = CLUSTER_M, window_m: float = WINDOW_M, straight_cues: str = "ambiguous", key: str = "route") -> DataFrame:
    """``(route, seq, cum_m, cue)`` at the decisions of each route.

    ``points`` has ``route, seq, lat, lon``; ``passed`` are :func:`junctions`; ``edges`` ``source, target, layer, length_m``; ``places``
    ``vertex, lat, lon``. A vertex with three or more neighbours is a decision. Decisions that follow each other are one if
    their vertices are linked by edges of at most ``cluster_m``, or are one vertex met again within that distance. Staying on
    a path over a road gives no cue, and a road never counts as a branch that could be mistaken.
    """
    near = neighbours(edges)
    degree = near.groupBy("vertex").agg(F.count_distinct("neighbour").alias("degree")).where("degree >= 3").select("vertex")
    along = window_bearings(cumulative(points, key), window_m, key)
    decisions = passed.join(degree, "vertex", "left_semi").join(along.select(key, "seq", "cum_m", "in_bearing", "out_bearing"), [key, "seq"])
    short = edges.where(F.col("length_m") <= cluster_m).join(degree.select(F.col("vertex").alias("source")), "source", "left_semi").join(degree.select(F.col("vertex").alias("target")), "target", "left_semi")
    complex_ = connected_components(short.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    decisions = decisions.join(complex_, "vertex", "left").withColumn("complex", F.coalesce("component", "vertex"))
    order = Window.partitionBy(key).orderBy("seq")
    lag = lambda x: F.lag(x).over(order)
    same = (lag("vertex") == F.col("vertex")) & (F.col("cum_m") - lag("cum_m") <= cluster_m) | (lag("vertex") != F.col("vertex")) & (lag("complex") == F.col("complex"))
    marked = decisions.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = marked.groupBy(key, "cluster").agg(
        F.min("seq").alias("seq"), F.min("cum_m").alias("cum_m"), F.min_by("in_bearing", "seq").alias("in_b"), F.max_by("out_bearing", "seq").alias("out_b"),
        F.min_by("layer_in", "seq").alias("layer_in"), F.max_by("layer_out", "seq").alias("layer_out"), F.min_by("from_vertex", "seq").alias("entry"), F.max_by("to_vertex", "seq").alias("exit"), F.collect_set("vertex").alias("own"),
    )
    branch = each.select(key, "cluster", "entry", "exit", "own", F.explode("own").alias("vertex")).join(near, "vertex").where((F.col("neighbour") != F.col("entry")) & (F.col("neighbour") != F.col("exit")) & ~F.array_contains("own", F.col("neighbour")))
    at = places.select("vertex", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    there = places.select(F.col("vertex").alias("neighbour"), F.col("lat").alias("lb"), F.col("lon").alias("lob"))
    branch = branch.join(at, "vertex").join(there, "neighbour")
    facts = branch.groupBy(key, "cluster").agg(F.bool_or(F.col("layer") == "road").alias("road"), F.array_sort(F.collect_list(F.when(F.col("layer") != "road", F.struct("vertex", "neighbour", bearing("la", "lo", "lb", "lob").alias("b"))))).alias("bs"))
    full = each.join(facts, [key, "cluster"], "left").withColumn("cue", classify_turn(angle_difference("out_b", "in_b")))
    over_road = (F.col("layer_in") == "cartpath") & (F.col("layer_out") == "cartpath") & F.coalesce("road", F.lit(False)) & F.col("cue").isin("straight", "slight_left", "slight_right")
    bearings = F.coalesce(F.transform("bs", lambda x: x["b"]), F.array().cast("array<double>"))
    return full.where(~over_road).withColumn("cue", refine("cue", "out_b", bearings, straight_cues)).where("cue is not null").select(key, "seq", "cum_m", "cue")
