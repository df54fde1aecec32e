"""GPS tracks: filtering, classification to a network, gap splitting, cutting into pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import distance, even_points, pieces

PIECE_M = 200.0
#: Boxes that are broadcast; beyond, fixes and boxes meet in cells of this size.
FEW_BOXES, CELL_M = 1000, 10_000.0


def real_fixes(fixes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Fixes that are neither null nor at (0, 0)."""
    return fixes.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~((F.col(lat) == 0) & (F.col(lon) == 0)))


def listing_reason(kind: Column, stub: Column, has_latlng: Column, known: Column, accepted: list[str], refetch: bool = False) -> Column:
    """Why a listed activity is not fetched, or ``fetch``; the first reason that holds."""
    known = F.lit(False) if refetch else known
    return F.when(~F.coalesce(kind.isin(accepted), F.lit(False)), "other type").when(stub, "stub").when(~has_latlng, "no gps").when(known, "known").otherwise("fetch")


def split_track(fixes: DataFrame, gap: float, key: str = "track") -> DataFrame:
    """``(track, part, seq, x, y)``: cut where consecutive fixes are more than ``gap`` apart (equal does not cut).

    Parts of one fix or without length are dropped, and tracks left with none give no rows. Parts are numbered from 0
    in order; the rows of one track are one window partition.
    """
    order = Window.partitionBy(key).orderBy("seq")
    jump = distance(F.lag("x").over(order), F.lag("y").over(order), "x", "y")
    marked = fixes.withColumn("_step", jump).withColumn("_raw", F.sum(F.when(F.col("_step") > gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy(key, "_raw")
    inside = F.when(F.col("_step") <= gap, F.col("_step")).otherwise(0.0)
    good = marked.withColumn("_len", F.sum(inside).over(part)).where("_len > 0")
    return good.withColumn("part", (F.dense_rank().over(Window.partitionBy(key).orderBy("_raw")) - 1).cast("int")).drop("_raw", "_step", "_len")


def track_pieces(points: DataFrame, metres: float = PIECE_M, key: str = "track") -> DataFrame:
    """Each part cut into the fewest equal pieces of at most ``metres``: ``(track, part, piece, from_m, to_m)``. Lengths count to
    the micrometre here, as what a sum of steps is off by must not add a piece."""
    whole = pieces(points, (key, "part")).where("last").select(key, "part", "part_m")
    n = F.greatest(F.lit(1), F.ceil(F.round("part_m", 6) / metres)).cast("int")
    each = whole.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select(key, "part", "piece", (F.col("part_m") * F.col("piece") / F.col("n")).alias("from_m"), (F.col("part_m") * (F.col("piece") + 1) / F.col("n")).alias("to_m"))


def straight_pieces(points: DataFrame, key: str = "track") -> DataFrame:
    """The parts' straight pieces, what the distance join takes."""
    return pieces(points, (key, "part"))


def classify(tracks: DataFrame, fixes: DataFrame, boxes: DataFrame, key: str = "track") -> DataFrame:
    """``(track, status, network_id)``: ``no_gps`` with fewer than two fixes, ``city`` with a fix in any network's box, of
    which the lowest id counts, else ``outside``. Lines between fixes do not count.

    ``boxes`` has ``network_id`` and four corners in order as ``corners array<struct<x,y>>``: a fix is inside if it is
    on one side of all four edges. It is one row for each network, and broadcast; more than ``FEW_BOXES`` meet the fixes
    by the cells that they reach.
    """
    inside_left, inside_right = F.lit(True), F.lit(True)
    for i in range(4):
        a, b = F.get("corners", F.lit(i)), F.get("corners", F.lit((i + 1) % 4))
        side = (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"])
        inside_left, inside_right = inside_left & (side >= 0), inside_right & (side <= 0)
    if boxes.count() <= FEW_BOXES:
        met = fixes.join(F.broadcast(boxes), inside_left | inside_right, "left")
    else:
        cell = lambda x: F.floor(x / CELL_M)
        reach = lambda v: F.sequence(cell(F.array_min(F.transform("corners", lambda c: c[v]))), cell(F.array_max(F.transform("corners", lambda c: c[v]))))
        cells = boxes.withColumn("_cx", F.explode(reach("x"))).withColumn("_cy", F.explode(reach("y")))
        placed = fixes.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
        met = placed.join(cells, (placed["_cx"] == cells["_cx"]) & (placed["_cy"] == cells["_cy"]) & (inside_left | inside_right), "left")
    hit = met.groupBy(key).agg(F.count_distinct("seq").alias("fixes"), F.min("network_id").alias("network_id"))
    joined = tracks.select(key).join(hit, key, "left")
    few = F.coalesce("fixes", F.lit(0)) < 2
    status = F.when(few, "no_gps").when(F.col("network_id").isNull(), "outside").otherwise("city")
    return joined.select(key, status.alias("status"), F.when(~few, F.col("network_id")).alias("network_id"))


def box_corners(extents: DataFrame) -> DataFrame:
    """The corners of extents ``x_min, y_min, x_max, y_max``."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return extents.withColumn("corners", F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max")))


def sync_window(latest: Column, today: Column, backfill: Column, overlap_days: int = 7, zone: str = "America/New_York") -> tuple[Column, Column]:
    """From the backfill start if nothing is stored, else ``overlap_days`` before the newest run's local date, to today."""
    return F.coalesce(F.date_sub(F.to_date(F.from_utc_timestamp(latest, zone)), overlap_days), backfill), today


def month_windows(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each calendar month of the inclusive range, cut to it; none if start is after end."""
    rows = df.where(F.col(start) <= F.col(end)).withColumn("_m", F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))))
    return rows.withColumn("from_date", F.greatest(start, "_m")).withColumn("to_date", F.least(F.col(end), F.last_day("_m"))).drop("_m")


def sample_share(parts: DataFrame, others: DataFrame, reach: float, every: float = 5.0, key: str = "id") -> DataFrame:
    """``(id, share)``: of points at most ``every`` metres apart on each line, both ends included, the part within
    ``reach`` of a piece of ``others``."""
    from pathloom.operators.spatial import near

    points = even_points(parts, every, (key, "part")).select(key, "x", "y")
    close = near(points.select("x", "y").distinct(), others.select("x1", "y1", "x2", "y2").distinct(), reach).select("x", "y").distinct().withColumn("near", F.lit(1.0))
    return points.join(close, ["x", "y"], "left").groupBy(key).agg(F.avg(F.coalesce("near", F.lit(0.0))).alias("share"))
