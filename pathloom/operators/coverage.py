"""The coverage map: whole segments by state, or runs of intervals that are run or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import feature_pieces, line_length, lines, piece_lines, simplify, substrings
from pathloom.operators.matching import intervals

TWIN = "second carriageway"


def islands(rows: DataFrame, keys: list[str], state: str, a: str = "a", b: str = "b") -> DataFrame:
    """Consecutive rows of one state as one: ``(*keys, state, a, b)``; ``a`` minus the row number within the state is
    the same along a run."""
    g = F.col(a) - F.row_number().over(Window.partitionBy(*keys, state).orderBy(a))
    return rows.withColumn("_g", g).groupBy(*keys, state, "_g").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("_g")


def states(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``segments``, less second carriageways, with ``nodes_total``, ``nodes_hit`` and ``state`` (null: cut into runs)."""
    seen = nodes.groupBy(F.col("segment_id").alias("id")).agg(F.count("*").alias("nodes_total"), F.count("hit_at").alias("nodes_hit"))
    shown = segments.where(~F.col("uncounted_reason").eqNullSafe(TWIN)).join(seen, "id", "left").fillna(0, ["nodes_total", "nodes_hit"])
    state = F.when(~F.col("counted") | (F.col("nodes_total") == 0), "uncounted").when(F.col("excluded"), "excluded").when((F.col("layer") == "cartpath") & (F.col("nodes_hit") == F.col("nodes_total")), "complete")
    return shown.withColumn("state", state)


def interval_runs(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(segment_id, part, state, a, b, n)``: runs of intervals of the segments that are cut."""
    cut = states(segments, nodes).where("state is null").select(F.col("id").alias("segment_id"))
    each = intervals(nodes).join(cut, "segment_id", "left_semi").withColumn("state", F.when(F.col("run"), "run").otherwise("not_run"))
    return islands(each, ["segment_id", "part", "n"], "state")


def coverage(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each feature of the map, with its line, its length and what is known of its segment."""
    about = states(segments, nodes)
    runs = interval_runs(segments, nodes)
    bounds = runs.select(F.col("segment_id").alias("id"), "part", F.struct("state", "a").alias("cut"), (F.col("a").cast("double") / F.col("n")).alias("a"), (F.col("b").cast("double") / F.col("n")).alias("b"))
    parts = feature_pieces(segments.select("id", "geom"))
    lines = piece_lines(substrings(parts, bounds), ["id", "part", "cut"])
    cut = lines.select("id", F.col("cut.state").alias("_s"), F.array("line").alias("shape"), F.col("length_m").alias("piece_m"))
    keep = [x for x in about.columns if x not in ("state", "geom")]
    pieces = about.drop("state").join(cut, "id").select(*keep, F.col("_s").alias("state"), "shape", "piece_m")
    whole = about.where("state is not null").select(*keep, "state", F.col("geom").alias("shape"), F.col("length_m").alias("piece_m"))
    return pieces.unionByName(whole)


def activities_layer(points: DataFrame, runs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``(run, start_at, lines, length_m)``: each run's split track as lines, simplified for display by ``tolerance`` metres;
    the length is that of the whole track. ``points`` has ``track, part, seq, x, y``, ``runs`` ``run, start_at``."""
    each = lines(points, ["track", "part"])
    each = each.select(F.col("track").alias("run"), "part", simplify(F.col("line"), tolerance).alias("line"), line_length(F.col("line")).alias("m"))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"])
    return each.groupBy("run").agg(shape.alias("lines"), F.sum("m").alias("length_m")).join(runs.select("run", "start_at").distinct(), "run").select("run", "start_at", "lines", "length_m")
