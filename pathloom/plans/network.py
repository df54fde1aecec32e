"""The engine's entry points: import a layer, take in tracks, recompute, and what a client asks for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geometry import even_points, feature_length, feature_pieces, shape_hash
from pathloom.operators import clean, coverage, graph, health, matching, routing, tracks
from pathloom.operators.numbering import number_rows
from pathloom.operators.runindex import RunIndex


@dataclass(frozen=True)
class Settings:
    """A network's tunables, in metres and hours."""

    node_spacing: float = 20.0
    min_segment: float = 1.0
    min_part: float = 1.0
    grid: float = 0.01
    gap: float = 100.0
    path_end: float = 10.0
    path: float = 10.0
    road: float = 20.0
    wide: float = 30.0
    wide_types: tuple[str, ...] = ("Arterial", "Collector")
    divided: tuple[str, ...] = ()
    click: float = 50.0
    stale_hours: float = 36.0
    graph: graph.GraphSettings = field(default_factory=graph.GraphSettings)

    @property
    def reach(self) -> float:
        return max(self.path_end, self.path, self.road, self.wide)


@dataclass
class Imported:
    """What an import gives: the layer's new segments, and its findings as DataFrames."""

    segments: DataFrame
    slivers: DataFrame
    duplicates: DataFrame
    twins: DataFrame
    changes: DataFrame
    no_geometry: DataFrame


def import_layer(features: DataFrame, stored: DataFrame | None, layer: str, settings: Settings = Settings(), at=None, expected: int | None = None) -> Imported:
    """Features ``(key, oid, name, seg_type, counted, uncounted_reason, geom)`` as the layer's segments.

    Refuses an empty download, one of another number of features than ``expected``, and repeated keys. Features without geometry and slivers go, of equal shapes the lowest
    object id stays, the second carriageway of a divided road is no longer counted. Ids and exclusions of stored keys
    stay; a change is marked unless this is the layer's first import.
    """
    if features.isEmpty():
        raise RuntimeError(f"{layer}: no features; refusing to import")
    if expected is not None and (n := features.count()) != expected:
        raise RuntimeError(f"{layer}: {n} features, but the service reports {expected}; refusing a partial import")
    if not clean.repeated_keys(features, "key").isEmpty():
        raise RuntimeError(f"{layer}: repeated keys")
    there, missing = clean.with_geometry(features)
    empty = missing.select("oid")
    good = there.withColumn("length_m", feature_length(F.col("geom"))).withColumn("geom_hash", shape_hash(F.col("geom"), settings.grid))
    slivers = good.where(F.col("length_m") < settings.min_segment).select("oid", "name", "length_m")
    ranked = clean.duplicates(good.where(F.col("length_m") >= settings.min_segment), "geom_hash", "oid", ["oid", "key"]).checkpoint()
    copies = ranked.where("rn > 1").select("oid", "key", "kept_oid", "kept_key")
    kept = ranked.where("rn = 1").drop("rn", "kept_oid", "kept_key")
    twins = clean.second_carriageways(kept, list(settings.divided)) if layer == "road" and settings.divided else kept.limit(0).select("key")
    twins = twins.checkpoint()
    kept = kept.join(twins.withColumn("_twin", F.lit(True)), "key", "left").withColumn("counted", F.col("counted") & F.col("_twin").isNull()).withColumn("uncounted_reason", F.when(F.col("_twin"), coverage.TWIN).otherwise(F.col("uncounted_reason"))).drop("_twin").checkpoint()
    first = stored is None or stored.isEmpty()
    if first:
        change = kept.select("key", F.lit("added").alias("change"))
        segments = number_rows(kept, ["key"]).withColumn("city_change", F.lit(None).cast("string")).withColumn("changed_at", F.lit(None).cast("timestamp"))
        segments = segments.withColumns({"excluded": F.lit(False), "exclusion_reason": F.lit(None).cast("string")})
    else:
        old = stored.withColumnRenamed("source_key", "key")
        change = clean.changes(old, kept, "key", ["geom_hash", "counted"])
        ids = old.select("key", F.col("id").alias("_id"), F.col("city_change").alias("_c"), F.col("changed_at").alias("_at"), F.col("excluded").alias("_x"), F.col("exclusion_reason").alias("_why"))
        top = old.agg(F.max("id").alias("_top"))
        known = kept.join(ids, "key", "left").join(change, "key")
        fresh = number_rows(known.where("_id is null"), ["key"]).crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("_top")).drop("_top")  # one row
        marked = known.where("_id is not null").withColumn("id", F.col("_id")).unionByName(fresh)
        moved = F.col("change").isin("added", "changed")
        segments = marked.withColumn("city_change", F.when(moved, F.col("change")).otherwise(F.col("_c"))).withColumn("changed_at", F.when(moved, F.current_timestamp() if at is None else at).otherwise(F.col("_at")))
        segments = segments.withColumns({"excluded": F.coalesce("_x", F.lit(False)), "exclusion_reason": F.col("_why")}).drop("_id", "_c", "_at", "_x", "_why", "change")
    segments = segments.withColumn("layer", F.lit(layer)).withColumnRenamed("key", "source_key").withColumnRenamed("oid", "source_oid")
    return Imported(segments, slivers, copies, twins, change, empty)


def make_nodes(segments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Nodes of counted segments' parts of at least the least length, with their radius and no hits."""
    parts = feature_pieces(segments.where("counted")).where(F.col("part_m") >= settings.min_part)
    nodes = even_points(parts, settings.node_spacing).withColumnRenamed("id", "segment_id")
    return matching.assign_radii(nodes, segments, settings.path_end, settings.path, settings.road, settings.wide, list(settings.wide_types), list(settings.divided))


def keep_nodes(nodes: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes of unchanged segments as they are, with the ``fresh`` ones of added and changed segments."""
    gone = changed.select(F.col("id").alias("segment_id"))
    return nodes.join(gone, "segment_id", "left_anti").unionByName(fresh.join(gone, "segment_id", "left_semi"), allowMissingColumns=True)


def runs_of(points: DataFrame, activities: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Straight pieces of the tracks, split at gaps, with the run's start and network: what matching takes."""
    about = activities.select(F.col("track"), "start_at", *[c for c in ("network_id",) if c in activities.columns])
    return tracks.straight_pieces(tracks.split_track(points, settings.gap)).join(about, "track").withColumnRenamed("track", "run")


def recompute(segments: DataFrame, points: DataFrame, activities: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All hits from segments and tracks anew: nodes with ``hit_at`` and ``hit_run``."""
    return matching.match(make_nodes(segments, settings), segments, runs_of(points, activities, settings), settings.reach)


def match_changed(nodes: DataFrame, segments: DataFrame, index: RunIndex, settings: Settings = Settings()) -> DataFrame:
    """The nodes of a few segments with their hits of all stored runs, of which only those near the nodes are read."""
    found = index.near(nodes).checkpoint()
    return matching.match(nodes, segments, found, settings.reach)


def completion(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    parts = feature_pieces(segments).where("last").select(F.col("id").alias("segment_id"), "part", "part_m")
    return matching.metrics(nodes, segments, parts)


def stats(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    per = nodes.groupBy(F.col("segment_id").alias("id")).agg(F.count("*").alias("nodes"), F.count("hit_at").alias("hit"))
    return segments.join(per, "id", "left").groupBy("layer").agg(F.count("*").alias("segments"), F.count_if(F.expr("counted and not excluded")).alias("counted"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"))


def latest_changes(segments: DataFrame) -> DataFrame:
    """Segments marked by each layer's latest import that changed anything."""
    last = segments.groupBy("layer").agg(F.max("changed_at").alias("changed_at"))
    return segments.join(last, ["layer", "changed_at"], "left_semi")


def status(jobs: DataFrame, now, settings: Settings = Settings()) -> DataFrame:
    return health.problem(health.source_health(jobs, now, settings.stale_hours))


def route_leg(requests: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return routing.legs(requests, edges, settings.click)


coverage_map = coverage.coverage
near_misses = matching.near_misses
build_graph = graph.build_graph
finish_routes = routing.finish_routes
new_ground = routing.new_ground
