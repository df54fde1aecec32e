"""Refresh of layers whose signature changed: import, nodes, graph, and a report of what that did."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators import clean, coverage, graph, health
from pathloom.operators.runindex import RunIndex
from pathloom.plans import network

LABELS = {"cartpath": "cart paths", "road": "roads"}
#: Lines of a list in a report; the rest is a count.
CAP = 25
#: The place of the first line on what changed in all.
IMPACT = 1_000_000_000


@dataclass
class State:
    """Segments, their nodes with hits, the graph of them, and ``(layer, dropped_key, canonical_key)`` of copies left out."""

    segments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vertices: DataFrame
    copies: DataFrame | None = None


@dataclass
class Exclusions:
    """What is not to be counted: ``by_key`` (layer, key, name, reason) and ``by_name`` (layer, name, reason)."""

    by_key: DataFrame
    by_name: DataFrame


@dataclass
class Refreshed:
    """The new state and signatures, which the caller publishes together, and the report's lines ``(place, line)``."""

    state: State
    signatures: DataFrame
    report: DataFrame
    layers: list[str]


def snapshot(state: State) -> DataFrame:
    """One row: completion, counted segments and metres of each layer, second carriageways, components and islands."""
    s = state.segments
    counted = F.col("counted") & ~F.col("excluded")
    of = lambda layer: counted & (F.col("layer") == layer)
    sums = [x for k in LABELS for x in (F.count_if(of(k)).alias(f"{k}_n"), F.coalesce(F.sum(F.when(of(k), F.col("length_m"))), F.lit(0.0)).alias(f"{k}_m"))]
    about = s.agg(*sums, F.count_if(F.col("uncounted_reason") == coverage.TWIN).alias("second"))
    report = graph.graph_report(state.edges, state.vertices).select("components", "islands")
    return about.crossJoin(network.completion(s, state.nodes)).crossJoin(report)  # a row each


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(place, line)``: what changed from one snapshot to the other."""
    mi = lambda side, c: F.format_string("%.2f", F.col(f"{side}.{c}") / 1609.344)
    n = lambda side, c: F.col(f"{side}.{c}").cast("string")
    pct = lambda side: F.format_string("%.1f%%", F.col(f"{side}.cartpath_pct"))
    both = lambda f, c: F.concat(f("b", c), F.lit(" -> "), f("a", c))
    lines = [F.lit("impact (before -> after):")]
    lines.append(F.concat(F.lit("  cart path miles complete: "), both(mi, "cartpath_complete_m"), F.lit(" of "), both(mi, "cartpath_total_m"), F.lit(" mi ("), pct("b"), F.lit(" -> "), pct("a"), F.lit(")")))
    lines.append(F.concat(F.lit("  segments complete: "), n("b", "cartpath_complete"), F.lit(" of "), n("b", "cartpath_total"), F.lit(" -> "), n("a", "cartpath_complete"), F.lit(" of "), n("a", "cartpath_total")))
    lines.append(F.concat(F.lit("  road miles covered: "), mi("b", "road_covered_m"), F.lit(" of "), mi("b", "road_total_m"), F.lit(" -> "), mi("a", "road_covered_m"), F.lit(" of "), mi("a", "road_total_m"), F.lit(" mi")))
    for k, label in LABELS.items():
        lines.append(F.concat(F.lit(f"  counted {label}: "), n("b", f"{k}_n"), F.lit(" ("), mi("b", f"{k}_m"), F.lit(" mi) -> "), n("a", f"{k}_n"), F.lit(" ("), mi("a", f"{k}_m"), F.lit(" mi)")))
    lines.append(F.concat(F.lit("  second carriageways: "), both(n, "second")))
    lines.append(F.concat(F.lit("  graph: "), both(n, "components"), F.lit(" components, "), both(n, "islands"), F.lit(" islands")))
    pair = before.select(F.struct("*").alias("b")).crossJoin(after.select(F.struct("*").alias("a")))  # a row each
    return pair.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def change_lists(changed: DataFrame, cap: int = CAP) -> DataFrame:
    """``(layer, change, place, line)`` of ``(layer, change, oid, name, seg_type, length_m)``: for each layer's added,
    changed and removed segments the first ``cap`` by object id and how many more there are. The cap is the report's own."""
    text = F.concat(F.lit("    "), F.col("oid").cast("string"), F.lit(" "), F.coalesce("name", F.lit("(no name)")), F.lit(" ("), F.coalesce("seg_type", F.lit("?")), F.lit(", "), F.format_string("%.0f", "length_m"), F.lit(" m)"))
    keys = ["layer", "change"]
    first = changed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("oid"))).where(F.col("place") <= cap).select(*keys, "place", text.alias("line"))
    counts = changed.groupBy(*keys).agg(F.count("*").alias("n"))
    title = counts.select(*keys, F.lit(0).alias("place"), F.concat(F.lit("  "), F.col("change"), F.lit(":")).alias("line"))
    more = counts.where(F.col("n") > cap).select(*keys, F.lit(cap + 1).alias("place"), F.concat(F.lit("    … and "), (F.col("n") - cap).cast("string"), F.lit(" more")).alias("line"))
    return title.unionByName(first).unionByName(more)


def import_lines(got: network.Imported, layer: str, segments: DataFrame, nodes: DataFrame, settings: network.Settings, warnings: DataFrame | None, cap: int = CAP) -> DataFrame:
    """``(place, line)``: what an import kept, left out and could not place, one count or list a line, then the warnings
    of exclusions. ``segments`` and ``nodes`` are those of the new state; lists are cut at ``cap`` with how many more there are."""
    own = segments.where(F.col("layer") == layer)
    counted = F.col("counted") & ~F.col("excluded")
    their_nodes = nodes.join(own.select(F.col("id").alias("segment_id")), "segment_id", "left_semi").agg(F.count("*").alias("nodes"))
    sums = own.agg(F.count("*").alias("stored"), F.count_if(counted).alias("counted"), F.coalesce(F.sum(F.when(counted, F.col("length_m"))), F.lit(0.0)).alias("m"), F.count_if("excluded").alias("excluded")).crossJoin(their_nodes)  # a row each
    text = lambda c: F.col(c).cast("string")
    about = sums.select(F.lit(0).alias("place"), F.concat(F.lit("  stored "), text("stored"), F.lit(", counted "), text("counted"), F.format_string(" (%.2f mi)", F.col("m") / 1609.344), F.lit(", excluded "), text("excluded"), F.lit(", nodes "), text("nodes")).alias("line"))
    oids = {
        "without geometry": got.no_geometry.select(F.col("oid").cast("string").alias("what"), F.col("oid").alias("by")),
        "slivers": got.slivers.select(F.concat(text("oid"), F.format_string(" (%.2f m)", "length_m")).alias("what"), F.col("oid").alias("by")),
        "duplicates": got.duplicates.select(F.concat(text("oid"), F.lit(" of "), text("kept_oid")).alias("what"), F.col("oid").alias("by")),
        "second carriageways": own.join(got.twins.select(F.col("key").alias("source_key")), "source_key", "left_semi").select(text("source_oid").alias("what"), F.col("source_oid").alias("by")),
        "parts without nodes": clean.tiny_parts(own, settings.min_part).join(own.select("id", "source_oid"), "id").select(F.concat(text("source_oid"), F.lit(" part "), text("part"), F.format_string(" (%.2f m)", "part_m")).alias("what"), F.col("source_oid").alias("by")),
        "segments without nodes": clean.nodeless(own, nodes).select(text("source_oid").alias("what"), F.col("source_oid").alias("by")),
    }
    lines = about
    for k, (name, rows) in enumerate(oids.items()):
        some = rows.orderBy("by", "what").limit(cap)
        first = some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("by", "what"))), lambda r: r["what"]), ", ").alias("list"))
        said = rows.agg(F.count("*").alias("n")).crossJoin(first).where("n > 0")  # a row each
        more = F.when(F.col("n") > cap, F.concat(F.lit(", … and "), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
        lines = lines.unionByName(said.select(F.lit(k + 1).alias("place"), F.concat(F.lit(f"  {name} "), text("n"), F.lit(": "), F.col("list"), more).alias("line")))
    if warnings is not None:
        mine = warnings.where(F.col("layer") == layer).withColumn("rn", F.row_number().over(Window.partitionBy("layer").orderBy("key", "warning")))  # entries of a settings file
        lines = lines.unionByName(mine.select((F.lit(len(oids)) + F.col("rn")).cast("int").alias("place"), F.concat(F.lit("  warning: "), F.col("warning"), F.lit(" exclusion "), F.col("key")).alias("line")))
    return lines


def headline(layers: list[str], counts: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(line)``: how many segments each layer added, changed and lost, or when unchanged layers were last edited."""
    label = lambda of: F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), of)
    if not layers:
        edit = F.concat(label(F.col("layer")), F.lit(" last edited "), F.coalesce(F.to_date("max_edited_at").cast("string"), F.lit("never")))
        return signatures.where(F.col("layer").isin(*LABELS)).agg(F.concat(F.lit("layers unchanged ("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", edit.alias("t")))), lambda x: x["t"]), ", "), F.lit(")")).alias("line"))
    n = lambda change: F.count_if(F.col("change") == change).cast("string")
    per = counts.groupBy("layer").agg(F.concat(n("added"), F.lit(" added, "), n("changed"), F.lit(" changed, "), n("removed"), F.lit(" removed")).alias("t"))
    names = counts.sparkSession.createDataFrame([(k, k in layers) for k in LABELS], "layer string, done boolean")
    said = names.join(per, "layer", "left").withColumn("t", F.concat(label(F.col("layer")), F.lit(": "), F.when(F.col("done"), F.coalesce("t", F.lit("0 added, 0 changed, 0 removed"))).otherwise("unchanged")))
    return said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "t"))), lambda x: x["t"]), "; ").alias("line"))


def changed_segments(stored: DataFrame, imported: network.Imported, layer: str) -> DataFrame:
    """``(layer, change, oid, name, seg_type, length_m)`` of an import, removed ones as they were stored."""
    about = lambda df, change: df.join(imported.changes.where(change), "key", "left_semi")
    new, old = imported.segments.withColumnRenamed("source_key", "key"), stored.withColumnRenamed("source_key", "key")
    kinds = imported.changes.where("change in ('added', 'changed')")
    here = new.join(kinds, "key").select("change", F.col("source_oid").alias("oid"), "name", "seg_type", "length_m")
    gone = about(old, "change = 'removed'").select(F.lit("removed").alias("change"), F.col("source_oid").alias("oid"), "name", "seg_type", "length_m")
    return here.unionByName(gone).select(F.lit(layer).alias("layer"), "*")


def refresh(
    now: DataFrame, stored: DataFrame, load: Callable[[str], DataFrame], state: State, settings: network.Settings = network.Settings(), forced: bool = False, at=None,
    runs: RunIndex | None = None, exclusions: Exclusions | None = None,
) -> Refreshed:
    """Import each layer whose signature ``now (layer, feature_count, max_oid, max_edited_at)`` differs from ``stored``.

    ``load(layer)`` gives its features. A download of another number of features than its signature has is refused, as
    a lost page would mark real segments as removed. New and changed segments get new nodes, which are matched with
    the stored ``runs`` that pass near them; without an index they have no hits. ``exclusions`` are applied anew to
    all layers, so entries that are gone count again; without them segments keep what was excluded. Nothing is
    published here: the new signatures are given back with
    the new state once all of it could be made, so after a failure the old ones still stand and the next run tries again.
    """
    stale = {r["layer"]: r["feature_count"] for r in health.stale_layers(now, stored, forced).collect() if r["layer"] in LABELS}  # a row a layer
    if not stale:
        return Refreshed(state, stored, headline([], now, now).select(F.lit(0).alias("place"), "line"), [])
    spark = state.segments.sparkSession
    copies = state.copies if state.copies is not None else spark.createDataFrame([], "layer string, dropped_key string, canonical_key string")
    segments, changed, moved, imports = state.segments, None, None, {}
    for layer, expected in stale.items():
        old = state.segments.where(F.col("layer") == layer)
        got = imports[layer] = network.import_layer(load(layer), old, layer, settings, at, expected)
        rows = changed_segments(old, got, layer)
        changed = rows if changed is None else changed.unionByName(rows)
        keys = got.segments.join(got.changes.where("change in ('added', 'changed')").withColumnRenamed("key", "source_key"), "source_key", "left_semi").select("id")
        moved = keys if moved is None else moved.unionByName(keys)
        segments = segments.where(F.col("layer") != layer).unionByName(got.segments.select(*[c for c in got.segments.columns if c in segments.columns]), allowMissingColumns=True)
        copies = copies.where(F.col("layer") != layer).unionByName(got.duplicates.select(F.lit(layer).alias("layer"), F.col("key").alias("dropped_key"), F.col("kept_key").alias("canonical_key")))
    warnings = None
    if exclusions is not None:
        segments, warnings = clean.apply_exclusions(segments, exclusions.by_key, exclusions.by_name, copies)
        warnings = warnings.checkpoint()
    segments, changed, moved, copies = segments.checkpoint(), changed.checkpoint(), moved.checkpoint(), copies.checkpoint()
    about = segments.join(moved, "id", "left_semi")
    fresh = network.make_nodes(about, settings).checkpoint()
    fresh = network.match_changed(fresh, about, runs, settings) if runs is not None else fresh.withColumns({"hit_at": F.lit(None).cast("timestamp"), "hit_run": F.lit(None).cast("long")})
    nodes = network.keep_nodes(state.nodes, fresh, moved).join(segments.where("counted").select(F.col("id").alias("segment_id")), "segment_id", "left_semi").checkpoint()
    after = State(segments, nodes, *graph.build_graph(segments, settings.graph), copies)
    lists = change_lists(changed)
    base = lambda i: 10_000_000 * (i + 1)  # noqa: E731  a layer's lines, by place
    heads = spark.createDataFrame([(base(i), f"{label}:") for i, (layer, label) in enumerate(LABELS.items()) if layer in stale], "place long, line string")
    order = F.array_position(F.array(*map(F.lit, ("added", "changed", "removed"))), F.col("change"))
    layer_at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("layer"))
    placed = lists.select((10_000_000 * layer_at + 1000 * order + F.col("place")).cast("long").alias("place"), "line")
    for i, layer in enumerate(LABELS):
        if layer in stale:
            own = import_lines(imports[layer], layer, segments, nodes, settings, warnings)
            placed = placed.unionByName(own.select((F.lit(base(i) + 10_000) + F.col("place")).cast("long").alias("place"), "line"))
    last = impact(snapshot(state), snapshot(after)).select((F.col("place") + IMPACT).cast("long").alias("place"), "line")
    first = headline(list(stale), changed, now).select(F.lit(0).cast("long").alias("place"), "line")
    return Refreshed(after, now, first.unionByName(heads).unionByName(placed).unionByName(last), list(stale))
