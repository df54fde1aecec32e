"""Steps of the import, the graph's build and the tracks' intake, one query each."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom import adapters as ad
from pathloom.catalog.network import GRID_SQL, LATLON, UP, built, grid, latlon
from pathloom.catalog.registry import query, table
from pathloom.functions import geometry as g
from pathloom.operators import clean, cues, graph, routing, spatial, tracks
from pathloom.operators.components import shared_folder
from pathloom.plans import network as plans
from pathloom.sources import features
from pathloom.streaming import updates


def straight(x1, y1, x2, y2):
    """A feature of one part of two points."""
    return F.array(F.array(g.point(x1, y1), g.point(x2, y2)))


@query("SELECT event_id AS id, event_type AS type, ts AS start_at FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 23:59:59'")
def s3_listing(spark, d):
    return features.listing(table(spark, d, "events"), "ts", "2024-01-10", "2024-01-20").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("start_at"))


@query(f"WITH {ad.SEG} SELECT layer, count(*) FILTER (length_m >= 100) AS long, count(*) FILTER (length_m < 40) AS short, 'unknown setting colour' AS warning FROM seg GROUP BY layer")
def s7_settings(spark, d):
    """Segments counted by two of a network's settings; a setting that nobody knows is a warning."""
    found, warnings = features.load_settings("city: {long_m: 100, short_m: 40, colour: red}\nother: {long_m: 1}", "city", {"long_m", "short_m"})
    m = F.col("length_m")
    return ad.seg(spark, d).groupBy("layer").agg(F.count_if(m >= found["long_m"]).alias("long"), F.count_if(m < found["short_m"]).alias("short")).withColumn("warning", F.lit(", ".join(warnings)))


@query(f"WITH {ad.SEG} SELECT id FROM seg WHERE id % 6 IN (0, 1)")
def f3_without_geometry(spark, d):
    """Features whose geometry is null or has no parts are set aside and reported."""
    k = F.col("id") % 6
    rows = ad.seg(spark, d).withColumn("geom", F.when(k == 0, F.lit(None)).when(k == 1, F.slice("geom", 1, 0)).otherwise(F.col("geom")))
    return clean.with_geometry(rows)[1].select("id")


@query("SELECT s_suppkey AS request, CASE WHEN s_suppkey % 4 = 0 THEN 'latitude or longitude out of range' WHEN s_suppkey % 4 = 1 THEN 'fewer than 2 points' END AS problem FROM supplier")
def f12_requests(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("request"), F.explode(F.sequence(F.lit(1), F.when(k % 4 == 1, 1).otherwise(2))).alias("seq"))
    points = s.withColumn("lat", F.when((F.col("request") % 4 == 0) & (F.col("seq") == 2), 91.0).otherwise(40.0)).withColumn("lon", F.lit(-84.0))
    return routing.check_requests(points)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05")
def f13_between(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_discount").between(0.03, 0.05)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f14_any(spark, d):
    own = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).join(own, "o_custkey", "left_semi").select("o_orderkey")


@query(f"WITH {ad.SEG}, {ad.NODE} SELECT id, count(node.seq) AS nodes FROM seg LEFT JOIN node ON segment_id = id GROUP BY id")
def j3_node_counts(spark, d):
    per = ad.node(spark, d).groupBy(F.col("segment_id").alias("id")).agg(F.count("*").alias("nodes"))
    return ad.seg(spark, d).select("id").join(per, "id", "left").fillna(0, ["nodes"])


@query(f"WITH {ad.SEG} SELECT id, 'tiny part' AS finding FROM seg WHERE counted AND length_m < 60 UNION ALL SELECT id, 'no nodes' FROM seg WHERE counted AND length_m < 60")
def d7_tiny_parts(spark, d):
    """Parts too short for nodes, and counted segments left without any."""
    s = ad.seg(spark, d)
    parts = g.feature_pieces(s.where("counted"))
    nodes = g.even_points(parts.where("part_m >= 60"), ad.SPACING).withColumnRenamed("id", "segment_id")
    tiny, bare = clean.tiny_parts(s, 60.0), clean.nodeless(s, nodes)
    return tiny.select("id", F.lit("tiny part").alias("finding")).unionByName(bare.select("id", F.lit("no nodes").alias("finding")))


@query("SELECT a.n_nationkey AS a, a.n_nationkey + 1 AS b FROM nation a WHERE a.n_nationkey % 3 <> 2 AND a.n_nationkey < 24 UNION ALL SELECT n_nationkey, n_nationkey + 100 FROM nation")
def j9_touching(spark, d):
    """Lines in a row, three to a name, each beginning where the last one ends, and one across the middle of each."""
    k = F.col("n_nationkey")
    t = table(spark, d, "nation")
    rows = t.select(k.alias("key"), F.floor(k / 3).alias("name"), straight(k * 50, k * 0, k * 50 + 50, k * 0).alias("geom"))
    over = t.select((k + 100).alias("key"), F.floor(k / 3).alias("name"), straight(k * 50 + 25, k * 0 - 10, k * 50 + 25, k * 0 + 10).alias("geom"))
    return clean.touching(rows.unionByName(over), ("name",)).where("key < other").select(F.col("key").alias("a"), F.col("other").alias("b"))


@query(f"SELECT s_suppkey + {UP} AS key FROM supplier")
def d3_twins(spark, d):
    """Pairs of carriageways 15 m apart, the second one the other way: of each pair the later is a twin."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier")
    one = t.select(k.alias("key"), straight(k * 1000, k * 0, k * 1000 + 200, k * 0).alias("geom"))
    two = t.select((k + UP).alias("key"), straight(k * 1000 + 200, k * 0 + 15, k * 1000, k * 0 + 15).alias("geom"))
    roads = one.unionByName(two).select("key", F.col("key").alias("oid"), F.lit("Div").alias("name"), F.lit(True).alias("counted"), F.lit(200.0).alias("length_m"), "geom")
    return clean.second_carriageways(roads, ["Div"])


@query(f"""WITH {ad.SEG}, k AS (SELECT id, length_m, row_number() OVER (PARTITION BY x0, y, length_m ORDER BY id) AS rn FROM seg WHERE length_m >= 40)
 SELECT CAST(id AS VARCHAR) AS source_key, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS id, length_m FROM k WHERE rn = 1""")
def d1_import(spark, d):
    f = ad.seg(spark, d).select(F.col("id").cast("string").alias("key"), F.col("id").alias("oid"), "name", "seg_type", "counted", "uncounted_reason", "geom")
    return plans.import_layer(f, None, "road", plans.Settings(min_segment=40.0)).segments.select("source_key", "id", "length_m")


@query(f"WITH {ad.SEG}, {ad.NODE} SELECT segment_id, CAST(seq AS BIGINT) AS seq, CASE WHEN segment_id % 3 = 0 THEN 'new' ELSE 'old' END AS made FROM node")
def d6_regenerate(spark, d):
    """Nodes of changed segments are made again, others stay."""
    nodes, s = ad.node(spark, d), ad.seg(spark, d)
    return plans.keep_nodes(nodes.withColumn("made", F.lit("old")), nodes.withColumn("made", F.lit("new")), s.where("id % 3 = 0")).select("segment_id", "seq", "made")


@query(f"WITH {ad.SEG} SELECT id, CASE WHEN layer = 'cartpath' THEN 'private' ELSE 'gated' END AS reason FROM seg WHERE (layer = 'cartpath' AND id = 4) OR (layer = 'road' AND (id = 7 OR upper(name) = 'ROAD 3'))")
def d10_exclusion_file(spark, d):
    """An exclusion file's entries, by key and by name, over the segments that they mean."""
    text = "cartpaths: [{global_id: '{4}', reason: private}]\nroads: [{object_id: 7, reason: gated}, {name: ' road 3', reason: gated}]"
    rows = spark.createDataFrame(features.load_exclusions(text), "layer string, key string, name string, reason string").withColumn("key", F.regexp_replace("key", "[{}]", ""))
    seg = ad.seg(spark, d).withColumn("source_key", F.col("id").cast("string"))
    none = spark.createDataFrame([], "layer string, dropped_key string, canonical_key string")
    out, _ = clean.apply_exclusions(seg, rows.where("key is not null"), rows.where("key is null"), none)
    return out.where("excluded").select("id", F.col("exclusion_reason").alias("reason"))


@query(f"WITH {ad.SEG}, s AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(id % 5 AS INTEGER)) AS changed_at FROM seg), m AS (SELECT layer, max(changed_at) AS changed_at FROM s GROUP BY layer) SELECT layer, id, changed_at FROM s JOIN m USING (layer, changed_at)")
def v5_changes(spark, d):
    at = F.timestamp_add("DAY", (F.col("id") % 5).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return plans.latest_changes(ad.seg(spark, d).withColumn("changed_at", at)).select("layer", "id", "changed_at")


@query(f"WITH {GRID_SQL} SELECT id, 700.0::DOUBLE AS part_m FROM line")
def b1_parts(spark, d):
    return graph.graph_parts(grid(spark, d)).where("k = 0").select("id", "part_m")


@query(f"WITH {GRID_SQL} SELECT id, round(i / 7.0::DOUBLE, 6) AS f FROM inner_cut WHERE r IN (0, 7)")
def b2_end_cuts(spark, d):
    return graph.t_cuts(graph.graph_parts(grid(spark, d)), 3.0).select(F.col("pid.id").alias("id"), "f")


@query(f"WITH {GRID_SQL} SELECT id, round(i / 7.0::DOUBLE, 6) AS f FROM inner_cut WHERE NOT up OR i <> 3")
def b3_crossing_cuts(spark, d):
    """A bridge neither cuts nor is cut."""
    return graph.crossing_cuts(graph.graph_parts(grid(spark, d)), 3.0).select(F.col("pid.id").alias("id"), "f")


@query("SELECT n_nationkey AS edge, CAST(2 * n_nationkey AS DOUBLE) / 10 AS length_m FROM nation WHERE n_nationkey >= 15")
def b6_short_loops(spark, d):
    """Lines whose ends snap together: loops shorter than the snap go, longer ones stay."""
    n = F.col("n_nationkey")
    x = n * 1000
    e = table(spark, d, "nation").select(n.alias("edge"), F.array(g.point(x, n * 0), g.point(x + 0.5, n / 10), g.point(x + 1, n * 0)).alias("line"), F.lit(0.0).alias("length_m"))
    return graph.snap_ends(e, 3.0)[0].select("edge", F.round("length_m", 6).alias("length_m"))


@query("SELECT s_suppkey AS edge FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 5000 <= 20")
def b7_alongside(spark, d):
    """Roads with a path k metres beside them, along all of an odd road and half of an even one."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier")
    y = k * 10_000
    roads = t.select(k.alias("id"), F.lit("road").alias("layer"), straight(k * 0, y, k * 0 + 200, y).alias("geom"))
    paths = t.select((k + UP).alias("id"), F.lit("cartpath").alias("layer"), straight(k * 0, y + k % 5000, F.when(k % 2 == 1, 200).otherwise(100), y + k % 5000).alias("geom"))
    segments = roads.unionByName(paths).withColumns({"seg_type": F.lit("Path"), "name": F.lit("x")})
    edges = roads.select(F.col("id").alias("edge"), "id", F.col("geom")[0].alias("line"))
    return graph.alongside(edges, segments, graph.graph_parts(segments), graph.GraphSettings())


@query(f"WITH {GRID_SQL} SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM spot")
def b8_vertices(spark, d):
    return built(spark, d)[1].select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT s_suppkey AS point, CAST(s_suppkey // 8 * 2000 + 50 AS DOUBLE) AS x, CAST(s_suppkey % 8 * 100 AS DOUBLE) AS y, 5.0::DOUBLE AS dist FROM supplier")
def r1_snap(spark, d):
    """Places 5 m from a street are put on it, places 50 m away are not."""
    k, x = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 8) * 2000.0 + 50
    t = table(spark, d, "supplier")
    near = t.select(k.alias("point"), x.alias("x"), (k % 8 * 100.0 + 5).alias("y"))
    far = t.select((k + UP).alias("point"), x.alias("x"), (k % 8 * 100.0 + 50).alias("y"))
    got = routing.snap(near.unionByName(far), built(spark, d)[0], 10.0)
    return got.select("point", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("dist", 3).alias("dist"))


@query(f"WITH {GRID_SQL} SELECT id, CAST(count(*) AS INTEGER) AS edges, CAST(100 * sum(z - a) AS DOUBLE) AS length_m FROM edge WHERE NOT up AND r IN (0, 2) GROUP BY id")
def r8_units(spark, d):
    streets = grid(spark, d).where(f"id < {UP} and id % 8 in (0, 2)")
    left = streets.select(F.col("id").alias("segment_id"), F.lit(0).alias("part"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    return routing.required_units(built(spark, d)[0], left, left.select("segment_id")).select("id", F.size("edges").alias("edges"), F.round("length_m", 2).alias("length_m"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS request, CAST(count(*) + 1 AS INTEGER) AS legs, CAST(100 * count(*) AS DOUBLE) AS walked FROM nation GROUP BY 1")
def r9_tour(spark, d):
    """A request for each region, its nations units on a line, 50 m each: out along all of them and back."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long")
    t = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("request"), F.col("n_name").alias("unit"), place.alias("target"))
    units = t.select("request", "unit", (F.col("target") - 1).alias("source"), "target", F.lit(50.0).alias("length_m"))
    ends = units.groupBy("request").agg(F.max("target").alias("n")).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), "n"))).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), "n")))
    costs = ends.select("request", "u", "v", (F.abs(F.col("u") - F.col("v")) * 50.0).alias("dist"))
    legs = routing.tours(units, costs, units.select("request", F.lit(0).cast("long").alias("home")).distinct())
    return legs.groupBy("request").agg(F.count("*").cast("int").alias("legs"), F.sum(F.col("deadhead") + F.col("length_m")).alias("walked"))


@query(f"WITH {ad.SEG} SELECT id, layer FROM seg WHERE id = 5")
def r12_find(spark, d):
    return ad.seg(spark, d).where("source_oid = 5").select("id", "layer")


@query(f"WITH {ad.SEG} SELECT id, x0 AS x_start, x0 + length_m AS x_end, 1 AS parts, 2 AS points FROM seg")
def g4_dump(spark, d):
    """Parts and points of a feature, and its first and last point."""
    v = g.vertices(ad.seg(spark, d))
    return v.groupBy("id").agg(F.min_by("x", F.struct("part", "seq")).alias("x_start"), F.max_by("x", F.struct("part", "seq")).alias("x_end"), F.count_distinct("part").cast("int").alias("parts"), F.count("*").cast("int").alias("points"))


@query(f"""WITH {ad.SEG}, q AS (SELECT id, x0, x0 + length_m AS x1, y FROM seg)
 SELECT a.id AS a, b.id AS b, round(sqrt(power(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + power(a.y - b.y, 2)), 6) AS dist FROM q a JOIN q b ON a.id < b.id WHERE abs(a.y - b.y) <= 4 AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 4 AND sqrt(power(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + power(a.y - b.y, 2)) <= 4""")
def g9_line_distance(spark, d):
    """Level lines within 4 m of each other."""
    met = spatial.line_pairs(g.feature_pieces(ad.seg(spark, d)), 4.0)
    return met.select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"WITH {ad.FIX}, q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM fix WINDOW w AS (PARTITION BY track ORDER BY seq)) SELECT track, count(*) AS points, last(x ORDER BY seq) AS x_first FROM q WHERE px IS NULL OR px <> x OR py <> y GROUP BY track")
def g13_reversed(spark, d):
    """Lines turned round, without repeated points."""
    line = F.reverse(g.without_repeats(F.col("line")))
    return g.lines(ad.fix(spark, d), ["track"]).select("track", F.size(line).cast("long").alias("points"), F.get(line, F.lit(0))["x"].alias("x_first"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey > 3 THEN 3 ELSE 2 END AS points FROM nation")
def g16_simplify(spark, d):
    """A bend is kept if it lies more than 3 m off the straight line."""
    n = F.col("n_nationkey").cast("long")
    line = F.array(g.point(n * 0, n * 0), g.point(n * 0 + 10, n * 0), g.point(n * 0 + 50, n), g.point(n * 0 + 90, n * 0), g.point(n * 0 + 100, n * 0))
    flat = F.array(F.get(line, F.lit(0)), F.get(line, F.lit(2)), F.get(line, F.lit(4)))
    t = table(spark, d, "nation").select(n.alias("id"), flat.alias("line"))
    return t.select("id", F.size(g.simplify(F.col("line"), 3.0)).alias("points"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 = 0")
def u4_check_srid(spark, d):
    """Rows whose reference system is not their network's."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("id"), (k % 2).alias("network_id"), F.when(k % 5 == 0, 4326).otherwise(32616 + k % 2).alias("srid"))
    return clean.other_srid(rows, spark.createDataFrame([(0, 32616), (1, 32617)], "network_id long, srid long")).select("id")


@query("""SELECT DATE '2024-01-05' AS from_date, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'other type' WHEN event_id % 3 = 0 THEN 'known' ELSE 'fetch' END AS reason, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-11' AND ts < TIMESTAMP '2024-02-01' GROUP BY 2
 UNION ALL SELECT DATE '2024-02-01', CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'other type' WHEN event_id % 3 = 0 THEN 'known' ELSE 'fetch' END, count(*) FROM events WHERE ts >= TIMESTAMP '2024-02-01' AND ts < TIMESTAMP '2024-02-11' GROUP BY 2""")
def m13_sync_counts(spark, d):
    """What a sync does with each listed activity, by month window."""
    asked = spark.range(1).select(F.lit("2024-01-05").cast("date").alias("start"), F.lit("2024-02-10").cast("date").alias("end"))
    months = tracks.month_windows(asked).select("from_date", "to_date", F.trunc("from_date", "month").alias("m"))
    r = tracks.listing_reason(F.col("event_type"), F.lit(False), F.lit(True), F.col("event_id") % 3 == 0, ["view", "click", "purchase"])
    met = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("m", F.trunc("day", "month")).join(F.broadcast(months), "m").where("day between from_date and to_date")
    return met.groupBy("from_date", r.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {ad.FIX}, {ad.STEP} SELECT track, CAST(dense_rank() OVER (PARTITION BY track ORDER BY g) - 1 AS INTEGER) AS part, CAST(seq AS BIGINT) AS seq FROM good")
def x4_split_stream(spark, d):
    """Fixes as a stream of three batches, split with the open part as state; the rows are those of the whole tracks."""
    folder = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    fixes = ad.fix(spark, d).select("track", F.col("seq").cast("long").alias("seq"), "x", "y").withColumn("third", F.ntile(3).over(Window.partitionBy("track").orderBy("seq")))
    for k in (1, 2, 3):
        fixes.where(F.col("third") == k).drop("third").repartition(2, "track").write.mode("append").parquet(f"{folder}/in")
    files = sum(1 for _ in spark.read.parquet(f"{folder}/in").inputFiles())
    stream = spark.readStream.schema("track long, seq long, x double, y double").option("maxFilesPerTrigger", max(1, files // 3)).parquet(f"{folder}/in")
    updates.split_stream(stream, ad.GAP).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("track", "part", "seq")


BEAR2 = "degrees(atan2(sin(radians({lo2}) - radians({lo1})) * cos(radians({la2})), cos(radians({la1})) * sin(radians({la2})) - sin(radians({la1})) * cos(radians({la2})) * cos(radians({lo2}) - radians({lo1})))) + 360"


@query(f"""WITH {LATLON}, q AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WINDOW w AS (PARTITION BY route ORDER BY seq)),
 c AS (SELECT route, seq, lat, lon, sum(coalesce(2 * 6371000.0 * asin(sqrt(power(sin((radians(lat) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin((radians(lon) - radians(lo)) / 2), 2))), 0)) OVER (PARTITION BY route ORDER BY seq) AS cum FROM q),
 b AS (SELECT *, coalesce(last(row(lat, lon)) OVER (PARTITION BY route ORDER BY cum RANGE BETWEEN UNBOUNDED PRECEDING AND 15 PRECEDING), first(row(lat, lon)) OVER (PARTITION BY route ORDER BY seq)) AS back FROM c)
 SELECT route, seq, round(({BEAR2.format(la1='back[1]', lo1='back[2]', la2='lat', lo2='lon')}) % 360, 3) AS in_bearing FROM b WHERE back[1] <> lat OR back[2] <> lon""")
def t4_bearings(spark, d):
    got = cues.window_bearings(cues.cumulative(latlon(spark, d)))
    first = cues.cumulative(latlon(spark, d)).where("cum_m > 0").select("route", "seq")
    return got.join(first, ["route", "seq"], "left_semi").select("route", "seq", F.round("in_bearing", 3).alias("in_bearing"))
