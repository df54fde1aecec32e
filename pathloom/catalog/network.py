"""Graphs, routes, turn cues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom import adapters as ad
from pathloom.catalog.registry import query, table
from pathloom.functions import geometry as g
from pathloom.functions.projection import from_utm, to_utm
from pathloom.operators import cues, graph, overlay, routing
from pathloom.operators.components import connected_components, shared_folder

NET = """net AS (SELECT n_nationkey AS source, (7 * n_nationkey + 3) % 25 AS target, CAST(1 + n_nationkey % 5 AS DOUBLE) AS cost FROM nation
 UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, CAST(4 + n_nationkey % 3 AS DOUBLE) FROM nation),
 both_ways AS (SELECT source AS u, target AS v, min(cost) AS cost FROM (SELECT source, target, cost FROM net UNION ALL SELECT target, source, cost FROM net) GROUP BY ALL)"""
# a round of relaxation for each step; 24 settle 25 vertices
RELAX = """r(step, origin, vertex, dist) AS (SELECT 0, o, o, 0.0::DOUBLE FROM origins
 UNION ALL SELECT step + 1, origin, vertex, min(dist) FROM (SELECT step, origin, vertex, dist FROM r UNION ALL SELECT step, origin, v, dist + cost FROM r JOIN both_ways ON u = vertex) WHERE step < 24 GROUP BY step, origin, vertex)"""


@query("SELECT CAST(n_nationkey AS INTEGER) AS vertex, CAST(n_nationkey % 5 AS INTEGER) AS component FROM nation")
def b9_components(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    return connected_components(n.withColumn("dst", (F.col("src") + 5) % 25))


@query("""WITH v AS (SELECT c_custkey AS vertex, c_nationkey AS k FROM customer) SELECT vertex, min(vertex) OVER (PARTITION BY CASE WHEN k < 20 THEN -1 ELSE k END) AS component FROM v""")
def b9_hubs(spark, d):
    """Customers linked to the least one of their nation, and the least ones of twenty nations to each other: stars of most vertices."""
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("vertex"), F.col("c_nationkey").alias("k"))
    hubs = v.groupBy("k").agg(F.min("vertex").alias("hub"))
    links = v.join(F.broadcast(hubs), "k").select(F.col("vertex").alias("src"), F.col("hub").alias("dst"))  # a row a nation
    rings = hubs.where("k < 20").select(F.col("hub").alias("src"), F.lead("hub").over(Window.orderBy("k")).alias("dst")).where("dst is not null")
    return connected_components(links.unionByName(rings), hub=500)


@query(f"WITH RECURSIVE {NET}, origins AS (SELECT 0 AS o), {RELAX} SELECT vertex, dist FROM r WHERE step = 24")
def r2_shortest_paths(spark, d):
    start = spark.createDataFrame([(0, 0, 0.0)], "origin int, vertex int, dist double")
    return routing.shortest_paths(routing.both_ways(ad.net(spark, d)), start).select("vertex", "dist")


@query("""WITH v AS (SELECT s_suppkey * 8 + i AS vertex, s_suppkey AS k, i FROM supplier, unnest(range(8)) AS t(i)),
 o AS (SELECT vertex AS origin, k AS ok, i AS oi FROM v WHERE k % 50 = 0 AND i = k // 50 % 8)
 SELECT origin, vertex, CAST(100 * abs(k - ok) + 30 * abs(i - oi) AS DOUBLE) AS dist FROM o, v""")
def r2_overlay(spark, d):
    """Eight streets along all suppliers, 100 m from one to the next, with cross streets of 30 m: searched over blocks, from a vertex of every fiftieth supplier."""
    vertices = _streets(spark, d)
    return overlay.search(_town(vertices), _origins(vertices), paths=False)[0]


@query("""WITH v AS (SELECT s_suppkey * 8 + i AS vertex, s_suppkey AS k, i FROM supplier, unnest(range(8)) AS t(i)),
 o AS (SELECT vertex AS origin, k AS ok, i AS oi FROM v WHERE k % 50 = 0 AND i = k // 50 % 8)
 SELECT o.origin, p.origin AS vertex, CAST(100 * abs(p.ok - o.ok) + 30 * abs(p.oi - o.oi) AS DOUBLE) AS dist FROM o, o p""")
def r4_overlay(spark, d):
    """The costs between those vertices, each search stopped at its farthest end."""
    vertices = _streets(spark, d)
    ends = _origins(vertices).checkpoint()
    pairs = ends.select("origin").join(F.broadcast(ends.select("vertex")))  # the matrix asked for
    return overlay.search(_town(vertices), ends, pairs, only_targets=True, paths=False)[0]


def _streets(spark, d):
    shared_folder(spark)
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return t.select("k", "i", (F.col("k") * 8 + F.col("i")).alias("vertex"), (F.col("k") * 100.0).alias("x"), (F.col("i") * 30.0).alias("y"))


def _town(vertices):
    next_k = vertices.select((F.col("k") - 1).alias("k"), "i", F.col("vertex").alias("target"))
    along = vertices.join(next_k, ["k", "i"]).select((F.col("vertex") * 2).alias("edge"), F.col("vertex").alias("source"), "target", F.lit(100.0).alias("cost"))
    across = vertices.where("i < 7").select((F.col("vertex") * 2 + 1).alias("edge"), F.col("vertex").alias("source"), (F.col("vertex") + 1).alias("target"), F.lit(30.0).alias("cost"))
    return overlay.build(routing.both_ways(along.unionByName(across)), overlay.blocks_by_place(vertices, 10_000.0))


def _origins(vertices):
    """For the query's own search: a vertex of every fiftieth supplier."""
    return vertices.where("k % 50 = 0 and i = floor(k / 50) % 8").select(F.col("vertex").alias("origin"), "vertex", F.lit(0.0).alias("dist"))


@query(f"WITH RECURSIVE {NET}, origins AS (SELECT unnest([0, 3, 11, 24]) AS o), {RELAX} SELECT origin, vertex, dist FROM r WHERE step = 24 AND vertex IN (0, 3, 11, 24)")
def r4_cost_matrix(spark, d):
    ends = spark.createDataFrame([(x, x, 0.0) for x in (0, 3, 11, 24)], "origin int, vertex int, dist double")
    return routing.shortest_paths(routing.both_ways(ad.net(spark, d)), ends).where(F.col("vertex").isin(0, 3, 11, 24)).select("origin", "vertex", "dist")


@query(f"WITH RECURSIVE {NET}, origins AS (SELECT unnest([0, 3]) AS o), {RELAX} SELECT origin, vertex AS target, dist AS walked FROM r WHERE step = 24 AND vertex IN (11, 24)")
def r5_paths(spark, d):
    """The edges of each pair's path, which must add up to its distance."""
    both = routing.both_ways(ad.net(spark, d))
    start = spark.createDataFrame([(x, x, 0.0) for x in (0, 3)], "origin int, vertex int, dist double")
    paths = routing.shortest_paths(both, start)
    steps = routing.walk_back(paths, paths.where(F.col("vertex").isin(11, 24)).select("origin", "vertex"))
    cost = both.groupBy("edge", "u").agg(F.min("cost").alias("cost"))
    return steps.join(cost, (steps["edge"] == cost["edge"]) & (steps["vertex"] == cost["u"])).groupBy("origin", "target").agg(F.sum("cost").alias("walked"))


def grid(spark, d):
    """Streets of grids, 2 km apart: of each eight suppliers every one is a horizontal line and a vertical one, 100 m apart, which cross and meet."""
    k, r, x0 = F.col("s_suppkey"), F.col("s_suppkey") % 8, F.floor(F.col("s_suppkey") / 8) * 2000
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    t = table(spark, d, "supplier")
    rows = t.select(k.alias("id"), F.when(r == 3, "Bridge").alias("seg_type"), F.array(F.array(p(x0, r * 100), p(x0 + 700, r * 100))).alias("geom"))
    cols = t.select((k + UP).alias("id"), F.lit(None).cast("string").alias("seg_type"), F.array(F.array(p(x0 + r * 100, r * 0), p(x0 + r * 100, r * 0 + 700))).alias("geom"))
    return rows.unionByName(cols).withColumns({"layer": F.when(F.col("id") % 2 == 0, "cartpath").otherwise("road"), "name": F.lit("x"), "source_oid": F.col("id")})


#: What is added to a supplier's key for its vertical line.
UP = 100_000_000


def built(spark, d):
    """The grids' graph, whose cost is its length."""
    edges, vertices = graph.build_graph(grid(spark, d), graph.GraphSettings(road_radius_m=20.0))
    return edges.withColumn("cost", F.col("length_m")), vertices


# every line is cut where it crosses another, but a bridge (row 3 of a grid) crosses nothing but what its ends touch
GRID_SQL = f"""blk AS (SELECT s_suppkey // 8 AS b, count(*) AS m FROM supplier GROUP BY 1),
 line AS (SELECT s_suppkey AS id, b, m, s_suppkey % 8 AS r, false AS up FROM supplier JOIN blk ON b = s_suppkey // 8 UNION ALL SELECT s_suppkey + {UP}, b, m, s_suppkey % 8, true FROM supplier JOIN blk ON b = s_suppkey // 8),
 cut AS (SELECT *, unnest(generate_series(0, 7)) AS i FROM line),
 inner_cut AS (SELECT * FROM cut WHERE i BETWEEN 1 AND 6 AND i < m AND CASE WHEN up THEN i <> 3 OR r IN (0, 7) ELSE r <> 3 END),
 keep AS (SELECT * FROM cut WHERE i IN (0, 7) UNION ALL SELECT * FROM inner_cut),
 edge AS (SELECT id, b, m, r, up, i AS a, lead(i) OVER (PARTITION BY id ORDER BY i) AS z FROM keep QUALIFY z IS NOT NULL),
 spot AS (SELECT DISTINCT b, b * 2000 + 100 * CASE WHEN up THEN r ELSE i END AS x, 100 * CASE WHEN up THEN i ELSE r END AS y FROM keep)"""


@query(f"WITH {GRID_SQL} SELECT id, round(a / 7.0::DOUBLE, 6) AS part_from, round(z / 7.0::DOUBLE, 6) AS part_to, CAST(100 * (z - a) AS DOUBLE) AS length_m FROM edge")
def b4_edges(spark, d):
    edges, _ = built(spark, d)
    return edges.select("id", F.round("part_from", 6).alias("part_from"), F.round("part_to", 6).alias("part_to"), F.round("length_m", 2).alias("length_m"))


@query(f"""WITH {GRID_SQL}, per AS (SELECT b, 100 * sum(z - a) AS length FROM edge GROUP BY b)
 SELECT (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM spot) AS vertices, (SELECT count(*) FROM blk) AS components, CAST((SELECT max(length) FROM per) AS DOUBLE) AS main_m, (SELECT count(*) - 1 FROM blk) AS islands""")
def b10_report(spark, d):
    return graph.graph_report(*built(spark, d)).select("edges", "vertices", "components", F.round("main_m", 2).alias("main_m"), "islands")


@query(f"""WITH {GRID_SQL}, per AS (SELECT b, 100 * sum(z - a) AS length FROM edge GROUP BY b)
 SELECT CAST(length AS DOUBLE) AS length_m, CAST(2 * m AS INTEGER) AS segments, 'cartpath:' || CAST(8 * b AS VARCHAR) AS first_label, b = (SELECT b FROM per ORDER BY length DESC, b LIMIT 1) AS main FROM per JOIN blk USING (b)""")
def b11_islands(spark, d):
    edges, vertices = built(spark, d)
    got = graph.islands(edges, vertices, grid(spark, d))
    lowest = F.array_sort(F.transform(F.filter("segments", lambda x: x.startswith("cartpath:")), lambda x: F.split_part(x, F.lit(":"), F.lit(2)).cast("long")))[0]
    return got.select(F.round("length_m", 2).alias("length_m"), F.size("segments").alias("segments"), F.concat(F.lit("cartpath:"), lowest.cast("string")).alias("first_label"), "main")


@query(f"""WITH {GRID_SQL}, lab AS (SELECT DISTINCT b, CASE WHEN (CASE WHEN up THEN id - {UP} ELSE id END) % 2 = 0 THEN 'cartpath:' ELSE 'road:' END || id AS label FROM edge)
 SELECT label, row_number() OVER (PARTITION BY b ORDER BY label) AS place FROM lab""")
def b11_labels(spark, d):
    """The labels of each island as rows in order."""
    edges, vertices = built(spark, d)
    return graph.island_labels(edges, vertices, grid(spark, d)).select("label", "place")


@query("""SELECT request, 'ok' AS reached, length_m, length_m AS line_m, CAST(request // 8 * 2000 + 50 AS DOUBLE) AS x_from, CAST(request // 8 * 2000 + 250 AS DOUBLE) AS x_to, CAST(request % 8 * 100 AS DOUBLE) AS y_to
 FROM (SELECT s_suppkey AS request, CAST(CASE WHEN s_suppkey % 8 = 3 THEN 600 ELSE s_suppkey % 8 * 100 + 200 END AS DOUBLE) AS length_m FROM supplier)""")
def r3_legs(spark, d):
    """From a place 50 m along the lowest street of a grid to one 250 m along a street above; the bridge is reached by its end only."""
    edges, _ = built(spark, d)
    k, x0 = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 8) * 2000.0
    asked = table(spark, d, "supplier").select(k.alias("request"), (x0 + 50).alias("ax"), F.lit(0.0).alias("ay"), (x0 + 250).alias("bx"), (k % 8 * 100).cast("double").alias("by"))
    got = routing.legs(asked, edges, 10.0)
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    return got.select("request", "reached", F.round("length_m", 2).alias("length_m"), F.round(g.line_length(F.col("line")), 2).alias("line_m"), F.round(first["x"], 3).alias("x_from"), F.round(last["x"], 3).alias("x_to"), F.round(last["y"], 3).alias("y_to"))


@query(f"WITH {GRID_SQL} SELECT 2 * b + 1 AS route, CAST(100 * (1 + b % 6) AS DOUBLE) AS new_m FROM blk UNION ALL SELECT 2 * b + 2, 0.0 FROM blk")
def r7_new_ground(spark, d):
    """Out and back over some of an unrun street counts once; a street that is run counts nothing."""
    got = routing.new_ground(*_out_and_back(spark, d))
    return got.select("route", (F.round(F.col("new_m") / 10) * 10).alias("new_m"))


@query(f"WITH {GRID_SQL} SELECT 2 * b + 1 AS route, 1 AS stretch, CAST(100 * (1 + b % 6) AS DOUBLE) AS length_m, CAST(b * 2000 AS DOUBLE) AS x_from, CAST(b * 2000 + 100 * (1 + b % 6) AS DOUBLE) AS x_to FROM blk")
def r7_lines(spark, d):
    """The line of new ground: from the street's beginning to where the route turns."""
    got = routing.new_ground_lines(*_out_and_back(spark, d))
    far = F.array_max(F.transform("line", lambda p: p["x"]))
    return got.select("route", "stretch", (F.round(F.col("length_m") / 10) * 10).alias("length_m"), F.get("line", F.lit(0))["x"].alias("x_from"), far.alias("x_to"))


def _out_and_back(spark, d):
    """Routes, edges, lengths of parts and what is to run, for each grid."""
    edges, _ = built(spark, d)
    streets = grid(spark, d)
    b = F.floor(F.col("s_suppkey") / 8)
    far = b * 2000.0 + 100 * (1 + b % 6)
    at = lambda route, seq, x, y: F.struct((2 * b + route).alias("route"), F.lit(seq).alias("seq"), x.alias("x"), F.lit(y).alias("y"))
    route = table(spark, d, "supplier").where("s_suppkey % 8 = 0").select(F.inline(F.array(at(1, 0, b * 2000.0, 0.0), at(1, 1, far, 0.0), at(1, 2, b * 2000.0, 0.0), at(2, 0, b * 2000.0, 100.0), at(2, 1, far, 100.0))))
    parts = g.feature_pieces(streets).where("last").select("id", "part", "part_m")
    left = streets.where(f"id < {UP} and id % 8 = 0").select(F.col("id").alias("segment_id"), F.lit(0).alias("part"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    return route, edges, parts, left


@query(f"""WITH {GRID_SQL}, places(x) AS (VALUES (0), (2), (700)),
 across AS (SELECT b, p.x AS x, q.x AS y, 200 + min(abs(p.x - 100 * c) + abs(100 * c - q.x)) AS w FROM blk, places p, places q, generate_series(0, 7) t(c) WHERE c < m AND c <= 7 GROUP BY ALL),
 sides(x) AS (VALUES (0), (700)),
 two AS (SELECT i.b AS b, least(abs(2 - s.x) + i.w + e.w, n.w + o.w + abs(700 - s.x - 2)) + 1400 AS total FROM sides s, sides u, across i, across e, across n, across o
  WHERE i.x = 700 - s.x AND i.y = u.x AND e.b = i.b AND e.x = 700 - u.x AND e.y = 2 AND n.b = i.b AND n.x = 2 AND n.y = u.x AND o.b = i.b AND o.x = 700 - u.x AND o.y = s.x)
 SELECT *, length_m AS line_m FROM (SELECT blk.b AS request, 'ok' AS state, CAST(CASE WHEN m > 2 THEN (SELECT min(total) FROM two WHERE two.b = blk.b) ELSE 1400 END AS DOUBLE) AS length_m, CAST(0 AS BIGINT) AS skipped FROM blk)""")
def r10_finish(spark, d):
    """Two whole streets of each grid to run, 700 m each, from a click 2 m from the corner: where all side streets are
    there, up one and down the other, 1804 m. The SQL tries both orders and all directions."""
    edges, vertices = built(spark, d)
    b = F.floor(F.col("s_suppkey") / 8)
    left = grid(spark, d).where(f"id < {UP} and id % 8 in (0, 2)").select(F.col("id").alias("segment_id"), F.lit(0).alias("part"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    asked = table(spark, d, "supplier").where("s_suppkey % 8 = 0").select(b.alias("request"), (b * 2000.0 + 2).alias("x"), F.lit(0.0).alias("y"))
    picked = left.select(F.floor(F.col("segment_id") / 8).alias("request"), "segment_id")
    legs, summary = routing.finish_routes(asked, picked, edges, vertices, left, 10.0)
    length = legs.groupBy("request").agg(F.round(F.sum(F.col("deadhead") + F.col("length_m")), 1).alias("length_m"), F.round(F.sum(g.line_length(F.col("line"))), 1).alias("line_m"))
    return summary.join(length, "request").select("request", "state", "length_m", "line_m", "skipped")


LATLON = "p AS (SELECT user_id AS route, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, 40 + value / 10000 AS lat, -84 + CAST(json_extract(props, '$.k') AS DOUBLE) / 10000 AS lon FROM events)"


def latlon(spark, d):
    return ad.fix(spark, d).select(F.col("track").alias("route"), "seq", (40 + F.col("x") / 10000).alias("lat"), (-84 + F.col("y") / 10000).alias("lon"))


HAV = "2 * 6371000.0 * asin(sqrt(power(sin((radians(lat) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin((radians(lon) - radians(lo)) / 2), 2)))"


@query(f"WITH {LATLON}, q AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WINDOW w AS (PARTITION BY route ORDER BY seq)) SELECT route, seq, round(sum(coalesce({HAV}, 0)) OVER (PARTITION BY route ORDER BY seq), 2) AS cum_m FROM q")
def t3_cumulative(spark, d):
    return cues.cumulative(latlon(spark, d)).select("route", "seq", F.round("cum_m", 2).alias("cum_m"))


BEAR = "(degrees(atan2(sin(radians(lon) - radians(lo)) * cos(radians(lat)), cos(radians(la)) * sin(radians(lat)) - sin(radians(la)) * cos(radians(lat)) * cos(radians(lon) - radians(lo)))) + 360)"


@query(f"WITH {LATLON}, q AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WINDOW w AS (PARTITION BY route ORDER BY seq)) SELECT route, seq, round({BEAR} - 360 * floor({BEAR} / 360), 5) AS bearing, round({HAV}, 3) AS metres FROM q WHERE la IS NOT NULL AND (la <> lat OR lo <> lon)")
def t1_bearing(spark, d):
    w = Window.partitionBy("route").orderBy("seq")
    p = latlon(spark, d).withColumn("la", F.lag("lat").over(w)).withColumn("lo", F.lag("lon").over(w)).where("la is not null and (la != lat or lo != lon)")
    return p.select("route", "seq", F.round(cues.bearing("la", "lo", "lat", "lon"), 5).alias("bearing"), F.round(cues.haversine("la", "lo", "lat", "lon"), 3).alias("metres"))


@query("SELECT a, b, ((a - b + 180) % 360 + 360) % 360 - 180 AS diff FROM (SELECT CAST(o_orderkey * 7 % 720 AS DOUBLE) - 360 AS a, CAST(o_custkey % 360 AS DOUBLE) AS b FROM orders)")
def t2_angle_difference(spark, d):
    o = table(spark, d, "orders").select(((F.col("o_orderkey") * 7 % 720).cast("double") - 360).alias("a"), (F.col("o_custkey") % 360).cast("double").alias("b"))
    return o.withColumn("diff", cues.angle_difference("a", "b"))


@query("""SELECT a, CASE WHEN abs(a) > 170 THEN 'u_turn' WHEN abs(a) > 135 THEN CASE WHEN a < 0 THEN 'sharp_left' ELSE 'sharp_right' END WHEN abs(a) > 45 THEN CASE WHEN a < 0 THEN 'left' ELSE 'right' END
 WHEN abs(a) > 20 THEN CASE WHEN a < 0 THEN 'slight_left' ELSE 'slight_right' END ELSE 'straight' END AS cue, count(*) AS n FROM (SELECT CAST(o_orderkey % 361 - 180 AS DOUBLE) AS a FROM orders) GROUP BY a""")
def t5_classify_turn(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 361 - 180).cast("double").alias("a"))
    return o.groupBy("a").agg(F.count("*").alias("n")).withColumn("cue", cues.classify_turn("a"))


@query("""WITH t AS (SELECT o_orderkey AS key, list_extract(['straight', 'slight_left', 'slight_right', 'left'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS cue, CAST(o_orderkey * 11 % 360 AS DOUBLE) AS ob, CAST(o_orderkey * 13 % 360 AS DOUBLE) AS branch FROM orders),
 f AS (SELECT *, ((branch - ob + 180) % 360 + 360) % 360 - 180 AS off FROM t)
 SELECT key, CASE WHEN cue = 'straight' THEN CASE WHEN abs(off) <= 45 THEN 'straight' END WHEN cue LIKE 'slight%' THEN CASE WHEN abs(off) > 30 THEN cue WHEN off > 0 THEN 'right_fork' ELSE 'left_fork' END ELSE cue END AS refined FROM f""")
def t6_refine(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("key"), F.get(F.array(*map(F.lit, ["straight", "slight_left", "slight_right", "left"])), (k % 4).cast("int")).alias("cue"), (k * 11 % 360).cast("double").alias("ob"), (k * 13 % 360).cast("double").alias("branch"))
    return o.select("key", cues.refine("cue", "ob", F.array("branch")).alias("refined"))


@query("""WITH p AS (SELECT o_custkey AS route, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS seq, CAST(o_orderkey // 16 % 5 AS INTEGER) AS s FROM orders),
 r AS (SELECT *, sum(CASE WHEN lag_s = s THEN 0 ELSE 1 END) OVER (PARTITION BY route ORDER BY seq) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY route ORDER BY seq) AS lag_s FROM p)),
 e AS (SELECT route, run, max(seq) AS seq, any_value(s) AS s FROM r GROUP BY ALL),
 f AS (SELECT *, lead(s) OVER (PARTITION BY route ORDER BY run) AS s2 FROM e)
 SELECT route, seq, CASE WHEN s2 = s + 1 THEN s2 ELSE s END AS vertex FROM f WHERE s2 = s + 1 OR s = s2 + 1""")
def t7_junctions(spark, d):
    """Orders as points on a chain of edges (s, s + 1)."""
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    s = F.floor(F.col("o_orderkey") / 16).cast("int") % 5
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("route"), seq.alias("seq"), s.alias("source"), (s + 1).alias("target"), F.lit("road").alias("layer"))
    return cues.junctions(p).select("route", "seq", "vertex")


# the ellipsoid's series in powers of the eccentricity, exact to a millimetre within a zone
UTM_SQL = """c AS (SELECT c_custkey AS key, radians((c_custkey % 600 - 300) / 100.0::DOUBLE) AS l, radians((c_custkey % 160) / 2.0::DOUBLE) AS p, 0.0066943799901413165::DOUBLE AS e2 FROM customer),
 t AS (SELECT *, e2 / (1 - e2) AS f2, 6378137 / sqrt(1 - e2 * sin(p) ^ 2) AS n, tan(p) ^ 2 AS tt, e2 / (1 - e2) * cos(p) ^ 2 AS cc, l * cos(p) AS a,
   6378137 * ((1 - e2 / 4 - 3 * e2 ^ 2 / 64 - 5 * e2 ^ 3 / 256) * p - (3 * e2 / 8 + 3 * e2 ^ 2 / 32 + 45 * e2 ^ 3 / 1024) * sin(2 * p) + (15 * e2 ^ 2 / 256 + 45 * e2 ^ 3 / 1024) * sin(4 * p) - 35 * e2 ^ 3 / 3072 * sin(6 * p)) AS m FROM c),
 xy AS (SELECT key, 500000 + 0.9996 * n * (a + (1 - tt + cc) * a ^ 3 / 6 + (5 - 18 * tt + tt ^ 2 + 72 * cc - 58 * f2) * a ^ 5 / 120) AS x,
   0.9996 * (m + n * tan(p) * (a ^ 2 / 2 + (5 - tt + 9 * cc + 4 * cc ^ 2) * a ^ 4 / 24 + (61 - 58 * tt + tt ^ 2 + 600 * cc - 330 * f2) * a ^ 6 / 720)) AS y FROM t)"""


@query(f"WITH {UTM_SQL} SELECT key, round(x / 100) AS x_hm, round(y / 100) AS y_hm, true AS round_trip FROM xy")
def g14_projection(spark, d):
    """Degrees to UTM and back, north and south."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("key"), (-87.0 + (k % 600 - 300) / 100.0).alias("lon"), ((k % 160) / 2.0).alias("lat"))
    x, y = to_utm(F.col("lon"), F.col("lat"), 32616)
    lon, lat = from_utm(x, y, 32616)
    sx, sy = to_utm(F.col("lon"), -F.col("lat"), 32716)
    slon, slat = from_utm(sx, sy, 32716)
    near = lambda a, b: F.abs(a - b) < 1e-9
    back = near(lon, F.col("lon")) & near(lat, F.col("lat")) & near(slon, F.col("lon")) & near(slat, -F.col("lat"))
    return c.select("key", F.round(x / 100).alias("x_hm"), F.round(y / 100).alias("y_hm"), back.alias("round_trip"))
