"""The driver's tables as networks, tracks, logs and graphs, by key arithmetic; SQL has the same as common table expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.catalog.registry import table
from pathloom.functions.geometry import even_points, feature_pieces
from pathloom.operators import matching, tracks
from pathloom.operators.components import shared_folder
from pathloom.sources import exports

GAP, REACH, SPACING = 40.0, 5.0, 20.0
TYPES = ["Path", "Bridge", "Tunnel", "Walking Path", "Park"]


def fix(spark: SparkSession, d: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("track"), seq.alias("seq"), "ts", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_id")


def seg(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x0, y, length = (k * 37 % 400).cast("double"), (k * 13 % 100).cast("double"), (20 + k % 180).cast("double")
    line = F.array(F.struct(x0.alias("x"), y.alias("y")), F.struct((x0 + length).alias("x"), y.alias("y")))
    return table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 2 == 0, "cartpath").otherwise("road").alias("layer"), F.get(F.array(*map(F.lit, TYPES)), (k % 5).cast("int")).alias("seg_type"), F.concat(F.lit("Road "), F.col("s_nationkey").cast("string")).alias("name"),
        (k % 7 != 0).alias("counted"), (k % 17 == 3).alias("excluded"), F.when(k % 29 == 1, "second carriageway").alias("uncounted_reason"), length.alias("length_m"), F.array(line).alias("geom"), k.alias("source_oid"), x0.alias("x0"), y.alias("y"),
    )


def node(spark: SparkSession, d: str) -> DataFrame:
    """Counted segments' nodes: ``segment_id, part, seq, n, x, y``."""
    parts = feature_pieces(seg(spark, d).where("counted"))
    return even_points(parts, SPACING).withColumnRenamed("id", "segment_id")


def node_radius(spark: SparkSession, d: str) -> DataFrame:
    return matching.assign_radii(node(spark, d), seg(spark, d), 3.0, 2.0, 4.0, REACH, ["Park"], ["Road 3"])


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Straight pieces of the split tracks with ``run`` and ``start_at``."""
    f = fix(spark, d)
    start = f.groupBy("track").agg(F.min("ts").alias("start_at"))
    return tracks.straight_pieces(tracks.split_track(f, GAP)).join(start, "track").withColumnRenamed("track", "run")


def match_all(spark: SparkSession, d: str) -> DataFrame:
    """All nodes matched with all runs anew."""
    shared_folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return matching.match(node_radius(spark, d).checkpoint(), seg(spark, d), runs(spark, d).repartition(n).checkpoint(), REACH)  # each piece makes many rows


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Matched nodes as they are published: the first reader of these tables in an application matches and publishes, the others read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    key = [spark.sparkContext.applicationId, d]
    for name in ("events", "supplier"):  # other files under the same name are other tables
        at = path(f"{d}/{name}.parquet")
        about = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        key += [str(about.getModificationTime()), str(about.getLen())]
    folder = f"{shared_folder(spark)}/hits-{hashlib.md5('|'.join(key).encode()).hexdigest()}"
    if exports.published(spark, folder) is None:
        exports.publish(match_all(spark, d), folder, 1)
    return exports.read_published(spark, folder)


def ivl(spark: SparkSession, d: str) -> DataFrame:
    """Orders as parts and their lines as nodes: ``part, seq, hit``."""
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), seq.alias("seq"), (F.col("l_returnflag") != "N").alias("hit"))


def stored_staging(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return o.where("key % 10 != 3"), o.where("key % 10 != 0").withColumn("value", F.when(F.col("key") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))


def net(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    t = table(spark, d, "nation")
    a = t.select(n.alias("source"), ((7 * n + 3) % 25).alias("target"), (1 + n % 5).cast("double").alias("cost"))
    b = t.select(n.alias("source"), ((n + 1) % 25).alias("target"), (4 + n % 3).cast("double").alias("cost"))
    both = a.unionByName(b)
    return both.withColumn("edge", F.col("source") * 100 + F.col("target"))


def joblog(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "city").otherwise("sync").alias("source"), F.when(kind == "error", "failed").otherwise("ok").alias("status"), F.col("ts").alias("finished_at"),
        F.when(kind == "error", F.concat(F.lit("HTTP 503 for url 'http://x/"), F.col("event_id").cast("string"), F.lit("'\nmore"))).alias("error"), F.concat(kind, F.lit(" done\nmore")).alias("summary"),
    )


FIX = "fix AS (SELECT user_id AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, ts, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, event_id FROM events)"
SEG = """seg AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'cartpath' ELSE 'road' END AS layer, list_extract(['Path', 'Bridge', 'Tunnel', 'Walking Path', 'Park'], CAST(s_suppkey % 5 + 1 AS INTEGER)) AS seg_type,
  'Road ' || CAST(s_nationkey AS VARCHAR) AS name, s_suppkey % 7 <> 0 AS counted, s_suppkey % 17 = 3 AS excluded, CASE WHEN s_suppkey % 29 = 1 THEN 'second carriageway' END AS uncounted_reason,
  CAST(20 + s_suppkey % 180 AS DOUBLE) AS length_m, CAST(s_suppkey * 37 % 400 AS DOUBLE) AS x0, CAST(s_suppkey * 13 % 100 AS DOUBLE) AS y FROM supplier)"""
NODE = """cnt AS (SELECT *, greatest(1, CAST(ceil(length_m / 20) AS BIGINT)) AS n FROM seg WHERE counted),
 node AS (SELECT id AS segment_id, 0 AS part, s AS seq, n, x0 + (x0 + length_m - x0) * ((length_m * s / n - 0) / length_m) AS x, y FROM cnt, LATERAL (SELECT unnest(generate_series(0, n)) AS s))"""
RADIUS = """noder AS (SELECT node.*, layer, seg_type, CAST(CASE WHEN layer = 'cartpath' AND seq IN (0, node.n) THEN 3 WHEN layer = 'cartpath' THEN 2 WHEN seg_type = 'Park' OR name = 'Road 3' THEN 5 ELSE 4 END AS DOUBLE) AS radius FROM node JOIN cnt ON cnt.id = segment_id)"""
STEP = """stepped AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM fix WINDOW w AS (PARTITION BY track ORDER BY seq)),
 gaps AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step FROM stepped),
 raw AS (SELECT *, sum(CASE WHEN step > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM gaps),
 good AS (SELECT * FROM (SELECT *, sum(CASE WHEN step <= 40 THEN step ELSE 0 END) OVER (PARTITION BY track, g) AS len FROM raw) WHERE len > 0)"""
RUNS = """start_of AS (SELECT track, min(ts) AS start_at FROM fix GROUP BY track),
 runs AS (SELECT good.track AS run, start_at, px AS x1, py AS y1, x AS x2, y AS y2 FROM good JOIN start_of USING (track) WHERE step <= 40)"""


def near_sql(points: str, pieces: str, on: str = "true") -> str:
    """Points met with pieces, with the distance."""
    return f"""(SELECT *, sqrt((x1 + (x2 - x1) * t - x) * (x1 + (x2 - x1) * t - x) + (y1 + (y2 - y1) * t - y) * (y1 + (y2 - y1) * t - y)) AS dist FROM
 (SELECT *, CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) = 0 THEN 0 ELSE greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END AS t
  FROM {points} p JOIN {pieces} q ON {on}))"""


HITS = f"""met AS (SELECT segment_id, part, seq, start_at, run FROM {near_sql('noder', 'runs')} WHERE dist <= radius),
 direct AS (SELECT segment_id, part, seq, arg_min(run, row(start_at, run)) AS hit_run, min(start_at) AS hit_at FROM met GROUP BY ALL),
 ends AS (SELECT segment_id, seq, x, y, radius FROM noder WHERE seg_type = 'Tunnel' AND seq IN (0, n)),
 both_ends AS (SELECT segment_id, run, min(start_at) AS start_at FROM {near_sql('ends', 'runs')} WHERE dist <= radius GROUP BY segment_id, run HAVING count(DISTINCT seq) = 2),
 tunnel AS (SELECT segment_id, arg_min(run, row(start_at, run)) AS t_run, min(start_at) AS t_at FROM both_ends GROUP BY segment_id),
 hit AS (SELECT noder.segment_id, noder.part, noder.seq, noder.n, noder.x, noder.y, noder.layer,
   CASE WHEN t_at IS NOT NULL AND (hit_at IS NULL OR row(hit_at, hit_run) > row(t_at, t_run)) THEN t_at ELSE hit_at END AS hit_at,
   CASE WHEN t_at IS NOT NULL AND (hit_at IS NULL OR row(hit_at, hit_run) > row(t_at, t_run)) THEN t_run ELSE hit_run END AS hit_run
   FROM noder LEFT JOIN direct USING (segment_id, part, seq) LEFT JOIN tunnel USING (segment_id))"""
IV = """iv AS (SELECT * FROM (SELECT segment_id, layer, seq - 1 AS a, seq AS b, n, hit_at IS NOT NULL AND lag(hit_at IS NOT NULL) OVER (PARTITION BY segment_id ORDER BY seq) AS run FROM hit) WHERE a >= 0)"""
ALL_HITS = f"WITH {FIX}, {SEG}, {NODE}, {RADIUS}, {STEP}, {RUNS}, {HITS}"
