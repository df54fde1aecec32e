"""Imports, change sets, exclusions, job logs, health, exports, and the relational operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom import adapters as ad
from pathloom.catalog.registry import query, table
from pathloom.functions import geometry as g
from pathloom.functions import text
from pathloom.operators import clean, health, matching, tracks
from pathloom.operators.numbering import number_rows
from pathloom.sources import exports, features

STG = """stored AS (SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 10 <> 3),
 staging AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 10 <> 0)"""
LOG = """jobs AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'city' ELSE 'sync' END AS source, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, ts AS finished_at, event_type FROM events)"""


@query(f"WITH {STG} SELECT key, CASE WHEN s.key IS NULL THEN 'added' WHEN t.key IS NULL THEN 'removed' WHEN s.value IS DISTINCT FROM t.value THEN 'changed' ELSE 'same' END AS change FROM stored s FULL JOIN staging t USING (key)")
def d4_changes(spark, d):
    return clean.changes(*ad.stored_staging(spark, d), "key", ["value"])


@query(f"WITH {STG} SELECT key, coalesce(t.value, s.value) AS value, s.key IS NULL AS inserted FROM stored s FULL JOIN staging t USING (key)")
def k2_upsert(spark, d):
    return clean.upsert(*ad.stored_staging(spark, d), ["key"], ["value"])


@query(f"WITH {STG} SELECT s.key, t.value FROM stored s JOIN staging t USING (key) WHERE s.value <> t.value")
def j1_changed(spark, d):
    stored, staging = ad.stored_staging(spark, d)
    return stored.select("key", F.col("value").alias("old")).join(staging, "key").where("old != value").select("key", "value")


@query(f"WITH {STG} SELECT * FROM stored WHERE NOT EXISTS (SELECT 1 FROM staging WHERE staging.key = stored.key)")
def k5_removed(spark, d):
    stored, staging = ad.stored_staging(spark, d)
    return stored.join(staging.select("key"), "key", "left_anti")


@query("SELECT o_custkey AS custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS orderkey FROM orders GROUP BY o_custkey")
def k3_latest(spark, d):
    return clean.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))


@query("SELECT doc_id, kept_id FROM (SELECT doc_id, first_value(doc_id) OVER w AS kept_id, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)) WHERE rn > 1")
def d2_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    return clean.duplicates(docs, "hash", "doc_id", ["doc_id"]).where("rn > 1").select("doc_id", F.col("kept_doc_id").alias("kept_id"))


@query("SELECT source AS key FROM documents GROUP BY source HAVING count(*) > 1")
def d1_repeated_keys(spark, d):
    return clean.repeated_keys(table(spark, d, "documents"), "source").withColumnRenamed("source", "key")


@query(f"WITH {ad.SEG} SELECT id, id % 3 AS copies_of FROM seg")
def g3_shape_hash(spark, d):
    """Copies that run the other way or list their parts in another order have one hash."""
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    a, b = F.array(p(0, 0), p(5, 5), p(9, 0)), F.array(p(20, 0), p(30, 1))
    k = F.col("id") % 3
    rows = ad.seg(spark, d).select("id", k.alias("k"), F.when(F.col("id") % 2 == 0, F.array(a, F.array(p(20, 0), p(30 , 1)))).otherwise(F.array(F.reverse(b), F.reverse(a))).alias("geom"))
    shift = F.transform("geom", lambda line: F.transform(line, lambda q: F.struct((q["x"] + 100 * F.col("k") + 0.001).alias("x"), q["y"].alias("y"))))
    hashed = rows.select("id", "k", g.shape_hash(shift).alias("hash"))
    first = F.first("k").over(Window.partitionBy("hash").orderBy("id"))
    return hashed.select("id", first.alias("copies_of"))


@query(f"WITH {ad.SEG} SELECT id, length_m FROM seg WHERE length_m < 60")
def f4_slivers(spark, d):
    return ad.seg(spark, d).withColumn("length_m", g.feature_length(F.col("geom"))).where("length_m < 60").select("id", "length_m")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE c_name END AS name FROM customer")
def f1_names(spark, d):
    k = F.col("c_custkey") % 4
    c = table(spark, d, "customer").select("c_custkey", F.when(k == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).when(k == 1, "  ").when(k == 2, "n/a").otherwise(F.col("c_name")).alias("a"), F.when(k == 2, F.col("c_mktsegment")).alias("b"))
    return c.select(F.col("c_custkey").alias("key"), clean.clean_name(F.col("a"), F.col("b")).alias("name"))


@query("SELECT p_partkey AS key, p_brand IN ('Brand#11', 'Brand#22') AS counted, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#22') THEN 'type ' || p_brand END AS reason FROM part")
def f2_counted(spark, d):
    ok, reason = clean.counted_path(F.col("p_brand"), ["Brand#11", "Brand#22"])
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), ok.alias("counted"), reason.alias("reason"))


@query("SELECT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'other type' WHEN user_id % 10 = 0 THEN 'stub' WHEN value < 50 THEN 'no gps' WHEN event_id % 3 = 0 THEN 'known' ELSE 'fetch' END AS reason, count(*) AS n FROM events GROUP BY 1")
def f5_listing(spark, d):
    r = tracks.listing_reason(F.col("event_type"), F.col("user_id") % 10 == 0, ~(F.col("value") < 50), F.col("event_id") % 3 == 0, ["view", "click", "purchase"])
    return table(spark, d, "events").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE NOT (nullif(event_id % 5, 1) IS NULL) AND NOT (event_id % 5 = 0 AND event_id % 7 = 0)")
def f6_real_fixes(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.nullif(k % 5, F.lit(1)).alias("lat"), (k % 7).alias("lon"))
    return tracks.real_fixes(e).select("event_id")


@query("SELECT p_partkey FROM part WHERE nullif(p_size, 10) IS DISTINCT FROM nullif(p_size, 20)")
def f7_distinct_from(spark, d):
    return table(spark, d, "part").where(~F.nullif(F.col("p_size"), F.lit(10)).eqNullSafe(F.nullif(F.col("p_size"), F.lit(20)))).select("p_partkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN (SELECT p_partkey FROM part WHERE p_size = 7) ON p_partkey = l_partkey")
def f8_id_set(spark, d):
    ids = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(ids, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT event_id FROM events WHERE nullif(event_id % 4, 0) IS NULL OR row(event_id % 4, user_id) > row(2, 40)")
def f9_row_value(spark, d):
    at = F.nullif(F.col("event_id") % 4, F.lit(0))
    return table(spark, d, "events").where(matching.earlier(at, F.col("user_id"), F.lit(2).cast("long"), F.lit(40).cast("long"))).select("event_id")


@query("SELECT s_suppkey FROM supplier WHERE upper(trim(' ' || lower(s_name) || ' ')) = upper(trim(s_name))")
def f11_same_name(spark, d):
    return table(spark, d, "supplier").where(F.upper(F.trim(F.concat(F.lit(" "), F.lower("s_name"), F.lit(" ")))) == F.upper(F.trim("s_name"))).select("s_suppkey")


@query("SELECT o_orderkey AS key, '{' || upper(md5(o_orderpriority)) || '}' AS gid FROM orders")
def d9_global_ids(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), clean.global_id(F.concat(F.lit(" {"), F.md5("o_orderpriority"), F.lit("} "))).alias("gid"))


@query(f"""WITH {ad.SEG}, k AS (SELECT id, layer || ':' || id AS key FROM seg)
 SELECT id, id % 9 = 4 OR (layer = 'road' AND name = 'Road 5') OR id % 9 = 5 AND id > 9 AS excluded, CASE WHEN id % 9 = 4 THEN 'by key' WHEN id % 9 = 5 AND id > 9 THEN 'by key' WHEN layer = 'road' AND name = 'Road 5' THEN 'by name' END AS reason FROM seg""")
def d8_exclusions(spark, d):
    seg = ad.seg(spark, d).withColumn("source_key", F.col("id").cast("string"))
    mine = seg.where("id % 9 = 4").select("layer", F.col("source_key").alias("key"), F.col("name"), F.lit("by key").alias("reason"))
    moved = seg.where("id % 9 = 5 and id > 9").select("layer", F.concat(F.lit("old"), "source_key").alias("key"), F.col("name"), F.lit("by key").alias("reason"))
    dup = seg.where("id % 9 = 5 and id > 9").select("layer", F.concat(F.lit("old"), "source_key").alias("dropped_key"), F.col("source_key").alias("canonical_key"))
    names = spark.createDataFrame([("road", " road 5 ", "by name"), ("road", "Nowhere", "by name")], "layer string, name string, reason string")
    out, _ = clean.apply_exclusions(seg, mine.unionByName(moved), names, dup)
    return out.select("id", "excluded", F.col("exclusion_reason").alias("reason"))


@query("SELECT 'road' AS layer, 'NOWHERE' AS key, 'orphan' AS warning UNION ALL SELECT 'road', '999999999', 'orphan' UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'cartpath' ELSE 'road' END, CAST(s_suppkey AS VARCHAR), 'renamed' FROM supplier WHERE s_suppkey IN (3, 4)")
def d8_warnings(spark, d):
    seg = ad.seg(spark, d).withColumn("source_key", F.col("id").cast("string"))
    mine = seg.where("id in (3, 4)").select("layer", F.col("source_key").alias("key"), F.lit("Other name").alias("name"), F.lit("x").alias("reason"))
    lost = spark.createDataFrame([("road", "999999999", None, "x")], "layer string, key string, name string, reason string")
    names = spark.createDataFrame([("road", "Nowhere", "by name")], "layer string, name string, reason string")
    none = spark.createDataFrame([], "layer string, dropped_key string, canonical_key string")
    return clean.apply_exclusions(seg, mine.unionByName(lost), names, none)[1]


@query(f"WITH {LOG} SELECT source, CASE WHEN arg_max(status, row(finished_at, id)) = 'failed' THEN 'failing' WHEN max(finished_at) FILTER (status = 'ok') IS NULL OR max(finished_at) FILTER (status = 'ok') < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 36 HOUR THEN 'stale' ELSE 'ok' END AS state, arg_max(id, row(finished_at, id)) AS latest_id, arg_max(id, row(finished_at, id)) FILTER (status = 'ok') AS last_ok_id FROM jobs GROUP BY source")
def h2_health(spark, d):
    got = health.source_health(ad.joblog(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return got.select("source", "state", "latest_id", "last_ok_id")


@query("SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_type = 'error' THEN 'HTTP 503' ELSE '' END AS brief, event_type || ' done' AS headline FROM events")
def z2_brief(spark, d):
    return ad.joblog(spark, d).select("id", text.brief(F.col("error")).alias("brief"), text.first_line(F.col("summary")).alias("headline"))


@query("SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE left(text, 157) || '...' END AS short FROM documents")
def z3_shorten(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shorten(F.col("text")).alias("short"))


@query("SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%b %-d, %-I:%M %p') AS said, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events")
def z4_eastern(spark, d):
    return table(spark, d, "events").select("event_id", text.eastern(F.col("ts")).alias("said"), text.eastern_date(F.col("ts")).alias("day"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN make_timestamp(CAST(1700000000000 + o_orderkey * 1000 AS BIGINT) * 1000) END AS at FROM orders")
def z5_epoch(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("key"), text.epoch_millis(F.when(k % 3 != 0, 1700000000000 + k * 1000).otherwise(F.lit(0))).alias("at"))


@query("SELECT o_orderkey AS key, round(o_totalprice / 1609.344, 2) AS miles FROM orders")
def z6_miles(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), matching.miles(F.col("o_totalprice")).alias("miles"))


@query("SELECT o_orderpriority AS layer, count(*) AS feature_count, max(o_orderkey) AS max_oid, max(o_orderdate) AS max_edited_at FROM orders GROUP BY 1")
def s2_signature(spark, d):
    return features.signature(table(spark, d, "orders"), F.col("o_orderpriority"), "o_orderkey", "o_orderdate")


@query("SELECT o_orderpriority AS layer FROM orders GROUP BY 1 HAVING count(*) % 2 = 0 OR o_orderpriority LIKE '1%'")
def h5_stale_layers(spark, d):
    now = features.signature(table(spark, d, "orders"), F.col("o_orderpriority"), "o_orderkey", "o_orderdate")
    stored = now.withColumn("feature_count", F.when(F.col("feature_count") % 2 == 0, F.col("feature_count") + 1).otherwise(F.col("feature_count"))).where("layer not like '1%'")
    return health.stale_layers(now, stored).select("layer")


@query(f"WITH {ad.SEG} SELECT CAST(id AS VARCHAR) AS oid, 1 AS parts, x0, x0 + length_m AS x1 FROM seg")
def s1_features(spark, d):
    """Features as service pages, parsed back."""
    line = F.array(F.array("x0", "y", F.lit(7.0)), F.array(F.col("x0") + F.col("length_m"), F.col("y"), F.lit(7.0)))
    one = F.struct(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct(F.col("id").cast("string").alias("OID")).alias("properties"))
    pages = ad.seg(spark, d).withColumn("page", F.floor(F.col("id") / 50)).groupBy("page").agg(F.to_json(F.struct(F.collect_list(one).alias("features"))).alias("body"))
    got = features.parse_features(pages)
    shape = F.get("geom", F.lit(0))
    return got.select(F.col("properties")["OID"].alias("oid"), F.size("geom").alias("parts"), F.get(shape, F.lit(0))["x"].alias("x0"), F.get(shape, F.lit(1))["x"].alias("x1"))


@query("SELECT user_id AS activity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seq, CASE WHEN event_id % 6 <> 0 AND event_id % 9 <> 0 THEN CAST(event_id % 90 AS DOUBLE) END AS lat, CASE WHEN event_id % 6 <> 0 AND event_id % 9 <> 0 THEN CAST(event_id % 180 AS DOUBLE) END AS lon FROM events")
def s4_fixes(spark, d):
    """Stream bodies, one for each user, parsed into fixes."""
    k = F.col("event_id")
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.when(k % 6 != 0, (k % 90).cast("double")).alias("a"), F.when(k % 9 != 0, (k % 180).cast("double")).alias("b"))))
    stream = F.array(F.struct(F.lit("latlng").alias("type"), F.transform("r", lambda x: x["a"]).alias("data"), F.transform("r", lambda x: x["b"]).alias("data2")))
    bodies = table(spark, d, "events").groupBy(F.col("user_id").alias("activity")).agg(rows.alias("r")).select("activity", F.to_json(stream, {"ignoreNullFields": "false"}).alias("body"))
    return features.parse_fixes(bodies)


@query("""WITH j AS (SELECT event_id AS id, ts AS started_at, ts + to_seconds(CAST(floor(value * 20) AS INTEGER)) AS finished_at FROM events WHERE event_type = 'signup'), i AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase')
 SELECT event_id, arg_max(id, row(started_at, id)) AS job_id FROM i LEFT JOIN j ON started_at <= ts AND ts <= finished_at GROUP BY event_id""")
def j23_covering_job(spark, d):
    e = table(spark, d, "events")
    jobs = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.timestamp_add("SECOND", F.floor(F.col("value") * 20).cast("int"), "ts").alias("finished_at"))
    return health.covering_job(e.where("event_type = 'purchase'").select("event_id", "ts"), jobs, "event_id", "ts").select("event_id", "job_id")


@query("""SELECT source, CASE WHEN bad AND (NOT is_open OR NOT told) THEN 'alert' ELSE 'recovered' END AS notice FROM (SELECT n_name AS source, n_nationkey % 2 = 0 AS bad, n_nationkey % 3 > 0 AS is_open, n_nationkey % 3 = 2 AS told FROM nation) WHERE (bad AND (NOT is_open OR NOT told)) OR (NOT bad AND is_open AND told)""")
def h4_alerts(spark, d):
    k = F.col("n_nationkey")
    t, now = table(spark, d, "nation"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    state = t.select(F.col("n_name").alias("source"), F.when(k % 2 == 0, "stale").otherwise("ok").alias("state"))
    opened = t.where(k % 3 > 0).select(F.col("n_name").alias("source"), now.alias("since"), F.when(k % 3 == 2, now).alias("alerted_at"), F.lit(None).cast("timestamp").alias("recovered_at"))
    return health.step_episodes(opened, state, now)[1].select("source", "notice")


@query("SELECT n_name || chr(31) || 'alert' || chr(30) AS record FROM nation")
def k8_records(spark, d):
    return health.notice_records(table(spark, d, "nation").select(F.col("n_name").alias("a"), F.lit("alert").alias("b")), ["a", "b"])


@query("""SELECT line FROM ((SELECT '  ' || s_name AS line FROM supplier ORDER BY s_suppkey LIMIT 25) UNION ALL SELECT '  … and ' || (count(*) - 25) || ' more' FROM supplier HAVING count(*) > 25)""")
def z12_capped_list(spark, d):
    return health.capped_lines(table(spark, d, "supplier"), F.col("s_name"), ["s_suppkey"])


@query("""WITH s AS (SELECT s_suppkey, DATE '2023-11-20' + CAST(s_suppkey % 40 AS INTEGER) AS a, DATE '2023-11-10' + CAST(s_suppkey * 7 % 200 AS INTEGER) AS b FROM supplier),
 m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS m FROM s WHERE a <= b)
 SELECT s_suppkey AS key, greatest(a, m) AS from_date, least(b, last_day(m)) AS to_date FROM m""")
def m2_month_windows(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("key"), F.date_add(F.lit("2023-11-20").cast("date"), (k % 40).cast("int")).alias("start"), F.date_add(F.lit("2023-11-10").cast("date"), (k * 7 % 200).cast("int")).alias("end"))
    return tracks.month_windows(s).select("key", "from_date", "to_date")


@query("SELECT user_id AS key, CAST(max(ts) - INTERVAL 5 HOUR AS DATE) - 7 AS from_date, DATE '2024-02-01' AS to_date FROM events GROUP BY user_id")
def m1_sync_window(spark, d):
    a, b = tracks.sync_window(F.max("ts"), F.lit("2024-02-01").cast("date"), F.lit("2020-01-01").cast("date"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(a.alias("from_date"), b.alias("to_date"))


@query(f"WITH {ad.SEG} SELECT layer, count(*) AS features, count(*) FILTER (name = 'Road 3') AS of_road_3 FROM seg GROUP BY layer")
def k1_geojson(spark, d):
    """Features of each layer in one collection, and what can be read back from it."""
    seg = ad.seg(spark, d)
    f = exports.geojson_features(seg, "geom", ["id", "layer", "name"])
    f = f.select("feature", F.get_json_object("feature", "$.properties.layer").alias("layer"), F.get_json_object("feature", "$.properties.id").cast("long").alias("id"))
    body = exports.feature_collection(f, ["layer"], ["id"])
    names = F.from_json(F.get_json_object("collection", "$.features"), "array<struct<properties:struct<name:string>>>")
    return body.select("layer", F.size(names).cast("long").alias("features"), F.size(F.filter(names, lambda x: x["properties"]["name"] == "Road 3")).cast("long").alias("of_road_3"))


@query("SELECT user_id AS route, count(*) AS points FROM events GROUP BY user_id")
def k7_gpx(spark, d):
    p = ad.fix(spark, d).select(F.col("track").alias("route"), "seq", (F.col("x") / 10).alias("lat"), (F.col("y") / 10).alias("lon"))
    made = exports.gpx(p, p.select("route").distinct().withColumn("name", F.lit("A & B")))
    return made.where(F.col("gpx").contains("<name>A &amp; B</name>")).select("route", F.size(F.regexp_extract_all("gpx", F.lit("<trkpt "), F.lit(0))).cast("long").alias("points"))


@query("""WITH p AS (SELECT user_id AS route, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, 40 + value / 10000 AS lat, -84 + CAST(json_extract(props, '$.k') AS DOUBLE) / 10000 AS lon FROM events)
 SELECT route, count(*) AS points, count(*) FILTER (seq % 50 = 0) AS cues, CAST(round(first(lat ORDER BY seq) * (2147483648.0::DOUBLE / 180)) AS BIGINT) AS first_lat, CAST(round(last(lon ORDER BY seq) * (2147483648.0::DOUBLE / 180)) AS BIGINT) AS last_lon, 'track ' || route AS name, true AS rising FROM p GROUP BY route""")
def k6_fit(spark, d):
    """A course file for each track, read back: its points and cues, where it begins and ends, its name, and that time and way never fall."""
    from pathloom.catalog.network import latlon
    from pathloom.operators.cues import cumulative
    from pathloom.sources.courses import read_courses

    p = cumulative(latlon(spark, d))
    cues_ = p.where("seq % 50 = 0").withColumn("cue", F.lit("left")).select("route", "lat", "lon", "cum_m", "cue")
    made = exports.fit_courses(p, cues_, p.select("route").distinct().withColumn("name", F.concat(F.lit("track "), F.col("route").cast("string"))), 1_700_000_000, 0.33)
    rows = read_courses(made)
    before = Window.partitionBy("route", "message").orderBy("place")
    falls = F.coalesce((F.col("metres") < F.lag("metres").over(before)) | (F.col("time_s") < F.lag("time_s").over(before)), F.lit(False))
    point, semi = F.col("message") == 20, lambda c: F.round(c * (2147483648.0 / 180)).cast("long")
    return rows.withColumn("falls", falls).groupBy("route").agg(
        F.count_if(point).alias("points"), F.count_if(F.col("message") == 32).alias("cues"), semi(F.min_by("lat", F.when(point, F.col("place")))).alias("first_lat"),
        semi(F.max_by("lon", F.when(point, F.col("place")))).alias("last_lon"), F.max(F.when(F.col("message") == 31, F.col("text"))).alias("name"), (~F.bool_or("falls")).alias("rising"),
    )


# ---- relational operators


@query("SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS f, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'nope'), 2), 0) AS none, count(nullif(o_orderstatus, 'O')) AS not_o, count(*) AS n FROM orders GROUP BY 1")
def a1_filtered(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count_if(s == "F").alias("f"), F.coalesce(F.sum(F.when(s == "nope", F.col("o_totalprice"))), F.lit(0.0)).alias("none"), F.count(F.nullif(s, F.lit("O"))).alias("not_o"), F.count("*").alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 5 AND avg(l_quantity) > 24")
def a3_having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.avg("l_quantity").alias("q")).where("parts > 5 and q > 24").select("l_suppkey", "parts")


@query("SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def a5_share(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("share"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment || ':' || c_nationkey)), ',') AS labels FROM customer GROUP BY 1")
def a6_sorted_labels(spark, d):
    label = F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


@query("SELECT l_suppkey AS main, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 1")
def a12_main(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("main")).agg(F.round(F.sum("l_quantity"), 2).alias("total")).orderBy(F.desc("total"), "main").limit(1)


@query("SELECT user_id, arg_min(event_id, row(ts, event_id)) AS first_event FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def a13_earliest(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("""WITH b AS (SELECT s_nationkey AS n, abs(s_acctbal - c_acctbal) AS dist FROM supplier JOIN customer ON s_nationkey = c_nationkey), m AS (SELECT n, min(dist) AS dist FROM b GROUP BY n)
 SELECT CASE WHEN dist < 10 THEN 0 WHEN dist < 15 THEN 1 WHEN dist < 20 THEN 2 WHEN dist < 60 THEN 3 ELSE 4 END AS slot, count(*) AS n FROM m GROUP BY 1""")
def a14_histogram(spark, d):
    b = table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_nationkey") == F.col("c_nationkey")).groupBy("s_nationkey").agg(F.min(F.abs(F.col("s_acctbal") - F.col("c_acctbal"))).alias("dist"))
    return b.groupBy(matching.bucket(F.col("dist"), (10, 15, 20, 60)).alias("slot")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT c_custkey, round(min(abs(s_acctbal - c_acctbal)), 4) AS dist FROM customer, supplier WHERE abs(s_acctbal - c_acctbal) <= 50 GROUP BY 1) SELECT customer.c_custkey AS item, dist FROM customer LEFT JOIN n USING (c_custkey)""")
def j8_nearest_value(spark, d):
    """Nearest supplier by balance within 50: in cells of 50 with both neighbours' suppliers, the one before or after in order."""
    v, cell = F.col("s_acctbal"), F.floor(F.col("s_acctbal") / 50)
    s = table(spark, d, "supplier").select("s_acctbal").distinct().select(F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"), F.lit(None).cast("long").alias("item"), v.alias("at"), v.alias("s"), F.lit(False).alias("asks"))
    c = table(spark, d, "customer").select(F.floor(F.col("c_acctbal") / 50).alias("cell"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("at"), F.lit(None).cast("double").alias("s"), F.lit(True).alias("asks"))
    order = Window.partitionBy("cell")
    both = s.unionByName(c).withColumn("below", F.last("s", True).over(order.orderBy("at"))).withColumn("above", F.last("s", True).over(order.orderBy(F.desc("at"))))
    gap = F.least(F.abs(F.col("below") - F.col("at")), F.abs(F.col("above") - F.col("at")))
    return both.where("asks").select("item", F.when(gap <= 50, F.round(gap, 4)).alias("dist"))


@query("SELECT a.l_orderkey AS k, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE least(a.l_quantity, b.l_quantity) - greatest(a.l_discount * 100, b.l_discount * 100) > 30")
def j19_overlap(spark, d):
    t = table(spark, d, "lineitem")
    a, b = (t.select("l_orderkey", *[F.col(x).alias(f"{s}_{x}") for x in ("l_linenumber", "l_partkey", "l_quantity", "l_discount")]) for s in "ab")
    return a.join(b, "l_orderkey").where("a_l_partkey < b_l_partkey").where(F.least("a_l_quantity", "b_l_quantity") - F.greatest(F.col("a_l_discount") * 100, F.col("b_l_discount") * 100) > 30).select(F.col("l_orderkey").alias("k"), F.col("a_l_linenumber").alias("a"), F.col("b_l_linenumber").alias("b"))


@query("SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def j21_lookup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return n.join(s, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


@query("SELECT event_type, event_id, ts FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS last FROM events) WHERE ts = last")
def j22_latest_change(spark, d):
    last = F.max("ts").over(Window.partitionBy("event_type"))
    return table(spark, d, "events").withColumn("_last", last).where("ts = _last").select("event_type", "event_id", "ts")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 END, c_custkey) AS canonical FROM customer")
def j25_canonical(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    to = c.where("id % 3 = 0").select("id", F.floor(F.col("id") / 3).alias("to"))
    return c.join(to, "id", "left").select("id", F.coalesce("to", "id").alias("canonical"))


@query("SELECT k AS layer, count(o_orderkey) AS n, max(o_orderdate) AS latest FROM (VALUES ('1-URGENT'), ('5-LOW'), ('none')) v(k) LEFT JOIN orders ON o_orderpriority = k GROUP BY k")
def j26_layer_status(spark, d):
    names = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("none",)], "layer string")
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("layer")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    return names.join(o, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "latest")


@query("SELECT s_suppkey AS id, CAST(unnest(generate_series(1, greatest(1, s_suppkey % 6))) AS BIGINT) AS i FROM supplier")
def j28_series(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), k % 6))).alias("i"))


@query("SELECT l_orderkey AS part, l_suppkey AS s, lag(l_suppkey) OVER w AS prior, lead(l_suppkey) OVER w AS following, CAST(row_number() OVER w AS INTEGER) AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def w7_lag_lead(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_suppkey").alias("s"), F.lag("l_suppkey").over(w).alias("prior"), F.lead("l_suppkey").over(w).alias("following"), F.row_number().over(w).alias("rn"))


@query("SELECT n_nationkey AS source, row_number() OVER (ORDER BY n_name) AS id FROM nation UNION ALL SELECT s_suppkey + 1000, row_number() OVER (ORDER BY s_name DESC, s_suppkey) FROM supplier")
def w8_numbering(spark, d):
    from pathloom.operators.numbering import number_rows

    a = number_rows(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source"), "n_name"), ["n_name"]).select("source", "id")
    b = number_rows(table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("source"), "s_name", "s_suppkey"), [F.desc("s_name"), "s_suppkey"]).select("source", "id")
    return a.unionByName(b)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def o1_latest_jobs(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("SELECT l_orderkey AS part, arg_min(l_partkey, row(l_linenumber, l_partkey, l_suppkey)) AS first_part, arg_max(l_partkey, row(l_linenumber, l_partkey, l_suppkey)) AS last_part FROM lineitem GROUP BY 1")
def o2_first_last(spark, d):
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("part")).agg(F.min_by("l_partkey", at).alias("first_part"), F.max_by("l_partkey", at).alias("last_part"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY nullif(p_size, 1) ASC NULLS LAST, p_partkey) AS place FROM part")
def o3_nulls_last(spark, d):
    size = F.nullif(F.col("p_size"), F.lit(1))
    parts = table(spark, d, "part").select("p_partkey", size.isNull().alias("none"), size.alias("s"))
    return number_rows(parts, ["none", "s", "p_partkey"], "place").select("p_partkey", "place")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_regionkey FROM nation")
def o5_unions(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    return a.union(table(spark, d, "nation").select("n_regionkey"))


@query("SELECT o_orderkey, o_totalprice, (SELECT max(o_totalprice) FROM orders) AS top FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def o7_scalar_subquery(spark, d):
    o = table(spark, d, "orders")
    s = o.agg(F.max("o_totalprice").alias("top"), (F.avg("o_totalprice") * 1.8).alias("_a"))
    return o.join(F.broadcast(s), F.col("o_totalprice") > F.col("_a")).select("o_orderkey", "o_totalprice", "top")


@query("SELECT event_type AS layer, count(*) FILTER (before) AS n_before, count(*) FILTER (NOT before) AS n_after FROM (SELECT event_type, ts < TIMESTAMP '2024-01-15' AS before FROM events) GROUP BY 1")
def a17_snapshots(spark, d):
    e = table(spark, d, "events")
    snap = lambda df, name: df.groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias(name))
    both = snap(e.where("ts < timestamp '2024-01-15'"), "n_before").join(snap(e.where("ts >= timestamp '2024-01-15'"), "n_after"), "layer", "full_outer")
    return both.fillna(0)


@query("SELECT event_id, user_id % 3 AS k FROM events WHERE user_id % 3 = 1 AND event_type = 'click'")
def s9_pruned_scan(spark, d):
    """A table partitioned by network and layer, read for one of each."""
    from pathloom.operators.components import shared_folder
    import uuid

    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("network_id"), F.col("event_type").alias("layer")).write.partitionBy("network_id", "layer").parquet(folder)
    return features.scan_network(spark, folder, 1, "click").select("event_id", F.col("network_id").cast("long").alias("k"))


@query("SELECT n_nationkey AS id, i - 1 AS seq, list_extract([n_nationkey, n_nationkey * 3, n_regionkey], i) AS key FROM nation, generate_series(1, 3) t(i)")
def s11_arrays(spark, d):
    """Arrays as rows, with their places."""
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("id"), F.posexplode(F.array(n, n * 3, F.col("n_regionkey"))).alias("seq", "key"))
