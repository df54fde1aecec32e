"""GeoJSON, GPX and course files from rows, and versioned folders as tables."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.numbering import number_rows


def geojson_features(df: DataFrame, geom: str, properties: list[str], digits: int = 6) -> DataFrame:
    """``(feature)``: a GeoJSON object for each row, coordinates rounded."""
    line = F.transform(geom, lambda part: F.transform(part, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))
    shape = F.struct(F.lit("MultiLineString").alias("type"), line.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def feature_collection(features: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(*keys, collection)``: a collection for each key, its features in order. A key's map is one value by its nature, so
    keys are map tiles or layers of a network, not everything."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "feature")))
    body = F.array_join(F.transform(rows, lambda r: r["feature"]), ",")
    return features.groupBy(*keys).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("collection"))


def write_collection(features: DataFrame, folder: str, order: list[str]) -> None:
    """One collection of any size over the text files of ``folder``, features in ``order``: joined in order of their
    paths they are one JSON document. Each task writes a range of the features; head and tail are files of their own."""
    spark = features.sparkSession
    placed = number_rows(features.select(*order, "feature"), order, "_place")
    line = F.concat(F.when(F.col("_place") == 1, "").otherwise(","), F.col("feature"))
    spark.createDataFrame([('{"type":"FeatureCollection","features":[',)], "value string").coalesce(1).write.text(f"{folder}/0-head")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "_place").sortWithinPartitions("_place").select(line.alias("value")).write.text(f"{folder}/1-features")
    spark.createDataFrame([("]}",)], "value string").coalesce(1).write.text(f"{folder}/2-tail")


def escape_xml(text: Column) -> Column:
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def gpx(points: DataFrame, names: DataFrame, key: str = "route") -> DataFrame:
    """``(route, gpx)``: one track for each route, points with seven decimals."""
    place = F.format_string('<trkpt lat="%.7f" lon="%.7f"/>', "lat", "lon")
    rows = F.array_sort(F.collect_list(F.struct("seq", place.alias("p"))))
    body = points.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["p"]), "").alias("body")).join(names, key)
    return body.select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="pathloom" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), escape_xml(F.col("name")), F.lit("</name><trkseg>"), F.col("body"), F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def fit_crc(data: bytes) -> int:
    """CRC-16 with the reflected polynomial 0xA001, as course files end with."""
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    return crc


# The course file's messages as (global number, [(field, size, base type, format)]).
FILE_ID = (0, [(0, 1, 0x00, "B"), (1, 2, 0x84, "H"), (2, 2, 0x84, "H"), (4, 4, 0x86, "I")])
COURSE = (31, [(4, 1, 0x00, "B"), (5, 64, 0x07, "64s")])
LAP = (19, [(253, 4, 0x86, "I"), (0, 1, 0x00, "B"), (1, 1, 0x00, "B"), (2, 4, 0x86, "I"), (3, 4, 0x85, "i"), (4, 4, 0x85, "i"), (5, 4, 0x85, "i"), (6, 4, 0x85, "i"), (7, 4, 0x86, "I"), (8, 4, 0x86, "I"), (9, 4, 0x86, "I")])
EVENT = (21, [(253, 4, 0x86, "I"), (0, 1, 0x00, "B"), (1, 1, 0x00, "B")])
RECORD = (20, [(253, 4, 0x86, "I"), (0, 4, 0x85, "i"), (1, 4, 0x85, "i"), (5, 4, 0x86, "I")])
COURSE_POINT = (32, [(1, 4, 0x86, "I"), (2, 4, 0x85, "i"), (3, 4, 0x85, "i"), (4, 4, 0x86, "I"), (5, 1, 0x00, "B"), (6, 16, 0x07, "16s")])
# Course point types by cue; the generic one is for services that drop the others.
POINT_TYPES = {"generic": 0, "left": 6, "right": 7, "straight": 8, "left_fork": 16, "right_fork": 17, "slight_left": 19, "sharp_left": 20, "slight_right": 21, "sharp_right": 22, "u_turn": 23}
# A course's file type, the maker's number for development, running, the timer event and its kinds.
COURSE_FILE, DEVELOPMENT, RUNNING, TIMER, START, STOP_ALL = 6, 255, 1, 0, 0, 4
SEMICIRCLES = 2**31 / 180
#: Seconds from 1970 to the format's epoch, the end of 1989.
EPOCH = 631_065_600


def fit_course(name: str, points: list[tuple[float, float, float]], cues: list[tuple[float, float, float, str]], start_s: int, pace_s_per_m: float, generic: bool = True) -> bytes:
    """A course file: ``points`` (lat, lon, metres along) and ``cues`` (lat, lon, metres along, cue) at an even pace.

    ``generic`` gives all cues the generic type, with the direction in their names only; otherwise each has its own.
    Names are ASCII, other characters a question mark, cut to what the field holds.
    """
    semi = lambda d: round(d * SEMICIRCLES)
    begin = start_s - EPOCH
    at = lambda m: begin + round(m * pace_s_per_m)
    text = lambda s, most: s.encode("ascii", "replace")[:most]
    (a, b, _), (y, z, total) = points[0], points[-1]
    took = round(total * pace_s_per_m * 1000)
    rows = [
        (FILE_ID, [(COURSE_FILE, DEVELOPMENT, 0, begin)]),
        (COURSE, [(RUNNING, text(name, 63))]),
        (LAP, [(begin, TIMER, START, begin, semi(a), semi(b), semi(y), semi(z), took, took, round(total * 100))]),
        (EVENT, [(begin, TIMER, START)]),
        (RECORD, [(at(m), semi(lat), semi(lon), round(m * 100)) for lat, lon, m in points]),
        (COURSE_POINT, [(at(m), semi(lat), semi(lon), round(m * 100), POINT_TYPES["generic" if generic else cue], text(cue, 15)) for lat, lon, m, cue in cues]),
        (EVENT, [(at(total), TIMER, STOP_ALL)]),
    ]
    body = b""
    for (number, fields), values in rows:
        if values:
            body += struct.pack("<BBBHB", 0x40, 0, 0, number, len(fields)) + b"".join(struct.pack("BBB", *f[:3]) for f in fields)
            form = "<B" + "".join(f[3] for f in fields)
            body += b"".join(struct.pack(form, 0, *v) for v in values)
    head = struct.pack("<BBHI4s", 14, 0x10, 2149, len(body), b".FIT")
    head += struct.pack("<H", fit_crc(head))
    return head + body + struct.pack("<H", fit_crc(head + body))


def fit_courses(points: DataFrame, cues: DataFrame, names: DataFrame, start_s: int, pace_s_per_m: float, generic: bool = True, key: str = "route") -> DataFrame:
    """``(route, fit)``: a course file for each route of ``points`` (route, seq, lat, lon, cum_m) and ``cues`` (.., cue)."""
    p = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon", "cum_m"))).alias("points"))
    q = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cum_m", "lat", "lon", "cue"))).alias("cues"))
    rows = names.join(p, key).join(q, key, "left")

    def write(batches):
        for pdf in batches:
            made = [fit_course(r.name, [(x["lat"], x["lon"], x["cum_m"]) for x in r.points], [(x["lat"], x["lon"], x["cum_m"], x["cue"]) for x in (r.cues if r.cues is not None else [])], start_s, pace_s_per_m, generic) for r in pdf.itertuples()]
            yield pdf[[key]].assign(fit=made)

    return rows.mapInPandas(write, f"{key} {dict(rows.dtypes)[key]}, fit binary")


def publish(df: DataFrame, folder: str, version: int) -> None:
    """A new state as a folder of its own, which readers see once it is whole; a version is written once."""
    df.write.mode("error").parquet(f"{folder}/version={version}")


def published(spark: SparkSession, folder: str) -> int | None:
    """The highest version whose writing is over, None if there is none: what readers follow."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(path(folder))]
    return max((int(n[8:]) for n in names if n.startswith("version=") and fs.exists(path(f"{folder}/{n}/_SUCCESS"))), default=None)


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The state that is published now; FileNotFoundError if none is."""
    version = published(spark, folder)
    if version is None:
        raise FileNotFoundError(folder)
    return spark.read.parquet(f"{folder}/version={version}")


def drop_before(spark: SparkSession, folder: str, version: int, keep: int = 2) -> None:
    """Delete versions that ``keep`` later ones have replaced; readers may still hold the last ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for x in fs.listStatus(path(folder)):
        name = x.getPath().getName()
        if name.startswith("version=") and int(name[8:]) <= version - keep:
            fs.delete(x.getPath(), True)
