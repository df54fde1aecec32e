"""Feature services, activity listings, fix streams and settings as sources."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathloom.functions.geometry import MULTILINE

FEATURES = "array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
PAGE = 1000


def fetch(url: str, tries: int = 3, base_s: float = 1.0, opener=urllib.request.urlopen, sleep=time.sleep) -> str:
    """A page's text: too many requests and server errors are tried again after ``Retry-After`` or a doubled wait; other
    errors are not."""
    for attempt in range(tries):
        try:
            with opener(url) as reply:
                return reply.read().decode()
        except urllib.error.HTTPError as e:
            if attempt == tries - 1 or not (e.code == 429 or e.code >= 500):
                raise
            sleep(float(e.headers.get("Retry-After") or base_s * 2**attempt))
    raise AssertionError


class FeatureService(DataSource):
    """``spark.read.format("feature_service").option("url", ...).option("count", n)``: a partition for each page of features.

    ``count`` is the layer's feature count, which its signature gives; a page's body is a row, for :func:`parse_features`.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return "page long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.url, self.count, self.page = options["url"], int(options["count"]), int(options.get("page", PAGE))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(max(1, -(-self.count // self.page)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query = urllib.parse.urlencode({"where": "1=1", "outFields": "*", "f": "geojson", "resultOffset": partition.value * self.page, "resultRecordCount": self.page})
        yield partition.value, fetch(f"{self.url}/query?{query}")


def parse_features(pages: DataFrame, body: str = "body") -> DataFrame:
    """``(properties map, geom array of parts)`` of GeoJSON bodies; an ``error`` body raises. A single line is one part, and
    further ordinates than x and y are dropped; features without coordinates have a null geometry."""
    has_error = F.get_json_object(body, "$.error").isNotNull()
    checked = F.when(has_error, F.raise_error(F.concat(F.lit("the service answered "), F.get_json_object(body, "$.error")))).otherwise(F.col(body))
    each = pages.select(F.explode(F.from_json(F.get_json_object(checked, "$.features"), FEATURES)).alias("f"))
    single = F.from_json("f.geometry.coordinates", "array<array<double>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    line = lambda p: F.transform(p, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))
    geom = F.when(F.col("f.geometry.type") == "LineString", F.array(line(single))).when(F.col("f.geometry.type") == "MultiLineString", F.transform(many, line))
    return each.select(F.col("f.properties").alias("properties"), F.when(F.size(geom) > 0, geom).cast(MULTILINE).alias("geom"))


def parse_fixes(streams: DataFrame, key: str = "activity", body: str = "body") -> DataFrame:
    """``(activity, seq, lat, lon)`` of stream bodies; a null in either place makes a null fix.

    Lists of unequal length, places out of range and values that are no numbers raise.
    """
    kind = "array<struct<type:string,data:array<string>,data2:array<string>>>"
    picked = F.get(F.filter(F.from_json(body, kind), lambda s: s["type"] == "latlng"), F.lit(0))
    s = streams.select(key, picked.alias("s")).where("s is not null")
    s = s.withColumn("s", F.when(F.size("s.data") != F.size("s.data2"), F.raise_error(F.lit("unequal lengths"))).otherwise(F.col("s")))
    fixes = s.select(key, F.posexplode(F.arrays_zip(F.col("s.data").alias("lat"), F.col("s.data2").alias("lon"))).alias("seq", "p"))
    return fixes.select(key, "seq", _degrees(F.col("p.lat"), F.col("p.lon"), 90).alias("lat"), _degrees(F.col("p.lon"), F.col("p.lat"), 180).alias("lon"))


def _degrees(value: Column, other: Column, most: int) -> Column:
    number = value.try_cast("double")
    bad = value.isNotNull() & (number.isNull() | (F.abs(number) > most))
    return F.when(value.isNull() | other.isNull(), F.lit(None)).when(bad, F.raise_error(F.concat(F.lit("no place: "), value))).otherwise(number)


def signature(features: DataFrame, layer: Column, oid: str, edited: str) -> DataFrame:
    """``(layer, feature_count, max_oid, max_edited_at)``."""
    return features.groupBy(layer.alias("layer")).agg(F.count("*").alias("feature_count"), F.max(oid).alias("max_oid"), F.max(edited).alias("max_edited_at"))


def load_settings(text: str, network: str, required: set[str]) -> tuple[dict, list[str]]:
    """``(settings, warnings)`` of a YAML text with a block for each network: a missing key raises, an unknown one warns."""
    import yaml

    blocks = yaml.safe_load(text) or {}
    if network not in blocks:
        raise ValueError(f"no settings for network {network!r}")
    own = blocks[network]
    if missing := sorted(required - own.keys()):
        raise ValueError(f"settings lack {', '.join(missing)}")
    return {k: own[k] for k in required}, [f"unknown setting {k}" for k in sorted(own.keys() - required)]


def listing(activities: DataFrame, at: str, oldest: str, newest: str) -> DataFrame:
    """Activities that start on the days from ``oldest`` to ``newest``, both included; a plain range that reaches the scan."""
    return activities.where((F.col(at) >= F.lit(oldest).cast("timestamp")) & (F.col(at) <= F.lit(f"{newest} 23:59:59").cast("timestamp")))


def load_exclusions(text: str) -> list[tuple[str, str | None, str | None, str]]:
    """``(layer, key, name, reason)`` of a YAML text with ``cartpaths`` (by global id) and ``roads`` (by object id, name or both).

    Anything else raises ValueError with the entry's place: unknown keys, no reason, no id, an id that is not a whole number.
    """
    import yaml

    kinds = {"cartpaths": ("cartpath", {"global_id", "reason"}), "roads": ("road", {"object_id", "name", "reason"})}
    blocks = yaml.safe_load(text) or {}
    if not isinstance(blocks, dict) or blocks.keys() - kinds.keys():
        raise ValueError("exclusions take cartpaths and roads only")
    rows = []
    for kind, (layer, allowed) in kinds.items():
        entries = blocks.get(kind) or []
        if not isinstance(entries, list):
            raise ValueError(f"{kind} must be a list")
        for i, entry in enumerate(entries):
            where = f"{kind}[{i}]"
            if not isinstance(entry, dict) or entry.keys() - allowed:
                raise ValueError(f"{where}: only {', '.join(sorted(allowed))}")
            texts = {k: entry.get(k) for k in ("global_id", "name", "reason")}
            if any(v is not None and not (isinstance(v, str) and v.strip()) for v in texts.values()):
                raise ValueError(f"{where}: empty or not a text")
            number = entry.get("object_id")
            if number is not None and type(number) is not int:
                raise ValueError(f"{where}: object_id must be a whole number")
            if texts["reason"] is None or (texts["global_id"] is None if layer == "cartpath" else number is None and texts["name"] is None):
                raise ValueError(f"{where}: a reason and what to exclude are needed")
            key = "{" + texts["global_id"].strip().strip("{}").upper() + "}" if layer == "cartpath" else None if number is None else str(number)
            rows.append((layer, key, texts["name"], texts["reason"]))
    return rows


def scan_network(spark: SparkSession, folder: str, network_id: int, layer: str | None = None) -> DataFrame:
    """A table partitioned by network and layer: the filters prune partitions."""
    rows = spark.read.parquet(folder).where(F.col("network_id") == network_id)
    return rows if layer is None else rows.where(F.col("layer") == layer)
