"""Sync of listed activities by month: what is new is fetched, classified and committed, a window at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import clean, tracks
from pathloom.sources import windows


def commit(activities: DataFrame, folder: str, window: str) -> None:
    """A window's activities as a part of their own; a window that comes again gets another number."""
    activities.write.mode("error").parquet(f"{folder}/part={_parts(activities.sparkSession, folder)[1]:06d}-{window}")


def _parts(spark: SparkSession, folder: str) -> tuple[list[str], int]:
    """The parts that are whole, and the number of the next one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    found = sorted(n for n in names if n.startswith("part="))
    return [f"{folder}/{n}" for n in found if fs.exists(path(f"{folder}/{n}/_SUCCESS"))], int(found[-1][5:11]) + 1 if found else 1


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All committed activities, the newest row of each ``id``."""
    whole, _ = _parts(spark, folder)
    if not whole:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*whole).withColumn("_part", F.col("_metadata.file_path"))
    return clean.latest(rows, ["id"], ["_part"]).drop("_part")


def sync(listing: DataFrame, fetch: Callable[[DataFrame], DataFrame], boxes: DataFrame, start: str, end: str, accepted: list[str], folder: str, each: Callable[[DataFrame, DataFrame], None] | None = None, refetch: bool = False, dry_run: bool = False) -> DataFrame:
    """``(from_date, reason, n)``: what the sync does with the activities listed from ``start`` to ``end``, by month.

    ``listing`` has ``id, day, start_at, type, stub, has_latlng``; ``fetch`` gives the fixes ``(track, seq, x, y)`` of
    ids, once a window, all at once. An activity is skipped for the first reason of :func:`tracks.listing_reason`;
    known are those committed already, unless ``refetch``, and those of earlier windows. Each month is one commit, so a
    failure keeps the months before it; ``each(activities, fixes)`` is called after it, for matching the new runs. A dry
    run counts the same and commits nothing. Fetched activities are counted by status: city, outside or no_gps.
    """
    spark = listing.sparkSession
    schema = f"id {dict(listing.dtypes)['id']}, start_at timestamp, status string, network_id long"
    months = tracks.month_windows(spark.createDataFrame([(start, end)], "start string, end string").select(F.to_date("start").alias("start"), F.to_date("end").alias("end")))
    known, counts = stored(spark, folder, schema).select("id"), None
    for w in months.orderBy("from_date").collect():  # a row a month
        met = listing.where(F.col("day").between(F.lit(w["from_date"]), F.lit(w["to_date"])))
        met = met.join(known.distinct().withColumn("_known", F.lit(True)), "id", "left")
        reason = tracks.listing_reason(F.col("type"), F.coalesce("stub", F.lit(False)) | F.col("start_at").isNull(), F.coalesce(F.col("has_latlng"), F.lit(False)), F.col("_known").isNotNull(), accepted, refetch)
        met = met.withColumn("reason", reason).checkpoint()
        todo = met.where("reason = 'fetch'").select(F.col("id").alias("track"), "start_at").dropDuplicates(["track"])
        fixes = tracks.real_fixes(fetch(todo.select("track")), "x", "y").checkpoint()
        status = tracks.classify(todo, fixes, boxes)
        rows = todo.join(status, "track").select(F.col("track").alias("id"), "start_at", "status", F.col("network_id").cast("long").alias("network_id")).checkpoint()
        if not dry_run and not rows.isEmpty():
            commit(rows, folder, f"{w['from_date']}")
            if each:
                each(rows, fixes)
        known = known.unionByName(rows.select("id")).checkpoint()
        found = met.where("reason != 'fetch'").groupBy("reason").agg(F.count("*").alias("n")).unionByName(rows.groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("n")))
        found = found.select(F.lit(w["from_date"]).alias("from_date"), "reason", "n").checkpoint()
        counts = found if counts is None else counts.unionByName(found)
    return counts if counts is not None else spark.createDataFrame([], "from_date date, reason string, n long")


def follow(spark: SparkSession, list_window: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame], boxes: DataFrame, start: str, accepted: list[str], folder: str, checkpoint: str, end: str | None = None, each: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """Syncs window by window from where ``checkpoint`` left off (:func:`windows.follow_windows`). ``list_window(window)`` lists
    from its ``list_from`` to its ``to_date``; activities listed again are known, so a window that comes again fetches nothing twice."""

    def one(window: DataFrame) -> None:
        w = window.first()
        sync(list_window(window), fetch, boxes, str(w["list_from"]), str(w["to_date"]), accepted, folder, each)

    windows.follow_windows(spark, start, one, checkpoint, end)
