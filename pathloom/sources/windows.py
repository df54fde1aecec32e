"""Windows of days as a stream, so that a listing is gone through month by month and never twice.

A micro-batch is one window: the rest of a calendar month, or of the days up to the end. The stream's offset is the first day
that is still to be listed, and Spark's checkpoint keeps it: a stream that starts again goes on behind the last window
that was done, and takes one that failed again. Only the window's two days pass through the driver; what is listed for
it is fetched by tasks.
"""

from __future__ import annotations

import calendar
import datetime as dt
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from pathloom.sources.features import fetch

WINDOW = "from_date date, to_date date, list_from date"


class DayWindows(DataSource):
    """``spark.readStream.format("day_windows").option("start", day)``; options ``end``, a day, today by itself, and ``overlap``,
    how many days before a window are listed again for what came late."""

    @classmethod
    def name(cls) -> str:
        return "day_windows"

    def schema(self) -> str:
        return WINDOW

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Windows(self.options)


def window_from(day: dt.date, end: dt.date, start: dt.date, overlap: int) -> tuple[dt.date, dt.date, dt.date] | None:
    """The window that begins on the day: to the month's last day or the end; None behind the end."""
    if day > end:
        return None
    last = day.replace(day=calendar.monthrange(day.year, day.month)[1])
    return day, min(last, end), max(start, day - dt.timedelta(days=overlap))


class _Windows(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.start = dt.date.fromisoformat(options["start"])
        self.fixed_end, self.overlap = options.get("end"), int(options.get("overlap", 7))

    def initialOffset(self) -> dict:
        return {"day": self.start.isoformat()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = dt.date.fromisoformat(self.fixed_end) if self.fixed_end else dt.date.today()
        found = window_from(dt.date.fromisoformat(start["day"]), end, self.start, self.overlap)
        if found is None:
            return iter(()), start
        return iter([found]), {"day": (found[1] + dt.timedelta(days=1)).isoformat()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A window that was begun before, with the end that it had then."""
        found = window_from(dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(end["day"]) - dt.timedelta(days=1), self.start, self.overlap)
        return iter([found] if found else ())

    def commit(self, end: dict) -> None:
        pass


def listed(windows: DataFrame, url: str) -> DataFrame:
    """``(from_date, to_date, body)``: what the service lists for each window, fetched by tasks, with its retries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w in frames:
            bodies = [fetch(f"{url}?{urllib.parse.urlencode({'oldest': a, 'newest': b})}") for a, b in zip(w["list_from"], w["to_date"])]
            yield w[["from_date", "to_date"]].assign(body=bodies)

    return windows.select("from_date", "to_date", "list_from").mapInPandas(run, "from_date date, to_date date, body string")


def follow_windows(spark: SparkSession, start: str, each: Callable[[DataFrame], None], checkpoint: str, end: str | None = None, overlap: int = 7) -> None:
    """``each(window)``, a row of ``from_date, to_date, list_from``, for every window up to the end that the checkpoint does
    not have yet, in order; it must bear a window that comes again after a failure. An error ends the stream and is raised."""
    spark.dataSource.register(DayWindows)
    stream = spark.readStream.format("day_windows").option("start", start).option("overlap", overlap)
    stream = (stream.option("end", end) if end else stream).load()

    def one(batch: DataFrame, _: int) -> None:
        rows = batch.collect()  # one window
        if rows:
            each(spark.createDataFrame(rows, WINDOW))

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
