"""Course files read back: the messages of each file as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pathloom.sources.exports import COURSE_POINT, EPOCH, RECORD, SEMICIRCLES, fit_crc

#: Formats by base type's number: unsigned, signed, text and so on; others are kept as bytes.
_FORMATS = {0x00: "B", 0x01: "b", 0x02: "B", 0x83: "h", 0x84: "H", 0x85: "i", 0x86: "I"}
#: Fields of a place in the messages that have one: time, latitude, longitude, distance.
_PLACES = {RECORD[0]: (253, 0, 1, 5), COURSE_POINT[0]: (1, 2, 3, 4)}


def messages(data: bytes) -> Iterator[tuple[int, dict[int, int | bytes]]]:
    """(global number, value by field number) of each message, in order; ValueError for a file that is cut, changed or no course file."""
    if len(data) < 16 or data[8:12] != b".FIT":
        raise ValueError("no course file")
    head, size = data[0], struct.unpack_from("<I", data, 4)[0]
    if len(data) != head + size + 2 or fit_crc(data):
        raise ValueError("a course file that is cut or changed")
    at, known = head, {}
    while at < head + size:
        first = data[at]
        if first & 0x40:  # what the messages of a local number look like
            order, number, count = "<>"[data[at + 2] & 1], 0, data[at + 5]
            number = struct.unpack_from(order + "H", data, at + 3)[0]
            known[first & 15] = (order, number, [tuple(data[at + 6 + 3 * k : at + 9 + 3 * k]) for k in range(count)])
            at += 6 + 3 * count
            continue
        order, number, fields = known[first & 15]
        at, values = at + 1, {}
        for field, length, base in fields:
            form = _FORMATS.get(base)
            values[field] = struct.unpack_from(order + form, data, at)[0] if form else data[at : at + length]
            at += length
        yield number, values


def read_courses(df: DataFrame, key: str = "route", column: str = "fit") -> DataFrame:
    """``(route, place, message, time_s, lat, lon, metres, kind, text)``: a row for each message of each file, numbered from 1.

    Places are those of records and course points, ``kind`` and ``text`` a course point's type and name, and a course's name. A null
    file gives no rows; a broken one raises.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, data in zip(frame[key], frame[column]):
                rows = []
                for place, (number, v) in enumerate(messages(bytes(data)) if data is not None else (), 1):
                    time, lat, lon, metres = (v.get(f) for f in _PLACES.get(number, (None,) * 4))
                    name = v.get(6) if number == COURSE_POINT[0] else v.get(5) if number == 31 else None
                    rows.append((own, place, number, time + EPOCH if time is not None else None, lat / SEMICIRCLES if lat is not None else None, lon / SEMICIRCLES if lon is not None else None, metres / 100 if metres is not None else None, v.get(5) if number == COURSE_POINT[0] else None, name.split(b"\0")[0].decode() if name is not None else None))
                names = [key, "place", "message", "time_s", "lat", "lon", "metres", "kind", "text"]
                yield pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in ("time_s", "kind")})

    kind = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(run, f"{key} {kind}, place long, message int, time_s long, lat double, lon double, metres double, kind long, text string")
