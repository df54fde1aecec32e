"""Joins by a key that most rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heavy keys that are broadcast; with more of them, what counts as heavy is raised.
MAX_HEAVY = 100_000


def join_by_key(rows: DataFrame, table: DataFrame, on: list[str], hub: int, count: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and in ``count`` how many of ``rows`` have it at most.

    Keys of more than ``hub`` rows come by broadcast, so their rows stay where they are; the others meet in a shuffle.
    There are at most as many heavy keys as there are rows over ``hub``; where these are over ``MAX_HEAVY``, ``hub`` is doubled until
    they are fewer. ``table`` is read several times and should be checkpointed.
    """
    while table.where(F.col(count) > hub).limit(MAX_HEAVY + 1).count() > MAX_HEAVY:
        hub *= 2
    heavy, light = table.where(F.col(count) > hub).drop(count), table.where(F.col(count) <= hub).drop(count)
    by_broadcast = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return by_broadcast.unionByName(rest.join(light, on))
