"""Schemas that change: steps applied once and in order, and readers that lift what older versions wrote.

Stored rows are never rewritten for a new schema. A part lies under the version that wrote it; a reader takes each version's
parts through the later steps. What has been applied is on record in the table's commit log, so a step that was changed,
left out or put between others is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pathloom.sources.commitlog import CommitLog


@dataclass(frozen=True)
class Step:
    """From the version before to ``number``: ``lift`` gives a DataFrame of the old schema the new one."""

    number: int
    name: str
    lift: Callable[[DataFrame], DataFrame]


class WrongSteps(RuntimeError):
    """The steps do not continue those on record."""


class VersionedTable:
    """Parts in ``folder``, written by the version that was in force; version 0 has no step."""

    def __init__(self, spark: SparkSession, folder: str, steps: list[Step]):
        self.spark, self.folder, self.steps = spark, folder.rstrip("/"), sorted(steps, key=lambda s: s.number)
        if [s.number for s in self.steps] != list(range(1, len(steps) + 1)):
            raise WrongSteps("steps are not numbered 1, 2, 3, ...")
        self.log = CommitLog(spark, self.folder)

    def _mark(self, step: Step) -> str:
        return hashlib.sha256(f"{step.number}:{step.name}".encode()).hexdigest()

    def applied(self) -> list[dict]:
        return [e for e in self.log.entries() if e["kind"] == "step"]

    def version(self) -> int:
        return len(self.applied())

    def migrate(self, holder: str = "migrate", now: int | None = None) -> list[int]:
        """Puts the steps that are not on record there, in order, under the table's lock; which these were. Another run does nothing."""
        done = self._checked()
        if done == len(self.steps):
            return []
        lease = self.log.acquire("migrate", holder, now=now)
        made = []
        for step in self.steps[self._checked() :]:
            self.log._as_holder(lease, lambda _, s=step: {"kind": "step", "number": s.number, "name": s.name, "mark": self._mark(s)}, now)
            made.append(step.number)
        self.log.release(lease, summary=f"steps {made}", now=now)
        return made

    def _checked(self) -> int:
        """How many steps are on record; :class:`WrongSteps` if they are not the first of these."""
        found = self.applied()
        if len(found) > len(self.steps) or any(e["mark"] != self._mark(s) for e, s in zip(found, self.steps)):
            raise WrongSteps("the table has other steps on record")
        return len(found)

    def append(self, df: DataFrame) -> None:
        """Adds rows of the schema in force."""
        df.write.mode("append").parquet(f"{self.folder}/schema={self._checked()}")

    def read(self) -> DataFrame:
        """All rows in the schema in force."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        rows = None
        for v in range(self._checked() + 1):
            at = f"{self.folder}/schema={v}"
            if self.log.fs.exists(path(at)):
                one = self.spark.read.parquet(at)
                for step in self.steps[v : self._checked()]:
                    one = step.lift(one)
                rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            raise FileNotFoundError(self.folder)
        return rows
