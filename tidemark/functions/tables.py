"""Table functions for SQL.

    SELECT * FROM gap_intervals(TABLE(SELECT series, t FROM ticks) PARTITION BY series ORDER BY (t), 3600000000, NULL, NULL)

A function sees one partition's rows one by one, in order, and keeps the last of them; operators.core.gaps finds the same gaps without Python.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="series string, gap_start long, gap_end long")
class GapIntervals:
    """Runs of missing grid times of `step` between neighbouring rows (series, t); from `start` to the first row and from the last one to `end`, where given."""

    def __init__(self):
        self.series = self.last = self.step = self.end = None

    def eval(self, row: Row, step: int, start: int | None, end: int | None) -> Iterator[tuple]:
        t = row["t"]
        if t is None or start is not None and t < start or end is not None and t >= end:
            return
        if self.last is None:
            if start is not None and t > start:
                yield str(row["series"]), start, t
        elif t - self.last > step:
            yield self.series, self.last + step, t
        self.series, self.last, self.step, self.end = str(row["series"]), t, step, end

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None and self.end is not None and self.last + self.step < self.end:
            yield self.series, self.last + self.step, self.end


def register(spark: SparkSession) -> None:
    spark.udtf.register("gap_intervals", GapIntervals)
