"""Table functions for SQL: windows of a trace, spans split at midnight, triggers of a probability curve.

``register`` makes them known to a session. They give the rows of ``signal.windows``, ``signal.split_midnight`` and ``signal.trigger``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="win: int, start: int, samples: array<double>")
class TraceWindows:
    """``trace_windows(samples, n, step)``: each whole window of a trace, none of a shorter one."""

    def eval(self, samples: list, n: int, step: int) -> Iterator[tuple]:
        if samples is not None:
            for win, start in enumerate(range(0, len(samples) - n + 1, step)):
                yield win, start, samples[start : start + n]


@udtf(returnType="part_start: timestamp, part_end: timestamp")
class MidnightParts:
    """``midnight_parts(start, end)``: the span, or both its parts if it passes the next midnight."""

    def eval(self, start: dt.datetime, end: dt.datetime) -> Iterator[tuple]:
        if start is not None and end is not None:
            day = dt.datetime(start.year, start.month, start.day) + dt.timedelta(days=1)
            yield from [(start, end)] if end <= day else [(start, day), (day, end)]


@udtf(returnType="id: long, onset: int, offset_: int, pick: int, max_prob: double")
class Triggers:
    """``triggers(TABLE(...) PARTITION BY id ORDER BY sample, least, blind)`` over rows (id, sample, p): stretches of samples in a row, from
    ``blind`` on, whose probability is at least ``least``; the pick is where it is highest, the first of equals. A partition holds one stretch at a time.
    """

    def __init__(self) -> None:
        self.id = self.onset = self.last = self.pick = None
        self.best = 0.0

    def eval(self, row: Row, least: float, blind: int) -> Iterator[tuple]:
        sample, p = row["sample"], row["p"]
        good = p is not None and sample is not None and sample >= blind and p >= least
        if self.onset is not None and (not good or sample != self.last + 1):
            yield self.id, self.onset, self.last, self.pick, self.best
            self.onset = None
        if good:
            if self.onset is None:
                self.id, self.onset, self.pick, self.best = row["id"], sample, sample, p
            elif p > self.best:
                self.pick, self.best = sample, p
            self.last = sample

    def terminate(self) -> Iterator[tuple]:
        if self.onset is not None:
            yield self.id, self.onset, self.last, self.pick, self.best


FUNCTIONS = {"trace_windows": TraceWindows, "midnight_parts": MidnightParts, "triggers": Triggers}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
