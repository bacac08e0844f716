"""Validity intervals as a table by levels of length and slices of their start, so that an instant reads the files that can hold it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import convert_to_datetime
from ..scratch import small_pieces, written

#: Snapshots in one slice of time, about, and slices at most.
PER_SLICE, SLICES = 200_000, 512


@dataclass
class Levels:
    """frame: intervals with level and slice, by which its files stand apart. Level k has intervals of at most width * 2**k microseconds, level -1 the open ones; a slice of a level is as wide as that, from first on."""

    frame: DataFrame
    first: int
    width: int
    top: int

    def rows(self) -> DataFrame:
        return self.frame.drop("level", "slice")

    def during(self, start: str, end: str) -> DataFrame:
        """The intervals that may hold at a moment from start to end: the filter is on the names of folders, and reads no file of the others."""
        a, b = (_micros(convert_to_datetime(x)) - self.first for x in (start, end))
        keep = (F.col("level") == -1) & (F.col("slice") <= b // self.width)
        for k in range(self.top + 1):
            w = self.width << k
            keep = keep | ((F.col("level") == k) & (F.col("slice") >= a // w - 1) & (F.col("slice") <= b // w))
        return self.frame.where(keep).drop("level", "slice")

    def at(self, time: str) -> DataFrame:
        return self.during(time, time)


def _micros(t) -> int:
    from datetime import datetime, timezone

    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def write_levels(v: DataFrame, snapshots: DataFrame, per_slice: int = PER_SLICE) -> Levels:
    """v (..., valid_from, valid_to) as such a table, made in one pass. The span and the number of slices come from snapshots, as every end of an interval is one's time. Slices of any size are dealt over tasks as they need."""
    time = F.unix_micros("generated_at")
    lo, hi, n = snapshots.agg(F.min(time), F.max(time), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    slices = min(SLICES, max(1, n // per_slice))
    width = max(1, -(-(hi - lo + 1) // slices))
    top = max(0, ((hi - lo) // width).bit_length())
    length = F.unix_micros("valid_to") - F.unix_micros("valid_from")
    over = F.call_function("div", length - 1, F.lit(width))
    level = F.when(F.col("valid_to").isNull(), -1).when(over <= 0, 0).otherwise(F.length(F.bin(over)))
    rows = v.withColumn("level", level.cast("int"))
    wide: Column = F.when(F.col("level") <= 0, F.lit(width).cast("long")).otherwise(F.call_function("shiftleft", F.lit(width).cast("long"), F.col("level")))
    rows = rows.withColumn("slice", F.call_function("div", F.unix_micros("valid_from") - F.lit(lo), wide).cast("int"))
    rows = rows.hint("rebalance", "level", "slice").sortWithinPartitions("level", "slice", "valid_from")
    with small_pieces(v.sparkSession):
        frame = written(rows, "levels", by=["level", "slice"])
    return Levels(frame, lo, width, top)
