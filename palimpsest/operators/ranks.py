"""Running sums within keys of any size, and joins of times with intervals that go over ranks instead of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def before(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with sums of whole numbers over the rows of the same key that stand before each one, in order.

    Rows are dealt by ranges of (by, order), so a key with a third of all rows is spread over tasks; what earlier
    ranges of a key hold is added from one row for each range and key. order must tell rows of a
    key apart, or ties count in any order.
    """
    kept = {f"_x{i}": c.cast("long") for i, c in enumerate(sums.values())}
    spread = written(rows.withColumns(kept).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = spread.groupBy(*by, "_part").agg(*[F.sum(x).alias(f"_n{x}") for x in kept])
    base = per.select(*by, "_part", *[F.coalesce(F.sum(f"_n{x}").over(earlier), F.lit(0)).alias(f"_b{x}") for x in kept])
    within = spread.withColumns({f"_w{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in kept}).join(base, [*by, "_part"])
    return within.withColumns({name: F.col(f"_w{x}") + F.col(f"_b{x}") for name, x in zip(sums, kept)}).drop("_part", *[p + x for x in kept for p in ("", "_w", "_b")])


def ranked(rows: DataFrame, by: list[str], order: list[str], counted: Column, name: str = "rank") -> DataFrame:
    """rows with the number of counted rows of the same key that stand before each one, in order (see before)."""
    return before(rows, by, order, {name: counted})


def line_of(rows: DataFrame, times: DataFrame, by: list[str]) -> DataFrame:
    """(by..., time, _time, _rank): the ends of rows (_time 0) and the times (_time 1) with the number of times before them, as a table."""
    ends = rows.select(*by, F.col("from_").alias("time")).union(rows.select(*by, F.col("to_").alias("time"))).distinct()
    marks = ends.withColumn("_time", F.lit(0)).unionByName(times.select(*by, "time").distinct().withColumn("_time", F.lit(1)))
    return written(ranked(marks, by, ["time", "_time"], F.col("_time") == 1, "_rank"), "timeline")


def held(rows: DataFrame, line: DataFrame, by: list[str]) -> DataFrame:
    """rows with _lo and _hi: they hold at the times of these ranks, _hi not among them; rows that hold at none are gone."""
    end = lambda name, rank: line.where("_time = 0").select(*by, F.col("time").alias(name), F.col("_rank").alias(rank))
    return rows.join(end("from_", "_lo"), [*by, "from_"]).join(end("to_", "_hi"), [*by, "to_"]).where("_lo < _hi")


#: Times that stand together in one row when ranks become rows.
BLOCK = 64


def at_times(rows: DataFrame, times: DataFrame, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """rows (by..., from_, to_, ...) at each time (by..., time) in [from_, to_): the columns of rows without from_ and to_, and time.

    Both ends become ranks on the timeline, and times of so many ranks stand together as one array. An equi-join on the number of the array brings it
    to each row that holds at some of its times, and there it becomes rows. So exactly the rows of the answer are made, whatever the lengths of timelines and
    intervals, and none of them is shuffled. rows is read twice and should be a table.
    """
    by = by or []
    line = line_of(rows, times, by)
    size, number = F.lit(block), lambda rank: F.call_function("div", rank, F.lit(block))
    arrays = line.where("_time = 1").groupBy(*by, number(F.col("_rank")).alias("_block")).agg(F.array_sort(F.collect_list("time")).alias("_times"))
    each = held(rows, line, by).withColumn("_block", F.explode(F.sequence(number(F.col("_lo")), number(F.col("_hi") - 1)))).drop("from_", "to_").join(arrays, [*by, "_block"])
    start = F.greatest(F.col("_lo") - F.col("_block") * size, F.lit(0))
    upto = F.least(F.col("_hi") - F.col("_block") * size, size)
    mine = F.slice("_times", (start + 1).cast("int"), (upto - start).cast("int"))
    return each.withColumn("time", F.explode(mine)).drop("_lo", "_hi", "_block", "_times")


#: Rows that one task makes, about, when rows are repeated, and repeats of a row that stand together.
MADE, TOGETHER = 4_000_000, 10_000


def repeated(rows: DataFrame, n: str, made: int = MADE, together: int = TOGETHER) -> DataFrame:
    """rows without n (long), each as often as its n says; those of 0, less or null are gone.

    Tasks get their share of the rows that come out, as few rows may become many: a row becomes pieces of at most so many repeats, and
    pieces are dealt over tasks that make about made rows each. Only pieces are shuffled. rows is read twice and should be a table.
    """
    total = rows.where(F.col(n) > 0).agg(F.sum(n)).first()[0] or 0
    pieces = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col(n) - 1, F.lit(together)))
    each = rows.where(F.col(n) > 0).withColumn("_piece", F.explode(pieces))
    each = each.withColumn("_n", F.least(F.col(n) - F.col("_piece") * together, F.lit(together)).cast("int")).drop(n, "_piece")
    return each.repartition(max(1, -(-total // made))).withColumn("_one", F.explode(F.array_repeat(F.lit(True), F.col("_n")))).drop("_one", "_n")
