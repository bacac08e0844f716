"""Joins, unions, gaps and counts of half-open intervals (from_, to_), whose work follows their number and the answer's, not times or pairs.

Frames have key columns, other columns, from_ and to_; an open end is OPEN. Small keys take the plain way: one
shuffle by key. Keys that are hot, as counted first, go by ranks and running sums over ranges, so that
no task gets a whole key and no pair is made that doesn't overlap. Both ways give the same rows. Inputs are read more than once and should
be tables; calling these functions runs the counting jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .ranks import before

OPEN, FIRST = "9999-12-31 00:00:00", "0001-01-03 00:00:00"
#: Pairs of a key, per row of it, up to which a plain join is taken, and rows of a key that one task may order.
PAIRS, ROWS = 200, 1_000_000


def at(text: str):
    return F.lit(text).cast("timestamp")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], pairs: int = PAIRS) -> DataFrame:
    """Rows of both sides with equal keys whose intervals overlap; from_ and to_ are what both share. Other columns must differ in name."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    if not keys:
        a, b = left.count(), right.count()
        return (_ranked_join if a * b > pairs * (a + b) else _plain_join)(left, right, keys)
    hot = n(left, "_n").join(n(right, "_m"), keys).where(F.col("_n") * F.col("_m") > pairs * (F.col("_n") + F.col("_m")))
    hot = written(hot.select(*keys), "hot")
    if hot.isEmpty():
        return _plain_join(left, right, keys)
    apart = lambda how: (left.join(hot, keys, how), right.join(hot, keys, how), keys)
    return _plain_join(*apart("left_anti")).unionByName(_ranked_join(*apart("left_semi")))


def _plain_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({"from_": "_f", "to_": "_t"})
    both = left.join(right, keys) if keys else left.crossJoin(right)
    return _shared(both)


def _shared(both: DataFrame) -> DataFrame:
    a, b = F.greatest("from_", "_f"), F.least("to_", "_t")
    return both.where(a < b).withColumns({"from_": a, "to_": b}).drop("_f", "_t")


def _ranked_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Of two intervals that overlap, one starts within the other. The starts of each side are numbered within keys; an interval takes the numbers of the other side's starts within it, and numbers join. Equal starts are the left side's."""
    ends = lambda df, c, a, b: df.select(*keys, F.col(c).alias("time"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    marks = ends(left, "from_", 1, 0).union(ends(left, "to_", 0, 0)).union(ends(right, "from_", 0, 1)).union(ends(right, "to_", 0, 0))
    marks = marks.groupBy(*keys, "time").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    line = written(before(marks, keys, ["time"], {"_ra": F.col("_a"), "_rb": F.col("_b")}), "marks")
    of = lambda c, **names: line.select(*keys, F.col("time").alias(c), *[(F.col(x) if isinstance(x, str) else x).alias(n) for n, x in names.items()])
    a = left.join(of("from_", _i="_ra", _lo="_rb"), [*keys, "from_"]).join(of("to_", _hi="_rb"), [*keys, "to_"])
    b = right.join(of("from_", _i="_rb", _lo=F.col("_ra") + F.col("_a")), [*keys, "from_"]).join(of("to_", _hi="_ra"), [*keys, "to_"])
    other = lambda df: df.drop("_lo", "_hi").withColumnsRenamed({"from_": "_f", "to_": "_t"})
    walk = lambda df: df.drop("_i").where("_lo < _hi").withColumn("_i", F.explode(F.sequence("_lo", F.col("_hi") - 1))).drop("_lo", "_hi")
    first = _shared(walk(a).join(other(b), [*keys, "_i"]).drop("_i"))
    second = _shared(walk(b).join(other(a), [*keys, "_i"]).drop("_i"))
    return first.unionByName(second)


def _steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., time, d): by how much the number of intervals changes; times without a change are gone."""
    one = lambda c, d: rows.select(*keys, F.col(c).alias("time"), F.lit(d).alias("d"))
    return one("from_", 1).union(one("to_", -1)).groupBy(*keys, "time").agg(F.sum("d").alias("d")).where("d <> 0")


def split(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of keys with at most so many, rows of the others); None where there are none."""
    if not keys:
        return (rows, None) if rows.limit(most + 1).count() <= most else (None, rows)
    hot = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), "hot")
    if hot.isEmpty():
        return rows, None
    return rows.join(hot, keys, "left_anti"), rows.join(hot, keys, "left_semi")


def levels(rows: DataFrame, keys: list[str], most: int = ROWS) -> DataFrame:
    """(keys..., n, from_, to_): how many intervals of a key hold, as stretches in which the number doesn't change; n is 1 or more."""
    cold, hot = split(written(_steps(rows, keys), "steps"), keys, most)
    out = []
    if cold is not None:
        w = Window.partitionBy(*keys).orderBy("time")
        out.append(cold.select(*keys, F.sum("d").over(w).alias("n"), F.col("time").alias("from_"), F.lead("time").over(w).alias("to_")))
    if hot is not None:
        line = written(before(hot, keys, ["time"], {"_n": F.col("d"), "_i": F.lit(1)}), "marks")
        after = line.select(*keys, (F.col("_i") - 1).alias("_i"), F.col("time").alias("to_"))
        out.append(line.join(after, [*keys, "_i"]).select(*keys, (F.col("_n") + F.col("d")).alias("n"), F.col("time").alias("from_"), "to_"))
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return rows.where("n > 0 and to_ is not null")


def islands(rows: DataFrame, keys: list[str], most: int = ROWS) -> DataFrame:
    """(keys..., from_, to_, i): the union of each key's intervals as stretches that neither overlap nor touch, numbered from 0."""
    cold, hot = split(written(_steps(rows, keys), "steps"), keys, most)
    out = []
    edge = (F.col("_b") == 0) | (F.col("_b") + F.col("d") == 0)
    if cold is not None:
        w = Window.partitionBy(*keys).orderBy("time")
        edges = cold.withColumn("_b", F.sum("d").over(w) - F.col("d")).where(edge)
        pairs = edges.withColumn("to_", F.lead("time").over(w)).where("_b = 0")
        out.append(pairs.select(*keys, F.col("time").alias("from_"), "to_", (F.row_number().over(w) - 1).cast("long").alias("i")))
    if hot is not None:
        edges = before(hot, keys, ["time"], {"_b": F.col("d")}).where(edge)
        line = written(before(edges, keys, ["time"], {"i": F.col("_b") == 0}), "marks")
        ends = line.where("_b <> 0").select(*keys, (F.col("i") - 1).alias("i"), F.col("time").alias("to_"))
        out.append(line.where("_b = 0").select(*keys, F.col("time").alias("from_"), "i").join(ends, [*keys, "i"]).select(*keys, "from_", "to_", "i"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def gaps(rows: DataFrame, keys: list[str], most: int = ROWS) -> DataFrame:
    """(keys..., from_, to_): when no interval of a key holds, from FIRST to OPEN, for each key that rows have."""
    solid = written(islands(rows, keys, most), "islands")
    after = solid.select(*keys, (F.col("i") - 1).alias("i"), F.col("from_").alias("_next"))
    behind = solid.join(after, [*keys, "i"], "left").select(*keys, F.col("to_").alias("from_"), F.coalesce("_next", at(OPEN)).alias("to_"))
    ahead = solid.where("i = 0").select(*keys, at(FIRST).alias("from_"), F.col("from_").alias("to_"))
    return behind.unionByName(ahead).where("from_ < to_")


def left_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], pairs: int = PAIRS) -> DataFrame:
    """overlap_join, and the parts of left's intervals in which no row of right holds, with nulls for right's columns."""
    more = [c for c in right.columns if c not in (*keys, "from_", "to_")]
    both = overlap_join(left, right, keys, pairs)
    free = overlap_join(left, written(gaps(right, keys), "gaps"), keys, pairs)
    lone = left.join(right.select(*keys).distinct(), keys, "left_anti") if keys else left.where(F.lit(right.isEmpty()))
    nulls = [F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in more]
    return both.unionByName(free.unionByName(lone).select("*", *nulls))
