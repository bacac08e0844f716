"""Validity intervals that follow a stream of snapshots: a batch closes and opens intervals of what it touches.

Tables lie under one path, in folders by a bucket of the entity's hash: snapshots and ops by batch, and intervals by
generation. A batch writes a new generation of the buckets it touches and then a list of which generation each bucket has; readers
take the last list, so they never see half a batch, and a batch that is run again replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.updates import to_ops
from ..operators import graph, replay
from ..operators.replay import QUAD

BUCKETS = 64
_KEY = ["entity", *QUAD]


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))


def _put(df: DataFrame, path: str, buckets: int) -> None:
    _bucketed(df, buckets).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _list(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, int]:
    """Generation of each bucket, of the last list or the last one up to a generation."""
    rows = spark.read.schema("bucket int, of int, gen int").parquet(f"{path}/lists")
    rows = rows if upto is None else rows.where(F.col("gen") <= upto)
    last = rows.agg(F.max("gen")).first()[0]
    return {r.bucket: r.of for r in rows.where(F.col("gen") == F.lit(last)).collect()}


def _name(spark: SparkSession, path: str, gen: int, of: dict[int, int]) -> None:
    spark.createDataFrame(sorted(of.items()), "bucket int, of int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/gen={gen}")


_VALIDITY = "entity string, s string, p string, o string, g string, valid_from timestamp, valid_to timestamp"


def _intervals(spark: SparkSession, path: str, of: dict[int, int]) -> DataFrame:
    rows = spark.read.schema(_VALIDITY + ", gen int, bucket int").parquet(f"{path}/validity")
    keep = F.lit(False)
    for gen in sorted(set(of.values())):
        keep = keep | ((F.col("gen") == gen) & F.col("bucket").isin(sorted(b for b, g in of.items() if g == gen)))
    return rows.where(keep).drop("gen", "bucket")


def current(spark: SparkSession, path: str) -> DataFrame:
    """(entity, s, p, o, g, valid_from, valid_to) after the last whole batch."""
    return _intervals(spark, path, _list(spark, path))


def start(path: str, quads: DataFrame, snapshots: DataFrame, ops: DataFrame, buckets: int = BUCKETS) -> None:
    """The first generation, from a dataset and its history so far; any of them may be empty."""
    _put(snapshots, f"{path}/snapshots/gen=0", buckets)
    _put(ops, f"{path}/ops/gen=0", buckets)
    v = graph.cut(replay.validity(ops, quads, snapshots))
    _put(v, f"{path}/validity/gen=0", buckets)
    _name(v.sparkSession, path, 0, dict.fromkeys(range(buckets), 0))


def _last(ops: DataFrame) -> DataFrame:
    """(entity, s, p, o, g, op): the last operation on each quad."""
    order = F.struct("generated_at", replay.number(F.col("snapshot")), "snapshot", "op_seq", "quad_seq")
    return ops.groupBy(*_KEY).agg(F.max_by("op", order).alias("op"))


def _now(v: DataFrame, ops: DataFrame) -> DataFrame:
    """(entity, s, p, o, g) that are there: what the last operation inserted, or without one what is in an open interval."""
    last = _last(ops)
    still = v.where("valid_to is null").select(*_KEY).join(last.select(*_KEY), _KEY, "left_anti")
    return still.unionByName(last.where("op = 'I'").select(*_KEY))


def apply(new: DataFrame, path: str, gen: int, buckets: int = BUCKETS) -> None:
    """The next generation, from new snapshots with update texts.

    Entities whose new snapshots all come after those known go the short way: only open intervals of the quads that
    are touched are read, closed, and others opened. Where a snapshot is late, or an operation removes what isn't there or adds
    what is (undoing it changes what was before), the entity's own operations are replayed. Both give what a build over everything gives.
    """
    spark = new.sparkSession
    new = graph.cut(new)
    ops = graph.cut(to_ops(new).where("generated_at is not null"))
    _put(new, f"{path}/snapshots/gen={gen}", buckets)
    _put(ops, f"{path}/ops/gen={gen}", buckets)
    of = _list(spark, path, gen - 1)
    touched = sorted(r.bucket for r in _bucketed(new.select("entity"), buckets).select("bucket").distinct().collect())
    if not touched:
        return _name(spark, path, gen, of)
    earlier = lambda name, df: spark.read.schema(_bucketed(df, buckets).withColumn("gen", F.lit(0)).schema).parquet(f"{path}/{name}").where(F.col("bucket").isin(touched) & (F.col("gen") < gen)).drop("bucket", "gen")
    old = earlier("snapshots", new).where("generated_at is not null")
    v = _intervals(spark, path, {b: of[b] for b in touched})
    known = old.groupBy("entity").agg(F.min("generated_at").alias("born"), F.max("generated_at").alias("last"))
    mine = new.where("generated_at is not null").groupBy("entity").agg(F.min("generated_at").alias("first")).join(known, "entity", "left")
    mine = graph.cut(mine.select("entity", F.coalesce("born", "first").alias("created"), F.coalesce(F.col("first") <= F.col("last"), F.lit(False)).alias("late")))
    # the first new operation on a quad tells whether it should have been there
    first = replay.collapse(ops).withColumn("i", F.row_number().over(Window.partitionBy(*_KEY).orderBy("generated_at"))).where("i = 1").select(*_KEY, "op", F.col("generated_at").alias("at"))
    open_ = v.where("valid_to is null").select(*_KEY, F.col("valid_from").alias("since"))
    first = graph.cut(first.join(open_, _KEY, "left").join(mine, "entity"))
    born_now = (F.col("at") == F.col("created")) & (F.col("op") == "I") & F.col("since").isNull()
    odd = first.where(~born_now & ((F.col("op") == "D") != F.col("since").isNotNull()))
    again = graph.cut(mine.where("late").select("entity").union(odd.select("entity")).distinct())
    quick = ops.join(again, "entity", "left_anti")
    # short way
    stay = first.join(again, "entity", "left_anti")
    born = lambda e: e.select("entity", F.col("created").alias("generated_at"))
    short = replay.validity(quick, _last(quick).where("op = 'I'").select(*_KEY), born(mine))
    since = stay.where("since is not null").select(*_KEY, "since", "created")
    short = short.join(since, _KEY, "left").withColumn("valid_from", F.when(F.col("valid_from") == F.col("created"), F.col("since")).otherwise(F.col("valid_from"))).drop("since", "created")
    # entities that are replayed
    all_ops = earlier("ops", ops).join(again, "entity", "left_semi").unionByName(ops.join(again, "entity", "left_semi"))
    all_snaps = old.select("entity", "generated_at").unionByName(new.select("entity", "generated_at")).join(again, "entity", "left_semi")
    long = replay.validity(all_ops, _now(v.join(again, "entity", "left_semi"), all_ops), all_snaps)
    kept = v.join(again, "entity", "left_anti")
    kept = kept.where("valid_to is not null").unionByName(kept.where("valid_to is null").join(stay.select(*_KEY), _KEY, "left_anti"))
    _put(kept.unionByName(short).unionByName(long), f"{path}/validity/gen={gen}", buckets)
    _name(spark, path, gen, {**of, **dict.fromkeys(touched, gen)})


def follow(snapshots: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Starts a query that applies each micro-batch of snapshots to the tables under path, which start() made."""
    writer = snapshots.writeStream.foreachBatch(lambda df, n: apply(df, path, n + 1, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
