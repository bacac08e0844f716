"""Connected components by alternating large-star and small-star rounds; no node's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of each node of edges (a, b: long); label is the component's smallest node. Nulls and loops don't count. An error is raised where labels are unfinished after so many rounds.

    Every round is a minimum per node (combined before the shuffle) and a join that
    adaptive execution may split, as the minima are a table of their own; its edges become a table in the shared folder.
    """
    at = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        new = written(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_written(at)
        drop_written(least)
        at = new
        if (now.n, now.h) == mark:
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
