"""Graph traversal: frontiers, components and merge events. Every loop is on the driver, every step a join; edges and visited nodes are never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import PROV, RDF_TYPE
from ..functions.times import within
from ..scratch import written
from .term_index import TermIndex


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    return written(df, "graph")


def reachable(start: DataFrame, edges: DataFrame, depth: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): nodes reached from start (root, node) along edges (src, dst), breadth first; depth None has no limit, 0 gives none. Nodes of seen (root, node) are not entered."""
    front = cut(start.select("root", "node", F.lit(0).alias("depth")).distinct())
    all_ = front if seen is None else front.unionByName(seen.select("root", "node", F.lit(0).alias("depth")))
    found = []
    step = 0
    while depth is None or step < depth:
        step += 1
        new = front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct().join(all_.select("root", "node"), ["root", "node"], "left_anti")
        front = cut(new.select("root", "node", F.lit(step).alias("depth")))
        if front.isEmpty():
            break
        found.append(front)
        all_ = all_.unionByName(front)
    out = start.sparkSession.createDataFrame([], "root string, node string, depth int")
    for f in found:
        out = out.unionByName(f)
    return out


def object_edges(v: DataFrame) -> DataFrame:
    """(src, dst): entity to the IRIs it has as objects in any version; provenance predicates and rdf:type don't count."""
    return v.where(F.col("o").startswith("<") & ~F.col("p").contains(PROV) & (F.col("p") != RDF_TYPE)).select(F.col("entity").alias("src"), F.col("o").alias("dst")).where("src <> dst").distinct()


def reverse_edges(quads: DataFrame) -> DataFrame:
    """(src, dst): object IRI to the subjects that refer to it in the current dataset."""
    return quads.where(F.col("o").startswith("<") & ~F.col("p").contains(PROV) & (F.col("p") != RDF_TYPE)).select(F.col("o").alias("src"), F.col("s").alias("dst")).where("src <> dst").distinct()


def mention_edges(ops: DataFrame) -> DataFrame:
    """(src, dst): an IRI, wherever it stands in an update, to the entities whose updates mention it."""
    return ops.select(F.explode(F.array("s", "p", "o", "g")).alias("src"), F.col("entity").alias("dst")).where(F.col("src").startswith("<") & (F.col("src") != F.col("dst"))).distinct()


def historical_reverse(mentions: DataFrame | TermIndex, terms: list[str]) -> DataFrame:
    """Entities whose updates mention one of the terms, anywhere and of any kind. mentions: operations, or their index, of which only the terms' buckets are read."""
    if isinstance(mentions, TermIndex):
        return mentions.mentions(terms).where(~F.col("entity").isin(terms)).select("entity").distinct()
    hit = F.lit(False)
    for c in ("s", "p", "o", "g"):
        hit = hit | F.col(c).isin(terms)
    return mentions.where(hit & ~F.col("entity").isin(terms)).select("entity").distinct()


def merge_edges(snapshots: DataFrame) -> DataFrame:
    """(snapshot, time, survivor, absorbed): a snapshot derived from another entity's snapshot merges that entity."""
    d = snapshots.select("snapshot", F.col("generated_at").alias("time"), F.col("entity").alias("survivor"), F.explode("derived_from").alias("from"))
    other = snapshots.select(F.col("snapshot").alias("from"), F.col("entity").alias("absorbed"))
    return d.join(other, "from").where("survivor <> absorbed").select("snapshot", "time", "survivor", "absorbed").distinct()


def merge_components(edges: DataFrame) -> DataFrame:
    """(entity, component): undirected components of merge edges; component is the smallest member. Least labels spread, then jump to their own label."""
    both = cut(edges.select(F.col("survivor").alias("a"), F.col("absorbed").alias("b")).union(edges.select("absorbed", "survivor")).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        spread = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        near = label.join(spread, "a").select("a", F.least("l", "m").alias("l"))
        jump = near.join(near.select(F.col("a").alias("l"), F.col("l").alias("up")), "l", "left").select("a", F.least("l", F.coalesce("up", "l")).alias("l"))
        new = cut(jump)
        if new.join(label, ["a", "l"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("entity"), F.col("l").alias("component"))
        label = new


def merge_events(edges: DataFrame, interval: tuple | None = None) -> DataFrame:
    """(entity, time, snapshot, survivor, absorbed): the merges in the interval an entity takes part in, as survivor or absorbed; absorbed is sorted."""
    each = edges.where(within(F.col("time"), interval)).groupBy("snapshot", "time", "survivor").agg(F.array_sort(F.collect_set("absorbed")).alias("absorbed"))
    return each.select(F.explode(F.array_union(F.array("survivor"), F.col("absorbed"))).alias("entity"), "time", "snapshot", "survivor", "absorbed")


def merge_lists(edges: DataFrame, interval: tuple | None = None) -> DataFrame:
    """(entity, merges): merge_events as one array an entity, by (time, snapshot)."""
    return merge_events(edges, interval).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("time", "snapshot", "survivor", "absorbed"))).alias("merges"))


def merged_history(main: DataFrame, related: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Related states as of the main entity's times: (root, time, entity, s, p, o, g). main: (root, time); related: states (root, entity, time, s, p, o, g). Each related entity gives its latest state up to the time. versions (root, entity, time) names all its versions, also those without quads, which give nothing."""
    from .replay import latest_up_to

    states = related.withColumnRenamed("time", "at")
    known = states.select("root", "entity", "at") if versions is None else versions.select("root", "entity", F.col("time").alias("at"))
    asks = main.join(known.select("root", "entity").distinct(), "root")
    return latest_up_to(asks, states, ["root", "entity"], known=known).drop("at")
