"""Entity API: state, history, delta, iteration, and the entities around one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, replay
from .query import Catalog, channels, metadata


class AgnosticEntity:
    """One entity (an IRI in brackets) and, as asked, entities around it. Methods return frames; iter_versions streams."""

    def __init__(self, catalog: Catalog, entity: str, *, include_related_objects: bool = False, include_merged_entities: bool = False, include_reverse_relations: bool = False, include_historical_reverse_relations: bool = False, reverse_relations_depth: int | None = None):
        self.catalog, self.entity = catalog, entity if entity.startswith("<") else f"<{entity}>"
        self.related, self.merged = include_related_objects, include_merged_entities
        self.reverse, self.past_reverse, self.depth = include_reverse_relations, include_historical_reverse_relations, reverse_relations_depth

    def _around(self) -> bool:
        return self.related or self.merged or self.reverse

    def entities(self, time: tuple | None = None, at_time: bool = False) -> DataFrame:
        """(entity): this one, then related objects, entities merged into it, and entities that refer to it; the sets share what was visited. With at_time, objects are those of versions selected by the interval time."""
        c, spark = self.catalog, self.catalog.quads.sparkSession
        start = spark.createDataFrame([(self.entity, self.entity)], "root string, node string")
        seen = start
        found = start.select("node")
        steps = []
        if self.related:
            steps.append((graph.object_edges(replay.valid_in(c.during(time), c.snapshots, time) if at_time else c.validity), None))
        if self.merged:
            steps.append((graph.merge_edges(c.snapshots).select(F.col("survivor").alias("src"), F.col("absorbed").alias("dst")), None))
        if self.reverse:
            edges = graph.reverse_edges(c.quads)
            # at every level, entities that refer to one now or did in an update
            steps.append((edges.union(graph.mention_edges(c.ops)).distinct() if self.past_reverse else edges, self.depth))
        for edges, depth in steps:
            got = graph.reachable(start, edges, depth, seen).select("root", "node")
            seen = seen.unionByName(got)
            found = found.union(got.select("node"))
        return found.distinct().select(F.col("node").alias("entity"))

    def _mine(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("entity") == self.entity)

    def _merged(self, ents: DataFrame, time: tuple | None) -> DataFrame:
        """States of all entities at this entity's selected times, under this entity's name: of each its latest selected version up to the time."""
        c = self.catalog
        of = lambda df: df.join(ents, "entity", "left_semi")
        times = graph.cut(replay.selected_times(of(c.snapshots), time))
        states = graph.cut(replay.history(of(c.during(time)), of(c.snapshots), time))
        root = F.lit(self.entity).alias("root")
        other = F.col("entity") != self.entity
        merged = graph.merged_history(self._mine(times).select(root, "time"), states.where(other).select(root, "*"), times.where(other).select(root, "*"))
        return self._mine(states).unionByName(merged.select(F.col("root").alias("entity"), "time", *replay.QUAD)).distinct()

    def get_history(self, *, include_prov_metadata: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(history, metadata): history (entity, time, s, p, o, g). With entities around, their states as of this entity's times are part of its own. metadata: snapshots of all of them with attribution and description, None unless asked for."""
        c = self.catalog
        ents = graph.cut(self.entities())
        states = self._merged(ents, None) if self._around() else replay.history(self._mine(c.validity), self._mine(c.snapshots))
        return states, metadata(c, ents, True) if include_prov_metadata else None

    def get_histories_by_entity(self, *, include_prov_metadata: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(histories, metadata): (entity, time, s, p, o, g) of this entity and those around it, each at its own times."""
        ents = graph.cut(self.entities())
        states = replay.history(self.catalog.validity.join(ents, "entity", "left_semi"), self.catalog.snapshots.join(ents, "entity", "left_semi"))
        return states, metadata(self.catalog, ents, True) if include_prov_metadata else None

    def get_state_at_time(self, time: tuple | None, *, include_prov_metadata: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(states, snapshots selected, other snapshots) for an interval. With entities around, their states up to each of this entity's selected times are part of its own, and snapshots are those of all of them. Without metadata both channels are None."""
        c = self.catalog
        ents = graph.cut(self.entities(time, True))
        states = self._merged(ents, time) if self._around() else replay.history(self._mine(c.during(time)), self._mine(c.snapshots), time)
        return (states, *(channels(c, ents, time or (None, None)) if include_prov_metadata else (None, None)))

    def get_delta(self, start: str, end: str) -> DataFrame:
        c = self.catalog
        return replay.delta(self._mine(c.validity), self._mine(c.ops), self._mine(c.snapshots), start, end)

    def iter_versions(self) -> Iterator[tuple]:
        """(time, set of quads) of each version, newest first.

        The dataset's state is undone in place by the operations, which are sorted by Spark and streamed one partition
        at a time: memory is that of one state and one partition, whatever the number of versions.
        """
        c = self.catalog
        quad = [*replay.QUAD[:3], "g" if c.is_quadstore else F.lit("").alias("g")]
        state = {tuple(r) for r in self._mine(c.quads).select(*quad).distinct().toLocalIterator()}
        times = replay.selected_times(self._mine(c.snapshots), None).select("time").orderBy(F.desc("time"))
        # several snapshots of one time are undone newest first, the operations of a text in their own order
        order = [F.desc("generated_at"), F.desc(replay.number(F.col("snapshot"))), F.desc("snapshot"), "op_seq", "quad_seq"]
        ops = self._mine(c.ops).where("generated_at is not null").orderBy(*order).select("generated_at", "op", *quad).toLocalIterator()
        following = next(ops, None)
        for r in times.toLocalIterator():
            yield r.time, set(state)
            while following is not None and following.generated_at >= r.time:
                (state.add if following.op == "D" else state.discard)(tuple(following[2:]))
                following = next(ops, None)

    def metadata(self) -> DataFrame:
        """Snapshots with attribution and description, derived_from sorted; none if the entity is a provenance record itself."""
        return metadata(self.catalog, self.catalog.quads.sparkSession.createDataFrame([(self.entity,)], "entity string"), True)
