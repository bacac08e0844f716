"""Structured queries as joins of validity intervals, expanded on the timeline of the relevant entities."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import normal_constant, normal_term, parts
from ..functions.times import convert_to_datetime
from ..operators import graph, intervals, replay
from ..operators.intervals import OPEN
from ..operators.levels import PER_SLICE, Levels, write_levels
from ..operators.ranks import at_times, held, line_of
from ..operators.term_index import TermIndex, write_index
from . import sparql

#: Rows up to which a set of entities or aliases is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; otherwise the join may shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass
class Catalog:
    """quads, snapshots, ops and the intervals made from them. With several sources, frames are unions of theirs."""

    quads: DataFrame
    snapshots: DataFrame
    ops: DataFrame
    validity: DataFrame
    merges: DataFrame | None = None
    components: DataFrame | None = None
    #: Tables in the shared folder that the frames read.
    tables: list[DataFrame] = field(default_factory=list)
    levels: Levels | None = None
    index: TermIndex | None = None
    is_quadstore: bool = True
    #: How many tasks share work on all operations; else Spark decides.
    tasks: int | None = None

    @classmethod
    def build(cls, quads: DataFrame, snapshots: DataFrame, ops: DataFrame, is_quadstore: bool = True, per_slice: int = PER_SLICE, tasks: int | None = None) -> Catalog:
        """The intervals become a table in the shared folder, by length and start: they are made once, every pattern reads them, and a question on an instant only those files that can hold it. tasks: how many make them; else Spark decides."""
        v = write_levels(replay.validity(ops, quads, snapshots, is_quadstore, tasks), snapshots, per_slice)
        return cls(quads, snapshots, ops, v.rows(), tables=[v.frame], levels=v, is_quadstore=is_quadstore, tasks=tasks)

    def during(self, interval: tuple | None) -> DataFrame:
        """The intervals that can hold at a version selected by interval: with both ends, those that meet it. A version before its start that stands in for none inside holds up to the start."""
        if self.levels is None or not interval or not all(convert_to_datetime(x) for x in interval):
            return self.validity
        return self.levels.during(*interval)

    def with_index(self) -> Catalog:
        """Makes the index of terms, with which searches in updates don't read all operations."""
        if self.index is None:
            self.index = write_index(self.ops, tasks=self.tasks)
            self.tables += [self.index.rows, self.index.sizes]
        return self

    def with_merges(self) -> Catalog:
        if self.components is None:
            self.merges = graph.cut(graph.merge_edges(self.snapshots))
            self.components = graph.merge_components(self.merges)
        return self


def is_var(x: str) -> bool:
    return x.startswith("?")


def matching(rows: DataFrame, col: str, term: str, catalog: Catalog, merge_aware: bool) -> DataFrame:
    """Rows whose column equals a constant; merge-aware, an IRI equals the members of its component, however many."""
    if merge_aware and term.startswith("<"):
        c = catalog.with_merges().components
        mine = c.where(F.col("entity") == term).select("component")
        own = rows.sparkSession.createDataFrame([(term,)], "alias_ string")
        names = c.join(F.broadcast(mine), "component").select(F.col("entity").alias("alias_")).union(own).distinct()
        return rows.join(small(names), F.col(col) == F.col("alias_"), "left_semi")
    return rows.where(F.col(col) == term)


def pattern(catalog: Catalog, t: tuple[str, str, str], merge_aware: bool = False, firsts: DataFrame | None = None, local: bool = False) -> DataFrame:
    """Rows of one triple pattern: a column for each variable, and the interval from_, to_. A repeated variable must be equal. With firsts (entity, first), entities take part from their first selected version on. local adds the owning entity as entity_, so that patterns join only within one."""
    v = catalog.validity
    if firsts is not None:
        v = v.join(firsts, "entity").withColumn("valid_from", F.greatest("valid_from", "first")).where("valid_to is null or valid_from < valid_to").drop("first")
    for col, x in zip("spo", t):
        if not is_var(x):
            v = matching(v, col, x, catalog, merge_aware and col != "p")
    names: dict[str, str] = {}
    for col, x in zip("spo", t):
        if is_var(x):
            if x in names:
                v = v.where(F.col(col) == F.col(names[x]))
            else:
                names[x] = col
    return v.select(*[F.col(c).alias(x[1:]) for x, c in names.items()], *([F.col("entity").alias("entity_")] if local else []), F.col("valid_from").alias("from_"), F.coalesce("valid_to", F.lit(OPEN).cast("timestamp")).alias("to_")).distinct()


def order(patterns: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Most constants first, then patterns that share a variable with what is joined already."""
    rest, out, bound = list(patterns), [], set()
    while rest:
        best = max(rest, key=lambda t: (bool(bound & set(t)) if out else True, sum(not is_var(x) for x in t)))
        rest.remove(best)
        out.append(best)
        bound |= {x for x in best if is_var(x)}
    return out


def linked(patterns: list[tuple[str, str, str]]) -> list[list[tuple[str, str, str]]]:
    """patterns in groups that share variables, directly or over others."""
    groups: list[list] = []
    for t in patterns:
        mine = [g for g in groups if any(is_var(x) and x in u for u in g for x in t)]
        groups = [g for g in groups if g not in mine] + [[*sum(mine, []), t]]
    return groups


def steps(catalog: Catalog, patterns: list[tuple[str, str, str]], merge_aware: bool = False, firsts: DataFrame | None = None, local: bool = False) -> list[tuple[tuple, DataFrame]]:
    """Each pattern, in the order of joins, with the solutions (variables, from_, to_) of it and those before it. Every join takes the table of the one before."""
    out: list[tuple[tuple, DataFrame]] = []
    for t in order(patterns):
        p = pattern(catalog, t, merge_aware, firsts, local)
        if out:
            done = out[-1][1]
            if not hasattr(done, "_scratch"):
                done = graph.cut(done)
                out[-1] = out[-1][0], done
            shared = [c for c in p.columns if c in done.columns and c not in ("from_", "to_")]
            if not shared:
                warnings.warn(f"The pattern {' '.join(t)} shares no variable with those before it: all its matches meet all of theirs", stacklevel=2)
            p = intervals.overlap_join(done, graph.cut(p), shared)
        out.append((t, p))
    return out


def solve(catalog: Catalog, patterns: list[tuple[str, str, str]], merge_aware: bool = False, firsts: DataFrame | None = None, local: bool = False) -> DataFrame | None:
    """Joins of all patterns with overlapping intervals: variables, from_, to_. Without patterns: None. More than one pattern runs jobs when called."""
    found = steps(catalog, patterns, merge_aware, firsts, local)
    return found[-1][1] if found else None


def present(catalog: Catalog, t: tuple[str, str, str]) -> DataFrame:
    """(entity): subjects that match a pattern in the current dataset; provenance graphs don't count."""
    rows = catalog.quads.where(~F.coalesce(F.col("g").contains("/prov/"), F.lit(False)))
    for col, x in zip("spo", t):
        if not is_var(x):
            rows = rows.where(F.col(col) == x)
    return rows.select("entity").distinct()


def discover(catalog: Catalog, t: tuple[str, str, str]) -> DataFrame:
    """(entity) of a pattern: those present, and those with an operation whose terms hold all constants, wherever they stand. There language tags compare in lower case."""
    consts = [normal_constant(x) for x in t if not is_var(x) and not x.startswith("_:")]
    tagged = any(not x.startswith("<") for x in consts)
    if catalog.index is not None and consts:
        return present(catalog, t).union(catalog.index.all_of(consts, tagged)).distinct()
    have = F.array("s", "p", normal_term(F.col("o")) if tagged else F.col("o"))
    past = catalog.ops
    for x in consts:
        past = past.where(F.array_contains(have, x))
    return present(catalog, t).union(past.select("entity")).distinct()


def relevant(catalog: Catalog, q: sparql.Query, merge_aware: bool = False) -> DataFrame:
    """Entities whose snapshots make the timeline: of isolated patterns those discovered, constant subjects, and what chains from constant subjects reach in any version and go on from. An object that no pattern has as its subject adds no versions of its own."""
    every = [*q.patterns, *sum(q.optionals, [])]
    spark = catalog.quads.sparkSession
    parts = []
    isolated = [i for i in range(len(every)) if sparql.is_isolated(every, i)]
    for i in sparql.new_patterns([every[i] for i in isolated]):
        parts.append(discover(catalog, every[isolated[i]]))
    fixed = sorted({t[0] for t in every if t[0].startswith("<")})
    if fixed:
        parts.append(spark.createDataFrame([(x,) for x in fixed], "entity string"))
    for chain in linked([t for i, t in enumerate(every) if i not in isolated]):
        met: set[str] = set()
        for t, rows in steps(catalog, chain, merge_aware):  # what a longer prefix leaves of a variable, its first one has too
            new = {y[1:] for y in (t[0], t[2]) if is_var(y) and not sparql.is_dead_end(every, y)} - met
            met |= new
            for x in sorted(new):
                parts.append(rows.select(F.col(x).alias("entity")).where(F.col("entity").startswith("<")))
    out = parts[0] if parts else spark.createDataFrame([], "entity string")
    for p in parts[1:]:
        out = out.union(p)
    out = out.distinct()
    if merge_aware:
        c = catalog.with_merges().components
        more = out.join(c, "entity").select("component").distinct().join(c, "component").select("entity")
        out = out.union(more).distinct()
    return out.join(catalog.snapshots.select("entity").distinct(), "entity", "left_semi")


def metadata(catalog: Catalog, entities: DataFrame, described: bool = False) -> DataFrame:
    """Snapshots of entities with their metadata: those with an attribution, and with described also a description; derived_from is sorted and distinct, or empty."""
    rows = catalog.snapshots.where("attributed_to is not null").join(small(entities), "entity", "left_semi")
    if described:  # an entity that is itself a snapshot has no history of its own
        rows = rows.where("description is not null").join(catalog.snapshots.select(F.col("snapshot").alias("entity")), "entity", "left_anti")
    return rows.withColumn("derived_from", F.coalesce(F.array_sort(F.array_distinct("derived_from")), F.array().cast("array<string>")))


def channels(catalog: Catalog, entities: DataFrame, on_time: tuple | None) -> tuple[DataFrame, DataFrame]:
    """(selected, other) snapshots of entities. With on_time those in the interval, or the fallback before it, are selected; without, all are, and they need a description."""
    rows = metadata(catalog, entities, on_time is None)
    if on_time is None:
        return rows, rows.limit(0)
    times = replay.selected_times(rows, on_time).withColumnRenamed("time", "generated_at")
    return rows.join(times, ["entity", "generated_at"], "left_semi"), rows.join(times, ["entity", "generated_at"], "left_anti")


class VersionQuery:
    """A structured query on one version (on_time) or on all; entity_local joins patterns only within the quads of one entity.

    answers(): when each answer holds, as intervals; counts() and versions(): how many there are, from the ends of intervals;
    bindings(): (time, variables...), distinct, the only one that makes a row for each time and answer; timeline(): every
    version, also those without a match; run_agnostic_query(): bindings with both channels of provenance. All of these, and making a query, run jobs that
    write tables in the shared folder.
    """

    def __init__(self, catalog: Catalog, query: str, on_time: tuple | None = None, *, merge_aware: bool = False, include_prov_metadata: bool = False, include_all_timestamps: bool = False, entity_local: bool = False):
        self.local = entity_local
        self.catalog, self.query, self.on_time, self.merge_aware, self.all_times = catalog, sparql.parse(query), on_time, merge_aware, include_all_timestamps
        self.with_metadata = include_prov_metadata
        self.entities = graph.cut(relevant(catalog, self.query, merge_aware))
        self._answers: DataFrame | None = None
        # the catalog with those intervals that the asked-for versions can hold
        self.near = replace(catalog, validity=catalog.during(on_time)) if on_time else catalog

    def selected(self) -> DataFrame:
        """(entity, time) of the relevant entities' snapshots in the interval, with the fallback before its start."""
        return replay.selected_times(self.catalog.snapshots.join(small(self.entities), "entity", "left_semi"), self.on_time)

    def timeline(self) -> DataFrame:
        times = self.selected().select("time").distinct()
        if self.all_times and self.on_time is None:
            first = times.agg(F.min("time").alias("first"))
            every = self.catalog.snapshots.select(F.col("generated_at").alias("time")).distinct()
            times = every.join(F.broadcast(first), every.time >= F.col("first")).select("time")
        return times

    def intervals(self) -> DataFrame:
        """Answers with the interval in which they hold, without expansion on the timeline: (variables..., from_, to_)."""
        rows = solve(self.near, self.query.patterns, self.merge_aware, self.firsts(), self.local)
        return rows.drop("entity_") if rows is not None else None

    def firsts(self) -> DataFrame | None:
        """(entity, first): the first selected version of each relevant entity; None without on_time."""
        return self.selected().groupBy("entity").agg(F.min("time").alias("first")) if self.on_time is not None else None

    def answers(self) -> DataFrame:
        """(selected variables..., from_, to_): when each answer holds; intervals of one answer neither overlap nor touch. Optional patterns extend an answer while they match. A table, made once."""
        if self._answers is not None:
            return self._answers
        out = self.intervals()
        if out is None:
            out = self.catalog.quads.sparkSession.range(1).select(intervals.at(intervals.FIRST).alias("from_"), intervals.at(OPEN).alias("to_"))
        sure = {x[1:] for t in self.query.patterns for x in t if is_var(x)}
        for group in self.query.optionals:
            for t in group:  # each pattern extends a binding if it can
                out, p = graph.cut(out), graph.cut(pattern(self.near, t, self.merge_aware, self.firsts()))
                shared = [c for c in p.columns if c in out.columns and c not in ("from_", "to_")]
                out = _left(out, p, [c for c in shared if c in sure], [c for c in shared if c not in sure])
        for c in self.query.select:
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast("string"))
        self._answers = graph.cut(_known(graph.cut(out.select(*self.query.select, "from_", "to_")), self.query.select, lambda df, keys: intervals.islands(df, keys).drop("i")))
        return self._answers

    def bindings(self) -> DataFrame:
        return at_times(self.answers(), graph.cut(self.timeline())).select("time", *self.query.select)

    def counts(self, *by: str) -> DataFrame:
        """(time, by..., n): how many different answers each version has, for each value of by; versions without one are left out. Work follows the number of interval ends and of rows that come out."""
        rows = _known(self.answers(), list(by), intervals.levels)
        return at_times(graph.cut(rows), graph.cut(self.timeline())).select("time", *by, "n")

    def versions(self, *by: str) -> DataFrame:
        """(by..., n): in how many versions an answer with these values holds; all variables without by. No row is made for a version."""
        names = list(by) or self.query.select
        rows = self.answers()
        if by:
            rows = graph.cut(_known(rows.select(*names, "from_", "to_"), names, lambda df, keys: intervals.islands(df, keys).drop("i")))
        counted = held(rows, line_of(rows, graph.cut(self.timeline()), []), [])
        return counted.groupBy(*names).agg(F.sum(F.col("_hi") - F.col("_lo")).alias("n"))

    def typed_bindings(self) -> DataFrame:
        """bindings() with each variable as struct(type, value, datatype, lang); null where it is unbound. Terms are read once for each answer, not for each time."""
        typed = self.answers().select(*[parts(F.col(c)).alias(c) for c in self.query.select], "from_", "to_")
        return at_times(typed, graph.cut(self.timeline())).select("time", *self.query.select)

    def typed_versions(self) -> DataFrame:
        """versions() with each variable as struct(type, value, datatype, lang); null where it is unbound."""
        return graph.cut(self.versions()).select(*[parts(F.col(c)).alias(c) for c in self.query.select], "n")

    def provenance(self) -> tuple[DataFrame, DataFrame]:
        """Snapshots selected for the answer, and the other ones, of the relevant entities. Without on_time all are selected."""
        return channels(self.catalog, self.entities, self.on_time)

    def run_agnostic_query(self, *, include_all_timestamps: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(bindings, selected snapshots, other snapshots); both channels are None unless metadata was asked for."""
        self.all_times = self.all_times or include_all_timestamps
        return (self.bindings(), *(self.provenance() if self.with_metadata else (None, None)))

    def to_dict(self) -> dict[str, list[dict]]:
        """{iso time: bindings}, for tests and small answers."""
        from ..functions.terms import n3_to_binding

        out = {convert_to_datetime(r.time, True): [] for r in self.timeline().collect()}
        for r in self.bindings().collect():
            out[convert_to_datetime(r.time, True)].append({c: n3_to_binding(r[c]) for c in self.query.select if r[c] is not None})
        return out


def _known(rows: DataFrame, names: list[str], run) -> DataFrame:
    """run(rows, names), where joins on names take null for a value: nulls stand apart behind a mark."""
    mark = {n: F.concat(F.lit("="), n) for n in names}
    out = run(rows.withColumns({n: F.coalesce(c, F.lit("-")) for n, c in mark.items()}) if names else rows, names)
    return out.withColumns({n: F.when(F.col(n) != "-", F.substring(n, 2, 2**31 - 1)) for n in names}) if names else out


def _left(left: DataFrame, right: DataFrame, keys: list[str], doubt: list[str]) -> DataFrame:
    """Left join of intervals on keys and on those doubtful variables that a row has bound; an unbound one takes the right side's value. One join for each set of bound variables, so none becomes a nested loop."""
    if not doubt:
        return intervals.left_overlap_join(left, right, keys)
    name, rest = doubt[0], doubt[1:]
    bound = _left(left.where(F.col(name).isNotNull()), right, [*keys, name], rest)
    free = _left(left.where(F.col(name).isNull()).drop(name), right, keys, rest)
    return bound.unionByName(free)


class DeltaQuery:
    """What changed in the entities that a query selects."""

    def __init__(self, catalog: Catalog, query: str, on_time: tuple | None = None, changed_properties: list[str] | None = None, *, merge_aware: bool = False, include_prov_metadata: bool = False):
        self.catalog, self.on_time, self.properties, self.merge_aware, self.with_metadata = catalog, on_time, changed_properties, merge_aware, include_prov_metadata
        self.entities = graph.cut(relevant(catalog, sparql.parse(query), merge_aware))

    def records(self) -> DataFrame:
        ents = small(self.entities)
        merges = graph.merge_lists(self.catalog.with_merges().merges, self.on_time) if self.merge_aware else None
        merges = merges.join(ents, "entity", "left_semi") if merges is not None else None
        return replay.delta_records(self.catalog.ops.join(ents, "entity", "left_semi"), self.catalog.snapshots.join(ents, "entity", "left_semi"), self.on_time, self.properties, merges)

    def provenance(self) -> tuple[DataFrame, DataFrame]:
        """Selected and other snapshots of the entities that have a record."""
        return channels(self.catalog, graph.cut(self.records().select("entity")), self.on_time)

    def run_agnostic_query(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(records, selected snapshots, other snapshots); both channels are None unless metadata was asked for."""
        return (self.records(), *(self.provenance() if self.with_metadata else (None, None)))
