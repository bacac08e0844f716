"""Validity intervals from update operations, and what follows from them: states, histories, deltas.

Undoing updates newest first has a closed form: the next operation on a quad after an
instant says whether the quad was there (a deletion: yes), and without one the current dataset
says it. So one window per quad gives half-open intervals, and every question about any
moment is a filter on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import convert_to_datetime, within
from ..scratch import written
from .intervals import OPEN, ROWS, split
from .ranks import at_times, before

QUAD = ["s", "p", "o", "g"]


def number(snapshot: Column) -> Column:
    """The number that a snapshot's name ends with, so that se/10 comes after se/9; -1 without one. Names tell equal numbers apart."""
    return F.coalesce(F.regexp_extract(snapshot, r"(\d{1,18})>?$", 1).try_cast("long"), F.lit(-1).cast("long"))


def collapse(ops: DataFrame) -> DataFrame:
    """The operation on a quad at each time of an entity that tells whether the quad was there before.

    Within a text the last one counts (texts are undone in their own order). Of several snapshots of one time the
    first by number counts: they are undone newest first, so the first has the last word.
    """
    order = F.struct(number(F.col("snapshot")), "snapshot", -F.col("op_seq"), -F.col("quad_seq"))
    return ops.groupBy("entity", "generated_at", *QUAD).agg(F.min_by("op", order).alias("op"))


def validity(ops: DataFrame, quads: DataFrame, snapshots: DataFrame, is_quadstore: bool = True, tasks: int | None = None) -> DataFrame:
    """(entity, s, p, o, g, valid_from, valid_to): half-open, valid_to null while the quad is in the dataset; intervals of a quad never touch. Entities without snapshots have no versions. Without a quad store, quads compare by s, p, o.

    One shuffle by entity and one order: an entity's creation stands first, then each quad's touches by time, then the
    dataset's quad. Of a quad's operations at one time the one counts that tells whether it was there before (see collapse). Touches that change
    nothing (removed and added again at one time) are passed over. tasks: how many share the work; else Spark decides.
    """
    if not is_quadstore:
        ops, quads = ops.withColumn("g", F.lit("")), quads.withColumn("g", F.lit(""))
    kinds = {"entity": "string", **{c: "string" for c in QUAD}, "at": "timestamp", "op": "string", "n_": "long", "snapshot": "string", "op_seq": "int", "quad_seq": "int", "created": "timestamp", "k_": "int"}
    full = lambda df, **have: df.select(*[have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    own = {c: F.col(c) for c in ("entity", *QUAD)}
    born = full(snapshots.groupBy("entity").agg(F.min("generated_at").alias("created")), entity=F.col("entity"), created=F.col("created"), k_=F.lit(0))
    touch = full(ops.where("generated_at is not null"), **own, at=F.col("generated_at"), op=F.col("op"), n_=number(F.col("snapshot")), snapshot=F.col("snapshot"), op_seq=F.col("op_seq"), quad_seq=F.col("quad_seq"), k_=F.lit(1))
    rows = born.union(touch).union(full(quads, **own, k_=F.lit(1))).where("entity is not null")
    rows = rows.repartition(tasks, "entity") if tasks else rows.repartition("entity")
    rows = rows.withColumn("h_", F.xxhash64("entity"))  # numbers order faster than names that begin alike
    quad = ["h_", "entity", "k_", *QUAD]
    order = [F.col("at").asc_nulls_last(), "n_", "snapshot", F.col("op_seq").desc_nulls_first(), F.col("quad_seq").desc_nulls_first()]
    upto = Window.partitionBy("h_", "entity").orderBy("k_", *QUAD, *order).rowsBetween(Window.unboundedPreceding, 0)
    each = Window.partitionBy(*quad).orderBy(*order)
    rows = rows.withColumn("created", F.first("created", True).over(upto)).withColumns({"same_": F.lag("at").over(each), "any_": F.lag(F.lit(True)).over(each)})
    rows = rows.where("k_ = 1 and created is not null and (any_ is null or not (same_ <=> at))").drop("n_", "snapshot", "op_seq", "quad_seq", "same_", "any_")
    w = Window.partitionBy(*quad).orderBy(F.col("at").asc_nulls_last())
    rows = rows.withColumns({"next_at": F.lead("at").over(w), "next_op": F.lead("op").over(w), "more": F.lead(F.lit(True)).over(w)})
    # what is there at creation has no earlier version; a row behind a touch that has no time is the dataset's
    rows = rows.withColumns({"was": (F.col("op") == "D") & (F.col("created") < F.col("at")), "is": F.coalesce((F.col("next_op") == "D") | (F.col("more") & F.col("next_at").isNull()), F.lit(False))})
    rows = rows.where("at is null or was <> is").withColumns({"to": F.lead("at").over(w), "back": F.lag(F.lit(True)).over(w)})
    piece = lambda a, b: F.struct(a.alias("valid_from"), b.alias("valid_to"))
    got = F.when(F.col("at").isNotNull() & F.col("is"), piece(F.col("at"), F.col("to"))).when(F.col("back").isNull(), piece(F.col("created"), F.col("at")))
    return rows.select("entity", *QUAD, got.alias("x")).where("x is not null").select("entity", *QUAD, "x.valid_from", "x.valid_to")


def holds_at(t: Column) -> Column:
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def state_at(v: DataFrame, time: str) -> DataFrame:
    """Quads of every entity at an instant; the state at a time is that of the latest snapshot up to it."""
    return v.where(holds_at(F.lit(convert_to_datetime(time)))).select("entity", *QUAD)


def selected_times(snapshots: DataFrame, interval: tuple | None, fallback: bool = True) -> DataFrame:
    """(entity, time): snapshot times in the interval. With a start and no time inside, the latest one up to the start."""
    times = snapshots.select("entity", F.col("generated_at").alias("time")).where("time is not null").distinct()
    inside = times.where(within(F.col("time"), interval))
    start = convert_to_datetime(interval[0]) if interval else None
    if start is None or not fallback:
        return inside
    before = times.where(F.col("time") <= F.lit(start)).groupBy("entity").agg(F.max("time").alias("time")).join(inside.select("entity").distinct(), "entity", "left_anti")
    return inside.unionByName(before)


def history(v: DataFrame, snapshots: DataFrame, interval: tuple | None = None) -> DataFrame:
    """(entity, time, s, p, o, g): the state at each selected snapshot; versions without quads have no row (see selected_times)."""
    rows = v.select("entity", *QUAD, F.col("valid_from").alias("from_"), F.coalesce("valid_to", F.lit(OPEN).cast("timestamp")).alias("to_"))
    return at_times(rows, selected_times(snapshots, interval), ["entity"]).select("entity", "time", *QUAD)


def valid_in(v: DataFrame, snapshots: DataFrame, interval: tuple | None) -> DataFrame:
    """The intervals that hold at one of an entity's selected snapshots. Selected ones follow each other and ends of intervals are snapshot times, so the first and the last are enough to tell."""
    ends = selected_times(snapshots, interval).groupBy("entity").agg(F.min("time").alias("first_"), F.max("time").alias("last_"))
    return v.join(ends, "entity").where("valid_from <= last_ and (valid_to is null or valid_to > first_)").drop("first_", "last_")


def net(ops: DataFrame, *by: str) -> DataFrame:
    """(by..., s, p, o, g, sign): operations in order cancel by a counter that stays between -1 and 1; those that end at 0 are gone.

    Steps that stay within bounds compose. With three states, two equal steps in a row always end at their bound, and
    steps that alternate behind them go between it and 0. So a run of steps is told by its first and last one and the last that
    equals the one before it. Runs are those of a calendar month, then all runs of a quad, of which there are as many as months.
    """
    key = [*by, *QUAD]
    at = F.struct("generated_at", number(F.col("snapshot")).alias("n"), "snapshot", "op_seq", "quad_seq")
    rows = ops.select(*key, F.date_trunc("month", "generated_at").alias("_month"), at.alias("_at"), "op")
    w = Window.partitionBy(*key, "_month").orderBy("_at")
    twice = F.when(F.lag("op").over(w) == F.col("op"), F.col("op"))
    runs = rows.withColumn("_twice", twice).groupBy(*key, "_month").agg(F.min_by("op", "_at").alias("first"), F.max_by("op", "_at").alias("last"), F.max_by("_twice", F.when(F.col("_twice").isNotNull(), F.col("_at"))).alias("twice"))
    m = Window.partitionBy(*key).orderBy("_month")
    runs = runs.withColumn("_bound", F.coalesce("twice", F.when(F.lag("last").over(m) == F.col("first"), F.col("first"))))
    whole = runs.groupBy(*key).agg(F.min_by("first", "_month").alias("first"), F.max_by("last", "_month").alias("last"), F.max_by("_bound", F.when(F.col("_bound").isNotNull(), F.col("_month"))).alias("_bound"))
    bound = F.coalesce("_bound", "first")  # from 0, the first step leads to its bound too
    return whole.select(*key, F.when(F.col("last") != bound, 0).when(bound == "I", 1).otherwise(-1).alias("sign")).where("sign <> 0")


def delta(v: DataFrame, ops: DataFrame, snapshots: DataFrame, start: str, end: str) -> DataFrame:
    """(entity, s, p, o, g, sign): net change of each entity in (start, end]. An entity whose first snapshot comes after start has its whole state at end as additions."""
    a, b = F.lit(convert_to_datetime(start)), F.lit(convert_to_datetime(end))
    born = snapshots.groupBy("entity").agg(F.min("generated_at").alias("born"))
    late = born.where(F.col("born") > a).select("entity")
    new = v.join(late, "entity", "left_semi").where(holds_at(b)).select("entity", *QUAD, F.lit(1).alias("sign"))
    old = net(ops.join(late, "entity", "left_anti").where((F.col("generated_at") > a) & (F.col("generated_at") <= b)), "entity")
    return old.unionByName(new)


def delta_records(ops: DataFrame, snapshots: DataFrame, interval: tuple | None = None, changed_properties: list[str] | None = None, merges: DataFrame | None = None) -> DataFrame:
    """One record an entity: created, deleted, changes (by snapshot), additions, deletions, merges.

    Both ends of the interval are inclusive. Entities with a snapshot, a deletion or a merge in the
    interval have a record, others none. changes has an entry for each snapshot in the interval that has a
    text or operations, those at the time of creation apart; their operations don't count in additions and
    deletions either. deleted is the invalidation of the entity's latest snapshot, if it lies in the interval.
    changed_properties keeps quads of those predicates and may leave entries, additions and deletions empty.
    """
    last = F.struct("generated_at", number(F.col("snapshot")), "snapshot")
    born = snapshots.where("generated_at is not null").groupBy("entity").agg(F.min("generated_at").alias("born"), F.max_by("invalidated_at", last).alias("ended"))
    texts = snapshots.where(within(F.col("generated_at"), interval)).select("entity", "snapshot", "generated_at", (F.coalesce(F.col("update_query"), F.lit("")) != "").alias("text"))
    seen = texts.select("entity").distinct().withColumn("seen", F.lit(True))
    inside = ops.join(born.select("entity", "born"), "entity").where((F.col("generated_at") > F.col("born")) & within(F.col("generated_at"), interval)).drop("born")
    quad = F.struct(*QUAD)
    wanted = [p if p.startswith("<") else f"<{p}>" for p in changed_properties or []]
    keep = F.col("p").isin(wanted) if wanted else F.lit(True)
    sets = [F.array_sort(F.collect_list(F.when((F.col("sign") == k) & keep, quad))).alias(n) for k, n in ((1, "additions"), (-1, "deletions"))]
    # a text whose operations cancel, or that has none, keeps its entry
    key = ["entity", "snapshot", "generated_at"]
    entries = texts.where("text").select(*key).union(inside.select(*key)).distinct().join(born.select("entity", "born"), "entity").where(F.col("generated_at") > F.col("born")).drop("born")
    none = F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in QUAD)}>>")
    each = entries.join(net(inside, *key).groupBy(*key).agg(*sets), key, "left").select("entity", F.struct(F.col("generated_at").alias("time"), number(F.col("snapshot")).alias("n"), "snapshot", F.coalesce("additions", none).alias("additions"), F.coalesce("deletions", none).alias("deletions")).alias("x"))
    changes = each.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["time"].alias("time"), x["additions"].alias("additions"), x["deletions"].alias("deletions"))).alias("changes"))
    total = net(inside, "entity").groupBy("entity").agg(*sets)
    base = born.select("entity", F.when(within(F.col("born"), interval), F.col("born")).alias("created"), F.when(within(F.col("ended"), interval), F.col("ended")).alias("deleted"))
    out = base.join(seen, "entity", "left").join(changes, "entity", "left").join(total, "entity", "left")
    if merges is not None:
        out = out.join(merges, "entity", "left")
    else:
        out = out.withColumn("merges", F.lit(None).cast("array<struct<time:timestamp,snapshot:string,survivor:string,absorbed:array<string>>>"))
    out = out.where(F.col("seen") | F.col("deleted").isNotNull() | F.col("merges").isNotNull())
    no_change = F.array().cast(dict(changes.dtypes)["changes"])
    return out.select("entity", "created", "deleted", F.coalesce("changes", no_change).alias("changes"), F.coalesce("additions", none).alias("additions"), F.coalesce("deletions", none).alias("deletions"), "merges")


def latest_up_to(times: DataFrame, events: DataFrame, by: list[str], time: str = "time", at: str = "at", known: DataFrame | None = None, most: int = ROWS) -> DataFrame:
    """As-of join: for each row of times the events of its key with the latest at <= time (all of that at).

    No pair of times and events is ever made. Keys of up to so many rows take one union and one window; of larger ones
    times and events are numbered over ranges, and an equi-join on numbers finds the event before. times: (by..., time); events: (by..., at, ...).
    known (by..., at) has the times that count where some of them have no events: a time that falls on such a one gets none.
    """
    known = (events if known is None else known).select(*by, at).distinct().select(*by, F.col(at).alias(time), F.col(at).alias("_at"))
    marks = times.select(*by, time, F.lit(None).cast("timestamp").alias("_at"), F.lit(True).alias("_ask")).unionByName(known.withColumn("_ask", F.lit(False)))
    cold, hot = split(written(marks, "marks"), by, most)
    found = []
    if cold is not None:
        w = Window.partitionBy(*by).orderBy(time, F.col("_ask").asc()).rowsBetween(Window.unboundedPreceding, 0)
        found.append(cold.withColumn("_at", F.last("_at", True).over(w)).where("_ask and _at is not null").select(*by, time, "_at"))
    if hot is not None:
        line = written(before(hot, by, [time, "_ask"], {"_n": ~F.col("_ask")}), "marks")
        last = line.where("not _ask").select(*by, "_n", "_at")
        found.append(line.where("_ask").select(*by, time, (F.col("_n") - 1).alias("_n")).join(last, [*by, "_n"]).select(*by, time, "_at"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.join(events.withColumnRenamed(at, "_at"), [*by, "_at"]).withColumnRenamed("_at", at)
