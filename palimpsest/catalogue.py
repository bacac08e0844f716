"""Queries by name on the driver's tables, and SQL that computes the same forwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rdfize
from .functions.updates import update_texts, with_ops
from .operators import convert, graph, replay
from .operators.ranks import repeated
from .plans import query as plan
from .plans.entity import AgnosticEntity
from .plans.query import DeltaQuery, VersionQuery
from .scratch import files_of, is_there

_T = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
PURCHASE = 'SELECT ?u WHERE { ?u <urn:p:status> "purchase" }'
STAR = 'SELECT ?u ?v WHERE { ?u <urn:p:status> "purchase" . ?u <urn:p:value> ?v }'


def _time(c: str):
    return F.date_format(c, _T).alias(c)


#: Catalogs already built, by folder and kind, of the session at hand, with the files they were built from.
_BUILT: dict = {}


def _cat(spark: SparkSession, d: str, kind: str = "") -> plan.Catalog:
    """The event catalog of a folder, built once a session while its files stay as they are: its states and intervals are tables in the shared folder, and every question reads them."""
    files = files_of(spark, f"{d}/events.parquet")
    c, known = _BUILT.get((d, kind), (None, None))
    if c is None or known != files or c.validity.sparkSession is not spark or not all(map(is_there, c.tables)):
        c = rdfize.event_catalog(spark, d, kind)
        _BUILT[(d, kind)] = c, files
    return c


def _merges(spark: SparkSession, d: str) -> DataFrame:
    return _cat(spark, d, "merged").with_merges().merges


def _bounds(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """Three instants inside the events' span: at a quarter, a half and three quarters, cut to whole seconds."""
    r = rdfize.table(spark, d, "events").agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b")).first()
    from datetime import datetime, timezone

    return tuple(datetime.fromtimestamp(r.a + (r.b - r.a) * k // 4, timezone.utc).isoformat() for k in (1, 2, 3))


def scan_quads(spark, d):
    return rdfize.static_quads(spark, d).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("o").alias("n_objects"))


def scan_quads_nation(spark, d):
    return rdfize.static_quads(spark, d, ("nation", "region")).select("s", "p", "o", "g")


def snapshots(spark, d):
    return _cat(spark, d).snapshots.select("entity", "snapshot", _time("generated_at"), F.size("derived_from").cast("bigint").alias("n_derived"))


def parse_ops(spark, d):
    ops = _cat(spark, d).ops
    texts = update_texts(ops, "entity", "snapshot")
    return with_ops(texts, "update_query", "x").select("entity", F.explode_outer("x").alias("x")).where("x is not null").groupBy("x.op", "x.p").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))


def parse_odd_texts(spark, d):
    """Operations of texts as other writers make them: without dots, with semicolons, escapes and both quotes, in any case, and with a block that isn't closed."""
    c = rdfize.dealt(rdfize.table(spark, d, "customer"))
    s = F.concat(F.lit("<urn:t:customer/"), F.col("c_custkey").cast("string"), F.lit(">"))
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    text = F.concat(
        F.lit("insert data{graph<urn:g:c>{"), s, F.lit(' <urn:p:name> "'), name, F.lit('\\\\n \\"q\\" {"@en '), s, F.lit(" <urn:p:seg> '"), seg, F.lit("' ; <urn:lone> }} ; DELETE\nDATA { GRAPH <urn:g:c> { "),
        s, F.lit(" <urn:p:old> 'it\\'s "), seg, F.lit('\\n"\'^^<urn:d:x> ; '), s, F.lit(' <urn:p:open> "DELETE DATA { GRAPH <urn:g:x> {" '),
    )
    rows = with_ops(c.select(s.alias("entity"), text.alias("text")), "text", "x")
    return rows.select("entity", F.explode_outer("x").alias("x")).select("entity", "x.op", "x.p", "x.o", "x.g")


def validity(spark, d):
    return _cat(spark, d).validity.select("entity", "p", "o", _time("valid_from"), _time("valid_to"))


def state_at(spark, d):
    t = _bounds(spark, d)[1]
    return replay.state_at(_cat(spark, d).during((t, t)), t).select("entity", "p", "o")


def state_interval(spark, d):
    a, b, _ = _bounds(spark, d)
    c = _cat(spark, d)
    return replay.history(c.during((a, b)), c.snapshots, (a, b)).groupBy("entity", "p").agg(F.count("*").alias("n"), F.date_format(F.min("time"), _T).alias("first"))


def state_fallback(spark, d):
    a = _bounds(spark, d)[2]
    c = _cat(spark, d)
    return replay.selected_times(c.snapshots, (a, a)).select("entity", _time("time"))


def history(spark, d):
    c = _cat(spark, d)
    return replay.history(c.validity, c.snapshots).groupBy("p", "o").agg(F.count("*").alias("n"))


def delta_net(spark, d):
    a, _, b = _bounds(spark, d)
    c = _cat(spark, d)
    return replay.delta(c.validity, c.ops, c.snapshots, a, b).select("entity", "p", "o", "sign")


def delta_record_flat(spark, d):
    a, b, _ = _bounds(spark, d)
    c = _cat(spark, d)
    r = DeltaQuery(c, PURCHASE, (a, b)).records()
    return r.select("entity", F.coalesce(F.size("changes"), F.lit(0)).cast("bigint").alias("n_changes"), F.date_format("created", _T).alias("created"))


def delta_changed_props(spark, d):
    a, b, _ = _bounds(spark, d)
    c = _cat(spark, d)
    r = replay.delta_records(c.ops, c.snapshots, (a, b), ["urn:p:status"])
    return r.select("entity", F.explode("changes").alias("x")).groupBy("entity").agg(F.sum(F.size("x.additions")).alias("n_added"), F.sum(F.size("x.deletions")).alias("n_deleted"))


def vm_single_pattern(spark, d):
    return VersionQuery(_cat(spark, d), PURCHASE, (_bounds(spark, d)[1],) * 2).bindings().select("u").distinct()


def sv_bgp_star(spark, d):
    a, b, _ = _bounds(spark, d)
    return VersionQuery(_cat(spark, d), STAR).intervals().where((F.col("from_") <= F.lit(b).cast("timestamp")) & (F.col("to_") > F.lit(b).cast("timestamp"))).select("u", "v")


def vm_typed_terms(spark, d):
    """Users and values at one instant, as kinds, values and datatypes of their terms: a row for each version that has them, made from their number, as no time is asked for."""
    _, b, _ = _bounds(spark, d)
    rows = VersionQuery(_cat(spark, d), STAR, (b, b)).typed_versions()
    rows = rows.select("u.type", F.col("u.value").alias("user"), F.col("v.type").alias("v_type"), F.col("v.value").cast("bigint").alias("cents"), F.col("v.datatype").alias("v_datatype"), F.col("v.lang").alias("v_lang"), "n")
    return repeated(rows, "n")


def cv_single_pattern(spark, d):
    i = VersionQuery(_cat(spark, d), PURCHASE).intervals()
    return i.select("u", F.date_format("from_", _T).alias("from_"), F.when(F.col("to_") < F.lit(replay.OPEN).cast("timestamp"), F.date_format("to_", _T)).alias("to_"))


def cv_bgp_star(spark, d):
    i = VersionQuery(_cat(spark, d), STAR).intervals()
    return i.groupBy("u").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))


def cv_timeline(spark, d):
    """How many answers each version has: users with a status."""
    return VersionQuery(_cat(spark, d), "SELECT ?u ?x WHERE { ?u <urn:p:status> ?x }").counts().select(_time("time"), "n")


def cv_optional(spark, d):
    """Values of users, with the status if there is one, and a further optional pattern that matches nothing: answers and versions of each status."""
    q = VersionQuery(_cat(spark, d), "SELECT ?u ?x ?v WHERE { ?u <urn:p:value> ?v . OPTIONAL { ?u <urn:p:status> ?x . ?y <urn:p:nothing> ?x } }")
    each = q.versions().groupBy("x").agg(F.sum("n").alias("n"))
    some = q.versions("x").select(F.col("x").alias("x2"), F.col("n").alias("n_times"))
    return each.join(some, F.col("x").eqNullSafe(F.col("x2"))).select("x", "n", "n_times")


def cv_gap_fill(spark, d):
    """Versions of each status, summed over users, on the timeline of all users."""
    q = VersionQuery(_cat(spark, d), "SELECT ?u ?x WHERE { ?u <urn:p:status> ?x }", include_all_timestamps=True)
    return q.versions().groupBy("x").agg(F.sum("n").alias("n"))


def cv_timeline_all(spark, d):
    """cv_timeline of every user; counts of the answers at each time."""
    q = VersionQuery(_cat(spark, d), 'SELECT ?u ?x WHERE { ?u <urn:p:status> ?x }')
    return q.counts("x").select(_time("time"), "x", "n")


def cv_optional_all(spark, d):
    """Values of every user with the status at the same time, if there is one."""
    q = VersionQuery(_cat(spark, d), 'SELECT ?u ?x ?v WHERE { ?u <urn:p:value> ?v . OPTIONAL { ?u <urn:p:status> ?x } }')
    each = q.versions().groupBy("u", "x").agg(F.sum("n").alias("n"))
    some = q.versions("u", "x").select(F.col("u").alias("u2"), F.col("x").alias("x2"), F.col("n").alias("n_times"))
    return each.join(some, (F.col("u") == F.col("u2")) & F.col("x").eqNullSafe(F.col("x2"))).select("u", "x", "n", "n_times")


def cv_gap_fill_all(spark, d):
    """Users that have a status "purchase" at some time, at all times of all users from the first on."""
    return VersionQuery(_cat(spark, d), PURCHASE, include_all_timestamps=True).versions()


def sv_bgp_chain(spark, d):
    c = rdfize.static_catalog(spark, d, ("customer", "nation", "region"))
    i = VersionQuery(c, 'SELECT ?c ?r WHERE { ?c <urn:p:c_nationkey> ?n . ?n <urn:p:n_regionkey> ?r . ?r <urn:p:r_name> "ASIA" }').intervals()
    return i.select("c", "n", "r")


def discovery_present(spark, d):
    return plan.present(_cat(spark, d), ("?u", rdfize.STATUS, '"purchase"'))


def discovery_historical(spark, d):
    return plan.discover(_cat(spark, d).with_index(), ("?u", rdfize.STATUS, '"purchase"')).select("entity")


def related_objects(spark, d):
    c = rdfize.static_catalog(spark, d, ("supplier", "nation", "region"))
    start = c.quads.where(F.col("g") == "<urn:g:supplier>").select(F.col("entity").alias("root"), F.col("entity").alias("node")).distinct()
    return graph.reachable(start, graph.cut(graph.object_edges(c.validity))).select("root", "node", F.col("depth").cast("bigint").alias("depth"))


def _reverse(spark, d, depth):
    q = rdfize.static_quads(spark, d, ("customer", "nation", "region"))
    start = spark.createDataFrame([("<urn:t:region/2>", "<urn:t:region/2>")], "root string, node string")
    return graph.reachable(start, graph.reverse_edges(q), depth).select("node", F.col("depth").cast("bigint").alias("depth"))


def reverse_relations_d1(spark, d):
    return _reverse(spark, d, 1)


def reverse_relations_d2(spark, d):
    return _reverse(spark, d, 2)


def historical_reverse(spark, d):
    return graph.historical_reverse(_cat(spark, d).with_index().index, ['"error"'])


def reverse_historical(spark, d):
    """Entities that referred to region 2, and those that referred to them, though none does any more."""
    e = AgnosticEntity(rdfize.moved_out(spark, d), "urn:t:region/2", include_reverse_relations=True, include_historical_reverse_relations=True)
    return e.entities()


def merged_forward(spark, d):
    """Whom survivors have absorbed, directly or not, and over how few steps."""
    return _absorbed(_merges(spark, d)).groupBy("node").agg(F.min("depth").cast("bigint").alias("depth"))


def merged_forward_all(spark, d):
    """merged_forward from every survivor."""
    return _absorbed(_merges(spark, d)).select("root", "node", F.col("depth").cast("bigint").alias("depth"))


def _absorbed(m: DataFrame) -> DataFrame:
    start = m.select(F.col("survivor").alias("root"), F.col("survivor").alias("node")).distinct()
    return graph.reachable(start, m.select(F.col("survivor").alias("src"), F.col("absorbed").alias("dst")))


def merge_components(spark, d):
    c = _cat(spark, d, "merged").with_merges().components
    return c.groupBy("component").agg(F.count("*").alias("n"), F.max("entity").alias("last"))


def merge_events(spark, d):
    e = graph.merge_events(_merges(spark, d))
    return e.select("entity", "snapshot", "survivor", _time("time"))


def history_merged_asof(spark, d):
    """The status of user u + 1 as of each event of user u."""
    ev = rdfize.table(spark, d, "events").where("user_id is not null and ts is not null and event_type is not null")
    asks = ev.select(F.col("user_id").alias("k"), F.col("ts").alias("time")).distinct()
    known = ev.groupBy((F.col("user_id") - 1).alias("k"), F.col("ts").alias("at")).agg(F.max_by("event_type", "event_id").alias("status"))
    return replay.latest_up_to(asks, known, ["k"]).select("k", _time("time"), "status")


def history_merged_all(spark, d):
    """The status of every user that a survivor has absorbed, directly or not, as of each event of the survivor."""
    ev = rdfize.table(spark, d, "events").where("user_id is not null and ts is not null and event_type is not null")
    states = ev.groupBy(rdfize.user(F.col("user_id")).alias("entity"), F.col("ts").alias("time")).agg(F.max_by("event_type", "event_id").alias("o"))
    states = graph.cut(states.select("entity", "time", F.col("entity").alias("s"), F.lit(rdfize.STATUS).alias("p"), "o", F.lit(rdfize.USERS).alias("g")))
    related = _absorbed(_merges(spark, d)).select("root", F.col("node").alias("entity"))
    main = related.select("root").distinct().join(states.select(F.col("entity").alias("root"), "time"), "root")
    return graph.merged_history(main, related.join(states, "entity")).select("root", _time("time"), "entity", F.col("o").alias("status"))


def prov_selected(spark, d):
    a, b, _ = _bounds(spark, d)
    sel, _ = VersionQuery(_cat(spark, d), PURCHASE, (a, b)).provenance()
    return sel.select("entity", "snapshot")


def prov_other(spark, d):
    a, b, _ = _bounds(spark, d)
    _, other = VersionQuery(_cat(spark, d), PURCHASE, (a, b)).provenance()
    return other.groupBy("entity").agg(F.count("*").alias("n"))


def ties_validity(spark, d):
    """Intervals where all of a day's snapshots have one time and their numbers decide which comes last."""
    return _cat(spark, d, "ties").validity.select("entity", "p", "o", _time("valid_from"), _time("valid_to"))


def delta_empty_changes(spark, d):
    """Delta records of all users for one property: changes of the other one stay as empty entries."""
    a, b, _ = _bounds(spark, d)
    c = _cat(spark, d)
    r = replay.delta_records(c.ops, c.snapshots, (a, b), ["urn:p:status"])
    n = lambda f: F.size(F.filter("changes", f)).cast("bigint")
    return r.select("entity", F.size("changes").cast("bigint").alias("n_changes"), n(lambda x: (F.size(x["additions"]) == 0) & (F.size(x["deletions"]) == 0)).alias("n_empty"), F.size("additions").cast("bigint").alias("n_added"), F.size("deletions").cast("bigint").alias("n_deleted"))


def delta_created_deleted(spark, d):
    """When users were created and deleted, from the first quarter of the time on."""
    a, _, _ = _bounds(spark, d)
    c = _cat(spark, d, "deleted")
    return replay.delta_records(c.ops, c.snapshots, (a, None)).select("entity", _time("created"), _time("deleted"))


def merge_aware_version(spark, d):
    """The status of user 0 in any version, of whoever was merged with it too."""
    i = VersionQuery(_cat(spark, d, "merged"), "SELECT ?x WHERE { <urn:user/0> <urn:p:status> ?x }", merge_aware=True).intervals()
    return i.select("x", F.date_format("from_", _T).alias("from_"), F.when(F.col("to_") < F.lit(replay.OPEN).cast("timestamp"), F.date_format("to_", _T)).alias("to_"))


def merge_aware_constant(spark, d):
    """Customers of nation 1, which is merged with the other nations of its region."""
    c = rdfize.nation_merges(spark, d, rdfize.static_catalog(spark, d, ("customer", "nation")))
    return VersionQuery(c, "SELECT ?c WHERE { ?c <urn:p:c_nationkey> <urn:t:nation/1> }", merge_aware=True).intervals().select("c")


def merge_aware_delta(spark, d):
    """Changes and merges of users that ever had a purchase, and of those merged with them."""
    a, b, _ = _bounds(spark, d)
    r = DeltaQuery(_cat(spark, d, "merged"), PURCHASE, (a, b), merge_aware=True).records()
    return r.select("entity", F.size("changes").cast("bigint").alias("n_changes"), F.coalesce(F.size("merges"), F.lit(0)).cast("bigint").alias("n_merges"))


def cv_bgp_chain_static(spark, d):
    """Suppliers with the names of their regions, over two hops."""
    c = rdfize.static_catalog(spark, d, ("supplier", "nation", "region"))
    return VersionQuery(c, "SELECT ?s ?x WHERE { ?s <urn:p:s_nationkey> ?n . ?n <urn:p:n_regionkey> ?r . ?r <urn:p:r_name> ?x }").bindings().select("s", "x")


def state_with_related(spark, d):
    """The state of supplier 1 with the objects it refers to, directly or not."""
    c = rdfize.static_catalog(spark, d, ("supplier", "nation", "region"))
    states, _, _ = AgnosticEntity(c, "urn:t:supplier/1", include_related_objects=True).get_state_at_time((None, None))
    return states.select("s", "p", "o")


def state_with_merged(spark, d):
    """The states of user 0 between two instants, with those of the users merged into it."""
    a, b, _ = _bounds(spark, d)
    states, _, _ = AgnosticEntity(_cat(spark, d, "merged"), "urn:user/0", include_merged_entities=True).get_state_at_time((a, b))
    return states.select(_time("time"), "s", "p", "o")


def history_with_reverse(spark, d):
    """The history of region 2 with its nations, one level of references back."""
    c = rdfize.static_catalog(spark, d, ("nation", "region"))
    states, _ = AgnosticEntity(c, "urn:t:region/2", include_reverse_relations=True, reverse_relations_depth=1).get_history()
    return states.select("s", "p", "o")


def state_metadata(spark, d):
    """Snapshots selected between two instants and the other ones, for user 0 and the users merged into it."""
    a, b, _ = _bounds(spark, d)
    _, chosen, other = AgnosticEntity(_cat(spark, d, "merged"), "urn:user/0", include_merged_entities=True).get_state_at_time((a, b), include_prov_metadata=True)
    rows = chosen.withColumn("channel", F.lit("selected")).unionByName(other.withColumn("channel", F.lit("other")))
    return rows.groupBy("entity", "channel").agg(F.count("*").alias("n"), F.sum(F.size("derived_from")).cast("bigint").alias("n_derived"))


def version_metadata(spark, d):
    """Snapshots with metadata of all users that ever had a purchase."""
    _, chosen, other = VersionQuery(_cat(spark, d), PURCHASE, include_prov_metadata=True).run_agnostic_query()
    return chosen.unionByName(other).groupBy("entity", "description", "attributed_to").agg(F.count("*").alias("n"))


def delta_metadata(spark, d):
    """Snapshots, selected and other, of the users with a delta record."""
    a, b, _ = _bounds(spark, d)
    _, chosen, other = DeltaQuery(_cat(spark, d), PURCHASE, (a, b), include_prov_metadata=True).run_agnostic_query()
    rows = chosen.withColumn("channel", F.lit("selected")).unionByName(other.withColumn("channel", F.lit("other")))
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))


def _days(copies) -> int:
    return copies.agg(F.max("version")).first()[0] + 1


def ic_diff(spark, d):
    c = rdfize.daily_copies(spark, d)
    return convert.copies_to_changes(c, _days(c)).select(F.col("version").cast("bigint").alias("version"), "op", "entity", "o")


def cb_apply(spark, d):
    c = rdfize.daily_copies(spark, d)
    return convert.apply_changes(c.where("version = 0"), rdfize.daily_changes(c)).select("entity", "o")


def converter_numbering(spark, d):
    c = rdfize.daily_copies(spark, d)
    return convert.numbered(c, convert.copies_to_changes(c, _days(c))).select("entity", F.col("number").cast("bigint").alias("number"), F.col("version").cast("bigint").alias("version"))


def converter_invalidation(spark, d):
    from datetime import datetime, timedelta, timezone

    c = rdfize.daily_copies(spark, d)
    n = _days(c)
    t0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
    _, s = convert.convert_copies(c, [t0 + timedelta(days=i) for i in range(n)], "urn:g:days", "urn:agent:driver")
    return s.where("invalidated_at is not null").select("entity", F.datediff("invalidated_at", F.lit("2020-01-01").cast("date")).cast("bigint").alias("version"))


def insert_text(spark, d):
    q = rdfize.static_quads(spark, d, ("nation",)).where(F.col("p") == "<urn:p:n_name>")
    return update_texts(q.withColumn("op", F.lit("I")), "entity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [scan_quads, scan_quads_nation, snapshots, parse_ops, parse_odd_texts, validity, state_at, state_interval, state_fallback, history, delta_net, delta_record_flat, delta_changed_props, vm_single_pattern, vm_typed_terms, sv_bgp_star, sv_bgp_chain, cv_single_pattern, cv_bgp_star, cv_timeline, cv_optional, cv_gap_fill, cv_timeline_all, cv_optional_all, cv_gap_fill_all, discovery_present, discovery_historical, related_objects, reverse_relations_d1, reverse_relations_d2, historical_reverse, merged_forward, merged_forward_all, merge_components, merge_events, history_merged_asof, history_merged_all, prov_selected, prov_other, ties_validity, delta_empty_changes, delta_created_deleted, merge_aware_version, merge_aware_constant, merge_aware_delta, cv_bgp_chain_static, state_with_related, state_with_merged, history_with_reverse, state_metadata, version_metadata, delta_metadata, reverse_historical, ic_diff, cb_apply, converter_numbering, converter_invalidation, insert_text]
    return {f.__name__: f for f in names}


_EV = """WITH ev AS (SELECT user_id, event_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents, '<urn:user/' || user_id || '>' AS entity FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT min(epoch_ms(ts)) // 1000 AS lo, max(epoch_ms(ts)) // 1000 AS hi FROM ev),
bounds AS (SELECT make_timestamp((lo + (hi - lo) * 1 // 4) * 1000000) AS t1, make_timestamp((lo + (hi - lo) * 2 // 4) * 1000000) AS t2, make_timestamp((lo + (hi - lo) * 3 // 4) * 1000000) AS t3 FROM b),
st AS (SELECT entity, ts, event_id, '<urn:p:status>' AS p, '"' || event_type || '"' AS o FROM ev UNION ALL SELECT entity, ts, event_id, '<urn:p:value>', '"' || cents || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM ev),
ch AS (SELECT *, lag(o) OVER (PARTITION BY entity, p ORDER BY ts, event_id) AS prev, row_number() OVER (PARTITION BY entity, p ORDER BY ts, event_id) AS rn FROM st),
iv AS (SELECT entity, p, o, ts AS valid_from, lead(ts) OVER (PARTITION BY entity, p ORDER BY ts, event_id) AS valid_to FROM ch WHERE prev IS DISTINCT FROM o)
"""
_F = "'%Y-%m-%dT%H:%M:%S.%f'"
_COPIES = """WITH c AS (SELECT DISTINCT date_diff('day', (SELECT min(date_trunc('day', ts)) FROM events), date_trunc('day', ts)) AS version, '<urn:user/' || user_id || '>' AS entity, '"' || event_type || '"' AS o FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
n AS (SELECT max(version) AS m FROM c),
ch AS (SELECT a.version, 'I' AS op, a.entity, a.o FROM c a LEFT JOIN c b ON a.entity = b.entity AND a.o = b.o AND b.version = a.version - 1 WHERE b.version IS NULL AND a.version > 0
 UNION ALL SELECT a.version + 1, 'D', a.entity, a.o FROM c a LEFT JOIN c b ON a.entity = b.entity AND a.o = b.o AND b.version = a.version + 1, n WHERE b.version IS NULL AND a.version < n.m),
ents AS (SELECT DISTINCT entity FROM c),
per AS (SELECT DISTINCT entity, version FROM ch)
"""
_MERGES = """WITH RECURSIVE l AS (SELECT user_id AS u, max(ts) AS time FROM events WHERE user_id IS NOT NULL GROUP BY 1),
t AS (SELECT u, time, CASE WHEN u % 5 <> 0 THEN u - u % 5 WHEN u % 10 = 0 THEN u - u % 100 END AS v FROM l),
m AS (SELECT '<urn:merge/' || u || '>' AS snapshot, time, '<urn:user/' || v || '>' AS survivor, '<urn:user/' || u || '>' AS absorbed, u, v FROM t WHERE v IS NOT NULL AND v <> u)
"""
_ABSORBED = """, r AS (SELECT DISTINCT survivor AS root, survivor AS node, CAST(0 AS BIGINT) AS depth FROM m UNION ALL SELECT r.root, m.absorbed, r.depth + 1 FROM r JOIN m ON m.survivor = r.node)
"""
_BOTH = "WITH RECURSIVE" + _EV.removeprefix("WITH") + ", " + _MERGES.removeprefix("WITH RECURSIVE ")
_COMPONENTS = """, e2 AS (SELECT survivor AS a, absorbed AS b FROM m UNION SELECT absorbed, survivor FROM m), r2 AS (SELECT a, a AS x FROM e2 UNION SELECT r2.a, e2.b FROM r2 JOIN e2 ON r2.x = e2.a), comp AS (SELECT a, min(x) AS component FROM r2 GROUP BY a)
"""


def _unpivot(name: str, cols: dict[str, str]) -> str:
    key = next(iter(cols))
    return " UNION ALL ".join(f"SELECT '<urn:t:{name}/' || {key} || '>' AS s, '<urn:p:{c}>' AS p, {o} AS o, '<urn:g:{name}>' AS g FROM {name} WHERE {c} IS NOT NULL" for c, o in cols.items())


def _cols(name: str) -> dict[str, str]:
    """Columns of the driver's tables and the SQL of their terms, by the rule of static_quads."""
    kinds = {
        "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:region", "customer": "c_custkey:i c_name:s c_nationkey:nation c_acctbal:c c_mktsegment:s",
        "supplier": "s_suppkey:i s_name:s s_nationkey:nation s_acctbal:c", "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:c", "orders": "o_orderkey:i o_custkey:customer o_orderstatus:s o_totalprice:c o_orderdate:d o_orderpriority:s",
    }[name]
    i = "^^<http://www.w3.org/2001/XMLSchema#integer>'"
    out = {}
    for x in kinds.split():
        c, k = x.split(":")
        out[c] = {"i": f"'\"' || {c} || '\"{i}", "s": f"'\"' || {c} || '\"'", "c": f"'\"' || CAST(round({c} * 100) AS BIGINT) || '\"{i}", "d": f"'\"' || strftime({c}, '%Y-%m-%d') || '\"^^<http://www.w3.org/2001/XMLSchema#date>'"}.get(k, f"'<urn:t:{k}/' || {c} || '>'")
    return out


def _quads_sql(*names: str) -> str:
    return " UNION ALL ".join(_unpivot(n, _cols(n)) for n in names)


def oracle_sql() -> dict[str, str]:
    q = {
        "scan_quads": f"SELECT p, count(*) AS n, count(DISTINCT o) AS n_objects FROM ({_quads_sql('customer', 'nation', 'region', 'supplier', 'part', 'orders')}) GROUP BY p",
        "scan_quads_nation": _quads_sql("nation", "region"),
        "snapshots": f"SELECT '<urn:user/' || user_id || '>' AS entity, '<urn:user/' || user_id || '/prov/se/' || lpad(CAST(n AS VARCHAR), 9, '0') || '>' AS snapshot, strftime(ts, {_F}) AS generated_at, CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS BIGINT) AS n_derived FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)",
        "parse_ops": _EV + "SELECT op, p, count(*) AS n, count(DISTINCT entity) AS n_entities FROM (SELECT 'I' AS op, p, entity FROM ch WHERE prev IS DISTINCT FROM o UNION ALL SELECT 'D', p, entity FROM ch WHERE prev IS NOT NULL AND prev IS DISTINCT FROM o) GROUP BY op, p",
        "parse_odd_texts": """WITH c AS (SELECT '<urn:t:customer/' || c_custkey || '>' AS entity, c_name AS name, c_mktsegment AS seg FROM customer)
SELECT entity, 'I' AS op, '<urn:p:name>' AS p, '"' || name || '\\\\n \\"q\\" {"@en' AS o, '<urn:g:c>' AS g FROM c UNION ALL SELECT entity, 'I', '<urn:p:seg>', '"' || seg || '"', '<urn:g:c>' FROM c
UNION ALL SELECT entity, 'D', '<urn:p:old>', '"it''s ' || seg || '\\n\\""^^<urn:d:x>', '<urn:g:c>' FROM c UNION ALL SELECT entity, 'D', '<urn:p:open>', '"DELETE DATA { GRAPH <urn:g:x> {"', '<urn:g:c>' FROM c""",
        "validity": _EV + f"SELECT entity, p, o, strftime(valid_from, {_F}) AS valid_from, strftime(valid_to, {_F}) AS valid_to FROM iv",
        "state_at": _EV + "SELECT entity, p, arg_max(o, (ts, event_id)) AS o FROM st, bounds WHERE ts <= t2 GROUP BY entity, p",
        "state_interval": _EV + f"SELECT entity, p, count(*) AS n, strftime(min(ts), {_F}) AS first FROM (SELECT entity, p, ts FROM st, bounds WHERE ts >= t1 AND ts <= t2 UNION ALL SELECT entity, p, max(ts) FROM st, bounds WHERE ts <= t1 AND entity NOT IN (SELECT entity FROM st, bounds WHERE ts >= t1 AND ts <= t2) GROUP BY entity, p) GROUP BY entity, p",
        "state_fallback": _EV + f"SELECT entity, strftime(max(ts), {_F}) AS time FROM ev, bounds WHERE ts <= t3 GROUP BY entity",
        "history": _EV + "SELECT p, o, count(*) AS n FROM st GROUP BY p, o",
        "delta_net": _EV + """, late AS (SELECT entity FROM ev, bounds GROUP BY entity HAVING min(ts) > any_value(t1)),
a AS (SELECT entity, p, arg_max(o, (ts, event_id)) AS o FROM st, bounds WHERE ts <= t1 GROUP BY entity, p),
z AS (SELECT entity, p, arg_max(o, (ts, event_id)) AS o FROM st, bounds WHERE ts <= t3 GROUP BY entity, p)
SELECT entity, p, o, CAST(1 AS INTEGER) AS sign FROM z WHERE (entity, p, o) NOT IN (SELECT (entity, p, o) FROM a) UNION ALL SELECT entity, p, o, -1 FROM a WHERE (entity, p, o) NOT IN (SELECT (entity, p, o) FROM z)""",
        "delta_record_flat": _EV + f""", per AS (SELECT entity, min(ts) AS born FROM ev GROUP BY entity), rel AS (SELECT DISTINCT entity FROM ch WHERE p = '<urn:p:status>' AND o = '"purchase"'),
k AS (SELECT ch.entity, count(DISTINCT ts) AS n FROM ch JOIN per USING (entity), bounds WHERE prev IS DISTINCT FROM o AND ts > born AND ts BETWEEN t1 AND t2 GROUP BY 1)
SELECT rel.entity, CAST(coalesce(k.n, 0) AS BIGINT) AS n_changes, CASE WHEN born BETWEEN t1 AND t2 THEN strftime(born, {_F}) END AS created FROM rel JOIN per USING (entity) LEFT JOIN k USING (entity), bounds WHERE entity IN (SELECT entity FROM ev, bounds WHERE ts BETWEEN t1 AND t2)""",
        "delta_changed_props": _EV + """, per AS (SELECT entity, min(ts) AS born FROM ev GROUP BY entity)
SELECT entity, CAST(count(*) FILTER (p = '<urn:p:status>') AS BIGINT) AS n_added, CAST(count(prev) FILTER (p = '<urn:p:status>') AS BIGINT) AS n_deleted FROM ch JOIN per USING (entity), bounds WHERE prev IS DISTINCT FROM o AND ts > born AND ts BETWEEN t1 AND t2 GROUP BY entity""",
        "vm_single_pattern": _EV + """SELECT entity AS u FROM (SELECT entity, arg_max(event_type, (ts, event_id)) AS e FROM ev, bounds WHERE ts <= t2 GROUP BY entity) WHERE e = 'purchase'""",
        "vm_typed_terms": _EV + """, sel AS (SELECT entity, max(ts) AS ts FROM ev, bounds WHERE ts <= t2 GROUP BY entity), x AS (SELECT DISTINCT sel.ts AS time, s.entity, v.o FROM sel AS own JOIN iv s ON s.entity = own.entity JOIN iv v ON v.entity = s.entity, sel
 WHERE s.p = '<urn:p:status>' AND s.o = '"purchase"' AND v.p = '<urn:p:value>' AND v.o IS NOT NULL AND own.ts <= sel.ts AND s.valid_from <= sel.ts AND (s.valid_to IS NULL OR sel.ts < s.valid_to) AND v.valid_from <= sel.ts AND (v.valid_to IS NULL OR sel.ts < v.valid_to))
SELECT 'uri' AS type, entity[2:-2] AS "user", 'literal' AS v_type, CAST(regexp_extract(o, '"(-?[0-9]+)"', 1) AS BIGINT) AS cents, 'http://www.w3.org/2001/XMLSchema#integer' AS v_datatype, CAST(NULL AS VARCHAR) AS v_lang FROM x""",
        "sv_bgp_star": _EV + """SELECT entity AS u, '"' || v || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS v FROM (SELECT entity, arg_max(event_type, (ts, event_id)) AS e, arg_max(cents, (ts, event_id)) AS v FROM ev, bounds WHERE ts <= t2 GROUP BY entity) WHERE e = 'purchase' AND v IS NOT NULL""",
        "sv_bgp_chain": "SELECT '<urn:t:customer/' || c_custkey || '>' AS c, '<urn:t:nation/' || n_nationkey || '>' AS n, '<urn:t:region/' || r_regionkey || '>' AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
        "cv_single_pattern": _EV + f"""SELECT entity AS u, strftime(valid_from, {_F}) AS from_, strftime(valid_to, {_F}) AS to_ FROM iv WHERE p = '<urn:p:status>' AND o = '"purchase"'""",
        "cv_bgp_star": _EV + """SELECT a.entity AS u, count(*) AS n, count(DISTINCT b.o) AS n_values FROM iv a JOIN iv b ON a.entity = b.entity AND greatest(a.valid_from, b.valid_from) < least(coalesce(a.valid_to, TIMESTAMP '9999-12-31'), coalesce(b.valid_to, TIMESTAMP '9999-12-31')) WHERE a.p = '<urn:p:status>' AND a.o = '"purchase"' AND b.p = '<urn:p:value>' GROUP BY 1""",
        "cv_timeline": _EV + f"SELECT strftime(t.ts, {_F}) AS time, count(*) AS n FROM (SELECT DISTINCT ts FROM ev) t JOIN iv ON valid_from <= t.ts AND (valid_to IS NULL OR t.ts < valid_to) WHERE p = '<urn:p:status>' AND o IS NOT NULL GROUP BY t.ts",
        "cv_optional": _EV + ", t AS (SELECT DISTINCT ts FROM ev), a AS (SELECT DISTINCT t.ts, entity, p, o FROM t JOIN iv ON valid_from <= t.ts AND (valid_to IS NULL OR t.ts < valid_to) WHERE o IS NOT NULL) SELECT s.o AS x, count(*) AS n, count(DISTINCT v.ts) AS n_times FROM a v LEFT JOIN a s ON s.entity = v.entity AND s.ts = v.ts AND s.p = '<urn:p:status>' WHERE v.p = '<urn:p:value>' GROUP BY 1",
        "cv_gap_fill": _EV + "SELECT o AS x, count(*) AS n FROM (SELECT DISTINCT ts FROM ev) t JOIN iv ON valid_from <= t.ts AND (valid_to IS NULL OR t.ts < valid_to) WHERE p = '<urn:p:status>' AND o IS NOT NULL GROUP BY 1",
        "cv_timeline_all": _EV + f"SELECT strftime(t.ts, {_F}) AS time, o AS x, count(*) AS n FROM (SELECT DISTINCT ts FROM ev) t JOIN iv ON valid_from <= t.ts AND (valid_to IS NULL OR t.ts < valid_to) WHERE p = '<urn:p:status>' AND o IS NOT NULL GROUP BY t.ts, o",
        "cv_optional_all": _EV + ", t AS (SELECT DISTINCT ts FROM ev), a AS (SELECT DISTINCT t.ts, entity, p, o FROM t JOIN iv ON valid_from <= t.ts AND (valid_to IS NULL OR t.ts < valid_to) WHERE o IS NOT NULL) SELECT v.entity AS u, s.o AS x, count(*) AS n, count(DISTINCT v.ts) AS n_times FROM a v LEFT JOIN a s ON s.entity = v.entity AND s.ts = v.ts AND s.p = '<urn:p:status>' WHERE v.p = '<urn:p:value>' GROUP BY 1, 2",
        "cv_gap_fill_all": _EV + """SELECT entity AS u, count(*) AS n FROM (SELECT DISTINCT ts FROM ev WHERE ts >= (SELECT min(e.ts) FROM ev e WHERE e.entity IN (SELECT entity FROM ev WHERE event_type = 'purchase'))) t JOIN iv ON valid_from <= t.ts AND (valid_to IS NULL OR t.ts < valid_to) WHERE p = '<urn:p:status>' AND o = '"purchase"' GROUP BY 1""",
        "discovery_present": _EV + """SELECT entity FROM ev GROUP BY entity HAVING arg_max(event_type, (ts, event_id)) = 'purchase'""",
        "discovery_historical": _EV + """SELECT DISTINCT entity FROM ev WHERE event_type = 'purchase'""",
        "related_objects": "SELECT '<urn:t:supplier/' || s_suppkey || '>' AS root, '<urn:t:nation/' || s_nationkey || '>' AS node, CAST(1 AS BIGINT) AS depth FROM supplier UNION ALL SELECT '<urn:t:supplier/' || s_suppkey || '>', '<urn:t:region/' || n_regionkey || '>', 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "reverse_relations_d1": "SELECT '<urn:t:nation/' || n_nationkey || '>' AS node, CAST(1 AS BIGINT) AS depth FROM nation WHERE n_regionkey = 2",
        "reverse_relations_d2": "SELECT '<urn:t:nation/' || n_nationkey || '>' AS node, CAST(1 AS BIGINT) AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '<urn:t:customer/' || c_custkey || '>', 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
        "historical_reverse": """SELECT DISTINCT '<urn:user/' || user_id || '>' AS entity FROM events WHERE event_type = 'error' AND user_id IS NOT NULL""",
        "merged_forward": _MERGES + _ABSORBED + "SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node",
        "merge_components": _MERGES + ", e AS (SELECT survivor AS a, absorbed AS b FROM m UNION SELECT absorbed, survivor FROM m), r AS (SELECT a, a AS x FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.x = e.a), c AS (SELECT a, min(x) AS component FROM r GROUP BY a) SELECT component, count(*) AS n, max(a) AS last FROM c GROUP BY component",
        "merge_events": _MERGES + f"SELECT survivor AS entity, snapshot, survivor, strftime(time, {_F}) AS time FROM m UNION ALL SELECT absorbed, snapshot, survivor, strftime(time, {_F}) FROM m",
        "history_merged_asof": f"SELECT q.user_id AS k, strftime(q.ts, {_F}) AS time, arg_max(e.event_type, (e.ts, e.event_id)) AS status FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL) q JOIN events e ON e.user_id = q.user_id + 1 AND e.ts <= q.ts AND e.event_type IS NOT NULL GROUP BY 1, q.ts",
        "merged_forward_all": _MERGES + _ABSORBED + "SELECT root, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY root, node",
        "history_merged_all": _MERGES + _ABSORBED + f"SELECT a.root, strftime(q.ts, {_F}) AS time, a.node AS entity, arg_max(e.event_type, (e.ts, e.event_id)) AS status FROM (SELECT DISTINCT root, node FROM r WHERE depth > 0) a JOIN (SELECT DISTINCT '<urn:user/' || user_id || '>' AS root, ts FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL) q USING (root) JOIN events e ON '<urn:user/' || e.user_id || '>' = a.node AND e.ts <= q.ts AND e.event_type IS NOT NULL GROUP BY 1, q.ts, 3",
        "prov_selected": _EV + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev), rel AS (SELECT DISTINCT entity FROM ev WHERE event_type = 'purchase'),
ins AS (SELECT n.* FROM n, bounds WHERE ts BETWEEN t1 AND t2), fall AS (SELECT entity, max(ts) AS ts FROM n, bounds WHERE ts <= t1 AND entity NOT IN (SELECT entity FROM ins) GROUP BY entity)
SELECT entity, '<urn:user/' || user_id || '/prov/se/' || lpad(CAST(i AS VARCHAR), 9, '0') || '>' AS snapshot FROM (SELECT entity, user_id, i FROM ins UNION ALL SELECT n.entity, n.user_id, n.i FROM n JOIN fall USING (entity, ts)) WHERE entity IN (SELECT entity FROM rel)""",
        "prov_other": _EV + """, rel AS (SELECT DISTINCT entity FROM ev WHERE event_type = 'purchase'), ins AS (SELECT ev.* FROM ev, bounds WHERE ts BETWEEN t1 AND t2),
sel AS (SELECT entity, ts FROM ins UNION SELECT entity, max(ts) FROM ev, bounds WHERE ts <= t1 AND entity NOT IN (SELECT entity FROM ins) GROUP BY entity)
SELECT entity, count(*) AS n FROM ev WHERE entity IN (SELECT entity FROM rel) AND (entity, ts) NOT IN (SELECT (entity, ts) FROM sel) GROUP BY entity""",
        "ties_validity": _EV + f""", dy AS (SELECT entity, p, date_trunc('day', ts) AS day, arg_max(o, (ts, event_id)) AS o FROM st GROUP BY 1, 2, 3),
dc AS (SELECT *, lag(o) OVER (PARTITION BY entity, p ORDER BY day) AS prev FROM dy), d2 AS (SELECT entity, p, o, day, lead(day) OVER (PARTITION BY entity, p ORDER BY day) AS nxt FROM dc WHERE prev IS DISTINCT FROM o)
SELECT entity, p, o, strftime(CAST(day AS TIMESTAMP), {_F}) AS valid_from, strftime(CAST(nxt AS TIMESTAMP), {_F}) AS valid_to FROM d2""",
        "delta_empty_changes": _EV + """, per AS (SELECT entity, min(ts) AS born FROM ev GROUP BY entity), inn AS (SELECT DISTINCT entity FROM ev, bounds WHERE ts BETWEEN t1 AND t2),
x AS (SELECT ch.entity, ts, max(CASE WHEN p = '<urn:p:status>' THEN 1 ELSE 0 END) AS st FROM ch JOIN per USING (entity), bounds WHERE prev IS DISTINCT FROM o AND ts > born AND ts BETWEEN t1 AND t2 GROUP BY 1, 2),
k AS (SELECT entity, count(*) AS n, sum(1 - st) AS e FROM x GROUP BY entity),
op AS (SELECT ch.entity, ts, event_id, 'D' AS op, prev AS o FROM ch JOIN per USING (entity), bounds WHERE p = '<urn:p:status>' AND prev IS NOT NULL AND prev IS DISTINCT FROM o AND ts > born AND ts BETWEEN t1 AND t2 UNION ALL SELECT ch.entity, ts, event_id, 'I', o FROM ch JOIN per USING (entity), bounds WHERE p = '<urn:p:status>' AND prev IS DISTINCT FROM o AND ts > born AND ts BETWEEN t1 AND t2),
fl AS (SELECT entity, o, arg_min(op, (ts, event_id)) AS f, arg_max(op, (ts, event_id)) AS l FROM op GROUP BY 1, 2),
nt AS (SELECT entity, count(*) FILTER (f = 'I' AND l = 'I') AS a, count(*) FILTER (f = 'D' AND l = 'D') AS d FROM fl GROUP BY 1)
SELECT inn.entity, CAST(coalesce(k.n, 0) AS BIGINT) AS n_changes, CAST(coalesce(k.e, 0) AS BIGINT) AS n_empty, CAST(coalesce(nt.a, 0) AS BIGINT) AS n_added, CAST(coalesce(nt.d, 0) AS BIGINT) AS n_deleted FROM inn LEFT JOIN k USING (entity) LEFT JOIN nt USING (entity)""",
        "delta_created_deleted": _EV + f""", per AS (SELECT entity, min(ts) AS born, max(ts) AS ended, arg_max(event_type, (ts, event_id)) AS e FROM ev GROUP BY entity)
SELECT entity, CASE WHEN born >= t1 THEN strftime(born, {_F}) END AS created, CASE WHEN e = 'error' AND ended + INTERVAL 1 SECOND >= t1 THEN strftime(ended + INTERVAL 1 SECOND, {_F}) END AS deleted FROM per, bounds WHERE ended >= t1 OR (e = 'error' AND ended + INTERVAL 1 SECOND >= t1)""",
        "merge_aware_version": _BOTH + _COMPONENTS + f"SELECT DISTINCT o AS x, strftime(valid_from, {_F}) AS from_, strftime(valid_to, {_F}) AS to_ FROM iv WHERE p = '<urn:p:status>' AND (entity = '<urn:user/0>' OR entity IN (SELECT a FROM comp WHERE component = (SELECT component FROM comp WHERE a = '<urn:user/0>')))",
        "merge_aware_constant": "SELECT '<urn:t:customer/' || c_custkey || '>' AS c FROM customer JOIN nation n ON c_nationkey = n.n_nationkey WHERE n.n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1)",
        "merge_aware_delta": _BOTH + _COMPONENTS + """, per AS (SELECT entity, min(ts) AS born FROM (SELECT entity, ts FROM ev UNION ALL SELECT survivor, time FROM m) GROUP BY entity), rel0 AS (SELECT DISTINCT entity FROM ch WHERE p = '<urn:p:status>' AND o = '"purchase"'),
rel AS (SELECT entity FROM rel0 UNION SELECT a FROM comp WHERE component IN (SELECT component FROM comp JOIN rel0 ON a = entity)),
k AS (SELECT ch.entity, count(DISTINCT ts) AS n FROM ch JOIN per USING (entity), bounds WHERE prev IS DISTINCT FROM o AND ts > born AND ts BETWEEN t1 AND t2 GROUP BY 1),
g AS (SELECT entity, count(*) AS n FROM (SELECT survivor AS entity FROM m, bounds WHERE time BETWEEN t1 AND t2 UNION ALL SELECT absorbed FROM m, bounds WHERE time BETWEEN t1 AND t2) GROUP BY 1),
inn AS (SELECT entity FROM ev, bounds WHERE ts BETWEEN t1 AND t2 UNION SELECT entity FROM g)
SELECT entity, CAST(coalesce(k.n, 0) AS BIGINT) AS n_changes, CAST(coalesce(g.n, 0) AS BIGINT) AS n_merges FROM rel JOIN per USING (entity) LEFT JOIN k USING (entity) LEFT JOIN g USING (entity) WHERE entity IN (SELECT entity FROM inn)""",
        "cv_bgp_chain_static": """SELECT '<urn:t:supplier/' || s_suppkey || '>' AS s, '"' || r_name || '"' AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "state_with_related": f"WITH q AS ({_quads_sql('supplier', 'nation', 'region')}) SELECT s, p, o FROM q WHERE s = '<urn:t:supplier/1>' OR s IN (SELECT '<urn:t:nation/' || s_nationkey || '>' FROM supplier WHERE s_suppkey = 1) OR s IN (SELECT '<urn:t:region/' || n_regionkey || '>' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1)",
        "state_with_merged": _BOTH + _ABSORBED + f""", mem AS (SELECT '<urn:user/0>' AS entity UNION SELECT node FROM r WHERE root = '<urn:user/0>' AND depth > 0),
ver AS (SELECT entity, ts FROM ev WHERE entity IN (SELECT entity FROM mem) UNION SELECT survivor, time FROM m WHERE survivor IN (SELECT entity FROM mem)),
ins AS (SELECT entity, ts FROM ver, bounds WHERE ts BETWEEN t1 AND t2), sel AS (SELECT entity, ts FROM ins UNION SELECT entity, max(ts) FROM ver, bounds WHERE ts <= t1 AND entity NOT IN (SELECT entity FROM ins) GROUP BY entity),
pick AS (SELECT a.ts AS time, b.entity, max(b.ts) AS at FROM sel a JOIN sel b ON b.ts <= a.ts WHERE a.entity = '<urn:user/0>' GROUP BY 1, 2)
SELECT strftime(pick.time, {_F}) AS time, iv.entity AS s, iv.p, iv.o FROM pick JOIN iv ON iv.entity = pick.entity AND iv.valid_from <= pick.at AND (iv.valid_to IS NULL OR pick.at < iv.valid_to)""",
        "history_with_reverse": f"WITH q AS ({_quads_sql('nation', 'region')}) SELECT s, p, o FROM q WHERE s = '<urn:t:region/2>' OR s IN (SELECT '<urn:t:nation/' || n_nationkey || '>' FROM nation WHERE n_regionkey = 2)",
        "state_metadata": _BOTH + _ABSORBED + """, mem AS (SELECT '<urn:user/0>' AS entity UNION SELECT node FROM r WHERE root = '<urn:user/0>' AND depth > 0),
sn AS (SELECT entity, ts, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 1 ELSE 0 END AS d FROM ev WHERE entity IN (SELECT entity FROM mem) UNION ALL SELECT survivor, time, 1 FROM m WHERE survivor IN (SELECT entity FROM mem)),
ins AS (SELECT DISTINCT entity, ts FROM sn, bounds WHERE ts BETWEEN t1 AND t2), sel AS (SELECT entity, ts FROM ins UNION SELECT entity, max(ts) FROM sn, bounds WHERE ts <= t1 AND entity NOT IN (SELECT entity FROM ins) GROUP BY entity)
SELECT entity, CASE WHEN (entity, ts) IN (SELECT (entity, ts) FROM sel) THEN 'selected' ELSE 'other' END AS channel, count(*) AS n, CAST(sum(d) AS BIGINT) AS n_derived FROM sn GROUP BY 1, 2""",
        "version_metadata": "SELECT '<urn:user/' || user_id || '>' AS entity, 'event' AS description, '<urn:agent:driver>' AS attributed_to, count(*) AS n FROM events WHERE ts IS NOT NULL AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1",
        "delta_metadata": _EV + """, rel AS (SELECT DISTINCT entity FROM ev WHERE event_type = 'purchase' AND entity IN (SELECT entity FROM ev, bounds WHERE ts BETWEEN t1 AND t2)) SELECT CASE WHEN ts BETWEEN t1 AND t2 THEN 'selected' ELSE 'other' END AS channel, count(*) AS n, count(DISTINCT entity) AS n_entities FROM ev JOIN rel USING (entity), bounds GROUP BY 1""",
        "reverse_historical": "SELECT '<urn:t:region/2>' AS entity UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '<urn:t:customer/' || c_custkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
        "ic_diff": _COPIES + "SELECT CAST(version AS BIGINT) AS version, op, entity, o FROM ch",
        "cb_apply": _COPIES + "SELECT c.entity, c.o FROM c, n WHERE c.version = n.m",
        "converter_numbering": _COPIES + "SELECT entity, CAST(1 AS BIGINT) AS number, CAST(0 AS BIGINT) AS version FROM ents UNION ALL SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY version) + 1, version FROM per",
        "converter_invalidation": _COPIES + "SELECT entity, CAST(max(version) AS BIGINT) AS version FROM per WHERE entity NOT IN (SELECT c.entity FROM c, n WHERE c.version = n.m) GROUP BY entity",
        "insert_text": """SELECT '<urn:t:nation/' || n_nationkey || '>' AS entity, 'INSERT DATA { GRAPH <urn:g:nation> { <urn:t:nation/' || n_nationkey || '> <urn:p:n_name> "' || n_name || '" . } }' AS update_query FROM nation""",
    }
    return q


