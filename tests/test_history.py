"""Tables by time and by term, composed changes and versions undone in place, against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, replay
from palimpsest.operators.levels import write_levels
from palimpsest.operators.term_index import write_index
from palimpsest.plans import query as plan
from palimpsest.plans.entity import AgnosticEntity
from palimpsest.plans.query import Catalog, VersionQuery

T0 = datetime(2021, 1, 1, tzinfo=timezone.utc)
OPS = "entity string, snapshot string, generated_at timestamp, op_seq int, quad_seq int, op string, s string, p string, o string, g string"
SNAPS = "entity string, snapshot string, generated_at timestamp, invalidated_at timestamp, attributed_to string, primary_source string, description string, update_query string, derived_from array<string>"


def files_read(df):
    """Files that the scans of a collected frame opened."""
    plan_, n = df._jdf.queryExecution().executedPlan(), 0
    plan_ = plan_.executedPlan() if "Adaptive" in plan_.getClass().getName() else plan_
    leaves = plan_.collectLeaves()
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        n += m.apply("numFiles").value() if m.contains("numFiles") else 0
    return n


def log(seed, entities=8, versions=12):
    """(catalog rows, states): random histories, with several snapshots at one time, and the state of each entity at each time."""
    rng = random.Random(seed)
    ops, snaps, quads, states = [], [], [], {}
    for e in range(entities):
        name, state, t = f"<urn:e/{e}>", set(), T0 + timedelta(days=rng.randint(0, 20))
        for k in range(1, versions + 1):
            if k > 1:
                t += timedelta(days=rng.choice([0, 1, 5, 40]))
            snap = f"<urn:e/{e}/prov/se/{k}>"
            snaps.append((name, snap, t, None, "<urn:a>", None, "d", None, []))
            if k == 1:
                state = {(name, f"<urn:p/{rng.randint(0, 2)}>", f'"{rng.randint(0, 4)}"', "<urn:g>") for _ in range(3)}
            else:
                gone = {q for q in sorted(state) if rng.random() < 0.3}  # a text that also adds such a quad would be undone to less
                for q in sorted(gone):
                    if q in state:
                        state.discard(q)
                        ops.append((name, snap, t, 0, len(ops), "D", *q))
                for _ in range(rng.randint(0, 2)):
                    q = (name, f"<urn:p/{rng.randint(0, 2)}>", rng.choice([f'"{rng.randint(0, 4)}"', '"x"@EN', f"<urn:e/{rng.randrange(entities)}>"]), "<urn:g>")
                    if q not in state | gone:
                        state.add(q)
                        ops.append((name, snap, t, 1, len(ops), "I", *q))
            states[name, t] = set(state)
        quads += [(name, *q) for q in state]
    return ops, snaps, quads, states


def catalog(spark, seed, per_slice=12):
    ops, snaps, quads, states = log(seed)
    c = Catalog.build(spark.createDataFrame(quads, "entity string, s string, p string, o string, g string"), spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(ops, OPS), per_slice=per_slice)
    return c, states, ops


def state_of(states, entity, t):
    times = [x for e, x in states if e == entity and x <= t]
    return states[entity, max(times)] if times else set()


@pytest.mark.parametrize("per_slice", [12, 10**6])
def test_instants_read_few_files(spark, per_slice):
    c, states, _ = catalog(spark, 3, per_slice)
    every = c.levels.rows()
    assert Counter(tuple(r) for r in every.collect()) == Counter(tuple(r) for r in replay.validity(c.ops, c.quads, c.snapshots).collect())
    all_files = files_read(every)
    for days in (-5, 0, 3, 30, 77, 150, 1000):
        t = T0 + timedelta(days=days)
        at = c.during((t.isoformat(), t.isoformat()))
        got = replay.state_at(at, t.isoformat())
        assert Counter(tuple(r)[1:] for r in got.collect()) == Counter(q for e in {e for e, _ in states} for q in state_of(states, e, t))
        if per_slice == 12 and days in (-5, 0, 3, 30):
            assert files_read(got) <= all_files / 2
        rows = replay.history(c.during((t.isoformat(), (t + timedelta(days=9)).isoformat())), c.snapshots, (t.isoformat(), (t + timedelta(days=9)).isoformat()))
        assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, replay.history(every, c.snapshots, (t.isoformat(), (t + timedelta(days=9)).isoformat())).collect()))


def test_levels_of_nothing(spark):
    none = spark.createDataFrame([], "entity string, s string, p string, o string, g string, valid_from timestamp, valid_to timestamp")
    lv = write_levels(none, spark.createDataFrame([], SNAPS))
    assert lv.at("2021-01-01").collect() == [] and lv.rows().columns == none.columns


def test_queries_on_instants_equal_those_on_all(spark):
    c, states, _ = catalog(spark, 5)
    plain = Catalog(c.quads, c.snapshots, c.ops, c.validity)
    for days in (2, 25, 90):
        t = (T0 + timedelta(days=days)).isoformat()
        ask = lambda cat: Counter(map(tuple, VersionQuery(cat, "SELECT ?s ?o WHERE { ?s <urn:p/1> ?o }", (t, t)).bindings().collect()))
        assert ask(c) == ask(plain)


def test_term_index(spark):
    c, _, ops = catalog(spark, 7)
    index = write_index(c.ops, 16)
    found = lambda df: {r.entity for r in df.collect()}
    for terms in (['"x"@EN'], ["<urn:p/1>"], ["<urn:p/1>", '"3"'], ["<urn:e/3>", "<urn:p/0>"], ["<urn:none>"], ['"3"', "<urn:none>"]):
        assert found(index.all_of(terms)) == {o[0] for o in ops if all(t in o[6:9] for t in terms)}
        assert found(index.mentions(terms)) == {o[0] for o in ops if any(t in o[6:10] for t in terms)}
        assert found(graph.historical_reverse(index, terms)) == found(graph.historical_reverse(c.ops, terms))
    one = index.mentions(["<urn:e/3>"])
    one.collect()
    whole = index.rows
    whole.collect()
    assert files_read(one) < files_read(whole) / 3
    indexed = Catalog(c.quads, c.snapshots, c.ops, c.validity).with_index()
    for t in (("?s", "<urn:p/1>", '"x"@en'), ("?s", "?p", '"2"'), ("<urn:e/2>", "<urn:p/1>", "?o"), ("?s", "?p", "_:b")):
        assert found(plan.discover(indexed, t)) == found(plan.discover(c, t))
    assert found(write_index(spark.createDataFrame([], OPS)).all_of(["<x>"])) == set()


def clamp(steps):
    x = 0
    for op in steps:
        x = max(-1, min(1, x + (1 if op == "I" else -1)))
    return x


def test_net_composes(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for q in range(150):
        t, steps = T0, []
        for k in range(rng.randint(1, 14)):
            t += timedelta(days=rng.choice([0, 1, 20, 70]))
            steps.append(rng.choice("ID"))
            rows.append(("<e>", f"<e/prov/se/{k + 1}>", t, 0, k, steps[-1], f"<s{q}>", "<p>", "<o>", "<g>"))
        want[f"<s{q}>"] = clamp(steps)
    rng.shuffle(rows)
    got = {r.s: r.sign for r in replay.net(spark.createDataFrame(rows, OPS), "entity").collect()}
    assert got == {s: x for s, x in want.items() if x}


def test_net_of_one_quad_without_an_array(spark):
    """Two million operations on one quad, in some tasks and no array."""
    rows = spark.range(2_000_000).select(F.lit("<e>").alias("entity"), F.lit("<x>").alias("snapshot"), F.timestamp_seconds(F.col("id") * 60).alias("generated_at"), F.lit(0).alias("op_seq"), F.col("id").cast("int").alias("quad_seq"), F.when(F.xxhash64("id") % 2 == 0, "I").otherwise("D").alias("op"), *[F.lit(f"<{c}>").alias(c) for c in "spog"])
    got = replay.net(rows, "entity")
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    want = clamp([r.op for r in rows.orderBy("generated_at").select("op").collect()[-5000:]])  # the last two equal steps are among them
    assert [r.sign for r in got.collect()] == ([want] if want else [])


def test_versions_are_undone_in_place(spark):
    c, states, _ = catalog(spark, 13)
    for e in ("<urn:e/0>", "<urn:e/5>"):
        got = list(AgnosticEntity(c, e).iter_versions())
        times = sorted({t for x, t in states if x == e}, reverse=True)
        assert [t.replace(tzinfo=timezone.utc) for t, _ in got] == times
        assert [s for _, s in got] == [state_of(states, e, t) for t in times]
    assert list(AgnosticEntity(c, "<urn:e/none>").iter_versions()) == []


@pytest.mark.parametrize("most", [10**6, 5, 0])
def test_latest_up_to(spark, most):
    """As-of answers of small and of hot keys; several events of one time, times on an event and before all."""
    rng = random.Random(17)
    events = [(rng.choice("aab"), T0 + timedelta(days=rng.randint(5, 30)), i) for i in range(40)]
    asks = sorted({(rng.choice("aabc"), T0 + timedelta(days=rng.randint(0, 40))) for _ in range(40)})
    got = replay.latest_up_to(spark.createDataFrame(asks, "k string, time timestamp"), spark.createDataFrame(events, "k string, at timestamp, v int"), ["k"], most=most)
    want = Counter()
    for k, t in asks:
        before = [e[1] for e in events if e[0] == k and e[1] <= t]
        want.update((k, t, v) for x, at, v in events if before and x == k and at == max(before))
    assert Counter((r.k, r.time.replace(tzinfo=timezone.utc), r.v) for r in got.collect()) == want
