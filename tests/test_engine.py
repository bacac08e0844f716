import os
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from palimpsest.functions.terms import binding_to_n3, n3_to_binding, normal_constant
from palimpsest.functions.times import convert_to_datetime
from palimpsest.functions.updates import insert_text, to_ops
from palimpsest.operators import graph, replay
from palimpsest.plans import sparql
from palimpsest.plans.entity import AgnosticEntity
from palimpsest.plans.query import Catalog, DeltaQuery, VersionQuery
from palimpsest.sources import rdf

T0 = datetime(2021, 1, 1, tzinfo=timezone.utc)
SNAP = "entity string, snapshot string, generated_at timestamp, invalidated_at timestamp, attributed_to string, primary_source string, description string, update_query string, derived_from array<string>"
OPS = "entity string, snapshot string, generated_at timestamp, op_seq int, quad_seq int, op string, s string, p string, o string, g string"
QUADS = "entity string, s string, p string, o string, g string"


def day(n):
    return T0 + timedelta(days=n)


@pytest.mark.parametrize("term", ["<http://a>", "_:b", '"x"', '"x"@en', '"5"^^<http://www.w3.org/2001/XMLSchema#int>', '"a\\"b\\\\n\\nc"'])
def test_terms_round_trip(term):
    assert binding_to_n3(n3_to_binding(term)) == term


def test_times_and_constants():
    assert convert_to_datetime("2021-05-07T09:59:15.000Z", True) == "2021-05-07T09:59:15+00:00"
    assert convert_to_datetime("2021-05-07T11:59:15+02:00", True) == "2021-05-07T09:59:15+00:00"
    assert convert_to_datetime("") is None and convert_to_datetime("None") is None
    assert normal_constant('"x"@EN') == '"x"@en' and normal_constant('"x"^^<D>') == '"x"^^<D>'


def test_insert_text():
    assert insert_text("g", []) == ("", 0) and insert_text("g", [("<s>", "<p>", "<o>")]) == ("INSERT DATA { GRAPH <g> { <s> <p> <o> . } }", 1)


@pytest.mark.parametrize(
    ("query", "what"),
    [("{ {?s <p> 1} UNION {?s <q> 2} }", "UNION"), ("{ ?s <p> ?o FILTER(?o > 3) }", "FILTER"), ("{ ?s <p> 1 MINUS { ?s <q> 2 } }", "MINUS"), ("{ GRAPH <g> { ?s <p> 1 } }", "GRAPH"), ("{ ?s <p> ?o } ORDER BY ?s", "ORDER BY"), ("{ ?s <p> ?o } LIMIT 3", "LIMIT or OFFSET"), ("{ ?s <p> ?o BIND(1 AS ?x) }", "BIND or an aggregate function"), ("{ ?s <p> ?o VALUES ?s { <a> } }", "VALUES or a subquery"), ("{ ?s <p>/<q> ?o }", "a property path"), ("{ ?s <p>* ?o }", "a property path"), ("{ ?s <p> 1 OPTIONAL { ?s <q> ?o FILTER(?o > 3) } }", "a FILTER inside an OPTIONAL")],
)
def test_refusals(query, what):
    with pytest.raises(ValueError, match=f"The query uses {what}, which is not supported"):
        sparql.parse("SELECT ?s WHERE " + query)


def test_parser():
    q = sparql.parse('PREFIX e: <http://e/> SELECT ?a WHERE { ?a a e:X ; e:p "x"@EN, 5 . OPTIONAL { ?a ^e:q ?b OPTIONAL { ?b e:r ?c } } }')
    assert len(q.patterns) == 3 and q.patterns[2][2].startswith('"5"^^') and q.optionals == [[("?b", "<http://e/q>", "?a"), ("?b", "<http://e/r>", "?c")]]
    assert sparql.parse("SELECT * WHERE {}").patterns == []
    with pytest.raises(ValueError, match="Only SELECT"):
        sparql.parse("ASK { ?s <p> ?o }")
    with pytest.raises(ValueError, match="at least one URI or Literal"):
        sparql.parse("SELECT ?s WHERE { ?s ?p ?o }")


def _random_logs(seed):
    rng = random.Random(seed)
    ops, snaps, quads, states, deltas = [], [], [], {}, {}
    for e in range(60):
        ent = f"<e{e}>"
        current = {q for q in range(4) if rng.random() < 0.5}
        n = rng.randint(1, 6)
        texts = [[(rng.choice("DI"), rng.randrange(4)) for _ in range(rng.randint(0, 3))] if k else [] for k in range(n)]
        for k in range(n):
            snaps.append((ent, f"{ent}/se/{k}", day(k), None, None, None, None, None, []))
            ops += [(ent, f"{ent}/se/{k}", day(k), i, 0, op, ent, "<p>", f'"{q}"', "<g>") for i, (op, q) in enumerate(texts[k])]
        quads += [(ent, ent, "<p>", f'"{q}"', "<g>") for q in current]
        state = set(current)
        for k in reversed(range(n)):
            states[(ent, k)] = set(state)
            for op, q in texts[k]:
                state.add(q) if op == "D" else state.discard(q)
        count = {}
        for k in range(1, n):
            for op, q in texts[k]:
                count[q] = max(-1, min(1, count.get(q, 0) + (1 if op == "I" else -1)))
        deltas[ent] = {(q, v) for q, v in count.items() if v}
    return ops, snaps, quads, states, deltas


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_sequential_undo(spark, seed):
    ops, snaps, quads, states, deltas = _random_logs(seed)
    o, s, q = spark.createDataFrame(ops, OPS), spark.createDataFrame(snaps, SNAP), spark.createDataFrame(quads, QUADS)
    v = graph.cut(replay.validity(o, q, s))
    got = {k: set() for k in states}
    for r in replay.history(v, s).collect():
        got[(r.entity, (r.time.replace(tzinfo=timezone.utc) - T0).days)].add(int(r.o.strip('"')))
    assert got == states
    net = {}
    for r in replay.delta(v, o, s, day(0).isoformat(), day(9).isoformat()).collect():
        net.setdefault(r.entity, set()).add((int(r.o.strip('"')), r.sign))
    assert {k: x for k, x in deltas.items() if x} == net


@pytest.fixture(scope="module")
def values(spark):
    """One entity, value 0 to 3 on four days, and a second one that is deleted."""
    texts = [None] + [f'DELETE DATA {{ GRAPH <g> {{ <e> <v> "{i}" . }} }}; INSERT DATA {{ GRAPH <g> {{ <e> <v> "{i + 1}" . }} }}' for i in range(3)]
    snaps = [("<e>", f"<e/prov/se/{i + 1}>", day(i), None, "<a>", None, "d", t, []) for i, t in enumerate(texts)]
    snaps += [("<f>", "<f/prov/se/1>", day(0), None, "<a>", None, "d", None, []), ("<f>", "<f/prov/se/2>", day(2), day(2), "<a>", None, "d", 'DELETE DATA { GRAPH <g> { <f> <r> <e> } }', ["<f/prov/se/1>"])]
    s = spark.createDataFrame(snaps, SNAP)
    return Catalog.build(spark.createDataFrame([("<e>", "<e>", "<v>", '"3"', "<g>")], QUADS), s, to_ops(s))


def test_interval_and_fallback(values):
    e = AgnosticEntity(values, "e")
    states, selected, other = e.get_state_at_time((day(1).isoformat(), day(2).isoformat()), include_prov_metadata=True)
    assert sorted(r.o for r in states.collect()) == ['"1"', '"2"'] and selected.count() == 2 and other.count() == 2
    states, _, _ = e.get_state_at_time(("2021-01-02T12:00:00Z", "2021-01-02T13:00:00Z"))
    assert [r.o for r in states.collect()] == ['"1"']
    assert [len(q) for _, q in e.iter_versions()] == [1, 1, 1, 1]
    assert {(r.o, r.sign) for r in e.get_delta(day(0).isoformat(), day(2).isoformat()).collect()} == {('"0"', -1), ('"2"', 1)}


def test_queries_over_versions(values):
    r = VersionQuery(values, "SELECT ?x WHERE { <e> <v> ?x }").to_dict()
    assert [v[0]["x"]["value"] for _, v in sorted(r.items())] == ["0", "1", "2", "3"]
    r = VersionQuery(values, "SELECT ?x WHERE { ?f <r> ?e . ?e <v> ?x }").to_dict()
    assert [[b["x"]["value"] for b in v] for _, v in sorted(r.items())][:4] == [["0"], ["1"], [], []]
    r = VersionQuery(values, "SELECT ?x ?n WHERE { <e> <v> ?x OPTIONAL { <e> <name> ?n } }").to_dict()
    assert all("n" not in b for v in r.values() for b in v) and len(r) == 4
    assert VersionQuery(values, "SELECT ?e WHERE { ?e ^<r> <f> }").to_dict() != {}


def test_delta_records(values):
    rows = {r.entity: r for r in DeltaQuery(values, "SELECT ?f WHERE { ?f <r> <e> }").records().collect()}
    assert rows["<f>"].deleted is not None and len(rows["<f>"].changes) == 1 and rows["<f>"].deletions[0].o == "<e>"
    rows = {r.entity: r for r in DeltaQuery(values, "SELECT ?x WHERE { <e> <v> ?x }", (day(1).isoformat(), day(2).isoformat()), ["v"]).records().collect()}
    assert [len(c.additions) for c in rows["<e>"].changes] == [1, 1] and {q.o for q in rows["<e>"].additions} == {'"2"'}


def test_merges(spark):
    rows = [(f"<{x}>", f"<{x}/se/1>", day(0), None, "<a>", None, "d", None, []) for x in "abcd"]
    rows += [("<c>", "<c/se/2>", day(31), None, "<a>", None, "d", None, ["<a/se/1>", "<b/se/1>", "<c/se/1>"]), ("<d>", "<d/se/2>", day(59), None, "<a>", None, "d", None, ["<c/se/2>", "<d/se/1>"])]
    s = spark.createDataFrame(rows, SNAP)
    e = graph.merge_edges(s)
    assert {r.entity: r.component for r in graph.merge_components(e).collect()} == dict.fromkeys(["<a>", "<b>", "<c>", "<d>"], "<a>")
    assert sorted((r.entity, r.survivor, r.absorbed) for r in graph.merge_events(e).where("entity = '<c>'").collect()) == [("<c>", "<c>", ["<a>", "<b>"]), ("<c>", "<d>", ["<c>"])]


def test_lines_and_files(spark, tmp_path):
    assert rdf.parse_line("<s> <p> \"x\"^^xsd:int .") == ("<s>", "<p>", '"x"^^xsd:int') and rdf.parse_line("# c") is None and rdf.parse_line("<s> <p>") is None
    assert rdf.parse_line("<s>\t<p>\t<o>") == ("<s>", "<p>", "<o>")
    f = tmp_path / "a.nq"
    f.write_text('<s> <p> "a b" <g> .\n# x\n\n<s> <p> "5"^^xsd:int .\n')
    assert {(r.o, r.g) for r in rdf.read_lines(spark, str(f)).collect()} == {('"a b"', "<g>"), ('"5"^^xsd:int', None)}
    j = tmp_path / "a.json"
    j.write_text('{"@context": {"e": "http://e/"}, "@graph": [{"@id": "e:a", "@type": "e:T", "e:n": {"@value": "x", "@language": "en"}}]}')
    assert {(r.s, r.o) for r in rdf.read_jsonld(spark, str(j)).collect()} == {("<http://e/a>", "<http://e/T>"), ("<http://e/a>", '"x"@en')}


def test_conversion_round_trip(spark):
    from palimpsest.operators import convert

    copies = [(0, "<a>", "<a>", "<p>", '"1"'), (0, "<b>", "<b>", "<p>", '"x"'), (1, "<a>", "<a>", "<p>", '"2"'), (2, "<a>", "<a>", "<p>", '"1"'), (2, "<c>", "<c>", "<p>", '"y"')]
    c = spark.createDataFrame(copies, "version int, entity string, s string, p string, o string")
    q, s = convert.convert_copies(c, [day(0), day(1), day(2)], "g", "agent")
    s = graph.cut(s)
    assert {(r.entity, r.number): r.invalidated_at is not None for r in s.collect()} == {("<a>", 1): False, ("<a>", 2): False, ("<a>", 3): False, ("<b>", 1): False, ("<b>", 2): True, ("<c>", 1): False, ("<c>", 2): False}
    v = replay.validity(to_ops(s), q, s)
    for n in range(3):
        got = {(r.entity, r.o) for r in replay.state_at(v, day(n).isoformat()).collect()}
        assert got == {(e, o) for k, e, _, _, o in copies if k == n}


@pytest.mark.parametrize("name", ["merged_forward_all", "history_merged_all", "cv_timeline_all", "cv_optional_all", "cv_gap_fill_all"])
def test_whole_tables_equal_their_sql(spark, name):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    duckdb = pytest.importorskip("duckdb")
    from palimpsest import catalogue

    got = catalogue.queries()[name](spark, "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    at = [c[0] for c in want.description]
    assert sorted(at) == sorted(got.columns)
    want = Counter(want.fetchall())
    assert want and Counter(tuple(r[c] for c in at) for r in got.collect()) == want


def test_merge_aware_constant_has_all_aliases(spark, monkeypatch):
    from palimpsest.plans import query

    monkeypatch.setattr(query, "BROADCAST_ROWS", 2)
    rows = [(f"<{x}>", f"<{x}/se/1>", day(0), None, "<a>", None, "d", None, []) for x in "abcdefg"]
    rows += [("<a>", "<a/se/2>", day(31), None, "<a>", None, "d", None, [f"<{x}/se/1>" for x in "abcdef"])]
    quads = spark.createDataFrame([(f"<{x}>", f"<{x}>", "<p>", f'"{x}"', "<g>") for x in "abcdefg"], QUADS)
    c = Catalog.build(quads, spark.createDataFrame(rows, SNAP), spark.createDataFrame([], OPS))
    found = lambda q: {r.x for r in VersionQuery(c, q, merge_aware=True).bindings().collect()}
    assert found("SELECT ?x WHERE { <b> <p> ?x }") == {f'"{x}"' for x in "abcdef"}
    assert found("SELECT ?x WHERE { <g> <p> ?x }") == {'"g"'}


def test_snapshots_of_one_time(spark):
    """se/10 comes after se/9; what one inserts and the next deletes at the same time was never there, and what comes back at once has one interval."""
    rows = [("<e>", f"<e/prov/se/{n}>", day(d), None, "<a>", None, "d", t, []) for n, d, t in ((8, 0, None), (9, 1, "INSERT DATA { GRAPH <g> { <e> <p> <x> } }"), (10, 1, "DELETE DATA { GRAPH <g> { <e> <p> <x> . <e> <p> <y> } }"), (11, 1, "INSERT DATA { GRAPH <g> { <e> <p> <y> } }"))]
    s = spark.createDataFrame(rows, SNAP)
    v = replay.validity(to_ops(s), spark.createDataFrame([("<e>", "<e>", "<p>", "<y>", "<g>")], QUADS), s)
    assert [(r.o, r.valid_from.day, r.valid_to) for r in v.collect()] == [("<y>", 1, None)]
    net = {r.o: r.sign for r in replay.net(to_ops(s), "entity").collect()}
    assert net == {}
    ended = [("<f>", f"<f/prov/se/{n}>", day(1), day(n), "<a>", None, "d", None, []) for n in (9, 10)]
    (record,) = replay.delta_records(spark.createDataFrame([], OPS), spark.createDataFrame(ended, SNAP)).collect()
    assert record.deleted.replace(tzinfo=timezone.utc) == day(10)


def test_delta_records_without_operations(values, spark):
    """A snapshot in the interval is enough for a record; texts whose wanted properties are empty keep an entry; lists are never null."""
    rows = [("<e>", "<e/se/1>", day(0), None, "<a>", None, "d", None, []), ("<e>", "<e/se/2>", day(5), None, "<a>", None, "d", None, []), ("<e>", "<e/se/3>", day(9), None, "<a>", None, "d", "INSERT DATA { GRAPH <g> { } }", [])]
    s = spark.createDataFrame(rows, SNAP)
    got = lambda *on: [(r.created is not None, len(r.changes), r.additions, r.deletions) for r in replay.delta_records(to_ops(s), s, *on).collect()]
    assert got((day(4).isoformat(), day(6).isoformat())) == [(False, 0, [], [])] and got((day(6).isoformat(), day(7).isoformat())) == []
    assert got() == [(True, 1, [], [])]
    (r,) = replay.delta_records(values.ops.where("entity = '<e>'"), values.snapshots.where("entity = '<e>'"), None, ["other"]).collect()
    assert [(c.additions, c.deletions) for c in r.changes] == [([], [])] * 3 and r.additions == []


def test_joins_of_times_and_intervals_by_brute_force(spark):
    from palimpsest.operators.ranks import at_times

    rng = random.Random(11)
    times = sorted({(k, day(rng.randint(0, 60))) for k in "ab" for _ in range(25)})
    rows = [(i, rng.choice("abc"), *sorted((day(rng.randint(0, 60)), day(rng.randint(0, 60))))) for i in range(120)]
    t = spark.createDataFrame(times, "k string, time timestamp")
    r = graph.cut(spark.createDataFrame(rows, "i int, k string, from_ timestamp, to_ timestamp"))
    at = lambda x: x.replace(tzinfo=timezone.utc)
    assert {(x.i, at(x.time)) for x in at_times(r, t, ["k"]).collect()} == {(i, y) for i, k, a, b in rows for j, y in times if j == k and a <= y < b}
    assert {(x.i, at(x.time)) for x in at_times(r, t.select("time").distinct()).collect()} == {(i, y) for i, _, a, b in rows for _, y in times if a <= y < b}


@pytest.fixture(scope="module")
def family(spark):
    """a refers to b since day 1 and to c until day 2; c is merged into a on day 3; d refers to a, f to d; h once referred to a."""
    text = lambda d, i: "; ".join(f"{w} DATA {{ GRAPH <g> {{ {x} }} }}" for w, x in (("DELETE", d), ("INSERT", i)) if x) or None
    snaps = [("a", 1, 0, None, []), ("a", 2, 1, text("", "<a> <r> <b>"), []), ("a", 3, 2, text("<a> <r> <c>", ""), []), ("a", 4, 3, None, ["<c/prov/se/1>"]), ("b", 1, 0, None, []), ("b", 2, 2, text('<b> <n> "old"', '<b> <n> "new"'), []), ("c", 1, 0, None, []), ("d", 1, 0, None, []), ("f", 1, 0, None, []), ("h", 1, 0, None, []), ("h", 2, 1, text("<h> <r> <a>", ""), [])]
    s = spark.createDataFrame([(f"<{e}>", f"<{e}/prov/se/{n}>", day(d), None, "<agent>" if e != "f" else None, None, "d", t, frm) for e, n, d, t, frm in snaps], SNAP)
    quads = [("a", "r", "<b>"), ("a", "n", '"a"'), ("b", "n", '"new"'), ("c", "n", '"c"'), ("d", "r", "<a>"), ("f", "r", "<d>"), ("h", "n", '"h"')]
    return Catalog.build(spark.createDataFrame([(f"<{e}>", f"<{e}>", f"<{p}>", o, "<g>") for e, p, o in quads], QUADS), s, to_ops(s))


def test_entities_around_one(family):
    names = lambda *a, **k: {r.entity.strip("<>") for r in AgnosticEntity(family, "a", **k).entities(*a).collect()}
    assert names() == {"a"} and names(include_related_objects=True) == {"a", "b", "c"} and names(include_merged_entities=True) == {"a", "c"}
    since = ((day(2).isoformat(), day(9).isoformat()), True)
    assert names(*since, include_related_objects=True) == {"a", "b"}
    assert names(include_reverse_relations=True) == {"a", "d", "f"} and names(include_reverse_relations=True, reverse_relations_depth=1) == {"a", "d"} and names(include_reverse_relations=True, reverse_relations_depth=0) == {"a"}
    assert names(include_reverse_relations=True, include_historical_reverse_relations=True, reverse_relations_depth=1) == {"a", "d", "h"}


def test_states_with_entities_around(family):
    def by_day(frame):
        out = {}
        for r in frame.collect():
            assert r.entity == "<a>"
            out.setdefault((r.time.replace(tzinfo=timezone.utc) - T0).days, set()).add((r.s.strip("<>"), r.o.strip('<>"')))
        return out

    e = AgnosticEntity(family, "a", include_related_objects=True)
    states, found = e.get_history(include_prov_metadata=True)
    own = {0: {("a", "a"), ("a", "c")}, 1: {("a", "a"), ("a", "b"), ("a", "c")}, 2: {("a", "a"), ("a", "b")}, 3: {("a", "a"), ("a", "b")}}
    name = {0: "old", 1: "old", 2: "new", 3: "new"}
    assert by_day(states) == {n: own[n] | {("b", name[n]), ("c", "c")} for n in own} and found.count() == 7
    states, chosen, other = e.get_state_at_time((day(1).isoformat(), day(1).isoformat()), include_prov_metadata=True)
    assert by_day(states) == {1: own[1] | {("b", "old"), ("c", "c")}}
    assert {r.snapshot for r in chosen.collect()} == {"<a/prov/se/2>", "<b/prov/se/1>", "<c/prov/se/1>"} and other.count() == 4
    states, chosen, other = e.get_state_at_time((day(1).isoformat(), day(1).isoformat()))
    assert chosen is None and other is None
    each, _ = e.get_histories_by_entity()
    assert {r.entity for r in each.collect()} == {"<a>", "<b>", "<c>"}
    # a snapshot without attribution is no metadata
    _, found = AgnosticEntity(family, "f").get_history(include_prov_metadata=True)
    assert found.count() == 0


def test_queries_with_metadata(family):
    _, chosen, other = VersionQuery(family, "SELECT ?x WHERE { <a> <r> ?x }", (day(2).isoformat(), day(2).isoformat()), include_prov_metadata=True).run_agnostic_query()
    assert [r.snapshot for r in chosen.where("entity = '<a>'").collect()] == ["<a/prov/se/3>"] and other.where("entity = '<a>'").count() == 3
    rows, chosen, other = VersionQuery(family, "SELECT ?x WHERE { <a> <r> ?x }", include_prov_metadata=True).run_agnostic_query(include_all_timestamps=True)
    assert chosen.where("entity = '<a>'").count() == 4 and other.count() == 0 and rows.count() == 5
    assert VersionQuery(family, "SELECT ?x WHERE { <a> <r> ?x }").run_agnostic_query()[1:] == (None, None)
    records, chosen, _ = DeltaQuery(family, "SELECT ?x WHERE { ?x <r> <b> }", merge_aware=True, include_prov_metadata=True).run_agnostic_query()
    got = {r.entity: r for r in records.collect()}
    assert set(got) == {"<a>", "<c>"} and [m.absorbed for m in got["<c>"].merges] == [["<c>"]] and chosen.count() == 5


def test_joins_within_entities(family):
    names = lambda **k: {r.x for r in VersionQuery(family, "SELECT ?x WHERE { ?a <r> ?b . ?b <n> ?x }", **k).bindings().collect()}
    assert names() == {'"old"', '"new"', '"c"', '"a"'} and names(entity_local=True) == set()
    assert {r.b for r in VersionQuery(family, 'SELECT ?b WHERE { ?a <r> ?b . ?a <n> "a" }', entity_local=True).bindings().collect()} == {"<b>", "<c>"}


def test_discovery_by_language_tag(spark):
    from palimpsest.plans.query import discover

    s = spark.createDataFrame([("<e>", "<e/se/1>", day(0), None, "<a>", None, "d", None, []), ("<e>", "<e/se/2>", day(1), None, "<a>", None, "d", 'DELETE DATA { GRAPH <g> { <e> <n> "x"@EN . <e> <n> "y" } }', [])], SNAP)
    c = Catalog.build(spark.createDataFrame([], QUADS), s, to_ops(s))
    hits = lambda o: discover(c, ("?e", "<n>", o)).count()
    assert (hits('"x"@en'), hits('"x"@En'), hits('"X"@en'), hits('"y"'), hits('"x"')) == (1, 1, 0, 1, 0)


def test_version_texts_and_sets(spark):
    states = spark.createDataFrame([("t", "<s>", "<p>", '"5"^^<d>'), ("t", "<s>", "<p>", '"a b"@en'), ("u", "<s>", "<p>", "<o>"), ("u", "<s>", "<p>", None)], "time string, s string, p string, o string")
    lines = rdf.version_lines(rdf.quad_set(states), "time")
    assert {r.time: r.lines for r in lines.collect()} == {"t": ['<s> <p> "5"', '<s> <p> "a b"@en'], "u": ["<s> <p> <o>"]}
    assert {tuple(r) for r in rdf.version_rows(lines, "time").collect()} == {("t", "<s>", "<p>", '"5"'), ("t", "<s>", "<p>", '"a b"@en'), ("u", "<s>", "<p>", "<o>")}
    assert rdf.ask(states) and not rdf.ask(states.where("s = '<z>'")) and rdf.quad_set(states.union(states)).count() == 3


def test_files_from_dumps_to_answers(spark, tmp_path):
    """Dumps of three versions, one of them gzipped, become lines of quads and of provenance; read back through a configuration they answer queries as the dumps do."""
    import gzip
    import json
    import zipfile

    from palimpsest.operators import convert
    from palimpsest.sources import config

    dumps = [['<a> <p> "1" .', "<a> <q> <b> .", '<b> <p> "x\\"y" .'], ['<a> <p> "2" .', '<b> <p> "x\\"y" .'], ['<a> <p> "1" .', '<c> <p> "z"@en .']]
    paths = [str(tmp_path / f"{i}.nt{'.gz' if i == 1 else ''}") for i in range(3)]
    for i, (path, lines) in enumerate(zip(paths, dumps)):
        with gzip.open(path, "wt") if i == 1 else open(path, "w") as f:
            f.write("\n".join(lines))
    copies = graph.cut(rdf.read_versions(spark, paths))
    times = [day(n) for n in range(3)]
    quads, snaps = convert.convert_copies(copies, times, "g", "agent")
    rdf.write_lines(convert.dataset_lines(quads), str(tmp_path / "data"), True)
    rdf.write_lines(convert.provenance_lines(snaps), str(tmp_path / "prov"))
    made = config.Config(config.Storer(file_paths=[str(tmp_path / "data")]), config.Storer(file_paths=[str(tmp_path / "prov")]))
    made.save(str(tmp_path / "c.json"))
    with open(tmp_path / "c.json") as f:
        more = json.load(f) | {"cache_triplestore_url": {"endpoint": ""}}
    (tmp_path / "c.json").write_text(json.dumps(more))
    c = config.catalog(spark, config.Config.load(str(tmp_path / "c.json")))
    for n in range(3):
        assert {(r.s, r.p, r.o) for r in replay.state_at(c.validity, times[n].isoformat()).collect()} == {rdf.parse_line(x) for x in dumps[n]}
    found = VersionQuery(c, "SELECT ?o WHERE { <a> <p> ?o }").to_dict()
    assert [[b["o"]["value"] for b in v] for _, v in sorted(found.items())] == [["1"], ["2"], ["1"]]
    # change sets give the same dataset as copies
    changes = convert.copies_to_changes(copies, 3)
    again, _ = convert.convert_changes(copies.where("version = 0").drop("version"), changes, times, "g", "agent")
    assert {tuple(r) for r in again.select("s", "p", "o").collect()} == {tuple(r) for r in quads.select("s", "p", "o").collect()}
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("x.json", '[{"@id": "http://e/a", "http://e/p": [{"@value": 5}, {"@id": "_:n"}]}]')
    assert {(r.s, r.o) for r in config.read_paths(spark, [str(tmp_path / "j.zip")]).collect()} == {("<http://e/a>", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("<http://e/a>", "_:n")}
    with pytest.raises(ValueError):
        config.Config(config.Storer(), config.Storer(), blazegraph_full_text_search="yes", fuseki_full_text_search="yes")
    with pytest.raises(ValueError):
        config.catalog(spark, config.Config(config.Storer(["http://x"]), config.Storer()))


def test_streaming_load(spark, tmp_path):
    """Operations of a stream of snapshots equal those of a load at once, also when a second run finds more files."""
    from palimpsest.streaming.ingest import ingest

    rows = [("<e>", f"<e/se/{i}>", day(i), None, "<a>", None, "d", f'INSERT DATA {{ GRAPH <g> {{ <e> <p> "{i}" }} }}', []) for i in range(6)]
    at = lambda x: str(tmp_path / x)
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, SNAP).write.mode("append").parquet(at("in"))
        q = ingest(spark.readStream.schema(SNAP).parquet(at("in")), at("ops"), at("marks"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(at("ops")).drop("batch")
    want = to_ops(spark.createDataFrame(rows, SNAP))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_no_plan_has_a_range_join(values):
    """Timelines meet intervals by equal ranks: neither nested loops nor products, also in optionals."""
    q = VersionQuery(values, "SELECT ?x ?n WHERE { <e> <v> ?x OPTIONAL { <e> <name> ?n } }")
    for df in (replay.history(values.validity, values.snapshots), q.bindings(), replay.delta_records(values.ops, values.snapshots)):
        plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_planner_predicates():
    from palimpsest.plans.query import linked

    a, b, c, d = ("<e>", "<p>", "?a"), ("?b", "<p>", "?c"), ("?a", "<p>", "?c"), ("<e>", "<p>", "?d")
    assert linked([a, b, d]) == [[a], [b], [d]] and linked([a, b, d, c]) == [[d], [a, b, c]] and linked([]) == []
    chain = [("<e>", "<p>", "?a"), ("?a", "<q>", "?b"), ("?x", "<r>", "?y"), ("?y", "<q>", '"1"')]
    assert [sparql.is_isolated(chain, i) for i in range(4)] == [False, False, True, True]
    assert sparql.is_dead_end(chain, "?b") and not sparql.is_dead_end(chain, "?a")
    assert sparql.new_patterns([("?a", "<p>", '"1"'), ("?b", "<p>", "?c"), ("?d", "<q>", '"1"')]) == [0, 2]


def test_products_warn_and_terms_have_parts(values):
    with pytest.warns(UserWarning, match="shares no variable"):
        VersionQuery(values, "SELECT ?x ?y WHERE { <e> <v> ?x . ?y <r> <e> }").intervals()
    rows = VersionQuery(values, "SELECT ?x ?n WHERE { <e> <v> ?x OPTIONAL { <e> <name> ?n } }").typed_bindings().collect()
    assert {(r.x.type, r.x.value, r.x.datatype, r.x.lang) for r in rows} == {("literal", str(i), None, None) for i in range(4)} and all(r.n is None for r in rows)
