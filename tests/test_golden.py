"""Known answers on a small bibliographic dataset with its provenance, read from N-Quads: an author's role is given to another agent, and agent and identifier that are merged go."""

from datetime import timezone

import pytest

from palimpsest.functions.times import convert_to_datetime
from palimpsest.plans.entity import AgnosticEntity
from palimpsest.plans.query import DeltaQuery, VersionQuery
from palimpsest.sources import config, rdf

#: Times of snapshots, and the facts.
A, B, C = "2021-05-07T09:59:15+00:00", "2021-05-31T18:19:47+00:00", "2021-06-01T18:46:41+00:00"
KB, PRO, DC, FOAF, LIT = "http://kb.test/", "http://purl.org/spar/pro/", "http://purl.org/spar/datacite/", "http://xmlns.com/foaf/0.1/", "http://www.essepuntato.it/2010/06/literalreification/"
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
STRING = "^^<http://www.w3.org/2001/XMLSchema#string>"
ORCID = '"http://orcid.org/0000-0002-3259-2309"'


def kb(x):
    return f"<{KB}{x}>"


ROLE, OLD, NEW = kb("ar/15519"), kb("ra/15519"), kb("ra/4")


def agent(name, identifier, tail=""):
    return [(name, f"<{DC}hasIdentifier>", identifier), (name, TYPE, f"<{FOAF}Agent>"), (name, f"<{FOAF}familyName>", '"Marini"' + tail), (name, f"<{FOAF}givenName>", '"Giulio"' + tail), (name, f"<{FOAF}name>", '"Giulio Marini"' + tail)]


def identifier(name, tail=""):
    return [(name, f"<{DC}usesIdentifierScheme>", f"<{DC}orcid>"), (name, f"<{LIT}hasLiteralValue>", ORCID + tail), (name, TYPE, f"<{DC}Identifier>")]


HELD = f"<{PRO}isHeldBy>"
ROLE_FACTS = [(ROLE, f"<{PRO}withRole>", f"<{PRO}author>"), (ROLE, "<https://w3id.org/oc/ontology/hasNext>", kb("ar/15520"))]
IN_TIME = (ROLE, TYPE, f"<{PRO}RoleInTime>")


def text(word, facts, graph):
    return f"{word} DATA {{ GRAPH {graph} {{ " + " ".join(f"{s} {p} {o} ." for s, p, o in facts) + " } }"


def lines():
    g = {x: kb(f"{x}/") for x in ("ar", "ra", "id")}
    data = [(*ROLE_FACTS[0], g["ar"]), (*ROLE_FACTS[1], g["ar"]), (*IN_TIME, g["ar"]), (ROLE, HELD, NEW, g["ar"]), *[(*f, g["ra"]) for f in agent(NEW, kb("id/14"))], *[(*f, g["id"]) for f in identifier(kb("id/14"))]]
    history = [
        (ROLE, 1, A, None, None, []), (ROLE, 2, B, None, text("INSERT", [IN_TIME], g["ar"]), []),
        (ROLE, 3, C, None, text("DELETE", [(ROLE, HELD, OLD)], g["ar"]) + "; " + text("INSERT", [(ROLE, HELD, NEW)], g["ar"]), []),
        (OLD, 1, A, None, None, []), (OLD, 2, C, C, text("DELETE", agent(OLD, kb("id/85509"), STRING), g["ra"]), []),
        (NEW, 1, A, None, None, []), (NEW, 2, C, None, None, [OLD]),
        (kb("id/14"), 1, A, None, None, []), (kb("id/14"), 2, C, None, None, [kb("id/85509")]),
        (kb("id/85509"), 1, A, None, None, []), (kb("id/85509"), 2, C, C, text("DELETE", identifier(kb("id/85509"), STRING), g["id"]), []),
    ]
    prov, out = "http://www.w3.org/ns/prov#", [" ".join(q) + " ." for q in data]
    for e, n, t, gone, update, merged in history:
        se = lambda x, k: f"<{x[1:-1]}/prov/se/{k}>"
        put = lambda p, o: out.append(f"{se(e, n)} <{p}> {o} <{e[1:-1]}/prov/> .")  # noqa: B023, E731
        time = lambda x: f'"{x}"^^<http://www.w3.org/2001/XMLSchema#dateTime>'
        put(prov + "specializationOf", e)
        put(prov + "generatedAtTime", time(t))
        put(prov + "wasAttributedTo", "<https://orcid.org/0000-0002-8420-0696>")
        put("http://purl.org/dc/terms/description", f'"snapshot {n}"')
        for x in [*([e] if n > 1 else []), *merged]:
            put(prov + "wasDerivedFrom", se(x, 1 if x != e else n - 1))
        if gone:
            put(prov + "invalidatedAtTime", time(gone))
        if update:
            put("https://w3id.org/oc/ontology/hasUpdateQuery", '"' + update.replace("\\", "\\\\").replace('"', '\\"') + '"')
    return out


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kb") / "data.nq"
    path.write_text("\n".join(lines()) + "\n")
    return config.catalog(spark, config.Config(config.Storer([], [str(path)]), config.Storer([], [str(path)])))


def ask(catalog, where, on_time=None, **how):
    prefixes = f"PREFIX pro: <{PRO}> PREFIX datacite: <{DC}> PREFIX literal: <{LIT}> PREFIX foaf: <{FOAF}> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> "
    got = VersionQuery(catalog, prefixes + where, on_time, **how).to_dict()
    return {t: sorted(tuple(sorted((k, v["value"].removeprefix(KB)) for k, v in b.items())) for b in rows) for t, rows in got.items()}


def test_role_and_type(catalog):
    q = f"SELECT DISTINCT ?o WHERE {{ {ROLE} pro:isHeldBy ?o; rdf:type pro:RoleInTime. }}"
    assert ask(catalog, q) == {A: [], B: [(("o", "ra/15519"),)], C: [(("o", "ra/4"),)]}
    assert ask(catalog, q, (B, B)) == {B: [(("o", "ra/15519"),)]}
    assert ask(catalog, q, ("2021-05-06T00:00:00+00:00", "2021-05-06T00:00:00+00:00")) == {}
    selected, other = VersionQuery(catalog, f"SELECT ?o WHERE {{ {ROLE} <{PRO}isHeldBy> ?o; {TYPE} <{PRO}RoleInTime>. }}", (B, B)).provenance()
    times = lambda df: {convert_to_datetime(r.generated_at.replace(tzinfo=timezone.utc), True) for r in df.where(df.entity == ROLE).collect()}
    assert (times(selected), times(other)) == ({B}, {A, C})


def test_optional_type(catalog):
    q = f"SELECT DISTINCT ?o WHERE {{ {ROLE} pro:isHeldBy ?o; OPTIONAL {{ {ROLE} rdf:type pro:RoleInTime. }} }}"
    assert ask(catalog, q) == {A: [(("o", "ra/15519"),)], B: [(("o", "ra/15519"),)], C: [(("o", "ra/4"),)]}


def test_chain_over_three_entities(catalog):
    """The identifier of whoever holds the role, in each version, also where agent and identifier are gone by now."""
    q = f"SELECT DISTINCT ?o ?id ?value WHERE {{ {ROLE} pro:isHeldBy ?o; rdf:type ?t. ?o datacite:hasIdentifier ?id. ?id literal:hasLiteralValue ?value. }}"
    row = lambda o, i: [(("id", i), ("o", o), ("value", ORCID[1:-1]))]
    assert ask(catalog, q) == {A: [], B: row("ra/15519", "id/85509"), C: row("ra/4", "id/14")}
    q = q.replace("; rdf:type ?t", f". OPTIONAL {{ {ROLE} rdf:type pro:RoleInTime. }}").replace(f"{ROLE} pro:isHeldBy ?o. OPTIONAL", f"{ROLE} pro:isHeldBy ?o OPTIONAL")
    assert ask(catalog, q) == {A: row("ra/15519", "id/85509"), B: row("ra/15519", "id/85509"), C: row("ra/4", "id/14")}


def test_variables_on_both_sides(catalog):
    row = lambda o: [(("o", o), ("s", "ar/15519"))]
    assert ask(catalog, "SELECT DISTINCT ?s ?o WHERE { ?s pro:isHeldBy ?o. }") == {A: row("ra/15519"), B: row("ra/15519"), C: row("ra/4")}


def test_optional_with_its_own_variable(catalog):
    q = f"SELECT DISTINCT ?a ?id WHERE {{ {NEW} datacite:hasIdentifier ?id. ?id literal:hasLiteralValue ?v. OPTIONAL {{?a pro:isHeldBy {OLD}.}} }}"
    got = ask(catalog, q)
    assert got[A] == [(("a", "ar/15519"), ("id", "id/14"))] and got[C] == [(("id", "id/14"),)]


def delta(catalog, cls, on_time=None, properties=None):
    rows = DeltaQuery(catalog, f"SELECT DISTINCT ?x WHERE {{ ?x a <{cls}>. }}", on_time, properties).records().collect()
    iso = lambda t: t and convert_to_datetime(t.replace(tzinfo=timezone.utc), True)
    facts = lambda xs: {tuple(x)[:3] for x in xs}
    return {r.entity: (iso(r.created), iso(r.deleted), [(iso(c.time), facts(c.additions), facts(c.deletions)) for c in r.changes], facts(r.additions), facts(r.deletions)) for r in rows}


CHANGE = (C, {(ROLE, HELD, NEW)}, {(ROLE, HELD, OLD)})


@pytest.mark.parametrize(
    ("on_time", "want"),
    [
        (None, {ROLE: (A, None, [(B, set(), set()), CHANGE], CHANGE[1], CHANGE[2])}),
        ((None, "2021-06-02T18:46:41+00:00"), {ROLE: (A, None, [(B, set(), set()), CHANGE], CHANGE[1], CHANGE[2])}),
        (("2021-06-01T00:00:00+00:00", "2021-06-02T18:46:41+00:00"), {ROLE: (None, None, [CHANGE], CHANGE[1], CHANGE[2])}),
        (("2021-06-02T00:00:00+00:00", None), {}),
        ((C, C), {ROLE: (None, None, [CHANGE], CHANGE[1], CHANGE[2])}),
    ],
)
def test_delta_of_a_property(catalog, on_time, want):
    assert delta(catalog, PRO + "RoleInTime", on_time, [PRO + "isHeldBy"]) == want


def test_delta_of_a_deleted_entity(catalog):
    gone = set(agent(OLD, kb("id/85509"), STRING))
    assert delta(catalog, FOAF + "Agent") == {OLD: (A, C, [(C, set(), gone)], set(), gone), NEW: (A, None, [], set(), set())}


def lines_of(catalog, entity, time=None):
    e = AgnosticEntity(catalog, entity)
    states = e.get_history()[0] if time is None else e.get_state_at_time(time)[0]
    out = {}
    for r in rdf.version_lines(states, "time").collect():
        out[convert_to_datetime(r.time.replace(tzinfo=timezone.utc), True)] = r.lines
    return out


def sorted_lines(*facts):
    return sorted(" ".join(f) for f in facts)


def test_history_of_an_entity(catalog):
    early = sorted_lines(*ROLE_FACTS, (ROLE, HELD, OLD))
    want = {A: early, B: sorted_lines(*ROLE_FACTS, (ROLE, HELD, OLD), IN_TIME), C: sorted_lines(*ROLE_FACTS, (ROLE, HELD, NEW), IN_TIME)}
    assert lines_of(catalog, ROLE) == want
    assert lines_of(catalog, ROLE, (B, B)) == {B: want[B]}
    assert lines_of(catalog, ROLE, ("2021-05-20T00:00:00+00:00", "2021-05-21T00:00:00+00:00")) == {A: early}  # the latest before
    assert lines_of(catalog, OLD) == {A: sorted_lines(*agent(OLD, kb("id/85509")))}  # no line of what is gone
    assert [(convert_to_datetime(t.replace(tzinfo=timezone.utc), True), len(q)) for t, q in AgnosticEntity(catalog, OLD).iter_versions()] == [(C, 0), (A, 5)]


def test_entities_around(catalog):
    found = lambda **how: {r.entity for r in AgnosticEntity(catalog, ROLE, **how).entities().collect()}
    assert found(include_related_objects=True) >= {ROLE, OLD, NEW, kb("id/14"), kb("id/85509")}
    merged = {r.entity for r in AgnosticEntity(catalog, NEW, include_merged_entities=True).entities().collect()}
    assert merged == {NEW, OLD}
