"""Update texts, terms and JSON-LD, compared with plain Python on random texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import terms
from palimpsest.functions.updates import to_ops, with_ops
from palimpsest.operators import convert
from palimpsest.sources import rdf

LITERAL = r'"(?:[^"\\]|\\.)*"(?:\^\^<[^>]+>|@[a-zA-Z][\w-]*)?|\'(?:[^\'\\]|\\.)*\'(?:\^\^<[^>]+>|@[a-zA-Z][\w-]*)?'
TOKEN = re.compile(rf"""\\["'\\]|{LITERAL}|\b(?:DELETE|INSERT)\s+DATA\b|\bGRAPH\s*<[^>]+>\s*\{{|<[^>]+>|_:[^\s{{}}]+|[{{}}]""", re.S | re.I)


def n3(token):
    if token[0] not in "\"'":
        return token
    m = re.fullmatch(r"""(?s)["'](.*)["'](\^\^<[^>]+>|@[a-zA-Z][\w-]*)?""", token)
    code = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", lambda x: chr(int(x[1] or x[2], 16)) if x[1] or x[2] else code.get(x[3], x[3]), m[1], flags=re.S)
    return f'"{terms.escape(text.encode("utf-16", "surrogatepass").decode("utf-16"))}"{m[2] or ""}'


def model(text):
    """(op_seq, quad_seq, op, s, p, o, g): terms in threes in each graph block; a block that isn't closed ends with its operation."""
    out, op, seq, g, depth, found = [], None, -1, None, 0, []

    def close():
        nonlocal g, found
        if g and op:
            out.extend((seq, i, op, *found[3 * i : 3 * i + 3], g) for i in range(len(found) // 3))
        g, found = None, []

    for m in TOKEN.finditer(text or ""):
        x = m[0]
        if x[0] == "\\":
            continue
        if x[0] in "dDiI":
            close()
            op, seq, depth = x[0].upper(), seq + 1, 0
        elif x[0] in "gG":
            close()
            g, depth = "<" + re.search("<([^>]+)>", x)[1] + ">", 1
        elif x == "{":
            depth += 1
        elif x == "}":
            if depth <= 1:
                close()
            depth = max(0, depth - 1)
        elif g:
            found.append(n3(x))
    close()
    return out


PIECES = ["<s>", "<p>", "<o>", "_:b1", '"x"', '"a\\"b"', '"a\\\\"', "'q'", "'it\\'s'", '"dt"^^<http://d>', '"l"@en-GB', '"br}ace{"', '"INSERT DATA { GRAPH <x> {"', '"n\\nl"', '"t\\tb"', '"\\u00e9\\U0001F600"', '"\\uD83D\\uDE00"', '"raw\nnl"', '"\ue0001\ue000"', '"\\x"', '"e\\\\\\"q"', "<a'b>", " . ", " ; ", " , ", ".", "\n"]
ODD = ["{", "}", "INSERT DATA {", "DELETE  DATA { ", "GRAPH <g> {", "graph<g2>{", " } }", '"', "'"]


def test_updates_equal_the_model(spark):
    rng = random.Random(4)
    texts = [None, "", "nonsense", "INSERT DATA { <s> <p> <o> }", "INSERT DATA { GRAPH <g> { <s> <p> <o> <s> <p> <q> } }", "INSERT DATA { GRAPH <g> { <s> <p> <o> . <s> <p> } }", 'INSERT DATA { GRAPH <g> { <s> <p> "open } }']
    texts += ["".join(rng.choice(PIECES + ODD) + rng.choice(["", " "]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["INSERT DATA { GRAPH <g> { " + " ".join(rng.choice(PIECES) for _ in range(30)) + " } } ; delete data { GRAPH <h> {" + " ".join(rng.choice(PIECES) for _ in range(20)) + rng.choice(["}}", "}", ""]) for _ in range(300)]
    rows = with_ops(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "ops")
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString().split("LocalTableScan")[0].split("Scan ExistingRDD")[0]
    got = {r.i: [tuple(o) for o in r.ops] for r in rows.collect()}
    for i, t in enumerate(texts):
        assert got[i] == model(t), t
    assert len(got[4]) == 2 and len(got[5]) == 1 and got[6] == []


def test_long_updates(spark):
    """A text of many quads and one of a long literal with many escapes: nothing grows with the square, and no pattern recurses."""
    many = "INSERT DATA { GRAPH <g> { " + " ".join(f'<s> <p> "{k}\\"" .' for k in range(30000)) + " } }"
    long = 'DELETE DATA { GRAPH <g> { <s> <p> "' + 'a\\"b' * 60000 + '" } }'
    rows = spark.createDataFrame([(1, many), (2, long)], "i int, t string")
    assert sorted(map(tuple, with_ops(rows, "t", "x").selectExpr("i", "size(x)", "length(x[size(x) - 1].o)").collect())) == [(1, 30000, 9), (2, 1, 240002)]


def test_names_stay_apart(spark):
    rows = with_ops(spark.createDataFrame([("INSERT DATA { GRAPH <g> { <s> <p> <o> } }", "kept", 5)], "t string, tokens_ string, Blocks_ int"), "t", "x").collect()
    assert rows[0].tokens_ == "kept" and rows[0].Blocks_ == 5 and len(rows[0].x) == 1


def test_values_of_terms(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["\\", '"', "n", "\n", "\r", "t", "\t", "'", "é", "\ue000", "1", "\0", "a"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms.literal(F.col("t")).alias("n3")).select("t", "n3", terms.value(F.col("n3")).alias("v"), terms.unmarked(terms.marked(F.col("t"))).alias("m"))
    for r in rows.collect():
        assert (r.v, r.m, r.n3) == (r.t, r.t, f'"{terms.escape(r.t)}"')


def test_provenance_lines_come_back(spark, tmp_path):
    """Update texts with backslashes, quotes and line ends survive being written and read, and give the same operations."""
    text = 'INSERT DATA { GRAPH <http://g> { <http://e> <http://p> "a\\\\nb \\"q\\" \\n \\\\" . <http://e> <http://p> "' + "x\\\\" * 9000 + '" } }'
    snaps = spark.createDataFrame([("<http://e>", "<http://e/prov/se/1>", None, None, None), ("<http://e>", "<http://e/prov/se/2>", text, 'said "so"\\n', "<http://e/prov/se/1>")], "entity string, snapshot string, update_query string, description string, from_ string")
    snaps = snaps.select("entity", "snapshot", F.lit("2021-01-01 00:00:00").cast("timestamp").alias("generated_at"), F.lit(None).cast("timestamp").alias("invalidated_at"), F.lit("<http://a>").alias("attributed_to"), F.lit(None).cast("string").alias("primary_source"), "description", "update_query", F.when(F.col("from_").isNotNull(), F.array("from_")).otherwise(F.array().cast("array<string>")).alias("derived_from"))
    rdf.write_lines(convert.provenance_lines(snaps), str(tmp_path / "p.nq"))
    _, back = rdf.split_provenance(rdf.read_lines(spark, str(tmp_path / "p.nq")))
    got = {r.snapshot: r for r in back.collect()}["<http://e/prov/se/2>"]
    assert got.update_query == text and got.description == 'said "so"\\n'
    assert {r.o for r in to_ops(back).collect()} == {r.o for r in to_ops(snaps).collect()} and len(to_ops(back).collect()) == 2


def test_jsonld():
    q = lambda d: {x[:3] for x in rdf.expand_jsonld(d)}
    assert q({"@id": "http://s", "http://p": {"http://q": {"http://r": "x"}}}) == {("<http://s>", "<http://p>", "_:b0"), ("_:b0", "<http://q>", "_:b1"), ("_:b1", "<http://r>", '"x"')}
    assert q({"@id": "http://s", "http://p": {"@set": ["x", {"@value": "y", "@language": "en"}]}}) == {("<http://s>", "<http://p>", '"x"'), ("<http://s>", "<http://p>", '"y"@en')}
    r = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    assert q({"@id": "http://s", "http://p": {"@list": ["x", 2]}}) == {("<http://s>", "<http://p>", "_:b0"), ("_:b0", r + "first>", '"x"'), ("_:b0", r + "rest>", "_:b1"), ("_:b1", r + "first>", '"2"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("_:b1", r + "rest>", r + "nil>")}
    assert q({"@id": "http://s", "http://p": {"@list": []}}) == {("<http://s>", "<http://p>", r + "nil>")}
    ctx = {"id": "@id", "e": "http://e/", "knows": {"@id": "e:knows", "@type": "@id"}, "lab": {"@id": "e:lab", "@container": "@language"}, "kids": {"@reverse": "e:parent"}, "seq": {"@id": "e:seq", "@container": "@list"}, "off": None, "@language": "fr"}
    doc = {"@context": ctx, "@graph": [{"id": "e:a", "knows": ["e:b", {"e:name": "n"}], "lab": {"en": "hi", "de": ["a", "b"]}, "kids": {"id": "e:k"}, "seq": "one", "off": 1, "unmapped": 2, "e:none": None}]}
    assert q(doc) == {("<http://e/a>", "<http://e/knows>", "<http://e/b>"), ("<http://e/a>", "<http://e/knows>", "_:b0"), ("_:b0", "<http://e/name>", '"n"@fr'), ("<http://e/a>", "<http://e/lab>", '"hi"@en'), ("<http://e/a>", "<http://e/lab>", '"a"@de'), ("<http://e/a>", "<http://e/lab>", '"b"@de'), ("<http://e/k>", "<http://e/parent>", "<http://e/a>"), ("<http://e/a>", "<http://e/seq>", "_:b1"), ("_:b1", r + "first>", '"one"@fr'), ("_:b1", r + "rest>", r + "nil>")}
    g = rdf.expand_jsonld({"@id": "http://g", "@graph": [{"@id": "http://s", "@type": "http://T"}]})
    assert g == [("<http://s>", terms.RDF_TYPE, "<http://T>", "<http://g>")]
    for bad in ({"@context": "http://remote"}, {"@included": []}, {"http://p": {"@value": 1, "@type": "@json"}}):
        with pytest.raises(ValueError, match="not read|are not read"):
            rdf.expand_jsonld(bad)


def test_anonymous_nodes_of_two_files_differ(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps({"http://p": n}))
    rows = rdf.read_jsonld(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()
    assert len({r.s for r in rows}) == 2 and {r.o for r in rows} == {'"a"', '"b"'}


def test_catalogs_follow_their_files(spark, tmp_path):
    """Overwriting the events of a folder is seen by the next question."""
    from palimpsest import catalogue

    rows = lambda n: spark.createDataFrame([(i, 1, i, "view" if i % 2 else "error", 1.0) for i in range(n)], "event_id long, user_id long, t int, event_type string, value double").selectExpr("event_id", "user_id", "timestamp_seconds(t) as ts", "event_type", "value")
    path = str(tmp_path / "events.parquet")
    rows(4).write.parquet(path)
    assert catalogue.validity(spark, str(tmp_path)).where("p = '<urn:p:status>'").count() == 4
    rows(7).write.mode("overwrite").parquet(path)
    assert catalogue.validity(spark, str(tmp_path)).where("p = '<urn:p:status>'").count() == 7
