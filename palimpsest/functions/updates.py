"""Update texts (INSERT DATA / DELETE DATA) to operations, as column expressions: no Python runs in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import MARK, escaped, marked, unmarked

#: Tokens of a marked text (see terms.marked). Literals and IRIs come first, so nothing inside them is a keyword or a brace.
_TAIL = r"(?:\^\^<[^>]+>|@[a-zA-Z][\w-]*)?"
_TOKEN = rf'"[^"]*+"{_TAIL}|\'[^\']*+\'{_TAIL}|\b(?i:DELETE|INSERT)\s+(?i:DATA)\b|\b(?i:GRAPH)\s*<[^>]+>\s*\{{|<[^>]+>|_:[^\s{{}}]+|[{{}}]'
_LITERAL = rf"(?s)^[\"'](.*)[\"']({_TAIL})$"
_CODES = r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\U000(?:0(?![dD][89a-fA-F])|10|[1-9a-fA-F])[0-9A-Fa-f]{4}"
OPS = "array<struct<op_seq:int,quad_seq:int,op:string,s:string,p:string,o:string,g:string>>"
_BLOCKS = "array<struct<op:string,op_seq:int,g:string,at:int,upto:int>>"


def _characters(body: Column) -> Column:
    """Character codes (\\u, \\U) as characters; halves of pairs that stand alone stay."""
    code = lambda c: F.decode(F.unhex(F.regexp_replace(c, r"\\u", "")), "UTF-16BE")
    wide = lambda c: F.decode(F.unhex(F.substring(c, 3, 8)), "UTF-32")
    pieces = F.split(F.regexp_replace(body, f"({_CODES})", MARK + "u$1" + MARK + "v"), f"{MARK}[uv]")
    # what the pattern met stands at odd places
    told = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, x).when(x.startswith("\\U"), wide(x)).otherwise(code(x)))
    return F.when(body.contains("\\u") | body.contains("\\U"), F.array_join(told, "")).otherwise(body)


def _term(token: Column) -> Column:
    """N3 text of a marked token: escapes are resolved, and written again as terms.escape writes them."""
    body = _characters(F.regexp_extract(token, _LITERAL, 1))
    for letter, c in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f")):
        body = F.replace(body, F.lit("\\" + letter), F.lit(c))
    text = unmarked(F.replace(body, F.lit("\\"), F.lit("")), "\\", '"', "'")
    literal = F.concat(F.lit('"'), escaped(text), F.lit('"'), unmarked(F.regexp_extract(token, _LITERAL, 2)))
    return F.when(token.rlike("^[\"']"), literal).otherwise(unmarked(token))


def _blocks(tokens: Column) -> Column:
    """The graph blocks of all operations: where their terms begin and end. A block that isn't closed ends with its operation."""
    kind = lambda t: F.when(t.rlike("^[dD]"), "D").when(t.rlike("^[iI]"), "I").when(t.rlike("^[gG]"), "G").when(t.isin("{", "}"), t)
    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(kind(t).alias("kind"), i.alias("at"), t.alias("t"))), lambda x: x["kind"].isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("op"), F.lit(-1).alias("seq"), F.lit(None).cast("string").alias("g"), F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array().cast(_BLOCKS).alias("out"))

    def closed(a: Column, upto: Column) -> Column:
        one = F.struct(a["op"].alias("op"), a["seq"].alias("op_seq"), a["g"].alias("g"), a["at"].alias("at"), upto.cast("int").alias("upto"))
        return F.when(a["g"].isNotNull() & a["op"].isNotNull(), F.concat(a["out"], F.array(one))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        k = x["kind"]
        op, graph = k.isin("D", "I"), k == "G"
        depth = F.when(op, 0).when(graph, 1).when(k == "{", a["depth"] + 1).otherwise(F.greatest(a["depth"] - 1, F.lit(0)))
        ends = op | graph | ((k == "}") & (a["depth"] <= 1))
        name = F.concat(F.lit("<"), F.regexp_extract(x["t"], "<([^>]+)>", 1), F.lit(">"))
        return F.struct(
            F.when(op, k).otherwise(a["op"]).alias("op"), F.when(op, a["seq"] + 1).otherwise(a["seq"]).alias("seq"), F.when(graph, unmarked(name)).when(ends, F.lit(None).cast("string")).otherwise(a["g"]).alias("g"),
            depth.cast("int").alias("depth"), F.when(graph, x["at"] + 1).otherwise(a["at"]).cast("int").alias("at"), F.when(ends, closed(a, x["at"])).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(marks, start, step, lambda a: closed(a, F.size(tokens)))


def with_ops(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the operations of an update text, in textual order: op is D or I, op_seq its number in the text, quad_seq the quad's in its graph block.

    Terms of a graph block count by threes, whatever stands between them (dots, semicolons, nothing); one or two
    terms at a block's end are left out. What isn't a term, such as a quote that isn't closed, is passed over; a block
    that isn't closed ends with its operation. Triples outside GRAPH are passed over. Null and other texts
    have no operations. Tokens are a column of their own, so that a text is read once; only braces and keywords are folded.
    """
    taken = {c.lower() for c in rows.columns}
    t, b = (next(n for n in (x + "_" * k for k in range(len(taken) + 1)) if n not in taken) for x in ("tokens_", "blocks_"))
    rows = rows.withColumn(t, F.regexp_extract_all(marked(F.coalesce(F.col(text), F.lit(""))), F.lit(_TOKEN), F.lit(0)))
    rows = rows.withColumn(b, _blocks(F.col(t)))

    def quads(x: Column) -> Column:
        terms = F.filter(F.slice(F.col(t), x["at"] + 1, x["upto"] - x["at"]), lambda y: ~y.isin("{", "}"))
        # threes are cut from the array as it is walked, each from a slice of three
        n = F.floor(F.size(terms) / 3).cast("int")
        three = lambda i: F.slice(F.col(t), i, F.lit(3))
        plain = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), three(x["at"] + 1 + 3 * i).alias("t")))
        odd = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.slice(terms, 3 * i + 1, F.lit(3)).alias("t")))
        each = F.when(n == 0, F.array().cast("array<struct<i:int,t:array<string>>>")).when(F.size(terms) == x["upto"] - x["at"], plain).otherwise(odd)
        return F.transform(each, lambda q: F.struct(x["op_seq"].alias("op_seq"), q["i"].alias("quad_seq"), x["op"].alias("op"), _term(q["t"][0]).alias("s"), _term(q["t"][1]).alias("p"), _term(q["t"][2]).alias("o"), x["g"].alias("g")))

    return rows.withColumn(name, F.flatten(F.transform(F.col(b), quads)).cast(OPS)).drop(t, b)


def to_ops(snapshots: DataFrame) -> DataFrame:
    """ops (entity, snapshot, generated_at, op_seq, quad_seq, op, s, p, o, g) of snapshots with update_query."""
    rows = with_ops(snapshots.where("update_query is not null").select("entity", "snapshot", "generated_at", "update_query"), "update_query", "x")
    return rows.select("entity", "snapshot", "generated_at", F.explode_outer("x").alias("x")).where("x is not null").select("entity", "snapshot", "generated_at", "x.*")


def insert_text(graph: str, quads: list[tuple]) -> tuple[str, int]:
    """INSERT DATA text of quads in one graph and their number; ("", 0) without quads."""
    lines = sorted({f"{s} {p} {o} ." for s, p, o, *_ in quads})
    return (f"INSERT DATA {{ GRAPH <{graph}> {{ {' '.join(lines)} }} }}", len(lines)) if lines else ("", 0)


def update_texts(ops: DataFrame, *by: str) -> DataFrame:
    """(by..., update_query): deletions, then insertions, quads sorted; a part without quads is left out."""
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    per = ops.groupBy(*by, "g").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("op") == k, line))), " ").alias(k) for k in "DI"])
    block = lambda c, word: F.when(F.col(c) != "", F.concat(F.lit(f"{word} DATA {{ GRAPH "), F.col("g"), F.lit(" { "), F.col(c), F.lit(" } }")))
    per = per.groupBy(*by).agg(F.array_sort(F.collect_list(block("D", "DELETE"))).alias("d"), F.array_sort(F.collect_list(block("I", "INSERT"))).alias("i"))
    return per.select(*by, F.array_join(F.concat("d", "i"), "; ").alias("update_query"))
