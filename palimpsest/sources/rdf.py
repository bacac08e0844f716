"""N-Triples, N-Quads and JSON-LD to terms; N-Quads with provenance to quads and snapshots."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import PROV, RDF_TYPE, XSD, escape, kind, marked, unmarked, value
from ..functions.times import parse
from ..operators.convert import IRIS

#: Of marked text (see terms.marked).
_TERM = r'(<[^>]*>|_:\S+|"[^"]*+"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>|_:\S+)?\s*\.?\s*$"
_SLOW = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^\S+|@\S+)?|<[^>]*>|[^\s]+', re.S)
_RDF = RDF_TYPE[1:-5]


def parse_line(line: str, object_normalizer: Callable[[str], str] | None = None) -> tuple[str, str, str] | None:
    """(s, p, o) of an N-Triples line, also of such with odd datatypes, tabs or no dot at the end; None for comments, blanks and fewer than three terms."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    parts = _SLOW.findall(line)
    if parts and parts[-1] == ".":
        parts.pop()
    elif parts and not parts[-1].startswith(("<", '"')) and parts[-1].endswith("."):
        parts[-1] = parts[-1][:-1]
    if len(parts) < 3:
        return None
    return parts[0], parts[1], object_normalizer(parts[2]) if object_normalizer else parts[2]


def read_lines(spark: SparkSession, paths: str | list[str], object_normalizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(s, p, o, g) of N-Triples or N-Quads files, gzip by suffix. Regular lines stay in the JVM; only others go through Python. g is null for triples."""
    text = spark.read.text(paths).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    text = text.withColumn("marked", marked(F.col("value")))
    fast = F.regexp_extract("marked", LINE, 1) != ""
    cols = [F.nullif(unmarked(F.regexp_extract("marked", LINE, i)), F.lit("")).alias(n) for i, n in enumerate("spog", 1)]

    @F.pandas_udf("struct<s:string,p:string,o:string,g:string>")
    def slow(lines):
        import pandas as pd

        return pd.DataFrame([(*(parse_line(x) or (None, None, None)), None) for x in lines], columns=list("spog"))

    rest = text.where(~fast).select(slow("value").alias("x")).select("x.*").where("s is not null")
    out = text.where(fast).select(*cols).unionByName(rest)
    return out.withColumn("o", object_normalizer(F.col("o"))) if object_normalizer else out


def read_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(version, entity, s, p, o) of one file a version, in the order of paths."""
    out = None
    for i, p in enumerate(paths):
        rows = read_lines(spark, p).select(F.lit(i).alias("version"), F.col("s").alias("entity"), "s", "p", "o").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


#: Keywords of JSON-LD that change what is meant and aren't read.
UNREAD = ("@included", "@nest", "@import", "@propagate", "@direction")


class _JsonLd:
    """Quads of one JSON-LD document; anonymous nodes are numbered in the order in which they are met."""

    def __init__(self, label: str):
        self.label, self.count, self.out = label, 0, []

    def new(self) -> str:
        self.count += 1
        return f"_:{self.label}{self.count - 1}"

    def context(self, ctx: dict, more) -> dict:
        for m in _list(more):
            if isinstance(m, str):
                raise ValueError("Remote JSON-LD contexts are not read: " + m)
            ctx = {} if m is None else {**ctx, **m}
            if found := [k for k in UNREAD if k in (m or {})]:
                raise ValueError(f"{found[0]} in a JSON-LD context is not read")
        return ctx

    def keyword(self, k: str, ctx: dict) -> str:
        return ctx[k] if isinstance(ctx.get(k), str) and ctx[k].startswith("@") else k

    def name(self, x: str, ctx: dict, vocab: bool = False) -> str:
        """The term that a text names; vocab: by the context's terms, as predicates and types are."""
        if x.startswith("_:"):
            return x
        t = ctx.get(x) if vocab else None
        if t is not None:
            t = t.get("@id", t.get("@reverse", x)) if isinstance(t, dict) else t
            if t != x:
                return self.name(t, {k: v for k, v in ctx.items() if k != x}, True)
        p, colon, local = x.partition(":")
        if colon and not local.startswith("//") and p in ctx:
            base = ctx[p]["@id"] if isinstance(ctx[p], dict) else ctx[p]
            return self.name(base + local, {k: v for k, v in ctx.items() if k != p})
        if vocab and not colon and ctx.get("@vocab") is not None:
            return f"<{ctx['@vocab']}{x}>"
        return f"<{urljoin(ctx['@base'], x) if not vocab and not colon and ctx.get('@base') else x}>"

    def node(self, n: dict, ctx: dict, g: str | None) -> str:
        if "@context" in n:
            ctx = self.context(ctx, n["@context"])
        keys = {self.keyword(k, ctx): v for k, v in n.items() if self.keyword(k, ctx).startswith("@")}
        if found := [k for k in UNREAD if k in keys]:
            raise ValueError(f"{found[0]} is not read in JSON-LD")
        s = self.name(keys["@id"], ctx) if "@id" in keys else None
        if "@graph" in keys:
            rest = [k for k in n if self.keyword(k, ctx) not in ("@graph", "@context")]
            s = s or (self.new() if rest else None)
            for m in _list(keys["@graph"]):
                self.node(m, ctx, s or g)
        elif s is None:
            s = self.new()
        for t in _list(keys.get("@type", [])):
            self.out.append((s, RDF_TYPE, self.name(t, ctx, True), g))
        for p, vs in (keys.get("@reverse") or {}).items():
            self.reverse(s, self.name(p, ctx, True), vs, ctx, g)
        for k, vs in n.items():
            how = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if k in ctx and ctx[k] is None or how.get("@id", "") is None or self.keyword(k, ctx).startswith("@"):
                continue
            if "@reverse" in how:
                self.reverse(s, self.name(how["@reverse"], ctx, True), vs, ctx, g)
                continue
            p = self.name(k, ctx, True)
            if ":" not in p:
                continue  # a key that the context doesn't map to an IRI says nothing
            for o in self.values(vs, ctx, how, g):
                self.out.append((s, p, o, g))
        return s

    def reverse(self, o: str, p: str, vs, ctx: dict, g: str | None) -> None:
        for v in _list(vs):
            self.out.append((self.node(v, ctx, g) if isinstance(v, dict) else self.name(v, ctx), p, o, g))

    def values(self, vs, ctx: dict, how: dict, g: str | None) -> list[str]:
        """Objects that a key's value stands for."""
        at = _list(how.get("@container", []))
        if found := [k for k in at if k in ("@id", "@type", "@graph")]:
            raise ValueError(f"Containers by {found[0]} are not read in JSON-LD")
        if isinstance(vs, dict) and "@language" in at:
            return [f'"{escape(v)}"' + ("" if k == "@none" else f"@{k}") for k, x in vs.items() for v in _list(x) if v is not None]
        if isinstance(vs, dict) and "@index" in at:
            vs = [v for x in vs.values() for v in _list(x)]
        if "@list" in at and not (isinstance(vs, dict) and "@list" in vs):
            vs = {"@list": vs}
        out = []
        for v in _list(vs):
            if isinstance(v, list):
                out += self.values(v, ctx, {k: x for k, x in how.items() if k != "@container"}, g)
            elif isinstance(v, dict) and (k := next((k for k in v if self.keyword(k, ctx) in ("@set", "@list")), None)):
                inner = self.values(v[k], ctx, {k: x for k, x in how.items() if k != "@container"}, g)
                out += inner if self.keyword(k, ctx) == "@set" else [self.chain(inner, g)]
            elif (o := self.value(v, ctx, how, g)) is not None:
                out.append(o)
        return out

    def chain(self, items: list[str], g: str | None) -> str:
        """Head of an RDF list."""
        nodes = [self.new() for _ in items]
        for x, n, after in zip(items, nodes, [*nodes[1:], f"<{_RDF}nil>"]):
            self.out += [(n, f"<{_RDF}first>", x, g), (n, f"<{_RDF}rest>", after, g)]
        return nodes[0] if nodes else f"<{_RDF}nil>"

    def value(self, v, ctx: dict, how: dict, g: str | None) -> str | None:
        if v is None:
            return None
        if isinstance(v, dict):
            keys = {self.keyword(k, ctx): x for k, x in v.items()}
            if "@value" not in keys:
                return self.node(v, ctx, g)
            how, lang, v = {"@type": keys.get("@type")}, keys.get("@language"), keys["@value"]
            if v is None:
                return None
        else:
            lang = how.get("@language", ctx.get("@language")) if isinstance(v, str) and "@type" not in how else None
        kind = how.get("@type")
        if kind == "@json":
            raise ValueError("JSON literals are not read in JSON-LD")
        if isinstance(v, bool) or isinstance(v, (int, float)):
            plain = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double"
            text = str(v).lower() if isinstance(v, bool) else str(v)
            return f'"{text}"^^' + (self.name(kind, ctx, True) if kind and kind[0] != "@" else f"<{XSD}{plain}>")
        if kind in ("@id", "@vocab"):
            return self.name(v, ctx, kind == "@vocab")
        return f'"{escape(v)}"' + (f"@{lang}" if lang else f"^^{self.name(kind, ctx, True)}" if kind and kind != "@none" else "")


def expand_jsonld(doc: dict | list, label: str = "b") -> list[tuple[str, str, str, str | None]]:
    """Quads (s, p, o, g) of JSON-LD: prefixes, aliases, @base, @vocab, @language, @type, @graph, @reverse, @set, @list, and containers by list, set, language and index.

    Nodes without @id are _:label0, _:label1 and so on. Remote contexts, @included, @nest, JSON literals and
    other containers are refused; null values and keys that aren't mapped to an IRI say nothing.
    """
    reader = _JsonLd(label)
    for n in _list(doc):
        reader.node(n, {}, None)
    return reader.out


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def read_jsonld(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(s, p, o, g) of JSON-LD files; of a .zip the first member is read. Anonymous nodes of different files are different. One file is one row, so files bound the memory of a task."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for path, data in zip(f.path, f.content):
                if path.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(z.namelist()[0])
                rows += expand_jsonld(json.loads(data), f"f{hashlib.sha256(path.encode()).hexdigest()[:16]}b")
            yield pd.DataFrame(rows, columns=list("spog"))

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "s string, p string, o string, g string")


def split_provenance(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quads, snapshots) of one set of rows s, p, o, g in which provenance stands in graphs <entity>/prov/.

    A snapshot with several times gets its earliest one with all update texts; every later one is a version without changes.
    """
    prov = F.coalesce(F.col("g").contains("/prov/"), F.lit(False)) | F.col("p").isin([f"<{x}>" for x in IRIS.values() if PROV in x])
    data = rows.where(~prov).distinct()
    of = {f"<{v}>": k for k, v in IRIS.items()}
    name = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    text = F.when(kind(F.col("o")) == "literal", value(F.col("o"))).otherwise(F.col("o"))
    facts = rows.where(prov).select(F.col("s").alias("snapshot"), name[F.col("p")].alias("k"), text.alias("v")).where("k is not null").distinct()
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("v"))))
    each = facts.groupBy("snapshot").agg(*[pick(k).alias(k) for k in IRIS])
    times = F.array_sort(F.transform("generated_at", lambda t: parse(t)))
    each = each.withColumn("t", times).where("size(t) > 0 and size(entity) > 0")
    one = lambda k: F.get(k, F.lit(0)).alias(k)
    flat = each.select(one("entity"), "snapshot", F.posexplode("t").alias("i", "generated_at"), parse(F.get("invalidated_at", F.lit(0))).alias("invalidated_at"), one("attributed_to"), one("primary_source"), one("description"), F.array_join("update_query", "; ").alias("update_query"), "derived_from")
    first = F.col("i") == 0
    snaps = flat.withColumn("update_query", F.when(first & (F.col("update_query") != ""), F.col("update_query"))).withColumn("derived_from", F.when(first, F.col("derived_from")).otherwise(F.array().cast("array<string>"))).drop("i")
    return data.select(F.col("s").alias("entity"), "s", "p", "o", "g"), snaps


def write_lines(lines: DataFrame, path: str, compress: bool = False) -> None:
    """Lines as text files, gzip if asked."""
    lines.write.option("compression", "gzip" if compress else "none").text(path)


def quad_set(bindings: DataFrame) -> DataFrame:
    """Rows without unbound variables, each once."""
    return bindings.na.drop("any").dropDuplicates()


def ask(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def version_lines(states: DataFrame, *by: str) -> DataFrame:
    """(by..., lines): sorted "s p o" lines of each state, datatypes left out."""
    from ..functions.terms import strip_datatype

    return states.groupBy(*by).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "s", "p", strip_datatype(F.col("o"))))).alias("lines"))


def version_rows(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., s, p, o): what version_lines made, as terms again; the first three terms of each line. Lines with fewer are left out, repeated ones come once."""
    terms = F.transform(F.regexp_extract_all(marked(F.col("line")), F.lit(_TERM), F.lit(1)), lambda t: unmarked(t))
    rows = lines.select(*by, F.explode("lines").alias("line")).select(*by, terms.alias("t")).where(F.size("t") >= 3)
    return rows.select(*by, *[F.col("t")[i].alias(c) for i, c in enumerate("spo")]).distinct()
