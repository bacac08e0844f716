"""N3 terms as text columns: kinds, parts, escapes. Terms compare by their exact text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
PROV = "http://www.w3.org/ns/prov#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_LITERAL = r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$'


#: Characters that a literal's text writes with a backslash, and their letters.
ESCAPES = {"\\": "\\", '"': '"', "\n": "n", "\r": "r"}
_ESCAPED = str.maketrans({c: "\\" + x for c, x in ESCAPES.items()})
_MEANT = {"\\" + x: c for c, x in ESCAPES.items()}
#: The grammar of terms; the group that matches is the kind.
_GRAMMAR = re.compile(r'<(?P<uri>.*)>|_:(?P<bnode>.*)|"(?P<literal>.*)"(?:\^\^<(?P<datatype>[^>]*)>|@(?P<lang>[A-Za-z0-9-]+))?', re.S)


def escape(value: str) -> str:
    """Backslash, quote, newline and carriage return; nothing else."""
    return value.translate(_ESCAPED)


def unescape(value: str) -> str:
    """Reverses escape; other escapes stay as they stand."""
    return re.sub(r"\\.", lambda m: _MEANT.get(m[0], m[0]), value, flags=re.S)


def binding_to_n3(b: dict) -> str:
    """N3 text of a SPARQL-JSON binding."""
    suffix = "@" + b["xml:lang"] if b.get("xml:lang") else "^^<" + b["datatype"] + ">" if b.get("datatype") else ""
    form = {"uri": "<{0}>", "bnode": "_:{0}"}.get(b["type"], '"{1}"{2}')
    return form.format(b["value"], escape(b["value"]), suffix)


def n3_to_binding(term: str | None) -> dict | None:
    """SPARQL-JSON binding of an N3 term; None for an unbound variable. Text of no kind is a literal."""
    if term is None:
        return None
    m = _GRAMMAR.fullmatch(term)
    parts = {k: v for k, v in m.groupdict().items() if v is not None} if m else {"literal": term}
    kind = next(k for k in ("uri", "bnode", "literal") if k in parts)
    extra = {"datatype": parts.get("datatype"), "xml:lang": parts.get("lang")}
    return {"type": kind, "value": unescape(parts[kind]) if kind == "literal" and m else parts[kind]} | {k: v for k, v in extra.items() if v}


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value.cast("string"), F.lit(">"))


def escaped(text: Column) -> Column:
    """escape of a column."""
    for c, x in ESCAPES.items():
        text = F.replace(text, F.lit(c), F.lit("\\" + x))
    return text


#: A character of the private area. Before a digit it stands for a pair of characters, so that patterns need no alternatives of one or two.
MARK = "\ue000"


def marked(text: Column) -> Column:
    """text, in which no backslash or quote is behind a backslash: MARK and 1, 2 or 3 stand for those pairs, and MARK and 0 for MARK itself."""
    for i, pair in enumerate((MARK, "\\\\", '\\"', "\\'")):
        text = F.replace(text, F.lit(pair), F.lit(MARK + str(i)))
    return text


def unmarked(text: Column, *meant: str) -> Column:
    """Reverses marked; meant are put in place of the three pairs, if given."""
    for i, pair in reversed(list(enumerate((MARK, *(meant or ("\\\\", '\\"', "\\'")))))):
        text = F.replace(text, F.lit(MARK + str(i)), F.lit(pair))
    return text


def literal(value: Column, datatype: str | None = None) -> Column:
    """Plain or typed literal of a column, escaped."""
    return F.concat(F.lit('"'), escaped(value.cast("string")), F.lit('"' + (f"^^<{datatype}>" if datatype else "")))


def kind(term: Column) -> Column:
    """uri, bnode, literal; null for null."""
    return F.when(term.startswith("<"), "uri").when(term.startswith("_:"), "bnode").when(term.isNotNull(), "literal")


def value(term: Column) -> Column:
    """The text that a term stands for, without brackets, quotes and escapes; other escapes than those of escape stay as they stand."""
    body = marked(F.regexp_extract(term, _LITERAL, 1))
    for a, b in (("\\n", "\n"), ("\\r", "\r")):
        body = F.replace(body, F.lit(a), F.lit(b))
    body = unmarked(body, "\\", '"', "\\'")
    return F.when(kind(term) == "uri", F.regexp_extract(term, r"^<(.*)>$", 1)).when(kind(term) == "bnode", F.substring(term, 3, 2**31 - 1)).otherwise(body)


def datatype(term: Column) -> Column:
    return F.nullif(F.regexp_extract(term, _LITERAL, 2), F.lit(""))


def lang(term: Column) -> Column:
    return F.nullif(F.regexp_extract(term, _LITERAL, 3), F.lit(""))


def strip_datatype(term: Column) -> Column:
    """Literals without their datatype; language tags stay."""
    return F.regexp_replace(term, r'(?s)^(".*")\^\^<[^>]*>$', "$1")


def normal_constant(term: str) -> str:
    """A query constant as it is matched in searches: the language tag in lower case, all else verbatim."""
    m = re.match(_LITERAL, term)
    return term[: -len(m[3])] + m[3].lower() if m and m[3] else term


def normal_term(term: Column) -> Column:
    """normal_constant of a column."""
    tag = F.regexp_extract(term, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1)
    return F.when(tag == "", term).otherwise(F.concat(F.substring(term, F.lit(1), F.length(term) - F.length(tag)), F.lower(tag)))


def parts(term: Column) -> Column:
    """struct(type, value, datatype, lang) of a term; null for null."""
    return F.when(term.isNotNull(), F.struct(kind(term).alias("type"), value(term).alias("value"), datatype(term).alias("datatype"), lang(term).alias("lang")))
