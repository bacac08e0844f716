"""Source divergence audit: how far the terms of each source stand from those of other sources and of its language.

Strings come late. Terms are counted as 64-bit digests, and those in too few documents go, before any text is looked at again.
A dictionary of the kept digests, made in a second pass, has the least and the greatest string of each; where they
differ, several terms share a digest, and these are split: their strings get numbers, and only they are counted anew.
What is ranked is digests; text joins the rows that can still be among the results.

A group is a source in a language. Its sum over all kept terms isn't made term by term for each other
group: terms that only one of two groups has are summed by count, of which there are few; a join on the digest adds what terms of both change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, prepare, table, union_all, written
from .words import UPPER

#: Runs of ASCII letters and of all characters beyond ASCII are terms.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
_KEY = ["l", "d", "sub"]


def digest(term: Column, bits: int = 64) -> Column:
    return F.xxhash64(term) if bits == 64 else F.shiftrightunsigned(F.xxhash64(term), 64 - bits)


def _lowered(term: Column) -> Column:
    """A-Z of a term in lower case. lower() does only that where all characters are ASCII."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, UPPER, UPPER.lower()))


def _split_text() -> Column:
    """Terms as they stand in text."""
    return F.array_remove(F.split("text", NO_TERM), "")


def _bare(documents: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return documents.select(text("lang"), text("source"), text("text"))


def _named(docs: DataFrame) -> DataFrame:
    """(g, l, lang, source): every group with fixed-width names of it and its language, a table. The seed is one with which no two have the same."""
    found = written(docs.select("lang", "source").distinct(), "groups")
    for seed in range(64):
        named = found.select(_group(seed).alias("g"), _lang(seed).alias("l"), "lang", "source")
        n = named.agg(F.countDistinct("g"), F.countDistinct("l"), F.count("*"), F.countDistinct("lang")).first()
        if n[0] == n[2] and n[1] == n[3]:
            out = written(named.withColumn("seed", F.lit(seed)), "groups")
            drop_written(found)
            return out
    raise RuntimeError("no seed tells the groups apart")


def _group(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "source")


def _lang(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang")


def _counts(docs: DataFrame, seed: int, bits: int) -> DataFrame:
    """(g, l, d, n, df): occurrences of each digest in a group, and the rows that hold it. Digests of a row are sorted, so its first ones of a kind count the row."""
    h = docs.select(_group(seed).alias("g"), _lang(seed).alias("l"), F.sort_array(F.transform(_split_text(), lambda w: digest(_lowered(w), bits))).alias("h"))
    each = F.transform("h", lambda x, i: F.struct(x.alias("d"), ((i == 0) | (x != F.get("h", i - 1))).cast("int").alias("new")))
    rows = h.select("g", "l", F.explode_outer(each).alias("x")).where("x is not null").select("g", "l", "x.d", "x.new")
    return rows.groupBy("l", "g", "d").agg(F.count("*").alias("n"), F.sum("new").alias("df"))


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """(l, g, d, sub, n, m, one): rows of the terms in enough documents of their language; m: the language's count; one: 1 in one row of each term, else 0."""
    w = Window.partitionBy(*_KEY)
    rows = counts.withColumns({"all": F.sum("df").over(w), "m": F.sum("n").over(w), "least": F.min("g").over(w)})
    return rows.where(F.col("all") >= least_docs).select("l", "g", "d", "sub", "n", "m", (F.col("g") == F.col("least")).cast("int").alias("one"))


def _terms(docs: DataFrame, bits: int) -> DataFrame:
    """(d, term) of all texts, each once."""
    rows = docs.select(F.explode_outer(F.array_distinct(_split_text())).alias("raw")).where("raw is not null")
    return rows.select(_lowered(F.col("raw")).alias("term")).select(digest(F.col("term"), bits).alias("d"), "term").distinct()


def _split(docs: DataFrame, shared: DataFrame, seed: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of the digests that several terms share: (names (d, sub, term), counts (l, g, d, sub, n, df)). Only rows of these digests carry text; they are joined by digest, of which there are few."""
    names = _terms(docs, bits).join(shared, "d", "left_semi")
    names = written(names.withColumn("sub", F.row_number().over(Window.partitionBy("d").orderBy("term"))), "terms")
    per = docs.select(_group(seed).alias("g"), _lang(seed).alias("l"), F.monotonically_increasing_id().alias("row"), "text")  # rows are numbered before they are taken apart
    per = per.select("g", "l", "row", F.explode_outer(_split_text()).alias("raw")).where("raw is not null").select("g", "l", "row", _lowered(F.col("raw")).alias("term"))
    per = per.withColumn("d", digest(F.col("term"), bits)).join(shared, "d", "left_semi").groupBy("l", "g", "d", "term", "row").agg(F.count("*").alias("n"))
    counts = per.groupBy("l", "g", "d", "term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    return names, counts.join(names, ["d", "term"]).select("l", "g", "d", "sub", "n", "df")


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact at any count."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), whole(n + v))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Frames of one audit: groups (lang, source, ...), pairs() and terms(). The tables behind them stay until drop()."""

    def __init__(self, documents: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64):
        spark = documents.sparkSession
        prepare(spark)
        docs = _bare(documents)
        groups = _named(docs)
        seed = groups.agg(F.coalesce(F.max("seed"), F.lit(0))).first()[0]
        kept = written(_kept(_counts(docs, seed, bits).withColumn("sub", F.lit(0)), least_docs), "kept")
        texts = _terms(docs, bits).join(kept.select("d").distinct(), "d", "left_semi")
        names = written(texts.groupBy("d").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "terms")
        shared = names.where("lo <> hi").select("d")
        names_one = names.where("lo = hi").select("d", F.lit(0).alias("sub"), F.col("lo").alias("term"))
        if shared.isEmpty():
            self.names = names_one
        else:
            more, counts = _split(docs, shared, seed, bits)
            self.names = names_one.unionByName(more)
            kept = written(kept.join(shared, "d", "left_anti").unionByName(_kept(counts, least_docs)), "kept")
        per = kept.groupBy("l", "g").agg(F.sum("n").alias("n"), F.sum("one").alias("v"))
        lang = per.groupBy("l").agg(F.sum("n").alias("ln"), F.sum("v").alias("v"))
        sizes = groups.join(per.select("g", "n"), "g", "left").join(lang, "l", "left").na.fill(0, ["n", "ln", "v"])
        # p0: of a kept term that the group doesn't have
        self.groups = written(sizes.select("g", "l", "lang", "source", "n", "ln", "v", F.when(F.col("v") > 0, _p(F.lit(0), F.col("n"), F.col("v"))).alias("p0")), "groups")
        self.rows = kept.join(self.groups.select("g", F.col("n").alias("gn"), "ln", "v", "p0"), "g").withColumn("p", _p(F.col("n"), F.col("gn"), F.col("v")))
        self.tables = [groups, kept, names, self.groups]

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): value sums f over all kept terms of the language, for each other source of it."""
        big = lambda c: c.cast("decimal(38,0)")
        a = self.groups.select("l", "g", F.col("p0").alias("gp0"))
        b = self.groups.select("l", F.col("g").alias("h"), F.col("p0").alias("hp0"))
        counts = written(self.rows.groupBy("l", "g", "p", "p0").agg(F.count("*").alias("k")), "counts")
        self.tables.append(counts)
        # terms of the first group, as if the second had none of them, and the reverse
        first = counts.join(b, "l").where("g <> h").groupBy("g", "h").agg(F.sum(big(F.col("k")) * (_f(F.col("p"), F.col("hp0")) - _f(F.col("p0"), F.col("hp0")))).alias("x"))
        second = counts.withColumnsRenamed({"g": "h", "p": "q", "p0": "q0"}).join(a, "l").where("g <> h").groupBy("g", "h").agg(F.sum(big(F.col("k")) * (_f(F.col("gp0"), F.col("q")) - _f(F.col("gp0"), F.col("q0")))).alias("x"))
        mine = self.rows.select(*_KEY, "g", "p", "p0")
        both = mine.join(mine.withColumnsRenamed({"g": "h", "p": "q", "p0": "q0"}), _KEY).where("g <> h")
        p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
        both = both.select("g", "h", (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)).alias("x"))
        # halves of 32 bits keep sums in longs
        both = both.groupBy("g", "h").agg(F.sum(F.shiftright("x", 32)).alias("hi"), F.sum(F.col("x").bitwiseAND(0xFFFFFFFF)).alias("lo")).select("g", "h", (big(F.col("hi")) * F.lit(1 << 32) + big(F.col("lo"))).alias("x"))
        more = union_all([x.select("g", "h", big(F.col("x")).alias("x")) for x in (first, second, both)]).groupBy("g", "h").agg(F.sum("x").alias("x"))
        left = self.groups.select("l", "g", "lang", "source", "v", "p0")
        right = self.groups.select("l", F.col("g").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q0"))
        value = F.when(F.col("v") > 0, big(F.col("v")) * big(_f(p0, q0)) + F.coalesce("x", F.lit(0))).otherwise(0)
        return left.join(right, "l").where("g <> h").join(more, ["g", "h"], "left").select("lang", "source", "item", value.cast("long").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): of each group the first terms that are more frequent in it than in its language. Rows beyond the last value that can count leave before text joins."""
        q = _p(F.col("m"), F.col("ln"), F.col("v"))
        rows = self.rows.withColumn("q", q).where("p > q").select("g", "d", "sub", _f(F.col("p"), F.col("q")).alias("value"))
        near = rows.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
        named = near.join(self.names.withColumnRenamed("term", "item"), ["d", "sub"]).join(self.groups.select("g", "lang", "source"), "g")
        return _ranked(named.select("lang", "source", "item", "value")).where(F.col("rank") <= top)

    def drop(self) -> None:
        for t in self.tables:
            drop_written(t)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source).

    Part "pair": every other source of the language, all ranks; 0 where the language keeps no term. Part "term": the first
    terms. Null text, lang and source are empty; empty texts and repeated rows count as documents; ties rank by item;
    an empty table gives no rows; other columns, whatever their names, aren't read. bits: width of digests, smaller only to test
    how shared ones are split.
    """
    audit = Audit(documents, least_docs, bits)
    pairs = _ranked(audit.pairs()).withColumn("part", F.lit("pair"))
    terms = audit.terms(top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same term by term: every group meets every kept term of its language.
ORACLE_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) AS v, sum(m) AS ln FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n) AS gn FROM c GROUP BY 1, 2),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(gn.gn, 0) + size.v)::HUGEINT AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (k.m + 1) // (size.ln + size.v)::HUGEINT AS BIGINT) AS q
 FROM g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
 UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""
