"""URL filters: fixed host rules first, then association rules mined by Spark's FP-growth.

A labelled page is a transaction of its URL's tokens and, where its label is bad, the token BAD.
FP-growth mines frequent combinations; rules "tokens -> BAD" that pass the bounds of
support, confidence and lift block a URL that has all tokens of one. Matching is an inverted index: a page's
tokens are joined to the rules they occur in, and a rule fires when its tokens are all there.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, written

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 0.005, 8, 0.6, 2.0, 3
BAD = "=bad"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct tokens: labels of the host, their parts, and segments of the path that hold no digit."""
    labels = F.split(host_, r"\.")
    parts = F.transform(F.split(host_, r"[.\-]"), lambda x: F.concat(F.lit("w:"), x))
    segments = F.transform(F.filter(F.split(path_, "/"), lambda x: ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    all_ = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), parts, segments)
    return F.array_distinct(F.filter(all_, lambda x: F.length(x) > 2))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(rule, antecedent, confidence, support) of pruned rules. A page is bad if a label of its id has quality 0 or toxic 1; null labels say nothing. Without labelled pages there are no rules."""
    spark = pages.sparkSession
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    rows = pages.select("page_id", "url")  # other columns may be named like those of labels
    items = rows.join(known, F.col("page_id") == F.col("doc_id")).select(tokens(host(F.col("url")), path(F.col("url"))).alias("t"), "bad").where(F.size("t") > 0)
    items = written(items.select(F.when(F.col("bad"), F.array_append("t", BAD)).otherwise(F.col("t")).alias("items")), "transactions")
    n = items.count()
    out = "rule long, antecedent array<string>, confidence double, support double"
    if not n:
        return spark.createDataFrame([], out)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min(1.0, min_count / n)), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift) & (F.size("antecedent") <= MAX_TOKENS))
    return written(rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), "antecedent", "confidence", "support"), "rules")


def matched(page_tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(k, confidence) of the pages (k, t: tokens) on which a rule fires, with the best confidence."""
    index = rules.select("rule", "confidence", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    return page_tokens.select("k", F.explode("t").alias("token")).distinct().join(index, "token").groupBy("k", "rule", "need", "confidence").agg(F.count("*").alias("has")).where("has = need").groupBy("k").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does. rules is a short parameter list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of each row of pages. Null and odd urls have empty host and path and are allowed; repeated rows are judged each, alike."""
    prepare(pages.sparkSession)
    mined = mine(pages, labels)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("k", F.xxhash64("host", "path"))
    fired = matched(rows.select("k", tokens(F.col("host"), F.col("path")).alias("t")), mined)
    out = rows.join(fired, "k", "left").withColumn("f", fixed_rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("f.rule").alias("rule"), F.coalesce("f.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: DuckDB SQL of op5_url_filters: every combination of up to MAX_TOKENS tokens of a labelled page is counted, which gives the rules that FP-growth finds within the same bounds.
ORACLE_SQL = f"""WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h0 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
h AS (SELECT page_id, translate(raw, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h0),
t AS (SELECT *, list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x), list_transform(string_split_regex(host, '[.-]'), lambda x: 'w:' || x),
 list_transform(list_filter(string_split(path, '/'), lambda x: NOT regexp_matches(x, '[0-9]')), lambda x: 'p:' || x)), lambda x: length(x) > 2)) AS tokens FROM h),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
items AS (SELECT row_number() OVER () AS i, tokens, bad FROM t JOIN known ON page_id = doc_id WHERE len(tokens) > 0),
n AS (SELECT count(*) AS n, sum(bad) AS bad FROM items),
e AS (SELECT i, bad, unnest(tokens) AS x FROM items),
combos AS (SELECT i, bad, [x] AS c FROM e UNION ALL SELECT a.i, a.bad, [a.x, b.x] FROM e a JOIN e b ON a.i = b.i AND a.x < b.x
 UNION ALL SELECT a.i, a.bad, [a.x, b.x, d.x] FROM e a JOIN e b ON a.i = b.i AND a.x < b.x JOIN e d ON a.i = d.i AND b.x < d.x),
rules AS (SELECT c, sum(combos.bad) / count(*) AS confidence FROM combos, n GROUP BY c, n.n, n.bad
 HAVING sum(combos.bad) >= ceil(greatest({MIN_SUPPORT}, least(1.0, {MIN_COUNT} / n.n)) * n.n) AND sum(combos.bad) / count(*) >= {MIN_CONFIDENCE} AND sum(combos.bad) / count(*) / (n.bad / n.n) >= {MIN_LIFT}),
hp AS (SELECT DISTINCT host, path, tokens FROM t),
fired AS (SELECT host, path, max(confidence) AS confidence FROM hp JOIN rules ON list_has_all(tokens, c) GROUP BY host, path),
f AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN (host = '{x}' OR host LIKE '%.{x}') AND path LIKE '{y}%' THEN '{v} {x}{y}'" for v, x, y in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS fits FROM t)
SELECT page_id, host, path, string_split(fits, ' ')[2] AS rule, CASE WHEN fits IS NOT NULL THEN string_split(fits, ' ')[1] WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, confidence FROM f LEFT JOIN fired USING (host, path)"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
