"""Interval operators against plain loops, on the plain way and on the one for hot keys."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import intervals
from palimpsest.operators.ranks import before
from palimpsest.plans.query import VersionQuery
from palimpsest.scratch import written

T0 = datetime(2021, 1, 1)
END = datetime(9999, 12, 31)


def day(n):
    return END if n is None else T0 + timedelta(days=n)


def frame(spark, rows, name):
    df = spark.createDataFrame([(k, v, day(a), day(b)) for k, v, a, b in rows], f"k string, {name} string, from_ timestamp, to_ timestamp")
    return written(df, "test")


def rows_of(seed, name, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randint(0, 40)
        out.append((rng.choice("xxyz" if name == "a" else "xxyw"), f"{name}{i % 9}", a, rng.choice([None, a + rng.randint(1, 15)])))
    return out


def last(b):
    return 10**6 if b is None else b


def shared(left, right):
    out = Counter()
    for k, v, a, b in left:
        for k2, v2, a2, b2 in right:
            if k == k2 and max(a, a2) < min(last(b), last(b2)):
                out[k, v, v2, max(a, a2), min(last(b), last(b2))] += 1
    return out


def read(df, *names):
    num = lambda t: 10**6 if t.year == 9999 else -(10**6) if t.year == 1 else (t - T0).days
    return Counter((*(r[n] for n in names), num(r.from_), num(r.to_)) for r in df.collect())


@pytest.mark.parametrize("pairs", [10**9, 2, 0])
def test_overlap_join(spark, pairs):
    left, right = rows_of(1, "a"), [*rows_of(2, "b"), ("x", "b0", 3, 9), ("x", "b0", 3, 9)]
    got = intervals.overlap_join(frame(spark, left, "a"), frame(spark, right, "b"), ["k"], pairs)
    assert read(got, "k", "a", "b") == shared(left, right)
    one = lambda rows: [("x", *r[1:]) for r in rows]
    got = intervals.overlap_join(frame(spark, left, "a").drop("k"), frame(spark, right, "b").drop("k"), [], pairs)
    assert read(got.withColumn("k", F.lit("x")), "k", "a", "b") == shared(one(left), one(right))
    assert intervals.overlap_join(frame(spark, [], "a"), frame(spark, right, "b"), ["k"], pairs).collect() == []


def test_hot_key_is_linear(spark):
    """10^5 intervals on each side of one key: 10^10 pairs for a plain join, some 2 * 10^5 that overlap."""
    one = lambda name, shift: written(spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").cast("string").alias(name), F.timestamp_seconds(F.col("id") * 10 + shift).alias("from_"), F.timestamp_seconds(F.col("id") * 10 + shift + 10).alias("to_")), "test")
    began = time.time()
    got = intervals.overlap_join(one("a", 0), one("b", 5), ["k"])
    assert got.count() == 199_999 and time.time() - began < 120


@pytest.mark.parametrize("most", [10**6, 3, 0])
def test_levels_islands_gaps(spark, most):
    rows = rows_of(5, "a", 25)
    df = frame(spark, rows, "a")
    points = [-1, *range(60), 10**5]
    holds = {k: {t: sum(x == k and a <= t < last(b) for x, _, a, b in rows) for t in points} for k in {r[0] for r in rows}}
    at = lambda got, t: [r for r in got for _ in range(got[r]) if r[-2] <= t < r[-1]]
    lv, isl, gap = (read(x, *n) for x, n in ((intervals.levels(df, ["k"], most), ("k", "n")), (intervals.islands(df, ["k"], most), ("k",)), (intervals.gaps(df, ["k"], most), ("k",))))
    for k, each in holds.items():
        for t, n in each.items():
            assert [r[1] for r in at(lv, t) if r[0] == k] == ([n] if n else [])
            assert len([r for r in at(isl, t) if r[0] == k]) == (n > 0) and len([r for r in at(gap, t) if r[0] == k]) == (n == 0)
    for k in holds:  # maximal
        mine = sorted(r[1:] for r in isl if r[0] == k)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))


def test_left_overlap_join(spark):
    left, right = rows_of(7, "a", 25), rows_of(8, "b", 12)
    for pairs in (10**9, 0):
        got = read(intervals.left_overlap_join(frame(spark, left, "a"), frame(spark, right, "b"), ["k"], pairs), "k", "a", "b")
        for t in range(0, 60):
            want = Counter()
            for k, v, a, b in left:
                if a <= t < last(b):
                    found = [v2 for k2, v2, a2, b2 in right if k2 == k and a2 <= t < last(b2)]
                    want.update((k, v, x) for x in found or [None])
            assert Counter({r[:3]: 0 for r in got} | Counter(r[:3] for r in got.elements() if r[3] <= t < r[4])) == Counter({r[:3]: 0 for r in got} | want)


def test_running_sums_of_hot_keys(spark):
    rows = [(("h" if i % 3 else "c"), i, (i * 7) % 5 - 2) for i in range(500)]
    got = before(spark.createDataFrame(rows, "k string, i int, v int").repartition(5), ["k"], ["i"], {"n": F.lit(1), "s": F.col("v")}).collect()
    seen = Counter()
    for r in sorted(got, key=lambda r: r.i):
        assert (r.n, r.s) == (seen[r.k, "n"], seen[r.k, "s"])
        seen[r.k, "n"] += 1
        seen[r.k, "s"] += r.v
    assert len(got) == 500


def test_counts_and_versions_equal_bindings(spark, tmp_path):
    """Sweeps give what grouping the expanded answers gives, with and without optionals and unbound variables."""
    from palimpsest import rdfize

    rng = random.Random(9)
    rows = [(i, rng.randint(1, 6), rng.randint(0, 40), rng.choice(["view", "error", None, "buy"]), rng.choice([None, 1.0, 2.0])) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, t int, event_type string, value double").selectExpr("event_id", "user_id", "timestamp_seconds(t) as ts", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    c = rdfize.event_catalog(spark, str(tmp_path))
    for text, by in (("SELECT ?u ?x WHERE { ?u <urn:p:status> ?x }", ["x"]), ("SELECT ?u ?x ?v WHERE { ?u <urn:p:value> ?v . OPTIONAL { ?u <urn:p:status> ?x } }", ["x"]), ("SELECT ?x WHERE { ?u <urn:p:status> ?x }", []), ('SELECT ?u ?x ?y WHERE { ?u <urn:p:value> ?v . OPTIONAL { ?u <urn:p:status> ?x . ?y <urn:p:status> ?x } }', ["u", "x"])):
        q = VersionQuery(c, text)
        each = q.bindings().collect()
        assert len(each) == len(set(each)) and each
        assert Counter({(r.time, *(r[b] for b in by)): r.n for r in q.counts(*by).collect()}) == Counter((r.time, *(r[b] for b in by)) for r in each)
        assert {tuple(r)[:-1]: r.n for r in q.versions().collect()} == Counter(tuple(r[v] for v in q.query.select) for r in each)
        if by:
            assert {tuple(r)[:-1]: r.n for r in q.versions(*by).collect()} == Counter(x[1:] for x in {(r.time, *(r[b] for b in by)) for r in each})


def test_chain_takes_one_scan_a_pattern(spark, tmp_path, monkeypatch):
    """A chain of k patterns reads the intervals k times, not once for each pattern of each prefix."""
    from palimpsest.plans import query

    spark.createDataFrame([(1, 1, "a", 1.0)], "event_id long, user_id long, event_type string, value double").selectExpr("event_id", "user_id", "timestamp_seconds(1) as ts", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    from palimpsest import rdfize
    from palimpsest.plans import sparql

    c = rdfize.event_catalog(spark, str(tmp_path))
    n = []
    real = query.pattern
    monkeypatch.setattr(query, "pattern", lambda *a, **k: n.append(1) or real(*a, **k))
    query.relevant(c, sparql.parse("SELECT ?c WHERE { <urn:user/1> <urn:p:a> ?b . ?b <urn:p:b> ?c . ?c <urn:p:c> ?d . ?d <urn:p:d> ?e }"))
    assert len(n) == 4
