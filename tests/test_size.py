"""How work is dealt: rows a task, what is shuffled and what is read once."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest import rdfize
from palimpsest.operators import replay
from palimpsest.operators.ranks import at_times, repeated
from palimpsest.plans.query import VersionQuery
from palimpsest.scratch import written

T0 = datetime(2021, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def small_tables(spark, folder, users=4, events=9):
    rows = [(i, T0 + timedelta(hours=i), i % users, ["purchase", "view", None][i % 3], float(i % 5)) for i in range(events * users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(i, f"c{i}", i % 2, 1.0, "s") for i in range(10)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    small_tables(spark, tmp_path)
    c = rdfize.table(spark, str(tmp_path), "customer")
    got = rdfize.dealt(c, 3)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, c.collect()))
    assert "RoundRobinPartitioning(4)" in plan_of(got) and "RoundRobin" not in plan_of(rdfize.dealt(c, 10))


def test_validity_shuffles_operations_once(spark, tmp_path):
    small_tables(spark, tmp_path)
    c = rdfize.event_catalog(spark, str(tmp_path))
    plan = plan_of(replay.validity(c.ops, c.quads, c.snapshots, tasks=7))
    assert plan.count("Exchange hashpartitioning(") == 2 and ", 7), REPARTITION_BY_NUM" in plan  # by entity, and the snapshots' for their first times
    assert len([x for x in plan.split("\n") if x.strip(" +-:*()0123456789").startswith("Sort [")]) == 1


def test_states_have_one_row_an_event(spark, tmp_path):
    small_tables(spark, tmp_path)
    rows = rdfize.event_states(spark, str(tmp_path))
    assert rows.count() == 36 and not [c for c, kind in rows.dtypes if kind == "string" and c not in ("event_type", "prev_type")]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_times_stand_together_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, i, *sorted(rng.sample(range(100), 2))) for i in range(40) for k in "ab"]
    times = [(k, t) for k in "ab" for t in rng.sample(range(100), 50)]
    at = lambda n: T0 + timedelta(hours=n)
    r = written(spark.createDataFrame([(k, i, at(a), at(b)) for k, i, a, b in rows], "k string, i int, from_ timestamp, to_ timestamp"), "test")
    t = spark.createDataFrame([(k, at(n)) for k, n in times], "k string, time timestamp")
    want = lambda same: Counter((k, i, at(n)) for k, i, a, b in rows for q, n in (times if same else {("", n) for _, n in times}) if a <= n < b and (q == k or not same))
    assert Counter((x.k, x.i, x.time) for x in at_times(r, t, ["k"], block).collect()) == want(True)
    assert Counter((x.k, x.i, x.time) for x in at_times(r, t.select("time").distinct(), None, block).collect()) == want(False)


def test_typed_terms_are_read_before_they_are_repeated(spark, tmp_path):
    small_tables(spark, tmp_path)
    q = VersionQuery(rdfize.event_catalog(spark, str(tmp_path)), 'SELECT ?u ?v WHERE { ?u <urn:p:status> "purchase" . ?u <urn:p:value> ?v }')
    rows = q.typed_bindings()
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(i for i, x in enumerate(plan) if "regexp_extract" in x) > min(i for i, x in enumerate(plan) if "Generate explode(slice" in x)
    assert Counter((x.time, x.u.value, x.v.value) for x in rows.collect()) == Counter((x.time, x.u[1:-1], x.v.split('"')[1]) for x in q.bindings().select("time", "u", F.col("v")).collect())


def test_repeated_rows_are_dealt_by_rows_that_come_out(spark):
    """One row that becomes 1,000 is made by many tasks, not by one."""
    n = {"a": 1000, "b": 1, "c": 0, "d": None, "e": -3, "f": 40, "g": 41, None: 2}
    rows = written(spark.createDataFrame(list(n.items()), "k string, n long").coalesce(1), "test")
    got = repeated(rows, "n", made=100, together=20)
    assert got.columns == ["k"] and Counter(r.k for r in got.collect()) == {k: x for k, x in n.items() if x and x > 0}
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 11 and max(per_task) <= 140
    assert repeated(rows.limit(0), "n").collect() == [] == repeated(rows.where("n <= 0"), "n").collect()


def test_typed_terms_of_all_versions_are_not_made_by_one_task(spark, tmp_path, monkeypatch):
    from palimpsest import catalogue

    small_tables(spark, tmp_path, users=40)
    monkeypatch.setattr(catalogue, "repeated", lambda rows, n: repeated(rows, n, made=20, together=5), raising=False)
    got = catalogue.vm_typed_terms(spark, str(tmp_path))
    q = VersionQuery(catalogue._cat(spark, str(tmp_path)), catalogue.STAR, (catalogue._bounds(spark, str(tmp_path))[1],) * 2)
    want = Counter(("uri", r.u[1:-1], "literal", int(r.v.split('"')[1]), r.v.split("<")[1][:-1], None) for r in q.bindings().collect())
    assert Counter(map(tuple, got.collect())) == want
    assert len(want) > 10 and got.rdd.getNumPartitions() == -(-sum(want.values()) // 20) > 5
    assert "explode(slice" not in plan_of(got)  # times are counted, not brought to answers


def test_language_model_learns_from_no_sample(spark, monkeypatch):
    from palimpsest.llm import mixing

    def limit(df, n):
        assert n == 1, "training took only some rows"  # as first() does
        return every(df, n)

    docs = spark.createDataFrame([(i, f"a word and number {i % 3}") for i in range(40)], "doc_id long, text string")
    every = type(docs).limit
    monkeypatch.setattr(type(docs), "limit", limit)
    model = mixing.train(docs, 10, 64)
    assert model.n == 40 * 6 and (model.broadcast.value["weights"] == mixing.start_weights()).all()


def test_index_is_made_in_small_pieces(spark, tmp_path, monkeypatch):
    from palimpsest.operators import term_index

    small_tables(spark, tmp_path)
    c = rdfize.event_catalog(spark, str(tmp_path))
    c.tasks, name, made = 7, "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    before = spark.conf.get(name)
    monkeypatch.setattr(term_index, "written", lambda df, *a, **b: made.append((spark.conf.get(name), plan_of(df))) or written(df, *a, **b))
    index = c.with_index().index
    assert [size for size, _ in made] == ["12m", "12m"] and spark.conf.get(name) == before
    assert made[0][1].count("Exchange hashpartitioning(") == 2 and ", 7), REPARTITION_BY_NUM" in made[0][1]  # quads, and the rebalance
    want = Counter((t, r.entity, r.s, r.p, r.o, r.g) for r in set(c.ops.select("entity", "s", "p", "o", "g").collect()) for t in {r.s, r.p, r.o, r.g})
    assert Counter((r.term, r.entity, r.s, r.p, r.o, r.g) for r in index.rows.collect()) == want


def test_learned_texts_stand_in_few_files(spark, monkeypatch):
    from palimpsest.llm import toxicity

    made = []
    monkeypatch.setattr(toxicity, "written", lambda df, tag: made.append((tag, written(df, tag))) or made[-1][1])
    docs = spark.createDataFrame([(i, f"word{i % 7} and {'bad' if i % 2 else 'good'}") for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as toxic")
    name, merge = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "50")
        spark.conf.set(merge, "false")
        toxicity.train(docs, labels)
    finally:
        spark.conf.set(name, before)
        spark.conf.unset(merge)
    assert made[0][0] == "bags" and len(made[0][1].inputFiles()) <= toxicity.BAGS
    assert made[0][1].count() == labels.where(~toxicity.held_out(F.col("doc_id"))).count()


@pytest.mark.parametrize("near", [1, 5, 1 << 14])
def test_symbols_looked_up_apart_give_equal_bits(monkeypatch, near):
    import numpy as np

    from palimpsest.llm import mixing

    rng = random.Random(near)
    texts = [b"", *(" ".join(rng.choice(["a", "bb", "ccc", f"x{rng.random()}"]) for _ in range(rng.randrange(1, 400))).encode() for _ in range(9))]
    coder = mixing.Coder([b"", b"a", b"bb"], np.array([10, 300, 200]), 90, [3] * 257)
    size = 10
    table = np.zeros((mixing.HASHED, 2 << size), np.int32)
    monkeypatch.setattr(mixing, "NEAR", near)
    mixing.add_counts(coder, table, texts, size)
    symbols, context, *_ = coder.symbols(texts)
    length, at = coder.expand(symbols)
    want = np.zeros_like(table)
    for k in range(mixing.HASHED):
        for c, node, bit in zip(np.repeat(context[k], length).tolist(), coder.nodes[at].tolist(), coder.bits[at].tolist()):
            want[k, 2 * (((c ^ node) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - size)) + bit] += 1
    assert (table == want).all() and table.sum() == mixing.HASHED * length.sum()
    tables = [mixing.odds(t) for t in table]
    alone = [mixing.code_nats(coder, tables, mixing.start_weights(), [t], size)[0][0] for t in texts]
    assert np.allclose(mixing.code_nats(coder, tables, mixing.start_weights(), texts, size)[0], alone)


def test_bits_of_repeated_pairs_are_looked_up_once(monkeypatch):
    """A context and symbol that come a thousand times cost as many looks as one that comes once."""
    import numpy as np

    from palimpsest.llm import mixing

    coder = mixing.Coder([b"", b"a", b"bb"], np.array([10, 300, 200]), 90, [3] * 257)
    looks, expand = [], coder.expand
    monkeypatch.setattr(coder, "expand", lambda symbols: looks.append(len(symbols)) or expand(symbols))
    table = np.zeros((mixing.HASHED, 2 << 10), np.int32)
    mixing.add_counts(coder, table, [b"a bb zz"] * 1000, 10)
    assert sum(looks) == mixing.HASHED * len(coder.symbols([b"a bb zz"])[0])
    once = np.zeros_like(table)
    mixing.add_counts(coder, once, [b"a bb zz"], 10)
    assert (table == 1000 * once).all()


def test_words_split_in_arrow_equal_plain_ones():
    from palimpsest.llm import mixing

    texts = [b"", b" ", b"  A  b\n", b"a\x0bB\x0cc\x1cd \r\n", "É ÀB　c d".encode(), b"x", b"\t\t"]
    for some in (texts, texts[2:], [b""], []):
        flat, n = mixing.split_words(mixing.as_strings(some))
        assert [w.encode() for w in flat.to_pylist()] == [w for t in some for w in t.lower().split()] and n.tolist() == [len(t.split()) for t in some]


def test_a_unit_is_looked_up_once_for_all_texts_of_a_go(monkeypatch):
    """Texts of many equal words cost as many looks in the table as they have different words, and their ids are the library's."""
    import numpy as np
    import public_tokenizers

    from palimpsest.llm import token_counts, token_files, units

    path = public_tokenizers.path("byte_bpe_50k.json")
    looks, plain = [], units.UnitCache.outcomes
    monkeypatch.setattr(units.UnitCache, "outcomes", lambda self, lists: looks.append(sum(map(len, lists))) or plain(self, lists))
    texts = ["one two, three " * 500 + "end", "", "two", " two", "two  one ", "a\0 b\0 two", "é　x one", "\n", "one\n two", "one two,"]
    end = b"\x02\x00"
    got = token_files.encode_ids(path, texts, 2, end)
    assert got == [np.array(x, "<u2").tobytes() + end for x in token_counts.library(path)(texts)]
    assert sum(looks) < 50 and token_files.encode_ids(path, [], 2, end) == [] and token_files.encode_ids(path, [""], 4, b"") == [b""]
    assert token_files.encode_ids(path, ["one two"], 4, b"") == [np.array(token_counts.library(path)(["one two"])[0], "<u4").tobytes()]


def test_shards_are_found_by_one_pass_over_texts(spark, monkeypatch):
    from palimpsest.llm import common, token_files

    rows = common.text_rows(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text")), F.lit(1).cast("long").alias("tie"))
    for sample in (100_000, 1000):
        monkeypatch.setattr(token_files, "SAMPLE", sample)
        agg = type(rows).agg
        monkeypatch.setattr(type(rows), "agg", lambda *a: pytest.fail("texts are summed up by a pass of their own"))
        bounds = token_files.ranges(rows, 40_000)
        monkeypatch.setattr(type(rows), "agg", agg)
        ends = [b[1] for b in bounds]
        assert len(bounds) in (7, 8, 9) and all(a < b for a, b in zip(ends, ends[1:])) and max(b - a for a, b in zip([0, *ends], [*ends, 3000])) < 600
    assert token_files.ranges(rows, 1 << 20) == [] == token_files.ranges(rows.limit(0), 10)
