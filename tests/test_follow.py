"""Intervals that follow a stream equal one build over everything."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from palimpsest.functions.updates import insert_text, to_ops
from palimpsest.operators import replay
from palimpsest.streaming import follow

T0 = datetime(2021, 1, 1, tzinfo=timezone.utc)
SNAPS = "entity string, snapshot string, generated_at timestamp, invalidated_at timestamp, attributed_to string, primary_source string, description string, update_query string, derived_from array<string>"
QUADS = "entity string, s string, p string, o string, g string"


def text(e, removed, added):
    part = lambda word, quads: insert_text("urn:g", quads)[0].replace("INSERT", word)
    return "; ".join(x for x in (part("DELETE", removed), part("INSERT", added)) if x) or None


def history(seed, odd):
    """Snapshots of six entities, with texts; odd: some texts remove what isn't there or add what is."""
    rng, out = random.Random(seed), []
    for e in range(6):
        state = set()
        for k in range(1, 11):
            all_ = [(f"<urn:e/{e}>", f"<urn:p/{i}>", f'"{j}"') for i in range(2) for j in range(3)]
            gone = {q for q in sorted(state) if rng.random() < 0.4}
            new = {q for q in all_ if q not in state and rng.random() < 0.3}
            state = (state - gone) | new
            if odd and k > 4 and rng.random() < 0.2:
                (gone if rng.random() < 0.5 else new).add(rng.choice(all_))
            out.append((f"<urn:e/{e}>", f"<urn:e/{e}/prov/se/{k}>", T0 + timedelta(days=10 * k + e), None, "<urn:a>", None, "d", text(e, gone - new, new - gone), []))
    return out


def built(spark, rows):
    snaps = spark.createDataFrame(rows, SNAPS)
    ops = to_ops(snaps)
    now = follow._last(ops).where("op = 'I'").select("entity", "s", "p", "o", "g")
    return Counter(map(tuple, replay.validity(ops, now, snaps).collect()))


def empty(spark, path, buckets):
    none = spark.createDataFrame([], SNAPS)
    follow.start(path, spark.createDataFrame([], QUADS), none, to_ops(none), buckets)


def test_batches_equal_one_build(spark, tmp_path):
    for odd in (False, True):
        rows, path = sorted(history(1, odd), key=lambda r: r[2]), str(tmp_path / f"t{odd}")
        empty(spark, path, 4)
        for n in range(5):
            follow.apply(spark.createDataFrame(rows[12 * n : 12 * n + 12], SNAPS), path, n + 1, 4)
        assert Counter(map(tuple, follow.current(spark, path).collect())) == built(spark, rows)


def test_late_snapshot_reopens(spark, tmp_path):
    """A snapshot that comes after later ones changes what was before and after it."""
    rows, path = sorted(history(2, False), key=lambda r: r[2]), str(tmp_path / "t")
    late = ("<urn:e/2>", "<urn:e/2/prov/se/99>", T0 + timedelta(days=45), None, "<urn:a>", None, "d", text(2, [("<urn:e/2>", "<urn:p/0>", '"1"')], [("<urn:e/2>", "<urn:p/9>", '"late"')]), [])
    empty(spark, path, 3)
    follow.apply(spark.createDataFrame(rows, SNAPS), path, 1, 3)
    before = follow._list(spark, path)
    follow.apply(spark.createDataFrame([late], SNAPS), path, 2, 3)
    after = follow._list(spark, path)
    assert sum(after[b] != before[b] for b in after) == 1  # one bucket was written
    follow.apply(spark.createDataFrame([late], SNAPS), path, 2, 3)  # a batch that is run again
    follow.apply(spark.createDataFrame([], SNAPS), path, 3, 3)
    assert Counter(map(tuple, follow.current(spark, path).collect())) == built(spark, [*rows, late])


def test_on_a_dataset_and_as_a_stream(spark, tmp_path):
    """A stream over files on top of a dataset with a history."""
    rows = sorted(history(3, True), key=lambda r: r[2])
    snaps = spark.createDataFrame(rows[:20], SNAPS)
    ops, path = to_ops(snaps), str(tmp_path / "t")
    now = follow._last(ops).where("op = 'I'").select("entity", "s", "p", "o", "g")
    follow.start(path, now, snaps, ops, 4)
    for n in range(2):
        spark.createDataFrame(rows[20 + 20 * n : 40 + 20 * n], SNAPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SNAPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow.follow(stream, path, str(tmp_path / "checkpoint"), 4).awaitTermination(300)
    assert Counter(map(tuple, follow.current(spark, path).collect())) == built(spark, rows)
